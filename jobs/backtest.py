"""spark-submit jobs/backtest.py SERIES OUT FIRST LAST: check a daily series, backtest both baselines, write the report tables."""

import sys
from datetime import date

from tidegauge.operators import backtest as bt
from tidegauge.operators.changelog import require_empty
from tidegauge.session import session, ship
from tidegauge.sources.files import write_report_tables
from tidegauge.sources.shared import stored


def main(series: str, out: str, first: str, last: str) -> None:
    spark = ship(session("backtest"))
    s = spark.read.parquet(series)
    require_empty(bt.series_violations(s), "the series breaks a rule")
    ends = date.fromisoformat(first), date.fromisoformat(last)
    p = stored(bt.rolling_backtest(s, *ends), "predictions")
    write_report_tables({"predictions": p, "skipped": bt.backtest_skips(s, *ends), "metrics": bt.summarize_all_levels(p)}, out)


if __name__ == "__main__":
    main(*sys.argv[1:5])
