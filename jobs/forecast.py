"""spark-submit jobs/forecast.py SERIES OUT ORIGIN: choose a challenger on four weeks, evaluate it on the four after, refit, publish a week's forecast."""

import sys
from datetime import date, timedelta

from tidegauge.operators import features as ft
from tidegauge.operators import modeling as md
from tidegauge.operators.experiment import Experiment, release
from tidegauge.session import session, ship
from tidegauge.sources.shared import stored

# The three challengers that are tried.
CANDIDATES = (
    md.Candidate("shallow_60", "gbt", {"maxIter": 60, "maxDepth": 3, "minInstancesPerNode": 30}),
    md.Candidate("shallow_120", "gbt", {"maxIter": 120, "maxDepth": 3, "minInstancesPerNode": 30}),
    md.Candidate("regularized_120", "gbt", {"maxIter": 120, "maxDepth": 4, "minInstancesPerNode": 50}),
)


def main(series: str, out: str, origin: str, candidates: tuple[md.Candidate, ...] = CANDIDATES) -> Experiment:
    """Validation and evaluation are the eight weekly origins whose targets are known at ORIGIN, the earlier four and the later four."""
    spark = ship(session("forecast", spark__scheduler__mode="FAIR"))
    at = date.fromisoformat(origin)
    s = spark.read.parquet(series)
    first = s.agg({"demand_date": "min"}).first()[0] + timedelta(days=27)
    x = stored(ft.build_examples(s, first, at, 1, require_targets=False), "examples")
    origins = [at - timedelta(days=7 * k) for k in range(8, 0, -1)]
    return release(s, x, out, at, origins[:4], origins[4:], candidates)


if __name__ == "__main__":
    main(*sys.argv[1:4])
