"""spark-submit jobs/ingest.py PAGES LOG: land new request pages in the log, one batch at a time, and print what the runs hold."""

import sys

from pyspark.sql import functions as F

from tidegauge.operators.changelog import merge_counts
from tidegauge.operators.normalize import normalize_requests
from tidegauge.session import session, ship
from tidegauge.sources.files import stream_request_pages
from tidegauge.streaming.jobs import merged_views, stream_ingest_merge


def main(pages: str, log: str) -> None:
    """PAGES holds folders run_id=N of JSON-lines files. Run again at any time: files that were taken are not taken twice."""
    spark = ship(session("ingest"))
    stream = stream_request_pages(spark, f"{pages}/run_id=*").withColumn("run_id", F.regexp_extract("file", r"run_id=(\d+)", 1).cast("long"))
    stream_ingest_merge(stream, log, f"{log}/_state", lambda rows: normalize_requests(rows, "run_id", "ordinal")).awaitTermination()
    views = merged_views(spark, log)
    merge_counts(views["observations"]).orderBy("run_id").show(1000)


if __name__ == "__main__":
    main(*sys.argv[1:3])
