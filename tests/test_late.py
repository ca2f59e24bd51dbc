"""Rows that come after their day has closed."""

import shutil
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from compare import DATA, rows, sql_rows
from tidegauge.plans.registry import ORACLES, QUERIES
from tidegauge.streaming import late

SCHEMA = "at timestamp, kind string"
START = datetime(2024, 1, 1, 12)


def land(spark, tmp_path, hours):
    spark.createDataFrame([(START + timedelta(days=d) if d is not None else None, k) for d, k in hours], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log"))
    late.stream_counted_days(stream, str(tmp_path / "out"), str(tmp_path / "check"), "at", "kind").awaitTermination()


def test_rows_forty_days_late(spark, tmp_path):
    land(spark, tmp_path, [(i, "a") for i in range(60)] + [(None, "a"), (3, None)])
    land(spark, tmp_path, [(60, "a"), (20, "a"), (20, "b"), (29, "a"), (28, "a")])  # day 59 came before: days before 29 are closed
    land(spark, tmp_path, [(200, "c"), (30, "a")])
    land(spark, tmp_path, [(160, "late"), (201, "a")])
    out, log = str(tmp_path / "out"), spark.read.schema(SCHEMA).parquet(str(tmp_path / "log"))
    assert sorted(r[0] for r in late.days_to_rebuild(spark, out).collect()) == [date(2024, 1, 1) + timedelta(i) for i in (20, 28, 160)]
    plain = log.filter("at is not null").groupBy(F.to_date("at").alias("demand_date"), F.col("kind").alias("category")).agg(F.count("*").alias("request_count"))
    got = late.rebuilt_counts(spark, out, log, "at", "kind")
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    assert not late.counts_in_time(spark, out).filter("category = 'late'").count()
    # the last batch again: its folders are written anew
    shutil.rmtree(tmp_path / "check" / "commits")
    before = sorted(got.collect(), key=str)
    late.stream_counted_days(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")), out, str(tmp_path / "check"), "at", "kind").awaitTermination()
    assert sorted(late.rebuilt_counts(spark, out, log, "at", "kind").collect(), key=str) == before


def test_query(spark):
    assert rows(QUERIES["stream_late_days"](spark, DATA)) == sql_rows(ORACLES["stream_late_days"])
