"""Daily counts of a stream in which no row vanishes: days close, and rows of closed days name the days to rebuild.

A day is closed once a day more than ``late`` days after it was seen in an earlier batch. Rows of open days are counted as they
come; a row of a closed day is put on the list of days to be counted anew from the log. All that a batch writes is in folders of
its own number, which a replay replaces.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_COUNTS = "demand_date date, category string, request_count long, late boolean, batch int"


def _mark(spark: SparkSession, path: str, batch_id: int) -> date | None:
    """The greatest day of all batches up to this one."""
    return spark.read.schema("day date").parquet(f"{path}/marks/{batch_id}").first()["day"] if batch_id >= 0 else None


def stream_counted_days(stream: DataFrame, path: str, checkpoint: str, time: str, category: str, late: int = 30) -> StreamingQuery:
    """Count rows per day and category, batch by batch, below ``path``. Rows without a time belong to no day and are passed over."""

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _mark(spark, path, batch_id - 1)
        closed = F.col("demand_date") < F.lit(before - timedelta(late)) if before else F.lit(False)
        days = batch.filter(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("demand_date"), F.col(category).alias("category")).agg(F.count("*").alias("request_count"))
        own = f"{path}/counts/batch={batch_id}"
        days.withColumn("late", closed).write.mode("overwrite").parquet(own)
        greatest = spark.read.schema(_COUNTS).parquet(own).agg(F.max("demand_date").alias("day"))
        greatest.select(F.greatest("day", F.lit(before).cast("date")).alias("day")).write.mode("overwrite").parquet(f"{path}/marks/{batch_id}")

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(land).start()


def _landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COUNTS).parquet(f"{path}/counts")


def days_to_rebuild(spark: SparkSession, path: str) -> DataFrame:
    """demand_date of each closed day that got rows later; at most as many as the calendar has."""
    return _landed(spark, path).filter("late").select("demand_date").distinct()


def counts_in_time(spark: SparkSession, path: str) -> DataFrame:
    """demand_date, category, request_count of the rows that came while their day was open."""
    return _landed(spark, path).filter("not late").groupBy("demand_date", "category").agg(F.sum("request_count").alias("request_count"))


def rebuilt_counts(spark: SparkSession, path: str, log: DataFrame, time: str, category: str) -> DataFrame:
    """The counts of all days: those on the list are counted from the log, which holds every row; the others are as the stream has them."""
    days = days_to_rebuild(spark, path)
    dated = log.filter(F.col(time).isNotNull()).select(F.to_date(time).alias("demand_date"), F.col(category).alias("category"))
    anew = dated.join(days, "demand_date", "left_semi").groupBy("demand_date", "category").agg(F.count("*").alias("request_count"))
    return counts_in_time(spark, path).join(days, "demand_date", "left_anti").unionByName(anew)
