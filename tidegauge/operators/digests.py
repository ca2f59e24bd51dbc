"""A tree of digests over a snapshot: months, their days, their rows.

Two snapshots are compared from the top: only days whose sums differ have their rows read and compared. Sums of row
digests lie beside the rows, which are in folders by month and sorted by day; so two equal snapshots are found equal
from their digests alone, and a changed day costs its own rows in one month's folder, whatever the history's length.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_SUMS = ("n_rows", "low", "high")
#: The folder of a row whose day is null.
_NO_DAY = "none"


def _halves(columns: list[str]) -> list[Column]:
    """Two numbers of a row's digest. As JSON, no two rows of one schema look alike, nulls included."""
    digest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))
    return [F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16)]


def _day(day: str) -> Column:
    return F.coalesce(F.col(day).cast("string"), F.lit(_NO_DAY))


def day_digests(table: DataFrame, day: str) -> DataFrame:
    """month, day (strings), n_rows, low, high: per day the number of rows and sums of their digests, which no order changes.

    A null day is ``none``; rows that repeat count as often as they are there. An empty table has no days."""
    low, high = _halves(sorted(table.columns))
    per = table.select(_day(day).alias("_day"), low.alias("_low"), high.alias("_high")).groupBy("_day").agg(F.count("*").alias("n_rows"), F.sum("_low").alias("low"), F.sum("_high").alias("high"))
    return per.select(F.substring("_day", 1, 7).alias("month"), F.col("_day").alias("day"), *_SUMS)


def month_digests(days: DataFrame) -> DataFrame:
    """month, n_rows, low, high of day digests: the level above."""
    return days.groupBy("month").agg(*[F.sum(c).alias(c) for c in _SUMS])


def differing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose sums differ, or that one side alone has."""
    b, a = before.select(key, F.struct(*_SUMS).alias("b")), after.select(key, F.struct(*_SUMS).alias("a"))
    return b.join(a, key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def write_snapshot(table: DataFrame, path: str, day: str) -> None:
    """Write ``path``/rows, in folders by month and sorted by day, then ``path``/days with the digests of the rows as they were written.

    ``path``/days is written last: a snapshot without it is not one. Columns named ``_month`` or ``_on`` are not allowed. A month of very
    many rows is dealt over tasks by ranges of days."""
    clash = {"_month", "_on"} & set(table.columns)
    if clash:
        raise ValueError(f"columns not allowed in a snapshot: {sorted(clash)}")
    spark = table.sparkSession
    placed = table.withColumn("_on", _day(day)).withColumn("_month", F.substring("_on", 1, 7))
    spread = placed.repartitionByRange("_month", "_on", F.xxhash64(*[F.col(f"`{c}`") for c in table.columns])).sortWithinPartitions("_month", "_on")
    spread.write.mode("overwrite").partitionBy("_month").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(table.schema.jsonValue()),)], "schema string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    day_digests(read_snapshot(spark, path).drop("_month", "_on"), day).coalesce(1).write.mode("overwrite").parquet(f"{path}/days")  # a row a day


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot with ``_on``, their day, and ``_month``, their folder."""
    about = spark.read.schema("schema string").json(f"{path}/about").first()
    schema = StructType.fromJson(json.loads(about["schema"])).add("_on", StringType()).add("_month", StringType())
    return spark.read.schema(schema).parquet(f"{path}/rows")


def changed_days(spark: SparkSession, before: str, after: str) -> list[str]:
    """Days on which two snapshots differ, found by month first. A list of days, at most as long as the calendar is."""
    b, a = spark.read.parquet(f"{before}/days"), spark.read.parquet(f"{after}/days")
    months = [r[0] for r in differing(month_digests(b), month_digests(a), "month").collect()]
    if not months:
        return []
    here = F.col("month").isin(months)
    return sorted(r[0] for r in differing(b.filter(here), a.filter(here), "day").collect())


def snapshot_drift(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Rows of either written snapshot that the other lacks (repeats count), with ``side``: before or after.

    Months whose digests agree are not read; of the others, days that differ are asked of the scan. Both must have the same columns; the order may differ."""
    b, a = read_snapshot(spark, before), read_snapshot(spark, after)
    own = b.drop("_month", "_on").columns
    if sorted(own) != sorted(a.drop("_month", "_on").columns):
        raise ValueError(f"snapshots with different columns: {sorted(b.columns)} and {sorted(a.columns)}")
    days = changed_days(spark, before, after)
    here = F.col("_month").isin(sorted({d[:7] for d in days})) & F.col("_on").isin(days) if days else F.lit(False)
    b, a = (x.filter(here).select(*[F.col(f"`{c}`") for c in own]) for x in (b, a))
    gone = b.exceptAll(a).withColumn("side", F.lit("before"))
    return gone.unionByName(a.exceptAll(b).withColumn("side", F.lit("after")))
