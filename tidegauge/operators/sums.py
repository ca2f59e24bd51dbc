"""Running totals and merged intervals, without a join by ``<=`` and without one task that sees all rows.

Running totals take two passes: the values of each key are aggregated before they shuffle, the keys are dealt by ranges
of their order, and each range's totals are taken where it lies; what the ranges before it add up to is added within
the range. What is summed over all ranges is one row for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


#: How values are aggregated, and how two aggregates are put together.
_KINDS = {"sum": (F.sum, _plus), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running_totals(table: DataFrame, order: str, values: dict[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """One row per distinct ``order``: it, and each of ``values`` (name: kind, column) over all rows whose ``order`` is not greater.

    Kinds are sum, min and max. A null order comes before all others. Null values count for nothing: a sum of none is 0, a min or max
    of none is null. An empty table gives an empty one. ``parts``: number of ranges; rows of one order meet aggregated, so a key that
    most rows share makes no range large."""
    parts = parts or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = table.groupBy(F.col(order)).agg(*[_KINDS[kind][0](column).alias(name) for name, (kind, column) in values.items()])
    ranged = own.repartitionByRange(parts, F.col(order).asc_nulls_first()).withColumn("_part", F.spark_partition_id())
    dealt = stored(ranged, "ranges")  # bounds of ranges come from a sample: written, so that a task run again deals alike
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = dealt.groupBy("_part").agg(*[_KINDS[kind][0](name).alias(name) for name, (kind, _) in values.items()])
    offsets = totals.select("_part", *[_KINDS[kind][0](name).over(before).alias(f"_{name}") for name, (kind, _) in values.items()])
    within = Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.join(F.broadcast(offsets), "_part")
    return met.select(order, *[both(F.col(f"_{name}"), agg(name).over(within)).alias(name) for name, (kind, _) in values.items() for agg, both in (_KINDS[kind],)])


def merged_intervals(intervals: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """``keys``, ``start``, ``end`` (dates): the days of each key's intervals as disjoint intervals that do not touch, by one sweep.

    Of intervals that start on one day the longest counts, and is found before they shuffle: the sweep sees at most one row for each
    key and day. An interval that starts by the day after the greatest end so far belongs to it. Intervals with a null end or start,
    or that end before they start, cover nothing."""
    own = intervals.filter(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    sweep = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("_first", (reach.isNull() | (F.col(start) > F.date_add(reach, 1))).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_first").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
