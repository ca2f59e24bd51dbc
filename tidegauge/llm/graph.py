"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Edges of a task that are contracted together, and edges that make a task of the later rounds.
LOCAL_EDGES, TASK_EDGES = 500_000, 200_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task with each node hung on the smallest that the task's own edges reach."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = i = up[up[i]]
        return i

    def out() -> pd.DataFrame:
        rows = [(i, root(i)) for i in up]
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["v", "u"]).astype("int64")

    for batch in batches:
        for a, b in zip(batch["v"].tolist(), batch["u"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > LOCAL_EDGES:
            yield out()
            up.clear()
    yield out()


def _settled(edges: DataFrame, parts: int) -> bool:
    """Whether every node hangs on one node at most, and none that hangs has others hanging on it."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").coalesce(parts).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for each end of the edges (a, b: long; loops and repeats are fine).

    Each task first contracts its own edges. Then each round hangs every node's neighbours on the smallest of them:
    minima are summed before they shuffle, so a node that all others touch does not gather them in a task. Rounds grow
    with the logarithm of the longest path. Few edges are kept in few partitions, however many a shuffle has.
    """
    clean = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).mapInPandas(_stars, "v long, u long").distinct(), "edges")
    parts = max(4, -(-clean.count() // TASK_EDGES))
    clean = clean.coalesce(parts)
    while not _settled(clean, parts):
        both = clean.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(clean.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("v"), F.col("m").alias("u")).filter(F.col("v") != F.col("u"))
        large = stored(large.distinct().coalesce(parts), "edges")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).filter(F.col("v") != F.col("u"))
        clean = stored(small.distinct().coalesce(parts), "edges")
    return clean.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(clean.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct().coalesce(parts))
