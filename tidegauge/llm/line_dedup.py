"""Line dedup by site-relative frequency, in DataFrame functions only.

Per host: pages that hold a line, over the host's pages. Lines above a ratio are boilerplate and go from every page
of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: A line is boilerplate on a host if more than this part of the host's pages hold it, and at least so many of them.
RATIO = 0.02
LEAST_PAGES = 5
#: The boilerplate hashes go to all executors only up to this many (8 bytes each); beyond it pages meet them by a shuffle.
BROADCAST_LINES = 1 << 20
SALTS = 64


def lines_of(text: Column) -> Column:
    """Lines of a text, cut at line feeds; null for a null text."""
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Boilerplate lines: host, h (64-bit hash of the line), pages, host_pages.

    Pages are counted per line after one page's repeats are merged, and summed before they shuffle, so neither a hot
    host nor a line that all pages hold gathers in one task.
    """
    host = F.col(host_col).alias("host")
    own = F.transform(F.filter(lines_of(F.col(text_col)), lambda x: ~_blank(x)), lambda x: F.xxhash64(x))
    pages = docs.groupBy(host).agg(F.count("*").alias("host_pages"))
    counts = docs.select(host, F.explode(F.array_distinct(own)).alias("h")).groupBy("host", "h").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    both = counts.join(pages, counts["host"].eqNullSafe(pages["host"])).select(counts["host"], "h", "pages", "host_pages")
    return both.filter(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def dedup_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and with ``n_lines`` and ``n_dropped`` (long).

    Every row stays, in all its columns, whatever their names; columns named n_lines or n_dropped before are replaced. Null
    text stays null with 0 lines; an empty text is one blank line; whole texts count, however long. Blank lines are neither
    counted nor dropped. A page all of whose lines go keeps an empty text. A null host is a host. Repeated rows count as
    pages each. An empty table gives an empty result. Lines equal by a 64-bit hash count as equal within a host.
    """
    bad = stored(boilerplate(docs, text_col, host_col, ratio, least_pages), "lines")
    n = bad.count()
    lists = bad.groupBy("host").agg(F.collect_list("h").alias("bad"))  # at most lines a page / ratio
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.select(F.struct("*").alias("row"), F.col(host_col).alias("own_host"))
    same = rows["own_host"].eqNullSafe(lists["host"])
    text = F.col("row").getField(text_col)
    if n <= BROADCAST_LINES:
        met = rows.join(F.broadcast(lists), same, "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        lists = lists.withColumn("salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        met = salted.join(lists, salted["own_host"].eqNullSafe(lists["host"]) & (F.col("salt") == F.col("salts")), "left")
    # a page's own boilerplate first, by hash sets; few pages have any, and only those are cut up again
    hashes = F.transform(lines_of(text), lambda x: F.xxhash64(x))
    met = met.select("row", F.coalesce(F.size(hashes), F.lit(0)).cast("long").alias("lines"), F.array_intersect(hashes, "bad").alias("hit"))
    kept = F.filter(lines_of(text), lambda x: _blank(x) | ~F.array_contains("hit", F.xxhash64(x)))
    met = met.select("row", F.when(text.isNull(), 0).otherwise(F.col("lines")).alias("lines"), F.when(F.size("hit") > 0, kept).alias("kept"))
    dropped = F.when(F.col("kept").isNotNull(), F.col("lines") - F.size("kept")).otherwise(0).cast("long")
    left = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(text)
    columns = [left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return met.select(*columns, F.col("lines").alias("n_lines"), dropped.alias("n_dropped"))
