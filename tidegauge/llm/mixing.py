"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document of source s gets a rate 2 / (1 + exp(-lambda_s * x)), x = size / mean size of its source: the weights
nearest to one each (in binary entropy on [0, 2], so that no document goes beyond two copies) that meet the source's
token target. The dual is convex and separates by source; a Newton step for all sources at once is one aggregation
over (source, size) counts. Rates are then rounded to whole copies so that the error carries from document to document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Documents whose roundings carry over to each other; larger sources are dealt to more groups by hash.
GROUP_DOCS = 256
NEWTON_STEPS = 30
#: Repeated rows that are numbered, or come back, together.
EXPLODED = 4096
RATE_TOLERANCE = 1e-4


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(per: DataFrame) -> DataFrame:
    """``per`` with ``at``: the place of each source in code-point order, null last. Sources are cut into ranges and
    numbered in each; only the ranges' sizes meet in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    ranges = stored(per.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranges.join(before, "part").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).drop("part", "before")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, source_docs, target.

    ``sized`` has ``source`` and ``size``. Sources in code-point order, null last, weigh ``weights`` over and over and
    share ``share`` of all sizes; a target stops at ``most`` times its source's size and the excess is shared again by
    weight, until no target is above. Each round is one sum over the sources; there may be many of them.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    w = reduce(lambda out, i: F.when(F.pmod("at", F.lit(len(weights))) == i, F.lit(float(weights[i]))).otherwise(out), range(len(weights)), F.lit(None).cast("double"))
    per = stored(_numbered(per).withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double")), "mix-weights")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("w")
        row = per.agg(F.sum("source_size").alias("all"), F.count(F.when(full, 1)).alias("n"), _total(F.when(full, F.col("cap"))).alias("used"), _total(F.when(~full, F.col("w"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        level, capped = (row["all"] * share - (row["used"] or 0.0)) / row["open"], row["n"]
    if not row["open"]:
        return per.select("source", "source_size", "source_docs", F.col("cap").alias("target"))
    return per.select("source", "source_size", "source_docs", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def _rate(size: str = "size") -> Column:
    """Rate of a document, in (0, 2]."""
    x = F.col("lam") * F.col(size) / F.greatest(F.col("mean"), F.lit(1e-9))
    return F.when(F.col("target") >= 2.0 * F.col("source_size"), F.lit(2.0)).otherwise(2.0 / (1.0 + F.exp(-F.least(F.greatest(x, F.lit(-60.0)), F.lit(60.0)))))


def _total(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def balanced_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: lam, mean, target, source_size, found by safeguarded Newton steps on all sources at once."""
    counts = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    share = F.least(F.greatest(F.col("target") / (2.0 * F.greatest(F.col("source_size"), F.lit(1))), F.lit(1e-9)), F.lit(1 - 1e-9))
    state = targets.select("source", "source_size", "source_docs", "target", (F.col("source_size") / F.col("source_docs")).alias("mean"), F.log(share / (1 - share)).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    state = stored(state, "mix-state")
    for _ in range(NEWTON_STEPS):
        own = counts.join(state, counts["source"].eqNullSafe(state["source"])).select(state["source"], "source_size", "source_docs", "target", "mean", "lam", "low", "high", "size", "n", _rate().alias("r"))
        slope = F.col("n") * F.col("size") * F.col("r") * (1 - F.col("r") / 2) * F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
        keys = ["source", "source_size", "source_docs", "target", "mean", "lam", "low", "high"]
        # sums of decimals do not depend on their order, so reruns agree to the last bit
        step = own.groupBy(*keys).agg((_total(F.col("n") * F.col("size") * F.col("r")) - F.col("target")).alias("over"), _total(slope).alias("slope"))
        low = F.when(F.col("over") < 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(F.col("over") > 0, F.least("high", "lam")).otherwise(F.col("high"))
        step = step.withColumn("low2", low).withColumn("high2", high).withColumn("newton", F.when(F.col("slope") > 0, F.col("lam") - F.col("over") / F.col("slope")))
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("low2")) & (F.col("newton") < F.col("high2"))
        bounded = (F.col("low2") > -1e6) & (F.col("high2") < 1e6)
        other = F.when(bounded, (F.col("low2") + F.col("high2")) / 2).otherwise(F.col("lam") + F.when(F.col("over") > 0, -1.0).otherwise(1.0) * (1 + F.abs("lam")))
        done = (F.abs("over") <= RATE_TOLERANCE * F.greatest("target", F.lit(1.0))) | (F.col("target") >= 2.0 * F.col("source_size"))
        state = stored(step.select("source", "source_size", "source_docs", "target", "mean", F.when(done, F.col("lam")).when(inside, F.col("newton")).otherwise(other).alias("lam"), F.col("low2").alias("low"), F.col("high2").alias("high"), done.alias("done")), "mix-state")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What names a document to the mix: rows with the same key are interchangeable."""
    text = F.col(text_col)
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash")]


_KEY = ("doc_id", "source", "size", "text_hash")


def taken_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """Per key (id, source, size and text): n, the rows that have it; copies, those the mix takes of all of them; source_size, target, rate.

    Rows that repeat a key are counted before they shuffle, so that no group holds them all.
    """
    sized = stored(docs.select(*_keys(docs, id_col, text_col, source_col)), "mix-docs")
    state = balanced_rates(sized, source_targets(sized, weights, share))
    keys = sized.groupBy(*_KEY).agg(F.count("*").alias("n"))
    own = keys.join(state, keys["source"].eqNullSafe(state["source"])).select("doc_id", keys["source"], "size", "text_hash", "n", "source_size", "target", "source_docs", _rate().alias("rate"))
    # a group: one source's keys with the same hash remainder, about GROUP_DOCS of them whatever the source's size
    group = F.pmod(F.xxhash64(F.struct("doc_id", "size", "text_hash")), F.ceil(F.col("source_docs") / GROUP_DOCS))
    rows = own.withColumn("part", group).groupBy("source", "source_size", "target", "part").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "text_hash", "n", "rate")), asc=False).alias("rows"))
    # largest first, the rows of a key together take as many copies as leave the smallest debt of words
    start = F.struct(F.lit(0.0).alias("debt"), F.array().cast("array<bigint>").alias("copies"))

    def carry(acc: Column, r: Column) -> Column:
        due = acc["debt"] + r["n"] * r["rate"] * r["size"]
        near = F.floor(due / r["size"] + 0.5)
        copies = F.when(r["size"] == 0, r["n"] * F.floor(r["rate"] + 0.5)).otherwise(F.least(r["n"] * F.ceil(r["rate"]), F.greatest(r["n"] * F.floor(r["rate"]), near))).cast("long")
        return F.struct((due - copies * r["size"]).alias("debt"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    rows = rows.withColumn("copies", F.aggregate("rows", start, carry)["copies"])
    out = rows.select("source", "source_size", "target", F.explode(F.arrays_zip("rows", "copies")).alias("r"))
    return out.select("r.rows.doc_id", "source", "r.rows.size", "r.rows.text_hash", "r.rows.n", "source_size", "target", "r.rows.rate", "r.copies")


def _share(rank: Column) -> Column:
    """Copies of the row of this rank among the rows of its key: an even share, the first ones one more."""
    return F.floor(F.col("copies") / F.col("n")) + (rank < F.pmod("copies", "n")).cast("long")


def mix_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies (0, 1 or 2), taken = copies * size.

    Null text has size 0, as has an empty one, and no copies beyond its rounded rate; a null source is a source of its own, last in
    order; null ids are ids like any other. Rows that repeat id, source and text share their copies evenly. An empty table gives an
    empty result. Whole texts are counted, however long. Other columns are ignored, whatever their names. The result depends on the
    rows alone, not on their order or partitioning: ties are broken by id, then by a hash of the text.
    """
    keys = taken_keys(docs, id_col, text_col, source_col, weights, share)
    # repeated rows come back in two steps, so that no array holds them all
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EXPLODED)))
    rows = keys.withColumn("block", block).withColumn("rank", F.explode(F.sequence(F.col("block") * EXPLODED, F.least("n", (F.col("block") + 1) * EXPLODED) - 1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", _share(F.col("rank")).cast("int").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of stored rows among those of their key. They are numbered in blocks; only blocks' sizes meet in a window."""
    place = rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / EXPLODED).alias("block")).alias("block"), F.col("_metadata.row_index").alias("index"))
    local = F.row_number().over(Window.partitionBy(*_KEY, "block").orderBy("index")) - 1
    before = F.coalesce(F.sum("in_block").over(Window.partitionBy(*_KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = place.groupBy(*_KEY, "block").agg(F.count("*").alias("in_block")).withColumn("before", before)
    same = reduce(lambda x, y: x & y, [place[c].eqNullSafe(blocks[c]) for c in (*_KEY, "block")])
    return place.withColumn("local", local).join(blocks.select(*[F.col(c) for c in (*_KEY, "block")], "before"), same).select("row", "n", "copies", (F.col("before") + F.col("local")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0, 1 or 2 times), in all its columns, whatever their names.

    Nulls, empty and long texts, repeats and empty tables are as in ``mix_rates``. Of the rows of one key that cannot share its copies
    evenly, which ones have one more is settled by their places in a stored table; such rows differ in other columns at most.
    """
    keys = stored(taken_keys(docs, id_col, text_col, source_col, weights, share).filter("copies > 0").select(*_KEY, "n", "copies"), "mix-taken")
    rows = docs.select(F.struct("*").alias("row"), *_keys(docs, id_col, text_col, source_col))

    def met(own: DataFrame) -> DataFrame:
        same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(own[c]) for c in _KEY])
        return rows.join(own, same).select("row", *[rows[c] for c in _KEY], "n", "copies")

    even = F.pmod("copies", "n") == 0
    out = met(keys.filter(even)).select("row", (F.col("copies") / F.col("n")).alias("times"))
    if not keys.filter(~even).isEmpty():
        out = out.unionByName(_ranked(stored(met(keys.filter(~even)), "mix-repeated")).select("row", _share(F.col("rank")).alias("times")))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("time")).select("row.*")
