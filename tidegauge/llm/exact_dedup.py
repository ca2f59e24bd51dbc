"""Exact dedup by two passes over the hashes, with a Bloom filter between them.

Pass one counts, in a Bloom filter of two-bit counters, how often each bit of each text's hash was hit. Pass two
tests every row: a hash with all its bits hit twice may be repeated, and only such rows shuffle; the rest are
certainly alone and pass straight through. A false positive costs a shuffled row, never a wrong result. The filter
grows with the table; hashes are cut into as many ranges as keep a range's filter small enough to send, and each
range is filtered in its turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Bits of a shard of the filter. A shard is the unit of merging.
SHARD_BITS = 1 << 20
#: Bytes of a filter sent to all executors (16 bits a row: 33 million rows); more rows are filtered in more turns.
FILTER_BYTES = 64 << 20
#: A filter is not cut smaller than this.
LEAST_BYTES = 128
#: Rows whose hits are merged in a task before they shuffle.
TASK_ROWS = 4 << 20
#: A group that holds more than one row in so many is hot: there are fewer than so many of them.
HOT_GROUPS = 2000
_PROBES = 2


def _bits(h: np.ndarray) -> np.ndarray:
    """The bit positions of each hash inside its shard, one line per probe."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((a + np.uint64(i) * b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44) for i in range(_PROBES)]).astype(np.int64)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h.astype(np.uint64) % np.uint64(shards)).astype(np.int64)


def _steps(at: np.ndarray) -> bytes:
    """Sorted positions as the steps between them, in 16 bits where they fit."""
    step = np.diff(at, prepend=0)
    wide = len(step) and step.max() > 0xFFFF
    return (b"\1" + step.astype(np.uint32).tobytes()) if wide else (b"\0" + step.astype(np.uint16).tobytes())


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32 if data[0] else np.uint16, offset=1), dtype=np.int64)


def _hits(shards: int):
    """Per task and shard: positions hit once and positions hit at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            h = np.concatenate(held)
            shard = _shard(h, shards)
            every, n = np.unique((shard[None, :] * SHARD_BITS + _bits(h)).ravel(), return_counts=True)
            cut = np.searchsorted(every, np.arange(shards + 1) * SHARD_BITS)
            found = [(s, every[a:b] - s * SHARD_BITS, n[a:b]) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in found], pa.int64()), pa.array([_steps(at[k == 1]) for _, at, k in found], pa.binary()), pa.array([_steps(at[k > 1]) for _, at, k in found], pa.binary())],
                ["shard", "once", "more"],
            )

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            rows += len(batch)
            if rows >= TASK_ROWS:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's bits that were hit at least twice."""
    hit, twice = np.zeros(SHARD_BITS, bool), np.zeros(SHARD_BITS, bool)
    for once, more in zip(rows["once"], rows["more"], strict=True):
        at, again = _places(once), _places(more)
        twice[at[hit[at]]] = True
        twice[again] = True
        hit[at] = True
        hit[again] = True
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "bits": [np.packbits(twice).tobytes()]})


def maybe_repeated(hashed: DataFrame, rows: int) -> DataFrame:
    """``hashed`` (with a long column ``h``) plus boolean ``maybe``: false only where ``h`` occurs once. ``rows``: about how many there are."""
    shards = max(1, -(-rows * 16 // SHARD_BITS))
    spark = hashed.sparkSession
    hits = hashed.select("h").mapInArrow(_hits(shards), "shard long, once binary, more binary")
    table = np.zeros((shards, SHARD_BITS // 8), np.uint8)
    for r in hits.groupBy("shard").applyInPandas(_merged, "shard long, bits binary").collect():  # about FILTER_BYTES at most
        table[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64)
        shard, out = _shard(x, shards), np.ones(len(x), bool)
        for at in _bits(x):
            out &= (sent.value[shard, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return hashed.withColumn("maybe", maybe("h"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id (largest id among equal texts), group_size, kept, text_sha256.

    Texts are equal when identical as they stand, whole, however long. A null text counts as empty. Of rows that repeat an id and a
    text, all have ``kept`` where that id is the largest. A null id is smaller than any other; a group of null ids alone has
    keep_id null and keeps its rows. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.count()
    turns = max(1, -(-rows * 2 // max(FILTER_BYTES, LEAST_BYTES)))
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("h"))
    # digests are read several times, texts once; a turn reads its own range of hashes
    if turns == 1:
        tested = maybe_repeated(stored(hashed, "digests"), rows)
    else:
        hashed = stored(hashed.withColumn("turn", F.pmod(F.shiftrightunsigned("h", 40), F.lit(turns)).cast("int")), "digests", by="turn")
        tested = None
        for i in range(turns):
            own = stored(maybe_repeated(hashed.filter(F.col("turn") == i).drop("turn"), -(-rows // turns)), "tested")
            tested = own if tested is None else tested.unionByName(own)
    alone = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.filter("maybe").select("doc_id", F.unhex("text_sha256").alias("digest"))
    # groups are summed before they shuffle; those of very many rows are few, and meet their rows without another shuffle
    groups = stored(maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    hot = F.col("group_size") * HOT_GROUPS > rows
    few = groups.filter(hot).select(F.col("digest").alias("hot_digest"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    met = maybe.join(F.broadcast(few), F.col("digest") == F.col("hot_digest"), "left")
    big = met.filter("hot_digest is not null").select("doc_id", "digest", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size"))
    rest = met.filter("hot_digest is null").select("doc_id", "digest").join(groups.filter(~hot), "digest").select("doc_id", "digest", "keep_id", "group_size")
    same = big.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return alone.unionByName(same)
