"""Scoring texts with a context tree learnt from the corpus, beside a unigram base score.

The corpus is counted whole: words with counts meet in one shuffle, contexts of running text with counts in a second
one, dealt by their newest bytes. Every context counts, and each bucket of them is weighted in a task of its own; only the
nodes above those bytes go to all executors. What texts ask for travels with what they teach, and the scores
travel back. Of the word counts, the most frequent HEAD words go to all executors; the other words of each text meet
their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .context_tree import DEPTH
from .running_tree import Subtrees, Top, bucket_of, merged, runs, stream, total_sums, unit_parts
from .words import U, blocks, by_key, mix

HEAD = 1 << 19
#: Bytes of text that are counted and scored together, bytes of text for which there is one bucket, bytes of text whose
#: words are told apart together, and codes weighted at a time.
UNIT_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
VOCABULARY_BYTES = 12 << 20
UNIT_POSITIONS = 1 << 18
#: Newest context bytes by which contexts are dealt, if the nodes above are so many at most (32 bytes each go to all executors); beyond it, one byte less.
TOP, TOP_NODES = 4, 1 << 22
#: Scores of bytes travel in steps of this part of a bit, as fine as single floats near one.
PRICE_STEPS = float(1 << 16)


def held_out(id_col: Column) -> Column:
    """Rows that the model does not learn from: crc32 of the id as text leaves 2 by 7."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(7)) == 2, F.lit(False))


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all slices behind each other, and their offsets."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    return data[at], offsets


class _Distinct:
    """Distinct words of the blocks taken in, with counts."""

    def __init__(self) -> None:
        self.hash, self.count, self.data, self.length, self.size = [], [], [], [], 0

    def take(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        own, offsets = _slices(data, start[first], end[first])
        for to, x in ((self.hash, u), (self.count, n), (self.data, own), (self.length, np.diff(offsets))):
            to.append(x)
        self.size += len(data)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (sorted), counts, bytes and offsets."""
        none = np.zeros(0, np.int64)
        h, n, data, length = (np.concatenate(x or [none]) for x in (self.hash, self.count, self.data, self.length))
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        u, first, inverse = np.unique(h.astype(U), return_index=True, return_inverse=True)
        own, cut = _slices(data.astype(np.uint8), offsets[first], offsets[first + 1])
        return u, np.bincount(inverse, n, len(u)).astype(np.int64), own, cut


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Distinct()

    def out() -> pa.RecordBatch:
        h, n, data, cut = found.words()
        token = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), token, pa.array(n)], ["h", "token", "c"])

    for batch in batches:
        for b in blocks(batch.column(0)):
            found.take(b.data, b.start, b.end, b.hashes())
            if found.size >= VOCABULARY_BYTES:
                yield out()
                found = _Distinct()
    yield out()


def vocabulary(texts: DataFrame) -> DataFrame:
    """h, token (bytes), c: the words of all rows of a one-column table, with counts; counted per task before they shuffle."""
    return texts.mapInArrow(_vocabulary, "h long, token binary, c long").groupBy("h", "token").agg(F.sum("c").alias("c"))


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, which compress well."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).ravel()


def _units(sent_head):
    """Rows of UNIT_BYTES of text at a time: what the base score needs, and the text as coded. Row i of a unit has number unit + i."""
    schema = ["unit", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "n_bytes", "tail", "stream"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_log, end_log = sent_head.value
        row = TaskContext.get().partitionId() << 40
        ids, held, hashes, firsts, sizes, streams, size = [], [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal row
            h = np.concatenate([np.zeros(0, U), *hashes])
            if len(head):
                at = np.minimum(np.searchsorted(head, h), len(head) - 1)
                tail = head[at] != h
                log = np.where(tail, 0.0, head_log[at])
            else:
                tail, log = np.ones(len(h), bool), np.zeros(len(h))
            per = np.concatenate(firsts)
            of = np.repeat(np.arange(len(per)), per)

            def total(x: np.ndarray) -> np.ndarray:
                return np.bincount(of, x, len(per))

            n, unit = len(per), row
            offsets = np.concatenate([[0], np.cumsum(total(tail))]).astype(np.int32)
            whole = pa.array([0, n], pa.int32())
            lists = [
                pa.concat_arrays(ids), pa.concat_arrays(held), pa.array(per.astype(np.int64) + 1), pa.array((total(~tail) + (end_log > 0)).astype(np.int64)), pa.array(total(log) + end_log),
                pa.array(np.concatenate(sizes)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[tail].view(np.int64))),
            ]
            row += n
            return pa.RecordBatch.from_arrays([pa.array([unit]), *[pa.ListArray.from_arrays(whole, x) for x in lists], pa.array([_packed(np.concatenate(streams))], pa.binary())], schema)

        for batch in batches:
            for b in blocks(batch.column(2)):
                ids.append(batch.column(0).slice(b.rows.start, b.rows.stop - b.rows.start))
                held.append(batch.column(1).slice(b.rows.start, b.rows.stop - b.rows.start))
                hashes.append(b.hashes())
                firsts.append(np.diff(b.first))
                coded, n = stream(b)
                streams.append(coded)
                sizes.append(n)
                size += len(coded)
                if size >= UNIT_BYTES:
                    yield out()
                    ids, held, hashes, firsts, sizes, streams, size = [], [], [], [], [], [], 0
        if ids:
            yield out()

    return run


def _grams(buckets: int, top: int):
    """Per unit and bucket: the distinct codes of all its texts, and how often those learnt from have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                size = np.asarray(batch.column(2)[i].values)
                learnt = ~batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(bool)
                found = [(own.code, own.sums(learnt[row])) for row, own in unit_parts(_unpacked(batch.column(3)[i].as_py(), int((size + DEPTH).sum()), np.uint8), size)]
                code, n = (np.concatenate(x) for x in zip(*found, strict=True))
                rows = [(j, len(at), _packed(code[at]), _packed(n[at])) for j, at in by_key(bucket_of(code, buckets, top))]
                del found, code, n
                pa.default_memory_pool().release_unused()
                unit = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit] * len(rows), pa.int64()), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]],
                    ["unit", "bucket", "size", "code", "n"],
                )

    return run


_SUMS = ("top", "zeros", "ones", "below")
_BUCKET = "size long, code binary, n binary, units array<bigint>, sizes array<bigint>, places array<binary>, " + ", ".join(f"{x} array<bigint>" for x in _SUMS)


def _bucket(rows: pa.Table, top: int) -> pa.Table:
    """One bucket of all units: distinct codes, counts, each unit's places among them, and sums for the nodes above."""
    units, sizes = rows["unit"].to_pylist(), rows["size"].to_pylist()
    given = np.concatenate([_unpacked(x.as_py(), k, U) for x, k in zip(rows["code"], sizes, strict=True)])
    counts = np.concatenate([_unpacked(x.as_py(), k, np.int64) for x, k in zip(rows["n"], sizes, strict=True)])
    code, n, at = merged(given, counts)
    sums = total_sums([Subtrees(code[s], n[s], top).sums() for s in runs(code, UNIT_POSITIONS, top)])
    places = [_packed(np.diff(x, prepend=0).astype(np.uint32)) for x in np.split(at, np.cumsum(sizes)[:-1])]
    own = {"size": [len(code)], "code": [_packed(code)], "n": [_packed(n)], "units": [units], "sizes": [sizes], "places": [places]}
    own |= {k: [x.astype(np.int64)] for k, x in zip(_SUMS, sums, strict=True)}
    kind = pa.list_(pa.int64())
    types = {"size": pa.int64(), "code": pa.binary(), "n": pa.binary(), "units": kind, "sizes": kind, "places": pa.list_(pa.binary())} | dict.fromkeys(_SUMS, kind)
    return pa.table({k: pa.array(v, types[k]) for k, v in own.items()})


def _dealt(top: int):
    return lambda rows: _bucket(rows, top).append_column("bucket", rows["bucket"].combine_chunks()[:1])


def _priced(sent, top: int):
    """The scores of each unit's codes, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                code, n = _unpacked(r["code"], r["size"], U), _unpacked(r["n"], r["size"], np.int64)
                log = np.concatenate([Subtrees(code[s], n[s], top).log2(sent.value) for s in runs(code, UNIT_POSITIONS, top)])
                log = np.rint(log * PRICE_STEPS).astype(np.int32)
                prices = [_packed(log[np.cumsum(_unpacked(p, k, np.uint32), dtype=np.int64)]) for p, k in zip(r["places"], r["sizes"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["units"], pa.int64()), pa.array([r["bucket"]] * len(prices), pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(prices, pa.binary())], ["unit", "bucket", "size", "price"])

    return run


def _summed(buckets: int, top: int):
    """A unit's texts with the scores of their codes: one score per row."""

    def run(unit: pa.Table, prices: pa.Table) -> pa.Table:
        size = unit["n_bytes"].combine_chunks().flatten().to_numpy()
        price = {j: _unpacked(x.as_py(), n, np.int32) for j, n, x in zip(prices["bucket"].to_pylist(), prices["size"].to_pylist(), prices["price"], strict=True)}
        used, score = dict.fromkeys(price, 0), np.zeros(len(size))
        for row, own in unit_parts(_unpacked(unit["stream"][0].as_py(), int((size + DEPTH).sum()), np.uint8), size):
            log = np.empty(len(own.code))
            for j, at in by_key(bucket_of(own.code, buckets, top)):  # a bucket's codes come in order of the parts
                log[at] = price[j][used[j] : used[j] + len(at)]
                used[j] += len(at)
            score += own.per_row(log, row, len(size))
        score *= np.log10(2.0) / PRICE_STEPS
        return pa.table({"row": unit["unit"][0].as_py() + np.arange(len(size)), "score": score})

    return run


def running_scores(units: DataFrame) -> DataFrame:
    """row, score: log10 of each text's chance, from the counts of all contexts of all texts learnt from."""
    spark = units.sparkSession
    size = units.agg(F.coalesce(F.sum(F.aggregate("n_bytes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, -(-size // BUCKET_BYTES))
    for top in (TOP, TOP - 1):
        grams = units.select("unit", "held_out", "n_bytes", "stream").mapInArrow(_grams(buckets, top), "unit long, bucket long, size long, code binary, n binary")
        # as many tasks as buckets, so that a task reads no more of a larger corpus
        dealt = grams.repartition(buckets, "bucket").groupBy("bucket")
        tables = stored(dealt.applyInArrow(_dealt(top), f"{_BUCKET}, bucket long"), "contexts")
        above = stored(tables.select(F.explode(F.arrays_zip(*_SUMS)).alias("s")).select("s.*").groupBy("top").agg(*[F.sum(x).alias(x) for x in _SUMS[1:]]), "nodes")
        if above.count() <= TOP_NODES:
            break
    nodes = above.toArrow()  # at most TOP_NODES, or those of two context bytes: 2^16 contexts, whatever the corpus
    sent = spark.sparkContext.broadcast(Top(*(nodes[x].to_numpy().astype(U if x == "top" else np.int64) for x in _SUMS), top) if len(nodes) else None)
    prices = tables.select("bucket", "size", "code", "n", "units", "sizes", "places").mapInArrow(_priced(sent, top), "unit long, bucket long, size long, price binary")
    streams = units.select("unit", "n_bytes", "stream").repartition(buckets, "unit")
    return streams.groupBy("unit").cogroup(prices.repartition(buckets, "unit").groupBy("unit")).applyInArrow(_summed(buckets, top), "row long, score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Null text counts as empty: one token, its end. A null id is learnt from. With nothing to learn from, every bit costs
    one bit and no token is known. Repeated rows are scored, and learnt from, each. Texts are counted and scored whole, however
    long. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.filter(~F.col("held_out"))
    words = stored(vocabulary(train.select("text")).select("h", "c"), "words")
    texts = train.count()
    band = F.floor(F.log2("c") * 4).cast("int")
    bands = sorted(((r["band"], r["n"], r["c"]) for r in words.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()), reverse=True)  # at most 4 * 63 rows
    tokens, kinds = sum(b[2] for b in bands) + texts, sum(b[1] for b in bands) + (texts > 0)
    least, n = 1 << 30, 0
    for b, k, _ in bands:
        n += k
        if n > HEAD:
            break
        least = b
    head = words.filter(band >= least).select("h", "c").toArrow()  # at most HEAD words
    h, c = head["h"].to_numpy().view(U), head["c"].to_numpy()
    order = np.argsort(h)
    sent_head = spark.sparkContext.broadcast((h[order], np.log10(c[order] + 1.0), float(np.log10(texts + 1.0))))
    kind = dict(rows.dtypes)["doc_id"]
    lists = {"doc_id": kind, "held_out": "boolean", "n_tokens": "long", "head_known": "long", "head_log": "double", "n_bytes": "long", "tail": "array<bigint>"}
    units = stored(rows.mapInArrow(_units(sent_head), f"unit long, {', '.join(f'{k} array<{t}>' for k, t in lists.items())}, stream binary"), "units")
    out = units.select("unit", F.posexplode(F.arrays_zip(*lists)).alias("i", "r")).select((F.col("unit") + F.col("i")).alias("row"), "r.*")
    tail = out.select("row", F.explode("tail").alias("h")).join(words.filter(band < least).select("h", "c"), "h")
    tail = tail.groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("tail_log"))
    both = out.drop("tail").join(tail, "row", "left").join(running_scores(units), "row")
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + kinds + 1.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
