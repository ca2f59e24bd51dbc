"""Exact Jaccard self join of documents' word shingles, down to connected components.

The upper levels of the signature tree are dealt over the cluster. At the root, a set is compared with all other sets
at once: tokens are shuffled in packed blocks by range of their hash, each token's block tells how many sets
hold it, and a set of which too few tokens are held elsewhere links with nothing (most documents end here). A token
that several sets of a block hold shuffles once for the block, with their number: a passage that all documents share
costs a task an entry a block. Of the rest, each set's rarest tokens are looked at: a linked pair shares one of the
first size - needed + 1 tokens, whatever the order of tokens, as long as it is the same for all. Sets joined by such
tokens form coarse classes, and no link crosses them. In each class a tree of OR-ed bitmaps is walked against itself
and the pairs left are compared exactly. A class too large for one task is cut into chunks, which are the nodes of an
upper level: a set goes to those chunks alone that hold one of its rare tokens in a set of a size that can match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .graph import components
from .signature_tree import link_all, linked, needed
from .words import U, blocks, by_key, give_back, mix, shingles

#: Bytes of text a range of tokens stands for on average; tokens in a block of documents; sets in a chunk of a large class;
#: bytes of tokens in a task of small classes, and the least number of such tasks.
TOKEN_BLOCK_BYTES = 16 << 20
BLOCK_TOKENS = 1 << 20
CHUNK_SETS = 512
TASK_BYTES, LEAST_TASKS = 4 << 20, 64
#: A class of fewer sets is large, too, if its tokens take so many bytes.
LARGE_BYTES = 64 << 20
#: Coarse class members that go to all executors (48 bytes each) to pick out their texts; beyond it, a shuffle join does.
BROADCAST_MEMBERS = 1 << 20
#: A group of copies, or of sets with a token, that holds more than one row in so many is hot: there are fewer than so many of them.
HOT_GROUPS = 2000
#: Sets of a large class that all its others are compared with first.
PIVOTS = 8
_LOW = U(0xFFFFFFFF)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Batch, row and sorted distinct shingles of each text."""
    for batch in batches:
        for b in blocks(batch.column(1)):
            h = b.hashes()
            for i in range(b.rows.stop - b.rows.start):
                yield batch, b.rows.start + i, np.unique(shingles(h[b.first[i] : b.first[i + 1]], k))


def _keys(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        return int((s.sum(dtype=U) + U(len(s))).view(np.int64)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64))


_SHAPE = "bucket long, block long, docs binary, counts binary, names binary, tokens binary, many binary, many_counts binary"


def _range_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _in_order(tokens: np.ndarray) -> np.ndarray:
    """Places of hashes in order of their first bits, by one sort of these and the places."""
    bits = max(21, len(tokens).bit_length())
    key = (tokens >> U(bits) << U(bits)) | np.arange(len(tokens), dtype=U)
    key.sort()
    return (key & U((1 << bits) - 1)).astype(np.int64)


def _packed(k: int, buckets: int):
    """Rows of two kinds. One per block of documents (bucket below 0): ids, sizes, names, and the tokens that several sets of
    the block hold, with these. One per block and range of tokens: tokens of one set of the block, set by set, with the
    sets' names, and tokens of several sets, with their number. Of copies in a block, that of the smallest id has the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, sets, size = [], [], 0

        def out() -> pa.RecordBatch:
            n = np.asarray([len(s) for s in sets], np.int64)
            id_of = np.asarray(ids, np.int64)
            keys = np.asarray([_keys(s) for s in sets], np.int64).reshape(-1, 2)
            by_id = np.argsort(id_of, kind="stable")
            heads = by_id[np.unique(keys[by_id], axis=0, return_index=True)[1]]
            tokens = np.concatenate([np.zeros(0, U), *[sets[i] for i in heads.tolist()]])
            doc = np.repeat(heads.astype(np.uint16), n[heads])
            order = _in_order(tokens)
            tokens, doc = tokens[order], doc[order]
            head = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))
            count = np.diff(np.append(head, len(tokens)))
            own = np.repeat(count > 1, count)
            shared, shared_n = tokens[head[count > 1]], count[count > 1].astype(np.uint16)
            rows = [(-1 - block, block, id_of.tobytes(), n.tobytes(), keys.tobytes(), shared.tobytes(), doc[own].tobytes(), shared_n.tobytes())]
            one, one_doc = tokens[~own], doc[~own]
            ranges = np.arange(buckets + 1)
            cut, shared_cut = (np.searchsorted(_range_of(x, buckets), ranges).tolist() for x in (one, shared))
            for i, (a, z, c, e) in enumerate(zip(cut[:-1], cut[1:], shared_cut[:-1], shared_cut[1:], strict=True)):
                if a < z or c < e:
                    at = a + np.argsort(one_doc[a:z], kind="stable")
                    docs, counts = np.unique(one_doc[at], return_counts=True)
                    low = [(x & _LOW).astype(np.uint32).tobytes() for x in (one[at], shared[c:e])]
                    rows.append((i, block, docs.tobytes(), counts.astype(np.uint32).tobytes(), keys[docs, 0].tobytes(), low[0], low[1], shared_n[c:e].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 2 + [pa.binary()] * 6)], ["bucket", "block", "docs", "counts", "names", "tokens", "many", "many_counts"])

        for batch, i, s in _sets(batches, k):
            ids.append(batch.column(0)[i].as_py())
            sets.append(s)
            size += len(s)
            if size >= BLOCK_TOKENS or len(ids) >= 60_000:
                yield out()
                block += 1
                ids, sets, size = [], [], 0
                give_back()
        if ids:
            yield out()
        ids, sets = [], []
        give_back()

    return run


def _held(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range of tokens: those in at least two different sets, with the number of sets, back to their blocks."""
    bucket = int(rows["bucket"].iloc[0])
    if bucket < 0:
        return rows
    entries, keys, shared, first = [], [], [], 0
    for at, r in enumerate(rows.itertuples(index=False)):
        counts, many = np.frombuffer(r.counts, np.uint32), np.frombuffer(r.many, np.uint32)
        entries.append((np.frombuffer(r.docs, np.uint16), np.frombuffer(r.names, np.int64), np.full(len(counts), at, np.int32)))
        # a token and the entry of its set (a set in a block) in one number
        keys.append((np.frombuffer(r.tokens, np.uint32).astype(U) << U(32)) | np.repeat(np.arange(first, first + len(counts), dtype=U), counts))
        first += len(counts)
        shared.append((many, np.frombuffer(r.many_counts, np.uint16), np.full(len(many), at, np.int32)))
    doc, name, at = (np.concatenate(x) for x in zip(*entries, strict=True))
    many, many_n, many_at = (np.concatenate(x) for x in zip(*shared, strict=True))
    key = np.concatenate(keys)
    del keys
    key.sort()
    token, entry = (key >> U(32)).astype(np.uint32), (key & _LOW).astype(np.uint32)
    del key
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), token[1:] != token[:-1]]))
    size = np.diff(np.append(start, len(token)))
    own = name[entry]
    held = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start) if len(start) else np.zeros(0, bool)
    # a token's sets in all: those of blocks where one has it, and of blocks where several do
    found, place = np.unique(many, return_inverse=True)
    total = np.bincount(place, many_n, len(found)).astype(np.int64)
    both = size.copy()
    if len(found) and len(start):
        here = np.minimum(np.searchsorted(found, token[start]), len(found) - 1)
        also = found[here] == token[start]
        total[here[also]] += size[also]
        both[also] = total[here[also]]
        held |= also
    held = np.repeat(held, size)
    df = np.repeat(np.minimum(both, 65535).astype(np.uint16), size)[held]
    entry, token = entry[held], token[held]
    many_df = np.minimum(total, 65535).astype(np.uint16)[place]
    own, some = dict(by_key(at[entry])), dict(by_key(many_at))
    none, out = np.zeros(0, np.int64), []
    for i in sorted({*own, *some}):
        a, m = own.get(i, none), some.get(i, none)
        out.append((bucket, int(rows["block"].iloc[i]), doc[entry[a]].tobytes(), df[a].tobytes(), b"", token[a].tobytes(), b"", many_df[m].tobytes()))
    del doc, name, at, many, many_n, many_at, token, entry, own, some
    give_back()
    return pd.DataFrame(out, columns=list(rows.columns))


def _rare(per: int, buckets: int):
    """Of one block of documents: id, size, keys, and the rarest held tokens of those that may link at all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        about = rows[rows["bucket"] < 0].iloc[0]
        ids, n, keys = np.frombuffer(about["docs"], np.int64), np.frombuffer(about["counts"], np.int64), np.frombuffer(about["names"], np.int64).reshape(-1, 2)
        shared, shared_n = np.frombuffer(about["tokens"], U), np.frombuffer(about["many_counts"], np.uint16)
        home, shared_df = _range_of(shared, buckets), np.zeros(len(shared), np.int64)
        doc, df, token = [], [], []
        for r in rows[rows["bucket"] >= 0].itertuples(index=False):
            doc.append(np.frombuffer(r.docs, np.uint16).astype(np.int64))
            df.append(np.frombuffer(r.counts, np.uint16).astype(np.int64))
            token.append((np.int64(r.bucket) << np.int64(32)) | np.frombuffer(r.tokens, np.uint32).astype(np.int64))
            back = np.frombuffer(r.many_counts, np.uint16)  # in the order they were sent
            a = int(np.searchsorted(home, r.bucket))
            shared_df[a : a + len(back)] = back
        doc.append(np.frombuffer(about["many"], np.uint16).astype(np.int64))
        df.append(np.repeat(shared_df, shared_n))
        token.append(np.repeat((home << np.int64(32)) | (shared & _LOW).astype(np.int64), shared_n))
        doc, df, token = np.concatenate(doc), np.concatenate(df), np.concatenate(token)
        held = np.bincount(doc, minlength=len(ids))
        open_ = (n > 0) & (held >= needed(n, per))
        keep = open_[doc]
        doc, df, token = doc[keep], df[keep], token[keep]
        order = np.lexsort((mix(token.view(U)), df, doc))
        doc, token = doc[order], token[order]
        first = np.searchsorted(doc, np.arange(len(ids)))
        give_back()
        look = np.where(open_, held - needed(n, per) + 1, 0)
        return pd.DataFrame({"doc_id": ids, "n": n, "k1": keys[:, 0], "k2": keys[:, 1], "rare": [token[f : f + m] if m else None for f, m in zip(first, look, strict=True)]})

    return run


def _texts_to_sets(k: int):
    """Sets of the member texts; a text that is not the one its id stands for is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, s in _sets(batches, k):
            if _keys(s) == (batch.column(3)[i].as_py(), batch.column(4)[i].as_py()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([s.tobytes()], pa.binary())], ["doc_id", "class", "tokens"])

    return run


def _unpacked(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in column]


def _class_links(per: int):
    """All links inside each class of a group of small classes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby("class", sort=False):
            ids = own["doc_id"].to_numpy()
            root = link_all(_unpacked(own["tokens"]), per)
            out.append(pd.DataFrame({"a": ids, "b": ids[root]}))
        give_back()
        return pd.concat(out)

    return run


def _chunk_links(per: int):
    """All links of a pair of chunks of a large class."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("left", ascending=False, kind="stable")
        ids = rows["doc_id"].to_numpy()
        root = link_all(_unpacked(rows["tokens"]), per, int(rows["left"].sum()))
        give_back()
        return pd.DataFrame({"a": ids, "b": ids[root]})

    return run


def _pivot_links(per: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                own = np.frombuffer(r.tokens, U)
                out += [(r.doc_id, p["doc_id"]) for p in r.pivots if linked(own, np.frombuffer(p["tokens"], U), per)]
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _large_links(sets: DataFrame, rare: DataFrame, per: int) -> DataFrame:
    """Links of the large classes (columns class, sets, doc_id, n, tokens; ``rare``: doc_id, token). Members linked with one
    pivot set are in one component already; only the others need to meet members, and of those, such as are in chunks
    with a set that shares a rare token and may match in size."""
    sets = stored(sets, "large")
    if sets.isEmpty():
        return sets.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    spread = F.xxhash64("doc_id")
    few = sets.filter(F.pmod(spread, F.col("sets")) < 4 * PIVOTS)  # about so many of each class
    pivots = few.groupBy("class").agg(F.slice(F.sort_array(F.collect_list(F.struct(spread.alias("h"), "doc_id", "tokens"))), 1, PIVOTS).alias("pivots"))
    met = sets.join(pivots, "class").select("doc_id", "tokens", "pivots").mapInPandas(_pivot_links(per), "a long, b long")
    met = stored(met, "pivots")
    by_pivot = components(met).withColumnRenamed("id", "doc_id")
    classed = sets.select("class", "sets", "doc_id", "n").join(by_pivot, "doc_id", "left")
    counts = classed.filter("component is not null").groupBy("class", "component").count()
    main = counts.groupBy("class").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    marked = classed.join(main, "class", "left").select("class", "sets", "doc_id", "n", F.coalesce(F.col("component") == F.col("main"), F.lit(False)).alias("in_main"))
    rest = marked.filter(~F.col("in_main")).groupBy("class").agg(F.ceil(F.count("*") / CHUNK_SETS).alias("rest_chunks"))
    # chunks of the rest are numbered first; classes without a rest are done
    chunk = F.when(F.col("in_main"), F.col("rest_chunks") + F.pmod(spread, F.ceil(F.col("sets") / CHUNK_SETS))).otherwise(F.pmod(spread, F.col("rest_chunks")))
    placed = stored(marked.join(rest, "class").withColumn("own", chunk).select("class", "doc_id", "n", "in_main", "own"), "placed")
    held = placed.join(rare, "doc_id")
    nodes = held.groupBy("class", "token", F.col("own").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.first("in_main").alias("other_main"))
    fits = (100 * F.least("n", "most") >= per * F.greatest("n", "least")) & ~(F.col("in_main") & F.col("other_main")) & (F.col("own") != F.col("other"))
    goes = held.join(nodes, ["class", "token"]).filter(fits).select("class", "doc_id", "own", "other").distinct()
    goes = goes.unionByName(placed.filter(~F.col("in_main")).select("class", "doc_id", "own", F.col("own").alias("other")))
    dealt = goes.join(sets.select("doc_id", "tokens"), "doc_id").select("class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "doc_id", "tokens")
    links = dealt.groupBy("class", "i", "j").applyInPandas(_chunk_links(per), "a long, b long")
    return met.unionByName(links)


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, value: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of the group that has their keys, null where there is none. Groups of very many rows are few, and
    meet them without a shuffle."""
    hot = F.col(size) * HOT_GROUPS > total
    near = rows.join(F.broadcast(groups.filter(hot).select(*keys, F.col(value).alias("found"))), keys, "left")
    far = near.filter("found is null").drop("found").join(groups.filter(~hot).select(*keys, value), keys, "left").select(*rows.columns, value)
    return near.filter("found is not null").select(*rows.columns, F.col("found").alias(value)).unionByName(far)


def jaccard_components(docs: DataFrame, k: int = 5, per: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    A text's set holds its distinct k-word shingles, of the whole text, however long; with fewer words, the whole sequence; a null
    or wordless text has none and links with nothing. Two texts link when 100 * intersection >= ``per`` * union. Equal sets are
    joined by their 128-bit name, all other links are found by comparing tokens (64-bit hashes of shingles). Ids are expected to
    be distinct; rows that repeat an id get their own text's component. A null id has component null and links nothing. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named, nameless = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, -(-size // TOKEN_BLOCK_BYTES))
    # as many tasks as ranges, so that a task reads no more of a larger table
    held = named.mapInArrow(_packed(k, buckets), _SHAPE).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_held, _SHAPE)
    about = stored(held.repartition(buckets, "block").groupBy("block").applyInPandas(_rare(per, buckets), "doc_id long, n long, k1 long, k2 long, rare array<bigint>"), "sets")
    # copies of a set are one set; its documents follow their smallest
    full = about.filter("n > 0")
    heads = full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    rare = full.filter("rare is not null").join(heads, ["k1", "k2", "n"]).filter(F.col("doc_id") == F.col("head"))
    rare = stored(rare.select("doc_id", "k1", "k2", "n", F.explode(F.array_distinct("rare")).alias("token")), "rare")
    groups = stored(rare.groupBy("token").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most"), F.count("*").alias("size")).filter(F.col("b") < F.col("most")), "groups")
    coarse = components(_met(rare.select("doc_id", "token"), groups, ["token"], "size", "b", rare.count()).filter("b is not null").select(F.col("doc_id").alias("a"), "b"))
    members = stored(rare.select("doc_id", "k1", "k2", "n").distinct().join(coarse, F.col("doc_id") == F.col("id")).select("doc_id", F.col("component").alias("class"), "k1", "k2", "n"), "members")
    classes = members.groupBy("class").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens_n"))
    total = members.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    one = members.select("doc_id", "class", "k1", "k2")
    texts = named.join(F.broadcast(one) if total["c"] <= BROADCAST_MEMBERS else one, "doc_id").select("doc_id", "text", "class", "k1", "k2")
    sets = stored(texts.mapInArrow(_texts_to_sets(k), "doc_id long, class long, tokens binary"), "tokens").dropDuplicates(["doc_id"])
    sets = sets.join(classes, "class")
    large = (F.col("sets") > CHUNK_SETS) | ((F.col("tokens_n") * 8 > LARGE_BYTES) & (F.col("sets") > 64))
    tasks = max(LEAST_TASKS, -(-total["n"] * 8 // TASK_BYTES))
    small = sets.filter(~large).groupBy(F.pmod(F.xxhash64("class"), F.lit(tasks)).alias("task")).applyInPandas(_class_links(per), "a long, b long")
    links = small.unionByName(_large_links(sets.filter(large).select("class", "sets", "doc_id", F.expr("octet_length(tokens) div 8").alias("n"), "tokens"), rare.select("doc_id", "token"), per))
    final = components(stored(links, "links"))  # written first, so that no task has two Python workers
    many = stored(heads.filter("copies > 1"), "copies")
    met = _met(about.select("doc_id", "n", "k1", "k2"), many, ["k1", "k2", "n"], "copies", "head", about.count())
    out = met.select("doc_id", "n", F.coalesce("head", "doc_id").alias("head"))
    out = out.join(final, F.col("head") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "head").alias("component_id"))
    lone = nameless.mapInArrow(_sizes(k), "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lone)


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int64())], ["n_shingles"])

    return run


def drop_near_copies(docs: DataFrame, k: int = 5, per: int = 80) -> DataFrame:
    """``docs`` without those that are not the smallest id of their component.

    Null, empty and wordless texts are like nothing and stay, as do rows with a null id; rows that repeat an id and a text stay or go together.
    Whole texts count. An empty table gives an empty one; all columns stay, whatever their names."""
    found = jaccard_components(docs, k, per)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
