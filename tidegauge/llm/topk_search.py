"""Exact top-k inner products: longest vectors first, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are rotated so that the leading coordinates are the main singular directions of all of them and hold most of
every inner product; what the others can add is at most the product of the two remainders' lengths. Candidates are cut by
length into blocks. The longest ones are scored first and give each query a score that its k-th best cannot fall below;
a block whose vectors are too short for all queries of a chunk is never met with it. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Queries in a chunk and candidates in a block, which are shipped once for each pair of them that meets; longest vectors scored first.
QUERY_ROWS, CANDIDATE_ROWS, HEAD_ROWS = 1024, 8192, 2048
#: Lengths by which candidates are cut.
BANDS = 64
#: Leading coordinates, and random directions that they are found from (with fewer dimensions, exactly).
LEADING, SKETCH = 16, 64
#: Groups that tasks' sums of products meet in before they meet in one; parts of the table of blocks.
SLOTS = 32


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite, or it is empty."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when((F.size(vector) > 0) & ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _directions(dim: int) -> np.ndarray:
    return np.eye(dim) if dim <= SKETCH else np.random.default_rng(dim).standard_normal((dim, SKETCH))


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per dimension: the matrix of products of a task's vectors, times the directions; a narrow matrix, whatever the rows."""
    total: dict[int, np.ndarray] = {}
    slot = TaskContext.get().partitionId() % SLOTS
    for b in batches:
        for n, own in b.groupby(b["v"].map(len)):
            x = np.stack(own["v"].to_numpy()).astype(np.float64)
            total[n] = total.get(n, 0.0) + x.T @ (x @ _directions(n))
    yield pd.DataFrame([(n, slot, g.tobytes()) for n, g in total.items()], columns=["dim", "slot", "sum"])


def _added(rows: pd.DataFrame) -> np.ndarray:
    out = np.frombuffer(rows["sum"].iloc[0]).copy()
    for x in rows["sum"].iloc[1:]:
        out += np.frombuffer(x)
    return out


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "sum": [_added(rows).tobytes()]})


def _turn(rows: pd.DataFrame) -> pd.DataFrame:
    """The leading directions of a dimension: orthonormal, whatever they were found from, so that bounds hold."""
    dim = int(rows["dim"].iloc[0])
    turn = np.linalg.svd(_added(rows).reshape(dim, -1), full_matrices=False)[0][:, :LEADING]
    return pd.DataFrame({"dim": [dim], "turn": [np.ascontiguousarray(turn).tobytes()]})


def rotations(vectors: DataFrame) -> DataFrame:
    """dim, turn: the leading directions of all vectors of each dimension, found in the cluster in one pass."""
    sums = vectors.select("v").mapInPandas(_products, "dim int, slot int, sum binary").groupBy("dim", "slot").applyInPandas(_summed, "dim int, sum binary")
    return sums.groupBy("dim").applyInPandas(_turn, "dim int, turn binary")


_PACKED = "dim int, {} ids binary, floors binary, rows binary, most2 double, need double"


def _pack(*by: str):
    """The rows of a group behind each other, longest first: ids, floors (a score that the k-th best cannot fall below) and vectors."""

    def run(rows: pa.Table) -> pa.Table:
        norm2 = rows["norm2"].to_numpy()
        order = np.argsort(-norm2, kind="stable")
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(norm2), -1)[order]
        floor = rows["floor"].to_numpy(zero_copy_only=False).astype(np.float64)[order]  # null: not a number
        need = np.where(floor > 0, floor / np.sqrt(np.maximum(norm2[order], 1e-300)), 0.0).min()
        out = {c: rows[c].combine_chunks()[:1] for c in ("dim", *by)}
        out |= {"ids": pa.array([rows["vec_id"].to_numpy()[order].tobytes()], pa.binary()), "floors": pa.array([floor.tobytes()], pa.binary()), "rows": pa.array([v.tobytes()], pa.binary())}
        return pa.table(out | {"most2": pa.array([float(norm2.max())]), "need": pa.array([float(need)])})

    return run


def _packed(vectors: DataFrame, **by: str) -> DataFrame:
    """Blocks of rows with the same values of the columns named, given with their types."""
    own = vectors if "floor" in vectors.columns else vectors.withColumn("floor", F.lit(None).cast("double"))
    schema = _PACKED.format("".join(f"{c} {t}, " for c, t in by.items()))
    return own.select("dim", *by, "vec_id", "v", "norm2", "floor").groupBy("dim", *by).applyInArrow(_pack(*by), schema)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = ids != own
    scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(k: int):
    """Meet a chunk of queries with a block of candidates: per query, its k best of the block that can be among all k best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in batches:
            for r in pairs.itertuples(index=False):
                qid, cid = np.frombuffer(r.ids, np.int64), np.frombuffer(r.c_ids, np.int64)
                q, c = (np.frombuffer(x, np.int64).reshape(-1, r.dim).astype(np.float64) for x in (r.rows, r.c_rows))
                floor = np.frombuffer(r.floors).copy()
                floor[np.isnan(floor)] = -np.inf
                turn = np.frombuffer(r.turn).reshape(r.dim, -1)
                qr, cr = q @ turn, c @ turn
                q_norm, c_norm = np.sqrt((q**2).sum(1)), np.sqrt((c**2).sum(1))
                q_rest, c_rest = (np.sqrt(np.maximum(n**2 - (x**2).sum(1), 0)) for n, x in ((q_norm, qr), (c_norm, cr)))
                slack = 1e-6 * (1 + q_norm[:, None] * c_norm[None, :].max(initial=0.0))
                out: list[tuple] = []
                kept_s: list[np.ndarray] = [np.zeros(0)] * len(q)
                kept_i: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
                for a in range(0, len(c), 256):  # longest first
                    b = min(a + 256, len(c))
                    live = np.flatnonzero(q_norm * c_norm[a] * (1 + 1e-12) + slack[:, 0] >= floor)
                    if not len(live):
                        break
                    bound = qr[live] @ cr[a:b].T + q_rest[live, None] * c_rest[None, a:b] + slack[live]
                    for i, may in zip(live.tolist(), bound >= floor[live, None], strict=True):
                        at = a + np.flatnonzero(may)
                        if len(at):
                            s, j = _best(np.concatenate([kept_s[i], c[at] @ q[i]]), np.concatenate([kept_i[i], cid[at]]), qid[i], k)
                            kept_s[i], kept_i[i] = s, j
                            if len(s) == k:
                                floor[i] = max(floor[i], s[-1])
                for i in range(len(q)):
                    out += [(int(qid[i]), int(j), int(s)) for s, j in zip(kept_s[i], kept_i[i], strict=True)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _bands(own: DataFrame, count: int) -> DataFrame:
    """``own`` with band (a range of lengths) and part (of a band, by hash; about CANDIDATE_ROWS rows, also where very many are of one length)."""
    cuts = sorted(set(own.approxQuantile("norm2", [i / BANDS for i in range(1, BANDS)], 0.005))) if count else []
    band = F.lit(0)
    for x in cuts:
        band = band + (F.col("norm2") > x).cast("int")
    banded = own.withColumn("band", band)
    sizes = banded.groupBy("dim", "band").agg(F.ceil(F.count("*") / CANDIDATE_ROWS).alias("parts"))
    return banded.join(sizes, ["dim", "band"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row, its k highest inner products with all other rows (all, if there
    are fewer); ties go to the smaller id.

    ``vector_col`` holds arrays of long, of any length; a null or empty one takes no part, nor does a null id. Vectors of different
    lengths do not meet. Rows with the query's id are its own; repeated rows of another id count each, repeated query rows once.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("is_query")).filter("vec_id is not null and size(v) > 0")
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    own = stored(own.withColumn("norm2", norm2).withColumn("dim", F.size("v")), "vectors")
    turns = stored(rotations(own), "rotations")
    blocks = stored(_packed(_bands(own, own.count()), band="int", part="long"), "blocks")
    queries = own.filter("is_query").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "norm2", "dim")
    chunks = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    found = "query_id long, vec_id long, score long"
    # first the longest vectors of all, at most HEAD_ROWS
    head = _packed(own.orderBy(F.desc("norm2"), "vec_id").limit(HEAD_ROWS)).select("dim", F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"))
    asked = _packed(queries, chunk="long").join(turns, "dim")
    first = asked.join(F.broadcast(head), "dim").select("dim", "turn", "ids", "floors", "rows", "c_ids", "c_rows").mapInPandas(_search(k), found)
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    known = queries.join(floor, queries["vec_id"] == floor["query_id"], "left").drop("query_id")
    asked = stored(_packed(known, chunk="long").join(turns, "dim"), "chunks")
    # which blocks meet is settled on their names and lengths alone, dealt over many tasks; then they are fetched by name
    names = blocks.select("dim", "band", "part", "most2", F.pmod(F.xxhash64("band", "part"), F.lit(SLOTS)).alias("slot"))
    want = asked.select("dim", "chunk", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).alias("slot"))
    meet = want.join(names, ["dim", "slot"]).filter(F.sqrt("most2") * (1 + 1e-9) >= F.col("need")).select("dim", "chunk", "band", "part")
    shipped = blocks.select("dim", "band", "part", F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"))
    pairs = meet.join(shipped, ["dim", "band", "part"]).join(asked.select("dim", "chunk", "turn", "ids", "floors", "rows"), ["dim", "chunk"])
    out = pairs.select("dim", "turn", "ids", "floors", "rows", "c_ids", "c_rows").mapInPandas(_search(k), found)
    # k at most of each pair of blocks; one query's come together
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
