"""Whitening of embeddings by exact arithmetic: integer scatter, its characteristic polynomial, its roots, its null spaces.

Entries are integers, so sums and products of all vectors are exact, whatever the order in which tasks add them. The
scatter's characteristic polynomial is found modulo many primes (Hessenberg reduction, a Spark task for some primes) and
put together by Chinese remaindering; its roots, all real, are isolated by counting sign changes of Taylor shifts; a
component is the null space of the scatter less its root, by inverse iteration in long fixed-point numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries beyond this (before scaling) are not representable and count as not finite.
LARGEST = float(1 << 52)
#: Bits of a limb, and rows whose limbs' products are summed in doubles without rounding.
LIMB, ROWS = 16, 1 << 18
#: Bits after the binary point of a root.
FRACTION = 64


def integers(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Vectors with entries, none of them null, infinite, not a number or beyond LARGEST."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - SHIFT


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Digits of 16 bits, the last one signed, as doubles."""
    out = []
    while True:
        low = x & ((1 << LIMB) - 1)
        if np.array_equal(x >> (LIMB - 1), np.where(x < 0, -1, 0)):
            return [*out, x.astype(np.float64)]
        out.append(low.astype(np.float64))
        x = x >> LIMB


def _products(d: int):
    """Exact sums of a task's entries (i < d) and of their products (pairs after those), by power of the limb."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for s, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(np.full(len(v), s)), pa.array(v)], ["i", "s", "v"])

        for batch in batches:
            x = _matrix(batch.column(0), d)
            for a in range(0, len(x), ROWS):
                limbs = _limbs(x[a : a + ROWS])
                for j, left in enumerate(limbs):
                    for k, right in enumerate(limbs):
                        own = np.zeros(d + len(upper[0]), np.int64)
                        own[d:] = np.rint((left.T @ right)[upper]).astype(np.int64)
                        if not k:
                            own[:d] = np.rint(left.sum(0)).astype(np.int64)
                        total[j + k] = total.get(j + k, 0) + own
                held += 1
            if held >= 256:  # sums stay below 2 ** 63
                yield from out()
                total, held = {}, 0
        yield from out()

    return run


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums of entries less SHIFT, and the scatter n * sum(x x') - S S' of vectors of length d (column ``x``); d squared numbers."""
    sums = vectors.select("x").mapInArrow(_products(d), "i long, s long, v long").groupBy("i", "s").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    n, value = vectors.count(), [0] * (d + d * (d + 1) // 2)
    for r in sums.toArrow().to_pylist():  # a few numbers for each pair of dimensions
        value[r["i"]] += int(r["v"]) << (LIMB * r["s"])
    s, at = value[:d], iter(value[d:])
    m = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            m[i][j] = m[j][i] = n * next(at) - s[i] * s[j]
    return n, s, m


def _is_prime(p: int) -> bool:
    return all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7)) and all(p % q for q in range(3, math.isqrt(p) + 1, 2))


def primes(product: int) -> list[int]:
    """Primes below 2 ** 31, from the largest down, whose product is above ``product``."""
    out, p, all_of = [], (1 << 31) - 1, 1
    while all_of <= product:
        if _is_prime(p):
            out.append(p)
            all_of *= p
        p -= 2
    return out


def hessenberg_polynomial(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x - m) modulo p: similar Hessenberg form, then its leading minors."""
    h, d = m.astype(np.int64) % p, len(m)
    for k in range(1, d - 1):
        found = np.flatnonzero(h[k:, k - 1])
        if not len(found):
            continue
        i = k + int(found[0])
        if i != k:
            h[[i, k]] = h[[k, i]]
            h[:, [i, k]] = h[:, [k, i]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        own = np.zeros(d + 1, np.int64)
        own[1:] = minors[k - 1, :-1]
        weight, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):  # entry (i, k - 1) times the subdiagonal between
            weight[i] = h[i, k - 1] * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        minors[k] = (own - (weight[:, None] * minors[:k] % p).sum(0)) % p
    return minors[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients (constant first) of det(x - m) of a positive semidefinite integer matrix."""
    d = len(m)
    mean = sum(m[i][i] for i in range(d)) // d + 1
    moduli = primes(2 * max(math.comb(d, k) * mean**k for k in range(d + 1)))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own = np.asarray([[x % p for x in row] for row in m], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([hessenberg_polynomial(own, p).tolist()], pa.list_(pa.int64()))], ["p", "c"])

    given = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), 4 * spark.sparkContext.defaultParallelism))
    found = given.mapInArrow(residues, "p long, c array<bigint>").collect()  # d numbers a prime; the primes are as many as the coefficients' bits ask for
    whole = math.prod(moduli)
    out = [0] * (d + 1)
    for r in found:
        rest = whole // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        out = [(a + c * unit) % whole for a, c in zip(out, r["c"], strict=True)]
    return [a - whole if 2 * a > whole else a for a in out]


def _value(c: list[int], z: int) -> int:
    out = 0
    for a in reversed(c):
        out = out * z + a
    return out


def _roots_above(c: list[int], z: int) -> int:
    """Roots greater than z, of a polynomial all of whose roots are real: sign changes of its Taylor shift by z."""
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += z * c[j + 1]
    signs = [a > 0 for a in c if a]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(c: list[int], k: int) -> list[int]:
    """The k largest roots of an integer polynomial with real roots, none negative, in units of 2 ** -FRACTION, rounded up, each as often as it is one."""
    d = len(c) - 1
    scaled = [a << (FRACTION * (d - i)) for i, a in enumerate(c)]
    top = (-c[d - 1] + 1) << FRACTION  # the sum of the roots
    out: list[int] = []
    todo = [(0, top, _roots_above(scaled, 0), 0)]
    while todo:
        low, high, above, beyond = todo.pop()  # roots above low, and above high
        n = above - beyond
        if not n or beyond >= k:
            continue
        if high - low == 1:
            out += [high] * n
        elif n == 1 and _value(scaled, high):
            side = _value(scaled, high) > 0
            while high - low > 1:
                mid = (low + high) // 2
                v = _value(scaled, mid)
                low, high = (low, mid) if not v or (v > 0) == side else (mid, high)
            out.append(high)
        else:
            mid = (low + high) // 2
            at = _roots_above(scaled, mid)
            todo += [(low, mid, above, at), (mid, high, at, beyond)]
    return sorted(out, reverse=True)[:k]


def _solve(lu: np.ndarray, order: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    x = b[order].copy()
    d = len(x)
    for i in range(1, d):
        x[i] -= (lu[i, :i] * x[:i]).sum() >> bits
    for i in range(d - 1, -1, -1):
        if i < d - 1:
            x[i] -= (lu[i, i + 1 :] * x[i + 1 :]).sum() >> bits
        x[i] = (x[i] << bits) // lu[i, i]
    return x


def null_vectors(m: list[list[int]], root: int, size: int) -> list[list[float]]:
    """Orthonormal vectors of the ``size`` directions in which m less root / 2 ** FRACTION is singular: inverse iteration in fixed point."""
    d = len(m)
    bits = 3 * FRACTION + 2 * max(1, max(abs(x) for row in m for x in row)).bit_length()
    lu = np.array([[((m[i][j] << FRACTION) - (root if i == j else 0)) << (bits - FRACTION) for j in range(d)] for i in range(d)], dtype=object)
    order = np.arange(d)
    for k in range(d):
        p = k + max(range(d - k), key=lambda i: abs(lu[k + i, k]))
        if p != k:
            lu[[k, p]], order[[k, p]] = lu[[p, k]], order[[p, k]]
        if not lu[k, k]:
            lu[k, k] = 1
        if k < d - 1:
            lu[k + 1 :, k] = (lu[k + 1 :, k] << bits) // lu[k, k]
            lu[k + 1 :, k + 1 :] -= (lu[k + 1 :, k, None] * lu[k, None, k + 1 :]) >> bits
    rng, found = np.random.default_rng(17), []
    for _ in range(size):
        v = np.array([int(x) << (bits - 20) for x in rng.integers(-(1 << 20), 1 << 20, d)], dtype=object)
        for _ in range(3):
            v = _solve(lu, order, v, bits)
            for _ in range(2):
                v = _unit(v, bits)
                for u in found:
                    v = v - ((u * ((u * v).sum() >> bits)) >> bits)
            v = _unit(v, bits)
        found.append(v)
    out = [np.array([float(x) / float(1 << bits) if bits < 1000 else float(x >> (bits - 200)) / float(1 << 200) for x in v]) for v in found]
    return [((v if v[np.abs(v).argmax()] > 0 else -v) / math.sqrt(float(v @ v))).tolist() for v in out]


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int((v * v).sum())) or 1
    return (v << bits) // length


def components(spark: SparkSession, m: list[list[int]], k: int = COMPONENTS) -> list[tuple[int, list[float]]]:
    """(root in units of 2 ** -FRACTION, unit vector) of the k largest positive roots; fewer where the scatter has a lower rank."""
    c = characteristic_polynomial(spark, m)
    rank = len(c) - 1 - next(i for i, a in enumerate(c) if a)
    roots = largest_roots(c, min(k, rank))
    # roots that agree to half of their fraction are one cluster, whose vectors are made orthogonal to each other
    groups: list[list[int]] = []
    for z in roots:
        if groups and groups[-1][-1] - z < 1 << (FRACTION // 2):
            groups[-1].append(z)
        else:
            groups.append([z])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = null_vectors(m, int(r["root"]), r["size"])
                yield pa.RecordBatch.from_arrays([pa.array([r["at"] + i for i in range(len(found))]), pa.array(found, pa.list_(pa.float64()))], ["at", "v"])

    first = np.cumsum([0, *map(len, groups)]).tolist()
    given = spark.createDataFrame([(a, str(g[len(g) // 2]), len(g)) for a, g in zip(first, groups, strict=False)], "at long, root string, size int").repartition(max(1, len(groups)))
    found = {r["at"]: r["v"] for r in given.mapInArrow(solve, "at long, v array<double>").collect()}  # k vectors
    return [(z, found[i]) for i, z in enumerate(roots)]


def _whitened(n: int, sums: list[int], vectors: list[list[float]], roots: list[float]):
    """deviation and whitened coordinates of each row; n * x - S is exact."""
    d = len(sums)
    basis = np.asarray(vectors).T / np.sqrt(np.asarray(roots))
    most = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            bound = n * int(np.abs(x).max(initial=0)) + most
            if bound * bound * d < 1 << 63:
                away = x * n - np.asarray(sums, np.int64)
                deviation = (away * away).sum(1).tolist()
            else:
                away = x.astype(object) * n - np.asarray(sums, dtype=object)
                deviation = [v if v < 1 << 63 else None for v in (away * away).sum(1).tolist()]
            w = away.astype(np.float64) @ basis
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component.

    Null and empty vectors and those that hold a null, an infinity, a NaN or an entry of 2 ** 52 and more take no part; nor do vectors of
    another length than the most frequent one (of equally frequent ones, the longest). Components of variance 0 have no coordinates:
    a table of one vector, of equal ones, or without any gives no row. Repeated rows count each; a null id is kept. A deviation
    beyond 64 bits is null. Variances that agree to 2 ** -32 share a space, of which any orthonormal vectors are taken. What meets on
    the driver is a few numbers for each pair of dimensions. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    own = stored(vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), integers(F.col(vector_col)).alias("x")), "vectors")
    lengths = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    none = spark.createDataFrame([], f"vec_id {dict(own.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if lengths is None:
        return none
    d = lengths["d"]
    own = own.filter(F.size("x") == d)
    n, sums, m = scatter(own, d)
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        return none
    found = components(spark, m, k)
    unit = 1 << FRACTION
    roots = [z / unit for z, _ in found]
    rows = stored(own.mapInArrow(_whitened(n, sums, [v for _, v in found], roots), f"vec_id {dict(own.dtypes)['vec_id']}, deviation long, w array<double>"), "whitened")
    w = [F.get("w", F.lit(i)) for i in range(len(found))]
    mean = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    centred = [c - F.lit(mean[i]) for i, c in enumerate(w)]
    pairs = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
    covariance = rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(covariance[a] - (i == j)) for a, (i, j) in enumerate(pairs))
    explained = F.array(*[F.lit(z / (trace * unit)) for z, _ in found])
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
