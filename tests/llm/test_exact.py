"""Suffix arrays, Merkle manifests and whitening against plain versions."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import merkle, whitening
from tidegauge.llm.substring_dedup import Sizes, dedup_substrings
from tidegauge.llm.suffix_array import permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(29)
WORDS = ["".join(rng.choice(list("abcdeéß"), 5)) for _ in range(40)]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


# 11


@pytest.mark.parametrize("symbols", [1, 2, 3, 26])
def test_suffix_array_by_sorting(symbols):
    r = np.random.default_rng(symbols)
    for n in [1, 2, 3, *r.integers(4, 150, 60).tolist()]:
        t = r.integers(0, symbols, n).astype(np.uint8)
        t = np.tile(t[: max(1, n // 4)], 5) if n % 3 == 0 else t
        b = bytes(t.tolist())
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023
        common = permuted_prefixes(t, sa)
        for i, j in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            k = 0
            while i + k < len(b) and j + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            assert common[j] == k


def plain_dedup(rows, w):
    """rows: (id, text); a null id comes last."""
    seen, out = set(), {}
    for i, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - w + 1):
            if b[a : a + w] in seen:
                gone[a : a + w] = True
            seen.add(b[a : a + w])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone].tolist())
        out[i] = (len(b), int(gone.sum()), len(edges) // 2, [tuple(x) for x in edges.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest(), kept)
    return out


def deduped(df, sizes):
    got = dedup_substrings(df, sizes=sizes, keep=True).collect()
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.spans], r.kept_sha256, bytes(r.kept))) for r in got]


SMALL = {"unit": 3000, "block": 400, "bucket": 2000, "shard": 2000}


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(window=21), Sizes(hot=5, **SMALL), Sizes(window=20, hot=1, **SMALL)])
def test_repeated_substrings_by_sets(spark, sizes):
    base = prose(400)
    rows = [(1, base), (2, base), (0, prose(30)), (3, None), (4, ""), (5, "a" * 1000), (6, "b" + "a" * 500), (7, base[:300] + prose(20) + base[500:900]), (8, "xy" * 400), (None, base[10:700]), (9, base * 3), (10, "é" * 49), (11, "é" * 50), (12, "é" * 51)]
    rows += [(20 + i, prose(5) + base[100 : 190 + i] + prose(6)) for i in range(60)]
    got = deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), sizes)
    assert len(got) == len(rows) and dict(got) == plain_dedup(rows, sizes.window)


def test_repeated_substrings_of_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(empty).count() == 0
    base = prose(60)
    rows = [(1, base, 7), (1, base, 8), (1, base, 9), (2, prose(40), 1), (2, base[:200], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `unit` int").withColumn("a.b", F.lit(1)).withColumn("n_bytes", F.lit("x")).withColumn("ord", F.lit(0))
    got = dedup_substrings(df).collect()
    assert Counter((r.doc_id, r.n_removed == r.n_bytes) for r in got) == {(1, False): 1, (1, True): 2, (2, True): 1, (2, False): 1}
    long = prose(400_000)  # over two million bytes, and then the same from within
    rows = [(1, long), (2, "x" + long[50_000:90_000] + "y")]
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(long[50_000:90_000].encode())
    assert got[2].n_removed == n and got[2].n_spans == 1
    assert got[1].n_removed == 0 and got[1].kept_sha256 == hashlib.sha256(long.encode()).hexdigest()


# 12


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def plain_tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain_path(tree, i):
    out = []
    for level in tree[:-1]:
        a = i - i % 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def plain_proofs(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {g: sorted((r for r in rows if r.lang == g), key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text))) for g in langs}
    trees = {g: plain_tree([plain_leaf(r, r.text) for r in by[g]]) for g in langs}
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            path = plain_path(trees[g], i) + plain_path(top, k)
            bad = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            x = plain_leaf(r, r.text.translate(low) if bad else r.text)
            for a, b in path:
                x = h(*a, x, *b)
            out.append((r.doc_id, plain_leaf(r, r.text), trees[g][-1][0], top[-1][0], h(*["".join(a + b) for a, b in path]), x, x == top[-1][0]))
    return out


def test_proofs_by_plain_trees(spark):
    """More rows than a subtree, so that a level between is made again above the kept one; odd rows in all columns."""
    texts = [None, "", "É ab", "ABC", "abc", "Zz" * 40_000]
    rows = [(i, texts[i % 6] if i % 7 else f"Text {i}", "en" if i % 5 else ["de", None, "Éx"][i % 3], None if i % 11 == 0 else f"s{i % 4}", None if i % 13 == 0 else i) for i in range(900)]
    rows += [(None, "a", "en", "s", 1), (None, None, None, None, None), (5, "twice", "en", "s", 1), (5, "twice", "en", "s", 1), (5, "thrice", "en", "s", 1), (901, "alone", "zz", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    more = df.withColumn("pos", F.lit(1)).withColumn("h", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("label", F.lit(3))
    got = [tuple(r) for r in merkle.verified_rows(more).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(plain_proofs(df.collect()), key=key)
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(4, "Ab", None, "s", 2)], SCHEMA)
    assert [tuple(r) for r in merkle.verified_rows(one).collect()] == plain_proofs(one.collect())
    assert merkle.verified_rows(one.limit(0)).count() == 0


def test_a_manifest_keeps_every_third_level(spark):
    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), merkle.leaf(F.col("id")).alias("h"))
    m = merkle.build(df, "lang", "doc_id")
    kept = [b.select(F.explode("nodes")).count() for b in (m.leaves, *m.levels)]
    assert kept == [1200, 3, 1]
    tree = plain_tree([h(f"{len(str(i))}:{i}") for i in range(1200)])
    assert m.root == tree[-1][0]


# 13


def plain_polynomial(m):
    """Faddeev-LeVerrier with fractions; constant first."""
    d = len(m)
    c, k = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for i in range(1, d + 1):
        k = [[sum(m[a][x] * k[x][b] for x in range(d)) + (c[-1] if a == b else 0) for b in range(d)] for a in range(d)]
        c.append(-sum(sum(m[a][x] * k[x][a] for x in range(d)) for a in range(d)) / i)
    return [int(x) for x in reversed(c)]


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial_by_fractions(spark, d):
    r = np.random.default_rng(d)
    x = r.integers(-(10**6), 10**6, (3 if d == 5 else 12, d)).tolist()  # of 3 vectors in 5 dimensions the rank is lower
    m = [[sum(v[a] * v[b] for v in x) for b in range(d)] for a in range(d)]
    assert whitening.characteristic_polynomial(spark, m) == plain_polynomial(m)


def test_roots_as_often_as_they_are_roots():
    c = [1]
    for root in (3, 3, 3, 10**12, 7, 0):
        c = [b - root * a for a, b in zip([*c, 0], [0, *c], strict=True)]
    unit = 1 << whitening.FRACTION
    assert whitening.largest_roots(c, 5) == [r * unit for r in (10**12, 7, 3, 3, 3)]


def whitened(df):
    rows = whitening.whiten(df).collect()
    return rows, {(r.vec_id, r.component): r.whitened for r in rows}


def test_whitening_by_floating_point(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (300, 12)) * np.arange(1, 13)
    bad = [[None] + [0.5] * 11, [float("nan")] * 12, [float("inf")] + [1.0] * 11, None, [], [1.0], [1e300] * 12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("w", F.lit(2)).withColumn("a.b", F.lit(3))
    got, by = whitened(df)
    y = np.floor(x * 1024) + 100000
    s, n = y.astype(np.int64).sum(0), len(y)
    e, v = np.linalg.eigh((y - y.mean(0)).T @ (y - y.mean(0)) / n)
    want = (y - y.mean(0)) @ v[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    out = np.array([[by[i, k] for k in range(1, 9)] for i in range(n)])
    assert np.allclose(out * np.sign((out * want).sum(0)), want, atol=1e-9) and len(got) == 8 * n
    first = {q.vec_id: q for q in got if q.component == 1}
    assert all(first[i].deviation == int(((n * y[i].astype(np.int64) - s) ** 2).sum()) for i in range(n))
    assert all(q.n == n and abs(q.explained - e[::-1][q.component - 1] / e.sum()) < 1e-9 and q.identity_error < 1e-9 for q in got)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, schema)).count() == 0
    # rank 1, ties, a null id, large entries whose sums pass 64 bits
    got, _ = whitened(spark.createDataFrame([(None, [0.0, 1e12]), (2, [0.0, -1e12]), (2, [0.0, -1e12])], schema))
    assert sorted(q.component for q in got) == [1, 1, 1] and got[0].identity_error < 1e-9 and {q.deviation for q in got} == {None}
    square = [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got, by = whitened(spark.createDataFrame(square, schema))
    w = np.array([[by[i, k] for k in (1, 2)] for i in range(4)])
    assert np.allclose(w.T @ w / 4, np.eye(2), atol=1e-12) and len(got) == 8
