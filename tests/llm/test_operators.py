"""The corpus operators on small frames: against plain versions, and with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import context_tree as ct
from tidegauge.llm import exact_dedup, licences, mixing, pieces
from tidegauge.llm.exact_dedup import exact_groups
from tidegauge.llm.graph import components
from tidegauge.llm.jaccard_join import drop_near_copies, jaccard_components
from tidegauge.llm.language_id import identify
from tidegauge.llm.line_dedup import dedup_lines
from tidegauge.llm.lm_score import score_texts
from tidegauge.llm.quality import keep_good, quality
from tidegauge.llm.signature_tree import link_all
from tidegauge.llm.topk_search import quantised, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(1)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(400)]


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def prose(n, r=rng):
    return " ".join(r.choice(VOCABULARY, n))


def frame(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "one", "one", "A b C d e f", "a　b é 漢字 😀 ▁ \x00 x", "z" * 30_000, ("word " * 9_000)]


def odd(spark):
    """Odd rows, with a repeated row, null ids, a null source and lang, and columns whose names operators use inside."""
    df = frame(spark, ODD, source=["s", "s", None, "t", "t", "s", "s", "t", "s"], lang=["en", None, "en", "de", "de", "en", "fr", "de", "en"])
    df = df.unionByName(df.filter("doc_id = 5")).unionByName(df.filter("doc_id in (3, 6)").withColumn("doc_id", F.lit(None).cast("long")))
    return df.withColumn("h", F.lit(1)).withColumn("size", F.lit("x")).withColumn("n_lines", F.lit(0)).withColumn("row", F.lit(2)).withColumn("class", F.lit("c")).withColumn("target", F.lit(0.5)).withColumn("_s", F.lit(3))


@pytest.fixture(scope="module")
def cases(spark):
    return odd(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 7


def test_exact_groups(spark, cases, none):
    got = exact_groups(cases).collect()
    assert len(got) == cases.count() and exact_groups(none).isEmpty()
    groups = defaultdict(list)
    for r in cases.collect():
        groups[r.text or ""].append(r.doc_id)
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), r.doc_id == keep)


def test_exact_groups_beyond_the_filter(spark, monkeypatch):
    df = frame(spark, [f"t{i % 37}" for i in range(200)])
    want = sorted(exact_groups(df).collect())
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 1)
    assert sorted(exact_groups(df).collect()) == want and sum(r.kept for r in want) == 37


# 8


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 500}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total, open_, left = 1.5 * 1610, {"a": 3, "b": 1, "c": 2, None: 3}, {}
    while True:
        share = {s: (total - sum(left.values())) * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            left |= share
            break
        for s in over:
            left[s] = 2 * sizes[s]
            del open_[s]
    assert all(abs(got[s] - left[s]) < 1e-6 for s in sizes)


def test_mix_meets_targets(spark):
    r = np.random.default_rng(2)
    texts = [prose(int(n), r) for n in r.integers(1, 300, 900)]
    df = frame(spark, texts, source=[f"s{i % 5}" if i % 3 else "hot" for i in range(900)])
    got = mixing.mix_rates(df).collect()
    assert sorted(got) == sorted(mixing.mix_rates(df.repartition(7)).collect())
    assert all(0 <= x.taken <= 2 * x.size and x.taken == x.copies * x.size for x in got) and len(got) == 900
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 0.02 * own[0].target
    taken = mixing.mix(df).groupBy("doc_id").count()
    assert {x["doc_id"]: x["count"] for x in taken.collect()} == {x.doc_id: x.copies for x in got if x.copies}


def test_mix_odd_rows(spark, cases, none):
    got = mixing.mix_rates(cases).collect()
    assert len(got) == cases.count() and all(x.taken <= 2 * x.size for x in got)
    assert mixing.mix_rates(none).isEmpty() and mixing.mix(none).isEmpty()
    assert mixing.mix(cases).columns == cases.columns


def test_mix_is_native(spark):
    plan = mixing.mix(frame(spark, ["a b", "c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert not re.search("Python|Pandas|Arrow", dedup_lines(frame(spark, ["a b", "c"]))._jdf.queryExecution().toString())


# 9


def test_line_dedup(spark, cases, none):
    texts = [f"menu\nbody {i}\n\n{'rare' if i < 3 else i}" for i in range(40)] + ["menu", None]
    df = frame(spark, texts, source=["a"] * 40 + ["b", "a"])
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[0].text == "body 0\n\nrare" and got[0].n_dropped == 1 and got[0].n_lines == 4
    assert got[40].text == "menu" and got[41].text is None and got[41].n_lines == 0
    out = dedup_lines(cases)
    assert out.count() == cases.count() and set(out.columns) == {*cases.columns, "n_dropped"} and dedup_lines(none).isEmpty()


def test_line_dedup_beyond_the_broadcast(spark, monkeypatch):
    from tidegauge.llm import line_dedup

    df = frame(spark, [f"menu\nbody {i}" for i in range(30)])
    want = sorted(dedup_lines(df).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(dedup_lines(df).collect()) == want


# 5


def plain_components(texts, k, per):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= per * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(r, groups=12, most=9):
    texts, passage = [], prose(60, r)
    for g in range(groups):
        words = prose(int(r.integers(3, 260)), r).split()
        for _ in range(int(r.integers(1, most))):
            own = list(words)
            for _ in range(int(r.integers(0, 4))):
                own[int(r.integers(0, len(own)))] = str(r.choice(VOCABULARY))
            texts.append(" ".join(own) + (" " + passage if g % 3 == 0 else ""))
    return texts + ["", None, "one two", "One  TWO", "x"]


@pytest.mark.parametrize(("k", "per"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, per):
    texts = near_copies(np.random.default_rng(k))
    got = [tuple(r) for r in jaccard_components(frame(spark, texts), k, per).orderBy("doc_id").collect()]
    assert got == plain_components(texts, k, per)


def test_jaccard_large_classes(spark, monkeypatch):
    from tidegauge.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 6)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "BROADCAST_MEMBERS", 0)
    texts = near_copies(np.random.default_rng(9), 4, 40)
    got = [tuple(r) for r in jaccard_components(frame(spark, texts), 4, 85).orderBy("doc_id").collect()]
    assert got == plain_components(texts, 4, 85)


def test_signature_tree_finds_all_links():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(15)]
    sets = [np.unique(np.concatenate([b[int(r.integers(0, 10)) :], r.integers(0, 2**63, int(r.integers(0, 6))).astype(np.uint64)])) for b in base for _ in range(6)]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    for split in (None, 40):
        got = link_all(sets, 85, split)
        assert [min(j for j in range(len(sets)) if got[j] == got[i]) for i in range(len(sets))] == [root(i) for i in range(len(sets))]


def test_jaccard_odd_rows(spark, cases, none):
    got = jaccard_components(cases)
    assert got.count() == cases.count() and jaccard_components(none).isEmpty()
    assert got.filter("doc_id is null and component_id is not null").isEmpty()
    assert [r.component_id for r in got.filter("doc_id in (3, 4)").collect()] == [3, 3]
    assert drop_near_copies(cases).columns == cases.columns and drop_near_copies(cases).filter("doc_id = 4").isEmpty()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(5)
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# 10


def test_lm_base_score(spark, cases, none):
    texts = [prose(30) for _ in range(60)] + [None, "", "unheard word"]
    df = frame(spark, texts)
    tokens = [[*WORD.findall(lower(t or "")), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for i, own in enumerate(tokens) if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in score_texts(df).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-9 * max(1, abs(r.base_score))
        assert r.score <= 0
    assert score_texts(cases).count() == cases.count() and score_texts(none).isEmpty()


def test_lm_tail_words_meet_their_counts(spark, monkeypatch):
    from tidegauge.llm import lm_score

    df = frame(spark, [prose(30) for _ in range(40)])
    want = {r.doc_id: r for r in score_texts(df).collect()}
    monkeypatch.setattr(lm_score, "HEAD", 20)
    for r in score_texts(df).collect():
        assert abs(r.base_score - want[r.doc_id].base_score) < 1e-9 and r.n_known == want[r.doc_id].n_known and r.score == want[r.doc_id].score


def plain_weighting(words, depth):
    """Sequentially coded context-tree weighting of given words: log2 of the whole, from the recursive definition over counts."""
    nodes = defaultdict(lambda: [0, 0])
    for w in words:
        before = bytes([ct.START])
        for byte in [*w, ct.WORD_END]:
            for d in range(min(len(before), depth) + 1):
                for j in range(8):
                    nodes[d, before[len(before) - d :], (1 << j) | (byte >> (8 - j))][(byte >> (7 - j)) & 1] += 1
            before += bytes([byte])
    return nodes


def test_context_tree_probabilities():
    words = [b"abc", b"abd", b"b", b"abc", "é".encode()]
    cut = np.cumsum([0, *map(len, words)])
    code, depth, _ = ct.position_grams(np.frombuffer(b"".join(words), np.uint8), cut[:-1], cut[1:])
    tree = ct.ContextTree(ct.depth_tables(code, depth, np.ones(len(code), np.int64)))
    for i in range(len(code)):  # chances of all bytes after a context sum to one
        every = (code[i] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((2 ** tree.log2(every, np.full(256, depth[i]))).sum() - 1) < 1e-6
    nodes = plain_weighting(words, ct.DEPTH)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def kids(d, context, bits):
        return [k for k in nodes if k[0] == d + 1 and k[2] == bits and k[1][1:] == context]

    def weighted(d, context, bits):
        a, b = nodes[d, context, bits]
        below = kids(d, context, bits)
        if not below:
            return kt(a, b)
        rest = [a - sum(nodes[k][0] for k in below), b - sum(nodes[k][1] for k in below)]
        deep = sum(weighted(*k) for k in below) + kt(*rest)
        return math.log(0.5) + max(kt(a, b), deep) + math.log1p(math.exp(-abs(kt(a, b) - deep)))

    def chance(path, i=0):
        a, b = nodes[path[i]]
        own = (b + 0.5) / (a + b + 1)
        if i + 1 == len(path) or not kids(*path[i]):
            return own
        share = math.exp(kt(a, b) - math.log(2) - weighted(*path[i]))
        return share * own + (1 - share) * chance(path, i + 1)

    word, before = words[0], bytes([ct.START])
    total = 0.0
    for byte in [*word, ct.WORD_END]:
        for j in range(8):
            path = [(d, before[len(before) - d :], (1 << j) | (byte >> (8 - j))) for d in range(min(len(before), ct.DEPTH) + 1)]
            p = chance(path)
            total += math.log2(p if (byte >> (7 - j)) & 1 else 1 - p)
        before += bytes([byte])
    assert abs(tree.log2(code[:4], depth[:4]).sum() - total) < 1e-4


# 3


def test_pieces_round_trip(spark, cases, none):
    out = pieces.decode_pieces(pieces.encode_texts(cases), out_col="back")
    assert out.filter(~F.col("text").eqNullSafe(F.col("back"))).isEmpty() and out.count() == cases.count()
    assert pieces.encode_texts(none).isEmpty()
    once = pieces.encode_and_decode(cases).select("doc_id", "text", "pieces", "back")
    assert once.exceptAll(out.select("doc_id", "text", "pieces", "back")).isEmpty()
    again = pieces.encode_texts(cases.repartition(3))
    a, b = (sorted((str(r.doc_id), r.text or "", r.pieces or []) for r in df.collect()) for df in (out, again))
    assert a == b


def test_pieces_are_drawn_by_weight():
    v = pieces.load()
    own, n = pieces.Lattices(v), 60_000
    ids, per = own.encode(["abcde"] * n, np.arange(n))
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(per)[:-1]))
    weight = {p.replace(pieces.BLANK, " "): ((r + pieces.OFFSET) ** -pieces.SHARPNESS, i) for r, (i, p) in enumerate((i, p) for i, p in enumerate(v.pieces) if p)}

    def ways(s):
        if not s:
            return {(): 1.0}
        return {(weight[s[:m]][1], *t): w * weight[s[:m]][0] for m in range(1, len(s) + 1) if s[:m] in weight for t, w in ways(s[m:]).items()}

    every = ways(" abcde")
    total = sum(every.values())
    assert set(got) <= set(every)
    assert all(abs(got[k] / n - w / total) < 0.01 for k, w in every.items())


# 2


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=12)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 12), (302, [1.0] * 5), (100, [1.0, None] * 6), (303, []), (None, [1.0] * 12)]
    rows += [(400 + i, rows[7][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", quantised(F.col("embedding")).alias("v"), F.lit(1).alias("norm2"))
    got = [tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in sorted(i for i in v if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
        want += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    assert got == want
    assert top_k(df.limit(0), F.lit(True)).isEmpty()


# 6


def test_language_id(spark, cases, none):
    r = np.random.default_rng(5)
    make = {"aa": "abcdef", "bb": "klmnop", "cc": "uvwxyé"}
    langs = [list(make)[i % 3] for i in range(240)]
    texts = [" ".join("".join(r.choice(list(make[x]), 4)) for _ in range(20)) for x in langs]
    got = identify(frame(spark, [*texts, None, "123 --"], lang=[*langs, "aa", "bb"])).collect()
    assert all(x.lang_pred == langs[x.doc_id] for x in got if x.doc_id < 240 and x.held_out)
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.doc_id >= 240)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in got)
    assert identify(cases).count() == cases.count() and identify(none).isEmpty()


# 1


def test_licences(spark, cases, none):
    ordinary = [prose(25) for _ in range(60)]
    model = licences.train(ordinary)
    texts = [f"{prose(10)}\n{t}\n{prose(12)}" for own in licences.TEMPLATES.values() for t in own] + ordinary + [None, ""]
    want = [f for f, own in licences.TEMPLATES.items() for _ in own]
    got = {r.doc_id: r for r in licences.scan(frame(spark, texts), model=model).collect()}
    found = [(got[i].hits[0].family if got[i].hits else None) for i in range(len(want))]
    assert found == want and all(got[i].hits[0].paragraph == 1 for i in range(len(want)))
    assert all(not got[i].hits for i in range(len(want), len(texts)))
    unsure = licences.scan(frame(spark, ["Licensed under the Wonderful Public License version 7"]), model=model).first()
    assert not unsure.hits or unsure.hits[0].family in ("unknown", *licences.TEMPLATES)
    assert licences.scan(cases).count() == cases.count() and licences.scan(none).isEmpty()


# 4


def test_quality(spark, cases, none):
    r = np.random.default_rng(6)
    texts = [prose(40, r) if i % 4 else prose(30, r).upper().replace(" ", "!! ") for i in range(400)] + ["", None]
    df = frame(spark, texts, source=[f"s{i % 9}" for i in range(402)])
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(0, 400, 3)] + [(9999, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality(df, labels).collect()}
    assert sum(got[i].keep == bool(i % 4) for i in range(400)) >= 396
    assert not got[400].keep and not got[401].keep and got[400].score == 0
    assert keep_good(df, labels).count() == sum(x.keep for x in got.values())
    assert quality(cases, labels).count() == cases.count() and quality(none, labels).isEmpty()
    assert quality(df, labels.limit(0)).filter("keep").count() == 400


def test_sparse_sites_are_drawn_to_the_rate_above(spark):
    r = np.random.default_rng(8)
    texts = [prose(40, r) if i % 2 else prose(30, r).upper().replace(" ", "!! ") for i in range(300)]
    source = ["good" if i % 2 else "bad" for i in range(299)] + ["alone"]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 290)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality(frame(spark, texts, source=source), labels).collect()}
    assert got[2].path_rate < got[299].path_rate < got[3].path_rate


def test_lm_learns_every_context_of_running_text(spark):
    """Against the plain definition, over whole texts: contexts seen once count, and so does what stands before a word."""
    texts = [prose(6, np.random.default_rng(i)) for i in range(25)] + ["", None, "abc  ABC é"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    coded = [b"".join(w.encode() + b" " for w in WORD.findall(lower(t or ""))) + b"\n" for t in texts]
    counts = defaultdict(lambda: [0, 0])

    def path(before, byte, j):
        return [(before[len(before) - d :], (1 << j) | (byte >> (8 - j))) for d in range(ct.DEPTH + 1)]

    def bits(text):
        text = bytes(ct.DEPTH) + text
        return [(path(text[i - ct.DEPTH : i], text[i], j), (text[i] >> (7 - j)) & 1) for i in range(ct.DEPTH, len(text)) for j in range(8)]

    for t, out in zip(coded, held, strict=True):
        for nodes, bit in [] if out else bits(t):
            for k in nodes:
                counts[k][bit] += 1
    kids = defaultdict(list)
    for context, lead in counts:
        if context:
            kids[context[1:], lead].append((context, lead))

    def own(k):
        a, b = counts[k]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    weight, share = {}, {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        deep = sum(weight[c] for c in kids[k]) if len(k[0]) < ct.DEPTH else None
        both = own(k) if deep is None else np.logaddexp(own(k), deep)
        share[k], weight[k] = math.exp(own(k) - both), both - (0 if deep is None else math.log(2))

    def log10(text):
        total = 0.0
        for nodes, bit in bits(text):
            mass, sure, p = 1.0, 0.0, 0.5
            for k in nodes:
                if k not in counts:
                    break
                kt = (counts[k][1] + 0.5) / (sum(counts[k]) + 1)
                p, mass, sure = sure + mass * kt, mass * (1 - share[k]), sure + mass * share[k] * kt
            total += math.log10(p if bit else 1 - p)
        return total

    assert any(held)
    for r in score_texts(frame(spark, texts)).collect():
        assert r.n_bytes == len(coded[r.doc_id]) and abs(r.score - log10(coded[r.doc_id])) < 1e-5 * max(1, -r.score)


def test_language_id_of_many_scripts(spark):
    """Two languages of one script whose letters are beyond the 62 that most texts have, beside many letters of others."""
    r = np.random.default_rng(6)
    spans = {"cyr": (0x430, 30), "gre": (0x3B1, 24), "geo": (0x10D0, 30), "zh": (0x4E00, 40), "ja": (0x4F00, 40), "arm": (0x561, 30)}
    share = [*["cyr", "gre", "geo", "arm"] * 5, "zh", "ja"]
    langs = [share[i % len(share)] for i in range(440)]
    texts = [" ".join("".join(chr(spans[x][0] + k) for k in r.integers(0, spans[x][1], 4)) for _ in range(20)) for x in langs]
    got = [x for x in identify(frame(spark, texts, lang=langs)).collect() if x.held_out]
    assert {langs[x.doc_id] for x in got} == set(spans) and all(x.lang_pred == langs[x.doc_id] for x in got)


def test_language_id_keeps_every_language(spark):
    from tidegauge.llm.language_id import sample

    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 450).cast("string")).alias("lang"))
    assert sample(docs, "doc_id", "lang").select("lang").distinct().count() == 450


def test_licences_wrapped_over_lines(spark):
    import textwrap

    model = licences.train([prose(25) for _ in range(60)])
    notices = [(f, max(licences.TEMPLATES[f], key=len)) for f in ("MIT", "GPL", "BSD")]
    texts, want = [], []
    for family, t in notices:
        for width in (80, 50, 30):
            texts += [prose(9) + "\n\n" + textwrap.fill(t, width) + "\n\n" + prose(8), prose(9) + "\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, width)) + "\n" + prose(8)]
            want += [(family, 2), (family, 1)]
    texts.append(prose(5) + "\nReleased under the MIT License.\n" + prose(6))
    want.append(("MIT", 1))
    for r in licences.scan(frame(spark, texts), model=model).collect():
        assert [h.family for h in r.hits] == [want[r.doc_id][0]] and want[r.doc_id][1] - 1 <= r.hits[0].paragraph <= want[r.doc_id][1], (texts[r.doc_id], r.hits)
