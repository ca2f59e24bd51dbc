"""The corpus operators against plain versions of their methods, and with the names, sizes and repeats that hurt."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, language_id, licences, mixing, pieces
from tidegauge.llm.exact_dedup import exact_groups
from tidegauge.llm.jaccard_join import drop_near_copies, jaccard_components
from tidegauge.llm.line_dedup import dedup_lines
from tidegauge.llm.lm_score import score_texts
from tidegauge.llm.quality import keep_good, quality
from tidegauge.llm.topk_search import top_k

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(11)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(300)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCABULARY, n))


def frame(spark, texts, source=None, lang=None):
    return spark.createDataFrame([(i, t, (lang or ["en"] * len(texts))[i], (source or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# 4


def test_quality_posteriors_by_loops(spark):
    r = np.random.default_rng(3)
    hosts = [f"h{i % 7}" if i % 11 else f"rare{i}" for i in range(300)]
    paths = [f"p{i % 3}" for i in range(300)]
    bad = [(hash_ % 5 < 2) for hash_ in r.integers(0, 100, 300)]
    texts = [prose(30, r).upper().replace(" ", "! ") if b else prose(30, r) for b in bad]
    labels = spark.createDataFrame([(i, int(not bad[i] if i % 6 else bad[i]), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality(frame(spark, texts, hosts, paths), labels).collect()}
    y = [int(not bad[i] if i % 6 else bad[i]) for i in range(0, 300, 2)]
    base = sum(y) / len(y)
    p = {i: 1 / (1 + math.exp(-(got[i].evidence + math.log(base / (1 - base))))) for i in got}
    q = {i: round(v, 12) for i, v in p.items()}

    def sums(keys):
        out = defaultdict(lambda: [0, 0.0, 0.0])
        for i, k in enumerate(keys):
            out[k][0] += 1
            out[k][1] += q[i]
            out[k][2] += q[i] * q[i]
        return out

    def strength(sites, above):
        many = {k: v for k, v in sites.items() if v[0] > 1}
        n, count = sum(v[0] for v in many.values()), len(many)
        spread = sum(v[0] * (v[1] / v[0] - above[k]) ** 2 for k, v in many.items())
        noise = sum(v[2] - v[1] ** 2 / v[0] for v in many.values()) / max(n - count, 1)
        binomial = sum(v[0] * above[k] * (1 - above[k]) for k, v in many.items()) / n
        return min(max(binomial / max((spread - noise * count) / n, 1e-9) - 1, 2.0), 1e4)

    host, path = sums(hosts), sums(list(zip(hosts, paths, strict=True)))
    rate = (sum(q.values()) + 1) / (len(q) + 2)
    by_host = strength(host, dict.fromkeys(host, rate))
    means = {h: (v[1] + by_host * rate) / (v[0] + by_host) for h, v in host.items()}
    by_path = strength(path, {k: means[k[0]] for k in path})
    for i, x in got.items():
        h, k = host[hosts[i]], path[hosts[i], paths[i]]
        host_rate = (h[1] - p[i] + by_host * rate) / (h[0] - 1 + by_host)
        path_rate = (k[1] - p[i] + by_path * host_rate) / (k[0] - 1 + by_path)
        score = 1 / (1 + math.exp(-(x.evidence + math.log(path_rate / (1 - path_rate)))))
        assert abs(x.host_rate - host_rate) < 1e-7 and abs(x.path_rate - path_rate) < 1e-7 and abs(x.score - score) < 1e-7


# 6


def test_language_fit_is_kernel_ridge_regression():
    """With every row a landmark, the folded weights are the solution of the explicit weighted kernel system."""
    r = np.random.default_rng(2)
    make = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "xyzabcé"}
    labels = [list(make)[i % 3] if i % 5 else "aa" for i in range(45)]
    texts = [" ".join("".join(r.choice(list(make[x]), 4)) for _ in range(6)) for x in labels]

    def grams(t):
        x = re.sub(r"\0+", "\0", "\0" + "".join(c.lower() if unicodedata.category(c)[0] == "L" else "\0" for c in t) + "\0")
        return {x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    sets = [grams(t) for t in texts]

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    k = np.asarray([[kernel(a, b) for b in sets] for a in sets])
    languages, n = sorted(make), len(texts)
    y = np.asarray([[1.0 if x == c else -1.0 for c in languages] for x in labels])
    w = np.asarray([1 / labels.count(x) for x in labels])
    w /= w.mean()
    ridge, loose = language_id.RIDGE * n / 10, language_id.RIDGE * n * 1e-6
    system = np.block([[w[:, None] * k + ridge * np.eye(n), w[:, None]], [(w @ k)[None, :], np.asarray([[w.sum() + loose]])]])
    solved = np.linalg.solve(system, np.concatenate([w[:, None] * y, (w @ y)[None, :]]))
    model = language_id.fit(texts, labels, [True] * n)
    other = [" ".join("".join(r.choice(list(make[x]), 4)) for _ in range(6)) for x in ("aa", "bb", "cc")] + ["zzz qqq"]
    got = model.scores([language_id.grams(language_id._letters(t.encode())) for t in other])
    want = np.asarray([[kernel(grams(t), s) for s in sets] for t in other]) @ solved[:n] + solved[n]
    assert model.languages == languages and np.abs(got - want).max() < 2e-4


# 8


def test_mix_rates_against_bisection(spark):
    r = np.random.default_rng(4)
    texts = [prose(int(n), r) for n in r.integers(1, 120, 300)]
    source = ["hot" if i % 3 else f"s{i % 4}" for i in range(300)]
    got = mixing.mix_rates(frame(spark, texts, source)).collect()
    for s in set(source):
        own = [x for x in got if x.source == s]
        size, target = np.asarray([x.size for x in own], float), own[0].target
        low, high = -1e3, 1e3
        for _ in range(200):
            lam = (low + high) / 2
            total = (size * 2 / (1 + np.exp(-np.clip(lam * size / size.mean(), -60, 60)))).sum()
            low, high = (lam, high) if total < target else (low, lam)
        if target < 2 * size.sum():
            rate = 2 / (1 + np.exp(-lam * size / size.mean()))
            assert np.abs(rate - [x.rate for x in own]).max() < 1e-3 and abs((size * [x.rate for x in own]).sum() - target) <= 2e-4 * target


def test_mix_of_repeated_rows(spark, monkeypatch):
    """Many rows of one key, more than are numbered at a time, share its copies; other columns may differ."""
    monkeypatch.setattr(mixing, "EXPLODED", 8)
    rows = [(None, "a b c", "en", "s", i % 3) for i in range(41)] + [(i, prose(9), "en", "t", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    rates = mixing.mix_rates(df).collect()
    own = [x.copies for x in rates if x.doc_id is None]
    assert len(rates) == 81 and len(own) == 41 and max(own) - min(own) <= 1 and max(own) <= 2
    taken = mixing.mix(df)
    assert taken.filter("doc_id is null").count() == sum(own) and taken.count() == sum(x.copies for x in rates)


def test_source_numbers_follow_code_points(spark):
    names = [f"{chr(97 + i % 26)}{i}" for i in range(300)]
    sized = spark.createDataFrame([(s, 10) for s in [*names, None]], "source string, size long").repartition(6)
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate([*sorted(names), None])}
    level = {round(got[s] / weight[s], 6) for s in got if got[s] < 20}
    assert len(level) == 1 and abs(sum(got.values()) - 1.5 * 10 * 301) < 1e-6 * 301


# 7


def test_exact_groups_in_turns(spark, monkeypatch):
    df = frame(spark, [f"t{i % 37}" if i % 2 else f"own {i}" for i in range(400)] + ["hot"] * 200)
    want = sorted(exact_groups(df).collect())
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 500)
    assert sorted(exact_groups(df).collect()) == want and max(r.group_size for r in want) == 200


# 5


def test_jaccard_of_a_passage_that_all_hold(spark):
    """Copies and a common passage shuffle once a block; links are those of all pairs."""
    r = np.random.default_rng(8)
    passage, body = prose(30, r), [prose(40, r) for _ in range(12)]
    texts = [f"{body[i % 12]} {passage}" for i in range(60)] + [f"{body[i % 12]} x{i} {passage}" for i in range(60)] + [passage] * 20
    got = {x.doc_id: x for x in jaccard_components(frame(spark, texts).repartition(3), 5, 80).collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert all(got[i].component_id == root(i) and got[i].n_shingles == len(sets[i]) for i in range(len(sets)))


# 1


@pytest.fixture(scope="module")
def licence_model():
    return licences.train([prose(25) for _ in range(200)])


def test_licence_chances_by_loops(licence_model):
    m = licence_model
    weight = {int(h): m.weights[i] for i, h in enumerate(m.vocabulary)}
    for t in ("Released under the MIT License.", "ab cd the GNU General Public License ef", prose(12), "Licensed under the Foo License"):
        grams, row = licences._grams([t])
        found, place = m.find(grams)
        number, family, chance, *_ = m.judge(row[found], place)
        z = np.sum([weight[int(h)] for h in set(grams.tolist()) if int(h) in weight], axis=0) + m.constant if len(found) else m.constant
        p = np.exp(z / m.heat - (z / m.heat).max())
        p /= p.sum()
        assert not len(number) or (abs(chance[0] - (1 - p[0])) < 1e-9 and family[0] == p[1:].argmax())
        words = [w for w in re.findall(r"[a-z0-9]+", t.lower())]
        want = {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        assert len(set(grams.tolist())) == len(want)


def test_licences_that_are_in_no_template(spark, licence_model):
    cases = {
        "// SPDX-License-Identifier: MIT": "MIT",
        "/* SPDX-License-Identifier: Apache-2.0 */": "Apache",
        "the whole of this code is governed by a BSD-style license": "BSD",
        "This is free and unencumbered software released into the public domain, by me": "Unlicense",
        "this module is licensed under the GNU Lesser General Public License, version 2.1 or later": "LGPL",
        "Apache License Version 2.0, January 2004": "Apache",
        "This work is licensed under the Open Publication License": "unknown",
    }
    got = licences.scan(frame(spark, [f"{prose(8)}\n\n{t}\n\n{prose(8)}" for t in cases]), model=licence_model).orderBy("doc_id").collect()
    assert [[h.family for h in r.hits] for r in got] == [[f] for f in cases.values()]


# 2


def test_top_k_of_many_dimensions(spark):
    r = np.random.default_rng(5)
    v = {i: [int(x) for x in r.integers(-400, 400, 1100)] for i in range(60)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, v array<bigint>").repartition(3)
    got = [tuple(x) for x in top_k(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 20, 40):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:3]
        want += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    assert got == want


# all

INSIDE = (
    "_i _id _copies _rows _size _source _bad _host _kept _both _p _gone _salt row rows id text_hash size copies n rank times own_host host bad salt lines hit kept both back block lang_pred score held_out unit bucket h turn digest "
    "maybe component class token own other in_main dim band part chunk floor norm2 vec_id ids x path evidence empty tail price place index file local before a.b back.x row.y both.pieces"
).split()


def test_columns_of_any_name_stay(spark):
    """Every name that a module uses inside may be a column of the caller."""
    texts = [f"menu\n{prose(12)}\nfoot {i}" for i in range(12)] + [None, ""]
    df = frame(spark, texts, source=["a", "b"] * 7)
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(INSIDE)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    values = {c: i for i, c in enumerate(INSIDE)}
    for out, new in ((dedup_lines(df), {"n_lines", "n_dropped"}), (mixing.mix(df), set()), (drop_near_copies(df), set()), (pieces.encode_and_decode(df), {"pieces", "back"}), (pieces.encode_texts(df), {"pieces"}), (keep_good(df, labels), set())):
        assert set(out.columns) == set(df.columns) | new
        row = out.first()
        assert all(row[c] == v for c, v in values.items() if c not in new)
    assert exact_groups(df).count() == score_texts(df).count() == jaccard_components(df).count() == licences.scan(df).count() == language_id.identify(df).count() == quality(df, labels).count() == 14


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and blank texts, one of several MB, ties, repeats, null sources and ids, extra columns; and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from compare import DATA

    long = " ".join(f"w{i % 9973} {'z' * (i % 5)}" for i in range(400_000))
    texts = [None, "", " \t\n", "one", "one", "a　b é 漢字 😀 ▁ \x00 x", long, *[f"head\n{prose(30)}" for _ in range(8)]]
    df = frame(spark, texts, source=[None if i % 4 == 0 else "s" for i in range(len(texts))])
    df = df.unionByName(df.filter("doc_id in (4, 7)")).unionByName(df.filter("doc_id in (3, 8)").withColumn("doc_id", F.lit(None).cast("long")))
    df = df.withColumn("_bad", F.lit(1)).withColumn("row", F.lit(2))
    assert len(long) > 2_000_000
    docs = df
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert stage(spark, df.limit(0), DATA).isEmpty(), name
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality":  # the stages after it see the odd rows all the same
            assert out.count() <= df.count()
            continue
        counts = Counter(r[0] for r in out.select("doc_id").collect())
        if name == "line_dedup":
            assert sum(counts.values()) == df.count()
        if name == "jaccard_join":
            assert counts[4] == 0 and counts[3] == 1 and counts[0] == counts[1] == 1
        if name == "mixing":
            assert max(counts.values()) <= 4 and counts[6] >= 1
        if name == "sentencepiece":
            assert out.filter("not lossless").isEmpty() and out.filter("doc_id = 6").first().n_pieces > 100_000
            continue
        docs = out


def test_lm_scores_do_not_depend_on_how_contexts_are_dealt(spark, monkeypatch):
    from tidegauge.llm import lm_score

    df = frame(spark, [prose(20) for _ in range(30)] + [None, ""])
    want = {r.doc_id: r.score for r in score_texts(df).collect()}
    monkeypatch.setattr(lm_score, "TOP_NODES", 0)
    got = {r.doc_id: r.score for r in score_texts(df).collect()}
    assert all(abs(got[i] - s) < 1e-5 * max(1, -s) for i, s in want.items())
