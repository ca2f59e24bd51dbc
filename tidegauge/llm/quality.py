"""Quality classification with hierarchical empirical Bayes.

A logistic regression on a document's own surface gives its evidence. Evidence is pooled by host and by path within
host in grouped aggregations; each site's rate is drawn towards the rate above it, the more so the fewer documents it
has and the less sites differ (beta priors fitted by moments). A document's score combines its own evidence with the
rate of its path, from which the document itself is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .words import blocks

#: Most labelled rows that the regression is fitted on (drawn by hash of the id). Everything else covers all rows.
TRAIN_ROWS = 20_000
RIDGE = 1.0
FEATURES = ("log_words", "word_bytes", "upper", "digit", "symbol", "bang", "bar", "stop", "high", "distinct", "repeat", "lines")

_CLASSES = np.zeros((256, 7), bool)
_CLASSES[65:91, 0] = True  # upper case
_CLASSES[48:58, 1] = True  # digits
_CLASSES[[ord(c) for c in "#$%&*<>=~^{}[]\\@+_`"], 2] = True
_CLASSES[ord("!"), 3] = True
_CLASSES[ord("|"), 4] = True
_CLASSES[[ord(c) for c in ".,;:?"], 5] = True
_CLASSES[128:, 6] = True
_BITS = (_CLASSES * (1 << np.arange(7))).sum(1).astype(np.uint8)


def _surface(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        parts = [np.zeros((0, len(FEATURES)))]
        for b in blocks(column, lower=False):
            size = np.maximum(np.diff(b.offsets), 1).astype(float)
            kind = _BITS[b.data]

            def per_row(mask: np.ndarray, b=b) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(mask)])
                return total[b.offsets[1:]] - total[b.offsets[:-1]]

            shares = [per_row((kind >> i) & 1) / size for i in range(7)]
            words = np.diff(b.first)
            n = np.maximum(words, 1).astype(float)
            h = b.hashes()
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[b.first[:-1][words > 0]] = False
            runs = np.concatenate([[0], np.cumsum(same)])
            distinct = np.asarray([len(np.unique(h[a:z])) for a, z in zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True)], float)
            lines = per_row(b.data == 10)
            parts.append(np.stack([np.log1p(words), size / n, *shares, distinct / n, (runs[b.first[1:]] - runs[b.first[:-1]]) / n, lines / n], 1))
        x = np.concatenate(parts)
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))


def surface(text: Column) -> Column:
    """FEATURES of a whole text as array<double>; null counts as empty."""
    return F.arrow_udf(_surface, "array<double>")(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and constant, by Newton steps on the ridge-penalised likelihood; features are standardised inside."""
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1.0
    z = np.concatenate([(x - mean) / std, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(z.shape[1] - 1, ridge), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / std, float(w[-1] - (w[:-1] * mean / std).sum())


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, above: Column) -> float:
    """Weight, in documents, of the rate above a site: from how far sites' means spread beyond what chance explains."""
    row = sites.filter("n > 1").agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - above, F.lit(2.0))).alias("spread"),
        F.sum(F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).alias("within"), F.sum(above * (1 - above) * F.col("n")).alias("binomial"),
    ).first()
    if not row["sites"] or not row["n"]:
        return 20.0
    noise = row["within"] / max(row["n"] - row["sites"], 1)
    between = (row["spread"] - noise * row["sites"]) / row["n"]
    return float(min(max(row["binomial"] / row["n"] / max(between, 1e-9) - 1, 2.0), 1e4))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, keep: one row per row of ``docs``.

    ``labels`` has the id and ``quality`` (0 or 1; other values and unknown ids are passed over). A text without words
    scores 0 and is not kept. Null hosts and paths are sites like any other. Without labels, or with one kind only, evidence is the
    same for all. Rows that repeat an id count each, and null ids like any other. Whole texts count, however long. An empty table
    gives an empty result; other columns are ignored, whatever their names. Scores at the threshold are kept.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), surface(F.col(text_col)).alias("x"))
    rows = stored(rows, "surface")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").dropDuplicates(["doc_id"])
    # thinned by the same hash that orders them, so that tasks send little more than what is kept
    few = min(1.0, 1.1 * TRAIN_ROWS / max(1, known.count()))
    thin = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) <= few * 1_000_003)
    sample = rows.filter(F.col("x")[0] > 0).join(thin, "doc_id").orderBy(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)), F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(TRAIN_ROWS).select("x", "y").collect()
    x, y = np.asarray([r["x"] for r in sample]).reshape(-1, len(FEATURES)), np.asarray([r["y"] for r in sample], float)
    if len(set(y)) == 2:
        weights, constant = fit_logistic(x, y)
        base = float(y.mean())
    else:
        weights, constant, base = np.zeros(len(FEATURES)), 0.0, 0.5
    log_odds = F.lit(constant)
    for i, w in enumerate(weights.tolist()):
        log_odds = log_odds + F.col("x")[i] * w
    empty = F.col("x")[0] <= 0
    p = 1 / (1 + F.exp(-F.least(F.greatest(log_odds, F.lit(-30.0)), F.lit(30.0))))
    own = stored(rows.select("doc_id", "host", "path", empty.alias("empty"), F.when(~empty, p).alias("p")), "evidence")
    # sums of decimals do not depend on their order, so reruns agree
    exact = [F.col("p").cast("decimal(28,12)"), (F.col("p") * F.col("p")).cast("decimal(28,12)")]
    sums = [F.count("p").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,12)").alias(k) for x, k in zip(exact, ("s", "ss"), strict=True)]]
    paths = stored(own.groupBy("host", "path").agg(*sums), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")), "hosts").withColumns({k: F.col(k).cast("double") for k in ("s", "ss")})
    paths = paths.withColumns({k: F.col(k).cast("double") for k in ("s", "ss")})
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()
    rate = (total["s"] + 1) / (total["n"] + 2)
    by_host = _strength(hosts, F.lit(rate))
    named = hosts.select(F.col("host").alias("_h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    met = paths.join(named, paths["host"].eqNullSafe(named["_h"])).drop("_h")
    by_path = _strength(met, (F.col("host_s") + by_host * rate) / (F.col("host_n") + by_host))
    sites = met.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "host_n", "host_s")
    met = own.join(sites, own["host"].eqNullSafe(sites["_h"]) & own["path"].eqNullSafe(sites["_p"]))
    left_out, one = F.coalesce("p", F.lit(0.0)), F.when(F.col("p").isNull(), 0).otherwise(1)
    host_rate = (F.col("host_s") - left_out + by_host * rate) / (F.col("host_n") - one + by_host)
    met = met.withColumn("host_rate", host_rate)
    met = met.withColumn("path_rate", (F.col("s") - left_out + by_path * F.col("host_rate")) / (F.col("n") - one + by_path))
    evidence = _logit(F.col("p")) - float(np.log(base / (1 - base)))
    score = F.when(F.col("empty"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-(evidence + _logit(F.col("path_rate"))))))
    return met.select("doc_id", F.when(~F.col("empty"), evidence).alias("evidence"), "host_rate", "path_rate", score.alias("score")).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose id was rejected; rows with a null id are judged like others but matched by nothing, and stay.

    Null and empty texts score 0 and go; whole texts count. Ties with the threshold stay, and repeated rows stay or go together. An empty
    table gives an empty one; all columns stay, whatever their names."""
    gone = quality(docs, labels, **options).filter(~F.col("keep")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[options.get("id_col", "doc_id")] == gone["_gone"], "left_anti")
