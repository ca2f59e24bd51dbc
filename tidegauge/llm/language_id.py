"""Language identification with a blended-spectrum string kernel.

A text is the set of its distinct 1-, 2- and 3-grams of lower-cased letters of any script (any other character counts as
a blank); a gram is the 63 bits of its code points. The kernel of two texts is the normalised size of
their common set. Kernel ridge regression, one language against the rest, is solved in the space spanned by Nystroem
landmarks; as the landmarks' sets are linear in the grams, the fitted function folds into one weight per gram and
language, and a batch is scored by one product of its presence matrix with those weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import row_runs, text_buffers

#: Bounds of the fitted sample, over all languages and per language, and characters from which a row is drawn last. All documents are scored.
TRAIN_ROWS, TRAIN_PER_LANGUAGE = 1600, 300
LANDMARK_ROWS, LANDMARKS_PER_LANGUAGE = 400, 64
SAMPLE_CHARS = 20_000
#: Languages whose counts go to all executors; more of them meet their rows in a shuffle.
SENT_LANGUAGES = 1 << 16
RIDGE = 1e-2


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """Per code point: the lower-cased letter, or 0."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _letters(text: bytes) -> np.ndarray:
    """Lower-cased letters of a UTF-8 text as code points, 0 where there is none."""
    return _lowered()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]


def grams(letters: np.ndarray) -> np.ndarray:
    """Distinct gram codes of a text, sorted: three code points of 21 bits, those that a shorter gram lacks all ones."""
    x = np.concatenate([[0], letters, [0]]).astype(np.int64)
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]  # one blank for a run of them
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.unique(np.concatenate([(0x1FFFFF << 42) | (0x1FFFFF << 21) | x, (0x1FFFFF << 42) | two, three]))


def _places(vocabulary: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sorted vocabulary, from 1; 0 where it is not there."""
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == codes, at + 1, 0)


class Model:
    """Languages, grams with weights and one constant per language."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.vocabulary, self.weights, self.bias = languages, vocabulary, weights, bias

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Decision values: a row per text, a column per language."""
        presence = np.zeros((len(sets), len(self.weights)), np.float32)
        for i, s in enumerate(sets):
            presence[i, _places(self.vocabulary, s)] = 1
        presence[:, 0] = 0  # where grams that no landmark has go
        return (presence @ self.weights) / np.sqrt(np.maximum([len(s) for s in sets], 1))[:, None] + self.bias


def fit(texts: list[str], labels: list[str], landmark: list[bool]) -> Model:
    """Nystroem kernel ridge regression, one-versus-rest, on a bounded sample."""
    sets = [grams(_letters(t.encode())) for t in texts]
    languages = sorted(set(labels))
    marks = [s for s, m in zip(sets, landmark, strict=True) if m]
    vocabulary = np.unique(np.concatenate(marks))

    def rows(of: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(of), len(vocabulary) + 1), np.float32)
        for i, s in enumerate(of):
            out[i, _places(vocabulary, s)] = 1
        out[:, 0] = 0
        return out / np.sqrt([max(len(s), 1) for s in of])[:, None].astype(np.float32)

    at = rows(marks)
    near = (at @ at.T).astype(np.float64)
    cross = np.concatenate([rows(sets[i : i + 256]) @ at.T for i in range(0, len(sets), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh(near)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.concatenate([cross @ root, np.ones((len(sets), 1))], 1)
    y = np.where(np.asarray(labels)[:, None] == np.asarray(languages)[None], 1.0, -1.0)
    # every language weighs the same, however many rows it has
    w = (1.0 / np.maximum((y > 0).sum(0), 1))[np.argmax(y, 1)]
    w = w / w.mean()
    gram = (phi * w[:, None]).T @ phi + RIDGE * len(sets) * np.eye(phi.shape[1]) * np.r_[np.ones(phi.shape[1] - 1) / 10, 1e-6]
    beta = np.linalg.solve(gram, (phi * w[:, None]).T @ y)
    folded = at.T.astype(np.float64) @ (root @ beta[:-1])
    return Model(languages, vocabulary, folded.astype(np.float32), beta[-1])


def sample(docs: DataFrame, id_col: str, lang_col: str, *last: str) -> DataFrame:
    """A sample of labelled rows, even over languages, drawn by hash of the id: bounded, but for four rows of every language. ``last``: flags of rows that are drawn if there are no others."""
    spread = F.xxhash64(F.col(id_col), F.lit(7))
    counts = docs.groupBy(lang_col).agg(F.count("*").alias("_n"))
    langs = counts.count()
    most = max(4, min(TRAIN_PER_LANGUAGE, TRAIN_ROWS // max(1, langs)))
    # first a thinning to a few times what is wanted, so that no language's rows meet in one task
    u = F.pmod(spread, F.lit(1 << 30)) / float(1 << 30)
    thin = docs.join(F.broadcast(counts) if langs <= SENT_LANGUAGES else counts, lang_col).filter(u * F.col("_n") < 3 * most + 20).withColumn("_spread", spread)
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(*last, "_spread", id_col))
    marks = max(2, min(LANDMARKS_PER_LANGUAGE, LANDMARK_ROWS // max(1, langs)))
    return thin.withColumn("_rank", rank).filter(F.col("_rank") <= most).withColumn("_mark", F.col("_rank") <= marks)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages of ``docs``, whose rows are all for training; None without any."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    # a sample of languages with enough rows of SAMPLE_CHARS at most has no longer ones
    rows = sample(rows.withColumn("long", F.length("text") > SAMPLE_CHARS), "id", "lang", "long").select("text", "lang", "_mark").collect()  # at most TRAIN_ROWS, or four a language
    rows.sort(key=lambda r: (r[1], r[0]))
    return fit([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]) if rows else None


def held_out(id_col: Column) -> Column:
    """Rows that take no part in the fitting: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: id, the columns of ``keep``, lang_pred and score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text where there was nothing to learn from. Whole
    texts count, however long. Repeated rows are scored each; of languages with one score, the first in order is taken. An empty
    table gives an empty result. Columns outside ``keep`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        m = sent.value
        for column in texts:
            data, offsets = text_buffers(pa.array(column, pa.large_string(), from_pandas=True))
            lang, score = np.full(len(column), "und", object), np.zeros(len(column))
            for a, b in row_runs(offsets) if m is not None else ():
                for c in range(a, b, 128):
                    rows, sets = [], []
                    for i in range(c, min(b, c + 128)):
                        x = _letters(data[offsets[i] : offsets[i + 1]].tobytes())
                        if x.any():
                            rows.append(i)
                            sets.append(grams(x))
                    if rows:
                        f = m.scores(sets)
                        best = f.argmax(1)
                        lang[rows] = np.asarray(m.languages, object)[best]
                        score[rows] = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    label = F.pandas_udf(run, "lang_pred string, score double")
    return docs.select(F.col(id_col).alias("doc_id"), *keep, label(F.col(text_col)).alias("_p")).select("doc_id", *keep, F.col("_p.lang_pred"), F.col("_p.score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score. A null id is not held out.

    A null text or one without a letter is ``und``; a null language teaches nothing. Whole texts are scored, however long; repeated rows
    each. An empty table gives an empty result; other columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(F.col(id_col)).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")), "doc_id", "text", "lang")
    return predict(rows, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
