"""From documents to sampled pieces: reject bad documents, drop boilerplate lines and near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.jaccard_join import drop_near_copies
from tidegauge.llm.line_dedup import dedup_lines
from tidegauge.llm.mixing import mix
from tidegauge.llm.pieces import encode_and_decode
from tidegauge.llm.quality import keep_good
from tidegauge.session import ship
from tidegauge.sources.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from ``labels``.

    Null, empty and blank texts score 0 and go; whole texts count. Ties with the threshold stay, as do rows of a null id, which no
    rejection names. Repeated rows stay or go together. An empty table gives an empty one. Columns other than COLUMNS go, whatever
    their names, here and in the stages after.
    """
    ship(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars is counted anew.

    Null texts stay null (n_chars null), empty ones empty; a null source is a source; whole texts count. Repeated rows are pages each.
    An empty table gives an empty one.
    """
    ship(spark)
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, 80 per cent): that of the smallest id.

    Null, empty and blank texts are like nothing and stay, as do rows of a null id. Rows that repeat an id and a text stay or go
    together. Whole texts count. An empty table gives an empty one.
    """
    ship(spark)
    return drop_near_copies(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times.

    Null and empty texts have no words and are taken by their rounded rate; a null source is a source, last in order; repeated rows
    share their copies evenly; ties go by id, then by text. Whole texts are counted. An empty table gives an empty one.
    """
    ship(spark)
    return mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, and whether they decode to its text.

    A null text has null pieces and counts as lossless, an empty one has none; whole texts are encoded. Rows that repeat an id and a
    text have the same pieces. An empty table gives an empty result.
    """
    ship(spark)
    out = encode_and_decode(docs)
    return out.select("doc_id", "lang", "source", "n_chars", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).alias("n_pieces"), F.col("text").eqNullSafe(F.col("back")).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_bad),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", drop_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the sampling.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
