"""Landed pages staged in one pass: good rows, a quarantine for the others, and the run's counts, taken as rows are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import REASONS
from ..sources.files import read_page_lines
from .normalize import judged, typed

#: The reason of a line that is no JSON object; every other reason is of a record that was read.
BROKEN = "not a JSON record"


def judged_lines(lines: DataFrame) -> DataFrame:
    """Records of lines (``text``, ``broken``, raw fields) with reject_reason: a broken line is that, whatever its fields lack."""
    return judged(lines).withColumn("reject_reason", F.when(F.col("broken"), F.lit(BROKEN)).otherwise(F.col("reject_reason")))


def stage_pages(spark: SparkSession, pages: str, out: str) -> dict[str, int]:
    """Read the pages below a path once, write ``out``/kind=good and ``out``/kind=rejected, and give the counts of that very pass:
    rows_read, rows_staged, rows_skipped and one for each reason.

    Good rows are typed, with their ordinal; rejected ones have their text as it was and the reason. Blank lines are passed over;
    a path without records gives counts of zero. Counts are observed on the rows written, so no second look at pages or
    output is needed to reconcile a run; writing again replaces both folders."""
    rows = judged_lines(read_page_lines(spark, pages))
    good = F.col("reject_reason").isNull()
    seen = Observation("staged")
    metrics = [F.count(F.lit(1)).alias("rows_read"), F.count_if(good).alias("rows_staged"), F.count_if(~good).alias("rows_skipped")]
    metrics += [F.count_if(F.col("reject_reason").eqNullSafe(F.lit(r))).alias(r) for r in (BROKEN, *REASONS)]
    fields = typed()
    named = rows.observe(seen, *metrics).select("ordinal", "text", "reject_reason", *fields)
    own = [c for c in named.columns if c not in ("ordinal", "text", "reject_reason")]
    kept = [F.when(good, F.col(c)).alias(c) for c in own]
    placed = named.select("ordinal", F.when(~good, F.col("text")).alias("text"), "reject_reason", *kept, F.when(good, "good").otherwise("rejected").alias("kind"))
    placed.write.mode("overwrite").partitionBy("kind").parquet(out)
    return {k: int(v) for k, v in seen.get.items()}


def staged(spark: SparkSession, out: str) -> DataFrame:
    """The good rows of a staging folder."""
    return spark.read.parquet(out).filter("kind = 'good'").drop("kind", "text", "reject_reason")


def quarantine(spark: SparkSession, out: str) -> DataFrame:
    """ordinal, text and reject_reason of the lines that were not staged."""
    return spark.read.parquet(out).filter("kind = 'rejected'").select("ordinal", "text", "reject_reason")
