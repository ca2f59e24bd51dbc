"""Change capture: deduplication, upsert, version and observation logs, dimensions, run checks.

The log-structured form is the primary one: state is an aggregation of the staged history, so a job may be run again at
any time with the same result. ``stage`` rows have run_id, request_id, payload_hash and an order within the run, given by
one or more columns (the later wins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import row_digest, title


def _order(order: tuple[str, ...]) -> Column:
    return F.struct(*order)


def _others(stage: DataFrame, keys: tuple[str, ...]) -> list[str]:
    return [c for c in stage.columns if c not in keys]


def _latest(stage: DataFrame, keys: tuple[str, ...], by: Column) -> DataFrame:
    """The row of the greatest ``by`` per key, by aggregation: rows are merged before they shuffle."""
    rest = _others(stage, keys)
    return stage.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest]).select(*stage.columns)


def dedup_stage(stage: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """One row per run and request: the latest of the run."""
    return _latest(stage, ("run_id", "request_id"), _order(order))


def upsert_requests(stage: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Current state per request: the newest run's latest row, with first_seen_run and last_seen_run."""
    attributes = [c for c in stage.columns if c not in ("run_id", "request_id", *order)]
    newest = F.max_by(F.struct(*attributes), F.struct("run_id", *order)).alias("_r")
    found = stage.groupBy("request_id").agg(newest, F.min("run_id").alias("first_seen_run"), F.max("run_id").alias("last_seen_run"))
    return found.select("request_id", *[f"_r.{c}" for c in attributes], "first_seen_run", "last_seen_run")


def merge_into_state(state: DataFrame, batch: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """State after one more batch: a batch's row replaces all attributes; first_seen_run is kept."""
    new = upsert_requests(batch, order)
    attributes = [c for c in new.columns if c not in ("request_id", "first_seen_run", "last_seen_run")]
    s, b = state.alias("s"), new.alias("b")
    met = s.join(b, "request_id", "full_outer")
    there = F.col("b.last_seen_run").isNotNull()
    pick = [F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in attributes]
    return met.select("request_id", *pick, F.coalesce("s.first_seen_run", "b.first_seen_run").alias("first_seen_run"), F.coalesce("b.last_seen_run", "s.last_seen_run").alias("last_seen_run"))


def append_versions(stage: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """One row per request and hash: of the first run that held it, the latest row."""
    by = F.struct((-F.col("run_id")).alias("_first"), *order)
    return _latest(stage, ("request_id", "payload_hash"), by)


def new_versions(log: DataFrame, batch: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Rows that a batch adds to the version log: those whose request and hash it does not hold yet."""
    return append_versions(batch, order).join(log.select("request_id", "payload_hash"), ["request_id", "payload_hash"], "left_anti").select(*batch.columns)


def record_observations(stage: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """One payload per request and run, so that a return to an earlier payload shows."""
    return dedup_stage(stage, order)


def merge_counts(stage: DataFrame) -> DataFrame:
    """Per run: rows_new (requests never seen before) and rows_changed (versions beyond those, at least 0)."""
    first = stage.groupBy("request_id").agg(F.min("run_id").alias("run_id")).groupBy("run_id").agg(F.count("*").alias("rows_new"))
    versions = stage.groupBy("request_id", "payload_hash").agg(F.min("run_id").alias("run_id")).groupBy("run_id").agg(F.count("*").alias("versions"))
    runs = stage.select("run_id").distinct()
    met = runs.join(first, "run_id", "left").join(versions, "run_id", "left")
    new, written = F.coalesce("rows_new", F.lit(0)), F.coalesce("versions", F.lit(0))
    return met.select("run_id", new.alias("rows_new"), F.greatest(written - new, F.lit(0)).alias("rows_changed"))


def discover_dimension(known: DataFrame, labels: DataFrame, key: str, in_scope: list[str] | None = None) -> DataFrame:
    """Rows to add to a dimension (``key``, source_label, display_name, in_scope) for labels it lacks, in label order.

    Categories are in scope if listed; areas (no list) never are, and show in title case. The window runs over new labels only."""
    new = labels.filter("source_label is not null").select("source_label").distinct().join(known.select("source_label"), "source_label", "left_anti")
    most = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_most"))
    number = F.row_number().over(Window.orderBy("source_label")).cast("long")
    shown = F.col("source_label") if in_scope is not None else title(F.col("source_label"))
    scope = F.col("source_label").isin(in_scope) if in_scope else F.lit(False)
    return new.crossJoin(F.broadcast(most)).select((F.col("_most") + number).alias(key), "source_label", shown.alias("display_name"), scope.alias("in_scope"))


def sync_scope(dimension: DataFrame, scope: list[str], key: str) -> DataFrame:
    """The dimension with in_scope as the list has it, and a row for each listed label it lacks (in label order)."""
    spark = dimension.sparkSession
    wanted = spark.createDataFrame([(s,) for s in scope], "source_label string")
    flagged = dimension.withColumn("in_scope", F.col("source_label").isin(scope) if scope else F.lit(False))
    added = discover_dimension(dimension, wanted, key, list(scope))
    return flagged.select(key, "source_label", "display_name", "in_scope").unionByName(added)


def run_checksum(stage: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """run_id, checksum: sums of the digests of a run's rows, each of its place, request and hash.

    Nothing is sorted or gathered: a run of any size is summed where its rows are. ``order`` names the columns that place a row within the run."""
    digest = row_digest(*order, "request_id", "payload_hash")
    halves = [F.sum(F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 16)]
    return stage.groupBy("run_id").agg(F.concat_ws("-", *halves).alias("checksum"))


def reconcile_runs(judged_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """run_id, rows_staged, rows_skipped, distinct_keys, run_status: ``mismatch`` if a row was skipped, or staged rows or distinct keys
    differ from what the source counted (a null count differs), else ``ok``. A run without rows has staged none."""
    good = F.col("reject_reason").isNull()
    per = judged_rows.groupBy("run_id").agg(F.count(F.when(good, 1)).alias("rows_staged"), F.count(F.when(~good, 1)).alias("rows_skipped"), F.countDistinct("unique_key").alias("distinct_keys"))
    met = ledger.select("run_id", "source_count").join(per, "run_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_staged", "rows_skipped", "distinct_keys")]
    met = met.select("run_id", "source_count", *zero)
    same = (F.col("rows_skipped") == 0) & F.col("rows_staged").eqNullSafe(F.col("source_count")) & F.col("distinct_keys").eqNullSafe(F.col("source_count"))
    return met.select("run_id", "rows_staged", "rows_skipped", "distinct_keys", F.when(same, "ok").otherwise("mismatch").alias("run_status"))


def guard_fixture_mix(ledger: DataFrame, mode: str = "fixtures") -> DataFrame:
    """One violation row if fixtures are to be loaded where live runs exist; else none."""
    live = ledger.filter(F.col("mode").isin("backfill", "incremental")).limit(1)
    return live.filter(F.lit(mode) == "fixtures").select(F.lit("live runs exist").alias("violation"))


def require_empty(violations: DataFrame, message: str) -> None:
    """Stop a job if a frame of violations has a row. The one action of the checks."""
    row = violations.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
