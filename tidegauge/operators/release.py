"""Checks before and after a release: drift, fingerprints, rule violations, the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import row_digest

MODELS = ("weekday_mean_4w", "seasonal_naive", "gbt")


def snapshot_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either snapshot that the other lacks (repeats count), with ``side``."""
    cols = [F.col(f"`{c}`") for c in before.columns]
    gone = before.exceptAll(after.select(*cols)).withColumn("side", F.lit("before"))
    return gone.unionByName(after.select(*cols).exceptAll(before).withColumn("side", F.lit("after")))


def content_fingerprint(table: DataFrame, *columns: str) -> DataFrame:
    """n_rows, fingerprint: independent of the rows' order; sums of row hashes, so nothing is sorted or gathered."""
    cols = columns or tuple(sorted(table.columns))
    d = row_digest(*cols)
    halves = [F.sum(F.conv(F.substring(d, i, 15), 16, 10).cast("decimal(38,0)")) for i in (1, 16)]
    return table.agg(F.count("*").alias("n_rows"), F.concat_ws("-", *[F.coalesce(h, F.lit(0)).cast("string") for h in halves]).alias("fingerprint"))


def publication_violations(settings: DataFrame, forecast: DataFrame, baseline_skips: DataFrame) -> DataFrame:
    """violation: why a forecast must not be published. ``settings``: one row of experiment_scope, release_scope (arrays of labels),
    categories (array), origin_date, evaluation_last_origin. An origin must not lie before the end of the evaluation's targets, every category
    needs a forecast, and the baselines' comparison must have skipped nothing."""
    found = forecast.agg(F.sort_array(F.collect_set("category")).alias("found"))
    rules = [
        (~F.col("experiment_scope").eqNullSafe(F.col("release_scope")), "experiment scope differs"),
        (F.col("origin_date") < F.date_add("evaluation_last_origin", 7), "origin before the evaluation's end"),
        (F.col("found") != F.sort_array("categories"), "categories without a forecast"),
    ]
    own = settings.crossJoin(found).select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("violation"))
    return own.unionByName(baseline_skips.limit(1).select(F.lit("incomplete baseline comparison").alias("violation")))


def release_violations(releases: DataFrame, forecasts: DataFrame, quantities: Sequence[str] | None = None) -> DataFrame:
    """release_id, violation: once per broken rule.

    ``releases``: release_id, version, policy, origin_date, area, categories (array), model_cutoff. ``forecasts``: release_id, origin_date, target_date, category,
    area and the quantities of all methods (or those named); a column that is not there is an invalid quantity. Rules: supported version and policy; the very categories and area; no repeats; its own origin; the seven days after it
    for each category; finite quantities not below 0; a model not newer than the origin."""
    quantities = quantities or MODELS
    r = releases.alias("r")
    met = forecasts.alias("f").join(r, F.col("f.release_id") == F.col("r.release_id"))
    bad_quantity = ~F.col("r.policy").isin(*quantities)
    for q in quantities:
        x = F.col(f"f.{q}").cast("double") if q in forecasts.columns else F.lit(None).cast("double")
        bad_quantity = bad_quantity | x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))
    rows = met.groupBy(F.col("r.release_id").alias("release_id")).agg(
        F.sort_array(F.collect_set("f.category")).alias("found"), F.first(F.sort_array("r.categories")).alias("wanted"),
        F.max((F.col("f.area") != F.col("r.area")).cast("int")).alias("area"), F.max((F.col("f.origin_date") != F.col("r.origin_date")).cast("int")).alias("origin"), F.max(bad_quantity.cast("int")).alias("quantity"),
    )
    per = met.groupBy(F.col("r.release_id").alias("release_id"), F.col("f.category").alias("category")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("f.target_date")).alias("days"), F.first("r.origin_date").alias("o"))
    days = F.sequence(F.date_add("o", 1), F.date_add("o", 7))
    per = per.groupBy("release_id").agg(F.max((F.col("n") > F.size("days")).cast("int")).alias("repeated"), F.max((F.col("days") != days).cast("int")).alias("days"))
    own = releases.join(rows, "release_id", "left").join(per, "release_id", "left")
    rules = [
        ((F.col("version") != 1) | ~F.col("policy").isin(*MODELS), "unsupported version or policy"),
        (F.col("found").isNull() | (F.col("found") != F.col("wanted")) | F.coalesce(rows["area"] == 1, F.lit(False)), "scope mismatch"),
        (F.col("repeated") == 1, "duplicate forecasts"),
        (F.col("origin") == 1, "wrong origin"),
        (F.col("days") == 1, "not seven days per category"),
        (F.col("quantity") == 1, "invalid quantities"),
        (F.col("model_cutoff") > releases["origin_date"], "model newer than origin"),
    ]
    return own.select("release_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("violation"))


def release_catalog(releases: DataFrame, violations: DataFrame) -> DataFrame:
    """Valid releases, newest first per agency and area: release_rank by origin, then generated_at, then id."""
    fine = releases.join(violations.select("release_id").distinct(), "release_id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("agency", "area").orderBy(F.desc("origin_date"), F.desc("generated_at"), F.desc("release_id")))
    return fine.select("agency", "area", "release_id", "origin_date", rank.alias("release_rank"))
