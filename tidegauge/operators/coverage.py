"""Trusted runs, the live view of requests, covered days, daily grids and archives."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sums import merged_intervals

LIVE_MODES = ("backfill", "incremental")
STATE_RANK, OBSERVATION_RANK = 9223372036854775807, 9223372036854775806


def trusted_runs(ledger: DataFrame) -> DataFrame:
    """Runs that are live, ended well and staged as many rows as the source counted (a null count is not trusted)."""
    return ledger.filter(F.col("mode").isin(*LIVE_MODES) & (F.col("status") == "ok") & (F.col("source_count") == F.col("rows_fetched")))


def live_requests(observations: DataFrame, versions: DataFrame, state: DataFrame, ledger: DataFrame) -> DataFrame:
    """request_id, demand_date, agency, category, area: what the newest trusted evidence says of each request.

    Evidence is an observation, an older version row, or the current state; of one run, state goes before observation before
    version (greater version_id first). Each frame has request_id, run_id and the fields; versions also version_id. Untrusted runs go before
    the shuffle, by a broadcast of the runs (one row per fetch job): a join that deals evidence by run would put a run in one task.
    The newest row is taken by aggregation; evidence that is dealt by request stays where it is."""
    fields = ["demand_date", "agency", "category", "area"]
    runs = F.broadcast(trusted_runs(ledger).select("run_id", "started_at"))

    def evidence(df: DataFrame, rank: Column) -> DataFrame:
        return df.join(runs, "run_id").select("request_id", F.struct("started_at", rank.cast("long").alias("rank")).alias("_at"), F.struct(*fields).alias("_r"))

    every = evidence(observations, F.lit(OBSERVATION_RANK)).unionByName(evidence(versions, F.col("version_id"))).unionByName(evidence(state.withColumnRenamed("last_seen_run", "run_id"), F.lit(STATE_RANK)))
    return every.groupBy("request_id").agg(F.max_by("_r", "_at").alias("_r")).select("request_id", *[f"_r.{c}" for c in fields])


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("demand_date"))


def calendar_grid(spark: SparkSession, start: date, end: date, categories: DataFrame, areas: DataFrame) -> DataFrame:
    """Every day with every category and area in scope (frames of labels: dimensions, small by nature)."""
    return calendar(spark, start, end).crossJoin(categories.select("category").distinct()).crossJoin(areas.select("area").distinct())


def distinct_daily_counts(requests: DataFrame) -> DataFrame:
    """Distinct requests per day, category and area. Fed by ``live_requests`` each id is there once and the second step is cheap."""
    once = requests.select("demand_date", "category", "area", "request_id").distinct()
    return once.groupBy("demand_date", "category", "area").agg(F.count("request_id").alias("request_count"))


def _midnight_after(day: Column, zone: str) -> Column:
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def _last_whole_day(at: Column, zone: str) -> Column:
    """The last local day whose end is not after an instant."""
    local = F.to_date(F.from_utc_timestamp(at, zone))
    return F.when(_midnight_after(local, zone) <= at, local).otherwise(F.date_sub(local, 1))


def _windows(ledger: DataFrame, start: date, end: date, zone: str) -> DataFrame:
    """The ledger's trusted runs with the first and last day that each of them covers (``lo``, ``hi``)."""
    runs = trusted_runs(ledger).filter("window_start is not null and window_end is not null and fetched_at is not null")
    hi = F.least("window_end", F.lit(end), _last_whole_day(F.col("fetched_at"), zone))
    return runs.withColumn("lo", F.greatest("window_start", F.lit(start))).withColumn("hi", hi)


def covered_days(ledger: DataFrame, start: date, end: date, zone: str = "America/New_York") -> DataFrame:
    """Days in the window of a trusted run that was fetched at or after the next local midnight. Windows are merged before they are
    unfolded into days, so that each day is made once, however many runs fetched it, and days meet by equality."""
    merged = merged_intervals(_windows(ledger, start, end, zone), "lo", "hi")
    return merged.select(F.explode(F.sequence("lo", "hi")).alias("demand_date"))


def covered_days_strict(ledger: DataFrame, scopes: DataFrame, start: date, end: date, zone: str = "America/New_York") -> DataFrame:
    """agency, area, demand_date: as ``covered_days``, per scope, counting only runs whose own scope equals it exactly.

    The ledger has agency and area of each run's query (null for a query of another shape)."""
    keys = ["agency", "area"]
    merged = merged_intervals(_windows(ledger, start, end, zone).join(scopes.select(*keys).distinct(), keys), "lo", "hi", *keys)
    return merged.select(*keys, F.explode(F.sequence("lo", "hi")).alias("demand_date"))


def daily_display_grid(grid: DataFrame, counts: DataFrame, covered: DataFrame) -> DataFrame:
    """The grid with counts (0 where there are none) and whether the day is complete."""
    met = grid.join(counts, ["demand_date", "category", "area"], "left").join(covered.withColumn("_c", F.lit(True)), "demand_date", "left")
    return met.select("demand_date", "category", "area", F.coalesce("request_count", F.lit(0)).alias("request_count"), F.coalesce("_c", F.lit(False)).alias("is_complete"))


def daily_forecast_grid(grid: DataFrame, counts: DataFrame, covered: DataFrame) -> DataFrame:
    """As the display grid, but the count of a day that is not covered is null: unknown is not zero."""
    shown = daily_display_grid(grid, counts, covered)
    return shown.withColumn("request_count", F.when(F.col("is_complete"), F.col("request_count")))


def rebuild_range(old: DataFrame, new: DataFrame, start: date, end: date) -> DataFrame:
    """The grid with the days of a range replaced; running it again changes nothing."""
    outside = old.filter(~F.col("demand_date").between(F.lit(start), F.lit(end)))
    return outside.unionByName(new.filter(F.col("demand_date").between(F.lit(start), F.lit(end))))


def archive_demand(partitions: DataFrame, records: DataFrame, spark: SparkSession, start: date, end: date, categories: list[str], area: str) -> DataFrame:
    """Forecast grid from attested archives: coverage is the union of the partitions' date ranges."""
    lo, hi = F.greatest("window_start", F.lit(start)), F.least("window_end", F.lit(end))
    covered = partitions.filter(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("demand_date")).distinct()
    labels = spark.createDataFrame([(c,) for c in categories], "category string")
    counts = records.filter(F.col("category").isin(categories)).groupBy("demand_date", "category", "area").agg(F.count("*").alias("request_count"))
    return daily_forecast_grid(calendar_grid(spark, start, end, labels, spark.createDataFrame([(area,)], "area string")), counts, covered)


def archive_violations(partitions: DataFrame, records: DataFrame, agency: str, area: str) -> DataFrame:
    """partition_key, violation, n: one row per broken rule of a partition.

    ``partitions``: partition_key, window_start, window_end, mode, status, expected_rows. ``records``: partition_key, request_id, demand_date,
    agency, area. An id that two records share breaks the rule in each partition that holds it."""
    met = records.join(partitions.select("partition_key", "window_start", "window_end"), "partition_key")

    def found(df: DataFrame, reason: str) -> DataFrame:
        return df.groupBy("partition_key").agg(F.count("*").alias("n")).select("partition_key", F.lit(reason).alias("violation"), "n")

    outside = found(met.filter(~F.col("demand_date").between(F.col("window_start"), F.col("window_end"))), "record outside partition")
    scope = found(met.filter(~(F.col("agency").eqNullSafe(F.lit(agency)) & F.col("area").eqNullSafe(F.lit(area)))), "record outside scope")
    twice = records.groupBy("request_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = found(records.join(twice, "request_id"), "duplicate id")
    held = records.groupBy("partition_key").agg(F.count("*").alias("_rows"))
    counts = partitions.join(held, "partition_key", "left").filter(F.coalesce("_rows", F.lit(0)) != F.col("expected_rows"))
    bad = partitions.filter((F.col("window_start") > F.col("window_end")) | (F.col("mode") != "backfill") | (F.col("status") != "ok"))
    return outside.unionByName(scope).unionByName(repeated).unionByName(found(counts, "row count")).unionByName(found(bad, "bad partition"))


def file_violations(files: DataFrame, content: DataFrame) -> DataFrame:
    """path, violation: files of a manifest (path, rows, sha256) that are absent, or whose bytes or rows differ (content: path, sha256, rows)."""
    met = files.alias("f").join(content.alias("c"), "path", "left")
    reason = F.when(F.col("c.sha256").isNull(), "file missing").when(F.col("c.sha256") != F.col("f.sha256"), "checksum").when(F.col("c.rows") != F.col("f.rows"), "page row count")
    return met.select("path", reason.alias("violation")).filter("violation is not null")


def archive_evidence(records: DataFrame, categories: list[str]) -> DataFrame:
    """One row: unique_raw_records and scoped_records."""
    return records.agg(F.countDistinct("request_id").alias("unique_raw_records"), F.count(F.when(F.col("category").isin(categories), 1)).alias("scoped_records"))
