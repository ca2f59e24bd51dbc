"""Registered queries of the demand operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import holidays
from ..operators import backtest as bt
from ..operators import changelog as cl
from ..operators import coverage as cv
from ..operators import digests as dg
from ..operators import experiment as ex
from ..operators import features as ft
from ..operators import modeling as md
from ..operators import normalize as nz
from ..operators import release as rl
from ..operators import staffing as st
from ..operators import staging as sg
from ..operators.kept import KeptState, rebuild_days, write_partitions
from ..sources import files
from ..sources.shared import new_path, stored, tasks
from ..streaming import jobs, late
from . import analogues as an
from .analogues import FIRST, LAST, ORDER, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ORIGIN = date(1998, 6, 6)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if it has any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums of floating-point numbers depend on their order in the last places."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# 2.1 sources and sinks


@query(sql("SELECT " + ", ".join("CAST(NULL AS VARCHAR) AS community_board" if f == "community_board" else f for f in files.RAW.names) + " FROM raw", "raw"))
def read_request_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records written as gzip pages and read back."""
    path = new_path(spark, "pages")
    files.write_request_pages(an.raw(spark, sf_dir).drop("source_id"), path)
    return files.read_request_pages(spark, f"{path}/run_id=*").drop("file", "ordinal")


@query(sql("SELECT run_id, count(*) AS n_records FROM raw GROUP BY run_id", "raw"))
def write_request_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pages")
    files.write_request_pages(an.raw(spark, sf_dir).drop("source_id"), path)
    return files.read_request_pages(spark, f"{path}/run_id=*").groupBy(F.regexp_extract("file", r"run_id=(\d+)", 1).cast("long").alias("run_id")).agg(F.count("*").alias("n_records"))


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive partitions: one per month of the requests of one agency and area; some are off by a row or badly marked."""
    own = an.requests(spark, sf_dir).filter("agency = 'BUILDING' and area = 'ASIA'")
    months = own.groupBy(F.trunc("demand_date", "MM").alias("window_start")).agg(F.count("*").alias("n"))
    m = F.month("window_start")
    return months.select(
        F.date_format("window_start", "yyyy-MM").alias("partition_key"), "window_start", F.last_day("window_start").alias("window_end"),
        F.when(m == 11, "incremental").otherwise("backfill").alias("mode"), F.when(m == 12, "failed").otherwise("ok").alias("status"), (F.col("n") + F.when(m == 10, 1).otherwise(0)).alias("expected_rows"),
    )


_PARTITIONS = """own AS (SELECT * FROM requests WHERE agency = 'BUILDING' AND area = 'ASIA'),
    parts AS (SELECT strftime(m, '%Y-%m') AS partition_key, m AS window_start, last_day(m) AS window_end, CASE WHEN month(m) = 11 THEN 'incremental' ELSE 'backfill' END AS mode,
        CASE WHEN month(m) = 12 THEN 'failed' ELSE 'ok' END AS status, n + CASE WHEN month(m) = 10 THEN 1 ELSE 0 END AS expected_rows
        FROM (SELECT CAST(date_trunc('month', demand_date) AS DATE) AS m, count(*) AS n FROM own GROUP BY 1))"""


@query(sql(f", {_PARTITIONS} SELECT 'ASIA' AS borough, 'BUILDING' AS agency, partition_key, window_start, window_end, mode, status, expected_rows, 'page-' || partition_key AS path, expected_rows AS rows FROM parts", "requests"))
def read_archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested manifest of the archive partitions, written as JSON and unfolded again."""
    p = _partitions(spark, sf_dir)
    one = F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"), "mode", "status", "expected_rows", F.array(F.struct(F.concat(F.lit("page-"), "partition_key").alias("path"), F.col("expected_rows").alias("rows"), F.lit("").alias("sha256"))).alias("files"))
    path = new_path(spark, "manifest")
    whole = p.groupBy(F.trunc("window_start", "YEAR").alias("y")).agg(F.collect_list(one).alias("partitions"))  # at most twelve a year
    whole.select(F.lit("owner").alias("coverage_basis"), F.lit("BUILDING").alias("agency"), F.lit("ASIA").alias("borough"), "partitions").write.json(path)
    found = spark.read.schema(files.MANIFEST).json(path).select("agency", "borough", F.explode("partitions").alias("p")).select("agency", "borough", "p.*")
    return found.select("agency", "borough", F.date_format("start", "yyyy-MM").alias("partition_key"), F.col("start").alias("window_start"), F.col("end").alias("window_end"), "mode", "status", "expected_rows", F.explode("files").alias("f")).select("*", "f.path", "f.rows").drop("f")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_table(spark, f"{sf_dir}/orders.parquet", {"o_orderpriority": "1-URGENT"}, "o_orderdate", "1997-01-01", "1997-12-31").select("o_orderkey", "o_orderdate", "o_totalprice")


@query(sql("SELECT * FROM series", "series"))
def read_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series written as CSV and read back with its schema."""
    path = new_path(spark, "csv")
    files.write_report_tables({"history": an.series(spark, sf_dir)}, path, "csv")
    return files.read_release_csv(spark, f"{path}/history", files.DAILY)


@query(sql("SELECT 'input' AS table_name, count(*) AS n FROM series UNION ALL SELECT 'predictions', count(*) FROM pred UNION ALL SELECT 'skips', count(*) FROM origins WHERE reason IS NOT NULL", "pred"))
def write_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(an.series(spark, sf_dir), "series")
    path = new_path(spark, "report")
    tables = {"input": s, "predictions": bt.rolling_backtest(s, FIRST, LAST), "skips": bt.backtest_skips(s, FIRST, LAST)}
    files.write_report_tables(tables, path)
    out = None
    for name in tables:
        own = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query(sql("SELECT DATE '1998-06-06' AS origin_date, category, area, horizon_days, target_date, seasonal_naive, weekday_mean_4w FROM base WHERE origin_date = DATE '1998-06-06'", "base"))
def write_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(an.series(spark, sf_dir), "series")
    path = new_path(spark, "release")
    forecast = bt.baseline_predictions(s, ORIGIN, ORIGIN)
    files.write_release({"forecast": forecast, "history": s}, path, spark.createDataFrame([("r1", ORIGIN)], "release_id string, origin_date date"))
    return files.read_release_table(spark, path, "forecast")


# 2.2 projections, filters, scalars

_TYPED = """SELECT source_id, CAST(trim(unique_key) AS BIGINT) AS request_id, CAST(regexp_replace(created_date, 'Z$', '') AS TIMESTAMP) AS created_at, CAST(CAST(regexp_replace(created_date, 'Z$', '') AS TIMESTAMP) AS DATE) AS created_day,
    CAST(closed_date AS TIMESTAMP) AS closed_at, CASE WHEN coalesce(agency, '') = '' THEN 'UNKNOWN' ELSE trim(agency) END AS agency, trim(complaint_type) AS complaint_type, nullif(descriptor, '') AS descriptor,
    upper(trim(borough)) AS borough, status, CAST(nullif(resolution_action_updated_date, '') AS TIMESTAMP) AS resolution_updated_at, sha256(payload) AS payload_hash, payload FROM payloads WHERE reject_reason IS NULL"""


@query(sql(_TYPED, "payloads"))
def normalize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.normalize_requests(an.raw(spark, sf_dir), "source_id")


@query(sql("SELECT source_id, unique_key, created_date, reject_reason FROM judged WHERE reject_reason IS NOT NULL", "judged"))
def reject_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.reject_requests(an.raw(spark, sf_dir), "source_id")


@query(sql("SELECT run_id, reject_reason, count(*) AS n_records FROM judged GROUP BY ALL", "judged"))
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.reject_summary(an.raw(spark, sf_dir))


@query(sql("SELECT coalesce(reject_reason, 'good') AS outcome, count(*) AS n_records, count(*) AS n_observed FROM judged GROUP BY ALL", "judged"))
def stage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages staged in one pass: rows in both folders by outcome, beside the counts that the pass itself observed."""
    pages, out = new_path(spark, "pages"), new_path(spark, "staging")
    files.write_request_pages(an.raw(spark, sf_dir).drop("source_id"), pages)
    seen = sg.stage_pages(spark, f"{pages}/run_id=*", out)
    observed = spark.createDataFrame([("good" if k == "rows_staged" else k, n) for k, n in seen.items() if k not in ("rows_read", "rows_skipped")], "outcome string, n_observed long")
    found = sg.staged(spark, out).select(F.lit("good").alias("outcome")).unionByName(sg.quarantine(spark, out).select(F.col("reject_reason").alias("outcome")))
    return found.groupBy("outcome").agg(F.count("*").alias("n_records")).join(observed.filter("n_observed > 0"), "outcome", "full_outer")


@query(sql("SELECT source_id, CASE WHEN regexp_matches(created_date, '^[0-9]{4}-') THEN CAST(regexp_replace(created_date, 'Z$', '') AS TIMESTAMP) END AS created_at FROM raw", "raw"))
def parse_wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.raw(spark, sf_dir).select("source_id", nz.parse_wall_clock(F.col("created_date")).alias("created_at"))


@query("SELECT event_id, CAST(ts AS DATE) AS local_day FROM events")
def local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.table(spark, sf_dir, "events").select("event_id", nz.local_day(F.col("ts")).alias("local_day"))


@query(sql("SELECT source_id, payload FROM payloads", "payloads"))
def tracked_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.raw(spark, sf_dir).select("source_id", nz.tracked_payload().alias("payload"))


@query(sql("SELECT source_id, sha256(payload) AS payload_hash FROM payloads", "payloads"))
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.raw(spark, sf_dir).select("source_id", nz.payload_hash().alias("payload_hash"))


@query(sql("SELECT * FROM requests WHERE agency = 'BUILDING' AND area = 'ASIA' AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'", "requests"))
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.scope_filter(an.requests(spark, sf_dir), "BUILDING", "ASIA", date(1996, 1, 1), date(1998, 12, 31))


@query(sql("SELECT * FROM requests WHERE category IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "requests"))
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.category_filter(an.requests(spark, sf_dir), PRIORITIES)


@query("""WITH m AS (SELECT CAST(m AS DATE) AS m FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) AS g(m)),
    w AS (SELECT strftime(m, '%Y-%m') AS partition_key, greatest(m, DATE '1995-01-10') AS window_start, least(last_day(m), DATE '2001-07-20') AS window_end FROM m WHERE m <= DATE '2001-07-20')
    SELECT partition_key, window_start, window_end, count(o_orderkey) AS n_requests FROM w LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN window_start AND window_end GROUP BY ALL""")
def month_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch windows, with the requests that fall in each."""
    w = nz.month_partitions(spark, date(1995, 1, 10), date(2001, 7, 20))
    day = an.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    met = day.join(F.broadcast(w), F.date_format("d", "yyyy-MM") == F.col("partition_key")).filter(F.col("d").between(F.col("window_start"), F.col("window_end")))
    sums = met.groupBy("partition_key").agg(F.sum("n").alias("n_requests"))
    return w.join(sums, "partition_key", "left").select("partition_key", "window_start", "window_end", F.coalesce("n_requests", F.lit(0)).alias("n_requests"))


@query(sql("SELECT * FROM requests WHERE demand_date BETWEEN DATE '1998-05-07' AND DATE '1998-06-06'", "requests"))
def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.rolling_window(an.requests(spark, sf_dir), ORIGIN)


@query(sql("""SELECT CAST(trim(unique_key) AS BIGINT) AS request_id, CAST(CAST(regexp_replace(created_date, 'Z$', '') AS TIMESTAMP) AS DATE) AS demand_date, trim(agency) AS agency, trim(complaint_type) AS category,
    upper(trim(borough)) AS area FROM judged WHERE reject_reason IS NULL""", "judged"))
def live_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.live_fields(nz.normalize_requests(an.raw(spark, sf_dir)))


# 2.3 change capture

_LATER = "l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC"


@query(sql(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, request_id ORDER BY {_LATER}) AS rn FROM stage) WHERE rn = 1", "stage"))
def dedup_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.dedup_stage(an.stage(spark, sf_dir), ORDER)


_STATE = f"""state AS (SELECT request_id, complaint_type, borough, created_date, payload_hash, payload, first_seen_run, last_seen_run FROM (SELECT *, min(run_id) OVER (PARTITION BY request_id) AS first_seen_run, max(run_id) OVER (PARTITION BY request_id) AS last_seen_run,
    row_number() OVER (PARTITION BY request_id ORDER BY run_id DESC, {_LATER}) AS rn FROM stage) WHERE rn = 1)"""


@query(sql(f", {_STATE} SELECT * FROM state", "stage"))
def upsert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after the first six runs merged with the seventh: the same as over the whole history."""
    s = an.stage(spark, sf_dir)
    before = cl.upsert_requests(s.filter("run_id <= 6"), ORDER)
    return cl.merge_into_state(before, s.filter("run_id > 6"), ORDER)


@query(sql("""SELECT run_id, count(*) FILTER (WHERE kind = 'new') AS rows_new, greatest(count(*) FILTER (WHERE kind = 'version') - count(*) FILTER (WHERE kind = 'new'), 0) AS rows_changed
    FROM (SELECT min(run_id) AS run_id, 'new' AS kind FROM stage GROUP BY request_id UNION ALL SELECT min(run_id), 'version' FROM stage GROUP BY request_id, payload_hash UNION ALL SELECT DISTINCT run_id, 'run' FROM stage) GROUP BY run_id""", "stage"))
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.merge_counts(an.stage(spark, sf_dir))


_VERSIONS = f"versions AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, payload_hash ORDER BY run_id, {_LATER}) AS rn FROM stage) WHERE rn = 1)"


@query(sql(f", {_VERSIONS} SELECT * FROM versions", "stage"))
def append_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of six runs, and what the seventh adds."""
    s = an.stage(spark, sf_dir)
    log = cl.append_versions(s.filter("run_id <= 6"), ORDER)
    return log.unionByName(cl.new_versions(log, s.filter("run_id > 6"), ORDER))


@query(sql(f"SELECT run_id, request_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY run_id, request_id ORDER BY {_LATER}) AS rn FROM stage) WHERE rn = 1", "stage"))
def record_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written a partition a run; a run that is recorded again replaces its own partition and no other."""
    path, s = new_path(spark, "observations"), an.stage(spark, sf_dir)
    found = cl.record_observations(s, ORDER).select("run_id", "request_id", "payload")
    write_partitions(found, path, "run_id")
    write_partitions(found.filter("run_id = 3"), path, "run_id")
    return spark.read.schema(found.schema).parquet(path)


_KNOWN = "known AS (SELECT row_number() OVER (ORDER BY o_orderpriority) AS category_id, o_orderpriority AS source_label FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '3'))"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = an.table(spark, sf_dir, "orders").filter("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("source_label"))
    none = spark.createDataFrame([], "category_id long, source_label string, display_name string, in_scope boolean")
    return cl.discover_dimension(none, labels, "category_id", [])


@query(f"""WITH {_KNOWN}, new AS (SELECT DISTINCT o_orderpriority AS source_label FROM orders WHERE o_orderpriority NOT IN (SELECT source_label FROM known))
    SELECT (SELECT coalesce(max(category_id), 0) FROM known) + row_number() OVER (ORDER BY source_label) AS category_id, source_label, source_label AS display_name, source_label IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS in_scope FROM new""")
def discover_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.discover_dimension(_known(spark, sf_dir), an.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_label")), "category_id", PRIORITIES)


@query(f"""WITH {_KNOWN}, wanted AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS label),
    new AS (SELECT label FROM wanted WHERE label NOT IN (SELECT source_label FROM known))
    SELECT category_id, source_label, source_label AS display_name, source_label IN (SELECT label FROM wanted) AS in_scope FROM known
    UNION ALL SELECT (SELECT coalesce(max(category_id), 0) FROM known) + row_number() OVER (ORDER BY label), label, label, TRUE FROM new""")
def sync_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.sync_scope(_known(spark, sf_dir), PRIORITIES, "category_id")


@query(sql("""SELECT run_id, concat_ws('-', CAST(sum(CAST('0x' || substr(d, 1, 15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(d, 16, 15) AS HUGEINT)) AS VARCHAR)) AS checksum
    FROM (SELECT run_id, md5(concat_ws('|', l_partkey, l_suppkey, l_shipdate, l_extendedprice, request_id, payload_hash)) AS d FROM stage) GROUP BY run_id""", "stage"))
def run_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.run_checksum(an.stage(spark, sf_dir), ORDER)


@query(sql("""SELECT l.run_id, coalesce(rows_staged, 0) AS rows_staged, coalesce(rows_skipped, 0) AS rows_skipped, coalesce(distinct_keys, 0) AS distinct_keys,
    CASE WHEN coalesce(rows_skipped, 0) = 0 AND coalesce(rows_staged, 0) = source_count AND coalesce(distinct_keys, 0) = source_count THEN 'ok' ELSE 'mismatch' END AS run_status
    FROM ledger l LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE reject_reason IS NULL) AS rows_staged, count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rows_skipped, count(DISTINCT unique_key) AS distinct_keys FROM judged GROUP BY run_id) j ON l.run_id = j.run_id""", "judged", "ledger"))
def reconcile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.reconcile_runs(nz.judged(an.raw(spark, sf_dir)), an.ledger(spark))


@query("SELECT 'live runs exist' AS violation FROM (SELECT DISTINCT 1 FROM lineitem WHERE l_linenumber IN (1, 2, 4, 5, 6, 7))")
def guard_fixture_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures are refused where runs of a live mode have staged rows."""
    used = an.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("run_id")).distinct()
    return cl.guard_fixture_mix(an.ledger(spark).join(used, "run_id", "left_semi"))


# 2.4 latest trusted observation, coverage


@query(sql("SELECT s.run_id, count(*) AS n_staged FROM stage s JOIN trusted t ON s.run_id = t.run_id GROUP BY s.run_id", "stage", "ledger"))
def trusted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted runs with the rows they staged."""
    return an.stage(spark, sf_dir).join(F.broadcast(cv.trusted_runs(an.ledger(spark)).select("run_id")), "run_id").groupBy("run_id").agg(F.count("*").alias("n_staged"))


_EVIDENCE = f"""{_STATE}, obs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, request_id ORDER BY {_LATER}) AS rn FROM stage) WHERE rn = 1 AND request_id % 3 <> 0),
    {_VERSIONS}, ev AS (SELECT request_id, started_at, 9223372036854775806 AS r, created_date, complaint_type, borough FROM obs JOIN trusted USING (run_id)
    UNION ALL SELECT request_id, started_at, request_id * 100 + run_id * 10 + instr('ANR', complaint_type) * 2 + CAST(borough = 'O' AS INTEGER), created_date, complaint_type, borough FROM versions JOIN trusted USING (run_id)
    UNION ALL SELECT request_id, started_at, 9223372036854775807, created_date, complaint_type, borough FROM state JOIN trusted ON last_seen_run = run_id)"""


@query(sql(f", {_EVIDENCE} SELECT request_id, created_date AS demand_date, CAST(NULL AS VARCHAR) AS agency, complaint_type AS category, borough AS area FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY started_at DESC, r DESC) AS rn FROM ev) WHERE rn = 1", "stage", "ledger"))
def live_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by their newest trusted evidence; a third of them have no observations, as before the log was kept."""
    s = an.stage(spark, sf_dir)
    fields = [F.col("created_date").alias("demand_date"), F.lit(None).cast("string").alias("agency"), F.col("complaint_type").alias("category"), F.col("borough").alias("area")]
    observed = cl.record_observations(s, ORDER).filter("request_id % 3 <> 0").select("request_id", "run_id", *fields)
    versions = cl.append_versions(s, ORDER).select("request_id", "run_id", F.expr("request_id * 100 + run_id * 10 + instr('ANR', complaint_type) * 2 + cast(borough = 'O' as int)").alias("version_id"), *fields)
    state = cl.upsert_requests(s, ORDER).select("request_id", "last_seen_run", *fields)
    return cv.live_requests(observed, versions, state, an.ledger(spark))


@query(sql("SELECT * FROM grid", "grid"))
def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.calendar_grid(spark, an.START, an.END, *an.labels(spark, sf_dir))


@query(sql("SELECT created_date AS demand_date, complaint_type AS category, borough AS area, count(DISTINCT request_id) AS request_count FROM stage GROUP BY ALL", "stage"))
def distinct_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the raw history of all runs, where requests repeat."""
    return cv.distinct_daily_counts(an.stage(spark, sf_dir).select("request_id", F.col("created_date").alias("demand_date"), F.col("complaint_type").alias("category"), F.col("borough").alias("area")))


@query(sql("SELECT c.demand_date, count(o_orderkey) AS n_requests FROM covered c LEFT JOIN orders ON CAST(o_orderdate AS DATE) = c.demand_date GROUP BY ALL", "covered"))
def covered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered days with the requests made on them."""
    day = an.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("demand_date")).agg(F.count("*").alias("n"))
    return cv.covered_days(an.ledger(spark), an.START, an.END).join(day, "demand_date", "left").select("demand_date", F.coalesce("n", F.lit(0)).alias("n_requests"))


@query(sql("""SELECT s.agency, s.area, d.demand_date, count(request_id) AS n_requests FROM (SELECT DISTINCT d.demand_date, t.agency, t.area FROM days d JOIN trusted t ON d.demand_date BETWEEN window_start AND window_end AND fetched_at >= d.demand_date + INTERVAL 29 HOUR) d
    JOIN (SELECT DISTINCT agency, area FROM requests) s ON d.agency = s.agency AND d.area = s.area LEFT JOIN requests r ON r.agency = s.agency AND r.area = s.area AND r.demand_date = d.demand_date GROUP BY ALL""", "covered", "requests"))
def covered_days_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered days of every agency and area whose own runs cover them, with the requests made on them."""
    q = an.requests(spark, sf_dir)
    day = q.groupBy("agency", "area", "demand_date").agg(F.count("*").alias("n"))
    days = cv.covered_days_strict(an.ledger(spark), day.select("agency", "area").distinct(), an.START, an.END)
    return days.join(day, ["agency", "area", "demand_date"], "left").select("agency", "area", "demand_date", F.coalesce("n", F.lit(0)).alias("n_requests"))


@query(sql("SELECT demand_date, category, area, coalesce(n.request_count, 0) AS request_count, c.demand_date IS NOT NULL AS is_complete FROM grid LEFT JOIN counts n USING (demand_date, category, area) LEFT JOIN covered c USING (demand_date)", "grid", "counts"))
def daily_display_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cv.calendar_grid(spark, an.START, an.END, *an.labels(spark, sf_dir))
    return cv.daily_display_grid(grid, cv.distinct_daily_counts(an.dealt_requests(spark, sf_dir)), cv.covered_days(an.ledger(spark), an.START, an.END))


@query(sql("SELECT * FROM series", "series"))
def daily_forecast_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.series(spark, sf_dir)


@query(sql("SELECT demand_date, category, area, CASE WHEN demand_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN coalesce(request_count, 0) ELSE -1 END AS request_count, CASE WHEN demand_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN is_complete ELSE FALSE END AS is_complete FROM series", "series"))
def rebuild_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year of a stale grid rebuilt, by overwriting its months' partitions."""
    new = an.series(spark, sf_dir).withColumn("request_count", F.coalesce("request_count", F.lit(0)))
    old = new.withColumn("request_count", F.lit(-1).cast("long")).withColumn("is_complete", F.lit(False))
    path = new_path(spark, "grid")
    rebuild_days(path, old)
    rebuild_days(path, new.filter(F.col("demand_date").between(F.lit(date(1996, 1, 1)), F.lit(date(1996, 12, 31)))))
    return spark.read.schema(new.withColumn("month", F.lit("")).schema).parquet(path).drop("month")


@query(sql(f""", {_PARTITIONS} SELECT demand_date, category, 'ASIA' AS area, CASE WHEN p.window_start IS NOT NULL THEN coalesce(n, 0) END AS request_count, p.window_start IS NOT NULL AS is_complete
    FROM (SELECT CAST(d AS DATE) AS demand_date, category FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) AS g(d) CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS category))
    LEFT JOIN parts p ON demand_date BETWEEN p.window_start AND p.window_end LEFT JOIN (SELECT demand_date, category, count(*) AS n FROM own GROUP BY ALL) USING (demand_date, category)""", "requests"))
def archive_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = an.requests(spark, sf_dir).filter("agency = 'BUILDING' and area = 'ASIA'")
    return cv.archive_demand(_partitions(spark, sf_dir), own, spark, date(1995, 1, 1), date(2001, 12, 31), PRIORITIES, "ASIA")


_RECORDS = """records AS (SELECT strftime(demand_date, '%Y-%m') AS partition_key, CASE WHEN request_id % 500 = 1 THEN request_id - 1 ELSE request_id END AS request_id, CASE WHEN request_id % 211 = 0 THEN demand_date + 40 ELSE demand_date END AS demand_date,
    agency, CASE WHEN request_id % 307 = 0 THEN 'EUROPE' ELSE area END AS area FROM own)"""


@query(sql(f""", {_PARTITIONS}, {_RECORDS}, met AS (SELECT r.*, window_start, window_end FROM records r JOIN parts USING (partition_key)), found AS (
    SELECT partition_key, 'record outside partition' AS violation FROM met WHERE demand_date NOT BETWEEN window_start AND window_end
    UNION ALL SELECT partition_key, 'record outside scope' FROM met WHERE area <> 'ASIA'
    UNION ALL SELECT partition_key, 'duplicate id' FROM records WHERE request_id IN (SELECT request_id FROM records GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT partition_key, 'row count' FROM parts LEFT JOIN (SELECT partition_key, count(*) AS n FROM records GROUP BY 1) USING (partition_key) WHERE coalesce(n, 0) <> expected_rows
    UNION ALL SELECT partition_key, 'bad partition' FROM parts WHERE mode <> 'backfill' OR status <> 'ok')
    SELECT partition_key, violation, count(*) AS n FROM found GROUP BY ALL""", "requests"))
def archive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = an.requests(spark, sf_dir).filter("agency = 'BUILDING' and area = 'ASIA'")
    k = F.col("request_id")
    records = own.select(F.date_format("demand_date", "yyyy-MM").alias("partition_key"), F.when(k % 500 == 1, k - 1).otherwise(k).alias("request_id"), F.when(k % 211 == 0, F.date_add("demand_date", 40)).otherwise(F.col("demand_date")).alias("demand_date"), "agency", F.when(k % 307 == 0, "EUROPE").otherwise(F.col("area")).alias("area"))
    return cv.archive_violations(_partitions(spark, sf_dir), records, "BUILDING", "ASIA")


@query(sql("SELECT count(DISTINCT request_id) AS unique_raw_records, count(*) FILTER (WHERE category IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS scoped_records FROM requests WHERE agency = 'BUILDING' AND area = 'ASIA'", "requests"))
def archive_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.archive_evidence(an.requests(spark, sf_dir).filter("agency = 'BUILDING' and area = 'ASIA'"), PRIORITIES)


# 2.5 series checks and baselines

_DIRTY = """dirty AS (SELECT demand_date, category, area, CASE WHEN day(demand_date) = 13 THEN -1 WHEN day(demand_date) = 17 THEN request_count + 0.5 ELSE request_count END AS request_count, is_complete FROM series
    UNION ALL SELECT demand_date, category, area, request_count, is_complete FROM series WHERE day(demand_date) = 1)"""


@query(sql(f""", {_DIRTY} SELECT 'duplicate segment day' AS violation, demand_date, category, area FROM dirty GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'bad complete count', demand_date, category, area FROM dirty WHERE is_complete AND (request_count IS NULL OR request_count < 0 OR floor(request_count) <> request_count)""", "series"))
def series_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a series with planted faults."""
    s = an.series(spark, sf_dir).withColumn("request_count", F.col("request_count").cast("double"))
    d = F.dayofmonth("demand_date")
    faulty = s.withColumn("request_count", F.when(d == 13, F.lit(-1.0)).when(d == 17, F.col("request_count") + 0.5).otherwise(F.col("request_count")))
    return bt.series_violations(faulty.unionByName(s.filter(d == 1)))


@query(sql("SELECT DISTINCT origin_date, count(reason) AS n_skipped, count(*) AS n_segments FROM origins GROUP BY origin_date", "origins"))
def weekly_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins with their segments and how many of them are skipped."""
    o = bt.weekly_origins(spark, FIRST, LAST, modelling=True)
    e = bt.origin_eligibility(an.series(spark, sf_dir), FIRST, LAST)
    return o.join(e, "origin_date", "left").groupBy("origin_date").agg(F.count("reason").alias("n_skipped"), F.count("*").alias("n_segments"))


@query("""WITH d AS (SELECT CAST(min(o_orderdate) AS DATE) AS data_start FROM orders) SELECT violation FROM (
    SELECT unnest(['validation reaches into evaluation', 'origins on different weekdays']) AS violation FROM d
    UNION ALL SELECT 'too little history before validation' FROM d WHERE data_start + 28 > DATE '1995-01-21'
    UNION ALL SELECT 'duplicate candidate id' UNION ALL SELECT 'bad candidate id')""")
def protocol_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a faulty protocol for the orders' dates."""
    start = an.table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("data_start"))
    days = {"validation_first": date(1995, 1, 21), "validation_last": date(1995, 2, 19), "evaluation_first": date(1995, 2, 20), "evaluation_last": date(1995, 3, 6)}
    return bt.protocol_violations(start.select("data_start", *[F.lit(v).alias(k) for k, v in days.items()]), spark.createDataFrame([("a_1",), ("a_1",), ("b c",)], "id string"))


@query(sql("SELECT origin_date, category, area, reason FROM origins", "origins"))
def origin_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.origin_eligibility(an.series(spark, sf_dir), FIRST, LAST)


@query(sql("SELECT origin_date, target_date, horizon_days, category, area, seasonal_naive FROM base", "base"))
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.baseline_predictions(an.series(spark, sf_dir), FIRST, LAST).drop("weekday_mean_4w")


@query(sql("SELECT origin_date, target_date, horizon_days, category, area, weekday_mean_4w FROM base", "base"))
def weekday_mean_4w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.baseline_predictions(an.series(spark, sf_dir), FIRST, LAST).drop("seasonal_naive")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.rolling_backtest(an.series(spark, sf_dir), FIRST, LAST)


@query(sql("SELECT * FROM pred", "pred"))
def rolling_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir)


@query(sql("SELECT origin_date, category, area, reason FROM origins WHERE reason IS NOT NULL", "origins"))
def backtest_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.backtest_skips(an.series(spark, sf_dir), FIRST, LAST)


_METRICS = "count(*) AS n, round(avg(absolute_error), 6) AS mae, round(CASE WHEN sum(actual) <> 0 THEN sum(absolute_error) / sum(actual) END, 6) AS wape, round(avg(error), 6) AS bias, sum(actual) AS actual_total"


@query(sql(f"SELECT model, category, {_METRICS} FROM pred GROUP BY ALL", "pred"))
def summarize_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.summarize_errors(_predictions(spark, sf_dir), "model", "category"))


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS cut, " + ", ".join(c if c in by else f"NULL AS {c}" for c in ("model", "category", "area", "horizon_days", "origin_date")) + f", {_METRICS} FROM pred GROUP BY {', '.join(by)}" for k, by in bt.CUTS.items()), "pred"))
def summarize_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.summarize_all_levels(_predictions(spark, sf_dir)))


# 2.6 features

_NTH = "make_date(y, {m}, 1) + CAST((({d} - dayofweek(make_date(y, {m}, 1))) + 7) % 7 + 7 * ({n} - 1) AS INTEGER)"
_HOLIDAYS = (
    "hol AS (SELECT name, CASE WHEN fixed AND dayofweek(d) = 6 THEN d - 1 WHEN fixed AND dayofweek(d) = 0 THEN d + 1 ELSE d END AS holiday_date FROM (SELECT name, since, y, fixed, d FROM (SELECT CAST(y AS INTEGER) AS y FROM range(1994, 2004) AS r(y)) CROSS JOIN LATERAL (VALUES "
    + ", ".join(f"('{n}', {s or 0}, TRUE, make_date(y, {m}, {d}))" for n, m, d, s in holidays.BY_DATE)
    + ", "
    + ", ".join(f"('{n}', {s or 0}, FALSE, {_NTH.format(m=m, d={'MON': 1, 'THU': 4}[w], n=k)})" for n, m, w, k, s in holidays.BY_WEEKDAY)
    + ", ('Memorial', 0, FALSE, make_date(y, 5, 31) - CAST((dayofweek(make_date(y, 5, 31)) + 6) % 7 AS INTEGER))) AS h(name, since, fixed, d) WHERE y >= since))"
)


@query(f"WITH {_HOLIDAYS} SELECT holiday_date, name, count(o_orderkey) AS n_requests FROM hol LEFT JOIN orders ON CAST(o_orderdate AS DATE) = holiday_date GROUP BY ALL")
def holiday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed holidays around the orders' years, with the requests made on them."""
    day = an.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("holiday_date")).agg(F.count("*").alias("n"))
    return holidays.holiday_calendar(spark, 1995, 2002).join(day, "holiday_date", "left").select("holiday_date", "name", F.coalesce("n", F.lit(0)).alias("n_requests"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS horizon_days, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS target_weekday, CAST(isodow(l_shipdate) >= 6 AS INTEGER) AS target_weekend, CAST(day(l_shipdate) AS INTEGER) AS target_day_of_month, CAST(month(l_shipdate) AS INTEGER) AS target_month FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ship dates against order dates."""
    rows = an.table(spark, sf_dir, "lineitem").join(an.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    target = F.to_date("l_shipdate")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[c.alias(k) for k, c in ft.calendar_features(target, F.datediff(target, F.to_date("o_orderdate"))).items()])


@query(f"WITH {_HOLIDAYS}, h AS (SELECT DISTINCT holiday_date FROM hol) SELECT o_orderkey, CAST(o_orderdate AS DATE) AS target_date, CAST(CAST(o_orderdate AS DATE) IN (FROM h) AS INTEGER) AS target_holiday, CAST(CAST(o_orderdate AS DATE) + 1 IN (FROM h) AS INTEGER) AS target_before_holiday, CAST(CAST(o_orderdate AS DATE) - 1 IN (FROM h) AS INTEGER) AS target_after_holiday FROM orders")
def holiday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.with_holidays(an.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("target_date")), 1995, 2002)


_EXAMPLES = f"""{_HOLIDAYS}, h AS MATERIALIZED (SELECT DISTINCT holiday_date FROM hol), x AS MATERIALIZED (SELECT category, area, demand_date AS origin_date, request_count AS v, count(request_count) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS n_hist, count(request_count) OVER (w ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS n_fut,
    lag(request_count, 7) OVER w AS lag7, avg(request_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7, avg(request_count) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS mean14, avg(request_count) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS mean28,
    stddev_pop(request_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS std7, stddev_pop(request_count) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS std28, min(request_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS min7,
    max(request_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS max7, avg(request_count) OVER (w ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS before7 FROM series WINDOW w AS (PARTITION BY category, area ORDER BY demand_date)),
    xh AS MATERIALIZED (SELECT x.*, CAST(h AS INTEGER) AS h, origin_date + CAST(h AS INTEGER) AS target_date FROM x CROSS JOIN range(1, 8) AS r(h) WHERE n_hist = 28),
    ex AS MATERIALIZED (SELECT x.origin_date, target_date, x.origin_date AS feature_max_date, x.origin_date - 27 AS history_start_date, l.actual, category, area, n_fut, CAST(h AS INTEGER) AS horizon_days, CAST(isodow(target_date) - 1 AS INTEGER) AS target_weekday,
    CAST(isodow(target_date) >= 6 AS INTEGER) AS target_weekend, CAST(day(target_date) AS INTEGER) AS target_day_of_month, CAST(month(target_date) AS INTEGER) AS target_month, CAST(target_date IN (FROM h) AS INTEGER) AS target_holiday, CAST(target_date + 1 IN (FROM h) AS INTEGER) AS target_before_holiday,
    CAST(target_date - 1 IN (FROM h) AS INTEGER) AS target_after_holiday, CAST(v AS DOUBLE) AS origin_last, CAST(lag7 AS DOUBLE) AS origin_lag7, round(mean7, 6) AS mean7, round(mean14, 6) AS mean14, round(mean28, 6) AS mean28, round(std7, 6) AS std7, round(std28, 6) AS std28,
    CAST(min7 AS DOUBLE) AS min7, CAST(max7 AS DOUBLE) AS max7, round(mean7 - before7, 6) AS recent_trend, l1 AS weekday_lag1, l2 AS weekday_lag2, l3 AS weekday_lag3, l4 AS weekday_lag4, (l1 + l2 + l3 + l4) / 4 AS weekday_mean4, l1 - (l1 + l2 + l3 + l4) / 4 AS weekday_trend
    FROM xh AS x JOIN lags AS l USING (category, area, target_date))"""
_WEEKLY = "origin_date BETWEEN DATE '1995-02-04' AND DATE '2001-06-30' AND (origin_date - DATE '1995-02-04') % 7 = 0"


def _examples(spark: SparkSession, sf_dir: str, require: bool = True, first: date = FIRST, last: date = LAST, step: int = 7) -> DataFrame:
    return ft.build_examples(an.series(spark, sf_dir), first, last, step, require)


def _origin_columns(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return rounded(_examples(spark, sf_dir).filter("horizon_days = 1").select("origin_date", "category", "area", *columns))


@query(sql(f", {_EXAMPLES} SELECT origin_date, category, area, origin_last, origin_lag7 FROM ex WHERE horizon_days = 1 AND n_fut = 7 AND {_WEEKLY}", "lags"))
def origin_level_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _origin_columns(spark, sf_dir, "origin_last", "origin_lag7")


@query(sql(f", {_EXAMPLES} SELECT origin_date, category, area, mean7, mean14, mean28, std7, std28, min7, max7 FROM ex WHERE horizon_days = 1 AND n_fut = 7 AND {_WEEKLY}", "lags"))
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _origin_columns(spark, sf_dir, "mean7", "mean14", "mean28", "std7", "std28", "min7", "max7")


@query(sql(f", {_EXAMPLES} SELECT origin_date, category, area, recent_trend FROM ex WHERE horizon_days = 1 AND n_fut = 7 AND {_WEEKLY}", "lags"))
def recent_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _origin_columns(spark, sf_dir, "recent_trend")


_LAGS = ("origin_date", "target_date", "category", "area", "weekday_lag1", "weekday_lag2", "weekday_lag3", "weekday_lag4", "weekday_mean4", "weekday_trend")


@query(sql(f", {_EXAMPLES} SELECT {', '.join(_LAGS)} FROM ex WHERE n_fut = 7 AND {_WEEKLY}", "lags"))
def weekday_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select(*_LAGS)


@query(sql(f", {_EXAMPLES} SELECT * EXCLUDE (n_fut) FROM ex WHERE {_WEEKLY}", "lags"))
def build_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets need not be known."""
    return rounded(_examples(spark, sf_dir, require=False))


@query(sql(f", {_EXAMPLES} SELECT origin_date, target_date, category, area, actual FROM ex WHERE actual IS NOT NULL AND target_date <= DATE '1998-06-06' AND {_WEEKLY}", "lags"))
def training_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.training_slice(_examples(spark, sf_dir, require=False), ORIGIN).select("origin_date", "target_date", "category", "area", "actual")


@query(sql(f", {_EXAMPLES} SELECT origin_date, target_date, feature_max_date, category, area FROM (SELECT * REPLACE (CASE WHEN day(origin_date) = 1 THEN origin_date + 3 ELSE feature_max_date END AS feature_max_date) FROM ex WHERE {_WEEKLY}) WHERE NOT (feature_max_date <= origin_date AND origin_date < target_date AND target_date <= DATE '2001-06-01')", "lags"))
def leakage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of examples with planted leaks."""
    x = _examples(spark, sf_dir, require=False)
    leaky = x.withColumn("feature_max_date", F.when(F.dayofmonth("origin_date") == 1, F.date_add("origin_date", 3)).otherwise(F.col("feature_max_date")))
    return ft.leakage_violations(leaky, date(2001, 6, 1))


_DAILY_SLICE = "actual IS NOT NULL AND origin_date BETWEEN DATE '1995-02-04' AND DATE '2001-06-30' AND target_date <= DATE '2001-07-01'"


def _daily_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.training_slice(_examples(spark, sf_dir, False, FIRST, LAST, 1), LAST + timedelta(days=1))


@query(sql(f", {_EXAMPLES} SELECT origin_date, target_date, category, area, round(1.0 / count(*) OVER (PARTITION BY target_date, category, area) * count(*) OVER () / (SELECT count(*) FROM (SELECT DISTINCT target_date, category, area FROM ex WHERE {_DAILY_SLICE})), 6) AS weight FROM ex WHERE {_DAILY_SLICE}", "lags"))
def example_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all daily origins, where horizons share targets."""
    return rounded(ft.example_weights(_daily_slice(spark, sf_dir)).select("origin_date", "target_date", "category", "area", "weight"))


_FIT_DATES = "(SELECT CAST(d AS DATE) AS fit_date FROM generate_series(DATE '1995-02-04', DATE '2001-06-30', INTERVAL 7 DAY) AS g(d))"


@query(sql(f""", {_EXAMPLES} SELECT fit_date, min(target_date) AS min_training_target, max(target_date) AS max_training_target, count(*) AS training_rows, count(DISTINCT (target_date, category, area)) AS unique_training_targets,
    CAST(sum(CAST(('0x' || substr(md5(origin_date || '|' || target_date || '|' || category || '|' || area), 1, 15)) AS HUGEINT)) AS VARCHAR) AS content_sum FROM {_FIT_DATES} JOIN (SELECT * FROM ex WHERE actual IS NOT NULL AND {_WEEKLY}) ON target_date <= fit_date GROUP BY fit_date""", "lags"))
def training_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.training_audit(_examples(spark, sf_dir, require=False), bt.weekly_origins(spark, FIRST, LAST))


# 2.7 model selection and forecasting

_ORIGINS = [date(1998, 5, 9), date(1998, 5, 16), date(1998, 5, 23), date(1998, 5, 30)]
#: As jobs/forecast.py has them, with a twelfth of the trees and larger steps.
_CANDIDATES = [
    md.Candidate("shallow_5", "gbt", {"maxIter": 5, "maxDepth": 3, "minInstancesPerNode": 30, "stepSize": 0.3}),
    md.Candidate("shallow_10", "gbt", {"maxIter": 10, "maxDepth": 3, "minInstancesPerNode": 30, "stepSize": 0.3}),
    md.Candidate("regularized_10", "gbt", {"maxIter": 10, "maxDepth": 4, "minInstancesPerNode": 50, "stepSize": 0.3}),
]
_MATURED = "actual IS NOT NULL AND origin_date BETWEEN DATE '1995-02-04' AND DATE '2001-06-30'"
_KEYS = ["origin_date", "target_date", "horizon_days", "category", "area"]
_AT = "origin_date IN (DATE '1998-05-09', DATE '1998-05-16', DATE '1998-05-23', DATE '1998-05-30')"


def _model_frames(spark: SparkSession, sf_dir: str, last: date = ORIGIN) -> tuple[DataFrame, DataFrame]:
    """Examples of every daily origin up to the last one that a model is asked for, and those of known targets."""
    x = stored(_examples(spark, sf_dir, False, FIRST, last, 1), "examples")
    return x, x.filter("actual is not null")


@query(sql(f", {_EXAMPLES} SELECT origin_date, target_date, category, area, CAST(dense_rank() OVER (ORDER BY category) - 1 AS DOUBLE) AS category_code, CAST(dense_rank() OVER (ORDER BY area) - 1 AS DOUBLE) AS area_code FROM ex WHERE origin_date BETWEEN DATE '1995-02-04' AND DATE '2001-06-30'", "lags"))
def encode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes learnt before the first origin, for all examples."""
    x, known = _model_frames(spark, sf_dir, LAST)
    out = md.encode_features(ft.training_slice(known, _ORIGINS[0]), x)
    return out.select("origin_date", "target_date", "category", "area", "category_code", "area_code")


def _with_fine(df: DataFrame, *columns: str) -> DataFrame:
    """SQL knows the rows that are predicted, and of a prediction that it is a number of at least 0."""
    return df.select(*columns, F.coalesce(F.col("prediction") >= 0, F.lit(False)).alias("fine"))


@query(sql(f", {_EXAMPLES} SELECT origin_date, target_date, category, area, actual, TRUE AS fine FROM ex WHERE {_MATURED} AND target_date <= DATE '1998-06-06'", "lags"))
def fit_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-sample predictions of a fitted challenger."""
    train = ft.training_slice(_model_frames(spark, sf_dir)[1], ORIGIN)
    return _with_fine(md.predict_challenger(md.fit_challenger(train, ORIGIN, _CANDIDATES[0]), train), "origin_date", "target_date", "category", "area", "actual")


@query(sql(f", {_EXAMPLES} SELECT origin_date, target_date, category, area, TRUE AS fine FROM ex WHERE origin_date = DATE '1998-05-09'", "lags"))
def predict_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, known = _model_frames(spark, sf_dir)
    model = md.fit_challenger(ft.training_slice(known, _ORIGINS[0]), _ORIGINS[0], _CANDIDATES[1])
    return _with_fine(md.predict_challenger(model, x.filter(F.col("origin_date") == F.lit(_ORIGINS[0]))), "origin_date", "target_date", "category", "area")


@query(sql(f", {_EXAMPLES} SELECT origin_date, target_date, category, area, 0.0::DOUBLE AS difference FROM ex WHERE origin_date = DATE '1998-05-09'", "lags"))
def save_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of predictions before and after saving."""
    x, known = _model_frames(spark, sf_dir)
    model = md.fit_challenger(ft.training_slice(known, _ORIGINS[0]), _ORIGINS[0], _CANDIDATES[0])
    path = new_path(spark, "model")
    md.save_model(model, path, _ORIGINS[0])
    again, cutoff = md.load_model(spark, path)
    rows = x.filter(F.col("origin_date") == F.lit(_ORIGINS[0]))
    keys = ["origin_date", "target_date", "category", "area"]
    a, b = md.predict_challenger(model, rows).select(*keys, "prediction"), md.predict_challenger(again, rows).select(*keys, F.col("prediction").alias("loaded"))
    return a.join(b, keys).select(*keys, (F.col("prediction") - F.col("loaded")).alias("difference"))


@query(sql(f"SELECT origin_date, target_date, horizon_days, category, area, model, actual, prediction AS baseline, TRUE AS fine FROM pred WHERE {_AT} UNION ALL SELECT DISTINCT origin_date, target_date, horizon_days, category, area, 'gbt', actual, NULL, TRUE FROM pred WHERE {_AT}", "pred"))
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weekly origins, fitted on all daily ones before, all three methods; SQL knows what the baselines say, and of the challenger that it is there."""
    _, known = _model_frames(spark, sf_dir)
    out = md.walk_forward(known, known, _ORIGINS, _CANDIDATES[0])
    own = F.col("model") == "gbt"
    return out.select("origin_date", "target_date", F.col("horizon_days").cast("int").alias("horizon_days"), "category", "area", "model", "actual", F.when(~own, F.col("prediction")).alias("baseline"), (F.col("prediction") >= 0).alias("fine"))


@query(sql("SELECT origin_date, target_date, horizon_days, category, area, 'methods differ' AS violation FROM (SELECT DISTINCT origin_date, target_date, horizon_days, category, area FROM pred) WHERE day(target_date) = 3", "pred"))
def pairing_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of predictions from which one method's third days are taken."""
    p = _predictions(spark, sf_dir).filter("not (model = 'seasonal_naive' and dayofmonth(target_date) = 3)")
    return md.pairing_violations(p, bt.MODELS)


@query(sql(f"SELECT candidate, n, TRUE AS fine FROM (SELECT count(*) AS n FROM pred WHERE model = 'seasonal_naive' AND {_AT}) CROSS JOIN (SELECT unnest(['shallow_5', 'shallow_10', 'regularized_10']) AS candidate)", "pred"))
def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of three candidates; SQL knows how many predictions each has."""
    _, known = _model_frames(spark, sf_dir)
    board = md.select_candidate(known, known, _ORIGINS, _CANDIDATES).board
    return board.select("candidate", "n", ((F.col("mae") >= 0) & (F.col("mae") < float("inf"))).alias("fine"))


@query(sql("SELECT model, count(*) AS n, round(avg(absolute_error), 6) AS mae FROM pred GROUP BY model ORDER BY avg(absolute_error), model LIMIT 1", "pred"))
def select_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(md.select_policy(_predictions(spark, sf_dir)))


@query(sql("SELECT origin_date, target_date, horizon_days, category, area, max(absolute_error) FILTER (WHERE model = 'weekday_mean_4w') AS weekday_mean_4w, max(absolute_error) FILTER (WHERE model = 'seasonal_naive') AS seasonal_naive, max(absolute_error) FILTER (WHERE model = 'weekday_mean_4w') - max(absolute_error) FILTER (WHERE model = 'seasonal_naive') AS weekday_mean_4w_minus_seasonal_naive FROM pred GROUP BY ALL", "pred"))
def paired_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.paired_errors(_predictions(spark, sf_dir), ("weekday_mean_4w", "seasonal_naive"))


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = ft.training_slice(_model_frames(spark, sf_dir)[1], ORIGIN)
    return md.feature_importance(md.fit_challenger(train, ORIGIN, _CANDIDATES[0]), spark)


@query(sql("SELECT origin_date, target_date, horizon_days, category, area, seasonal_naive, weekday_mean_4w, TRUE AS challenger, DATE '1998-06-06' AS model_cutoff FROM base WHERE origin_date = DATE '1998-06-06'", "base"))
def forecast_next_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of the series, by all three methods; SQL knows of the challenger that it is there."""
    x, known = _model_frames(spark, sf_dir)
    model = md.fit_challenger(ft.training_slice(known, ORIGIN), ORIGIN, _CANDIDATES[0])
    segments = an.labels(spark, sf_dir)[0].crossJoin(an.labels(spark, sf_dir)[1])
    out = md.forecast_next_week(x, ORIGIN, model, ORIGIN, segments)
    return out.withColumn("challenger", F.coalesce(F.col("gbt") >= 0, F.lit(False))).withColumn("horizon_days", F.col("horizon_days").cast("int")).drop("gbt")


# 2.8 release checks and planning


@query(sql("SELECT demand_date, category, area, CASE side WHEN 'before' THEN request_count ELSE request_count + 1 END AS request_count, is_complete, side FROM (SELECT *, unnest(['before', 'after']) AS side FROM series WHERE day(demand_date) = 5 AND is_complete)", "series"))
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots written with their digests; only the days that differ are compared row by row."""
    s = an.series(spark, sf_dir)
    changed = s.withColumn("request_count", F.when(F.dayofmonth("demand_date") == 5, F.col("request_count") + 1).otherwise(F.col("request_count")))
    paths = [new_path(spark, "snapshot") for _ in range(2)]
    for path, snapshot in zip(paths, (s, changed), strict=True):
        dg.write_snapshot(snapshot, path, "demand_date")
    return dg.snapshot_drift(spark, *paths)


@query("""SELECT count(*) AS n_rows, concat_ws('-', CAST(sum(CAST('0x' || substr(d, 1, 15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(d, 16, 15) AS HUGEINT)) AS VARCHAR)) AS fingerprint
    FROM (SELECT md5(o_orderkey || '|' || coalesce(o_orderpriority, '<null>') || '|' || coalesce(o_orderstatus, '<null>')) AS d FROM orders)""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.content_fingerprint(an.table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", "o_orderstatus")


@query(sql("SELECT origin_date, category, area, horizon_days, target_date, seasonal_naive, weekday_mean_4w, TRUE AS challenger FROM base WHERE origin_date = DATE '1998-06-06'", "base"))
def release_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choose a candidate by validation, evaluate it on later origins, forecast a week, check, write the release, check its files, read its forecast."""
    x, _ = _model_frames(spark, sf_dir)
    series = stored(an.series(spark, sf_dir), "series")
    path = new_path(spark, "release")
    ex.release(series, x, path, ORIGIN, _ORIGINS[:2], _ORIGINS[2:], _CANDIDATES)
    out = files.read_release_table(spark, path, "forecast")
    return out.select("origin_date", "category", "area", F.col("horizon_days").cast("int").alias("horizon_days"), "target_date", "seasonal_naive", "weekday_mean_4w", (F.col("gbt") >= 0).alias("challenger"))


def _releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A release per area and weekly origin of the series, some of them faulty."""
    base = bt.baseline_predictions(an.series(spark, sf_dir), FIRST, LAST).withColumn("gbt", F.col("weekday_mean_4w"))
    day = F.dayofmonth("origin_date")
    rid = F.concat_ws("/", "area", F.col("origin_date").cast("string")).alias("release_id")
    forecasts = base.select(rid, *base.columns).filter(~((day == 10) & (F.col("horizon_days") == 7))).withColumn("seasonal_naive", F.when((day == 17) & (F.col("horizon_days") == 1), F.lit(-1.0)).otherwise(F.col("seasonal_naive")))
    forecasts = forecasts.filter(~((day == 24) & (F.col("category") == "5-LOW")))
    cats = an.labels(spark, sf_dir)[0].agg(F.sort_array(F.collect_set("category")).alias("categories"))
    own = base.select("area", "origin_date").distinct().crossJoin(F.broadcast(cats))
    releases = own.select(
        rid, F.when(day == 31, 2).otherwise(1).alias("version"), F.lit("weekday_mean_4w").alias("policy"), "origin_date", F.col("area"), F.lit("ALL").alias("agency"), "categories",
        F.when(day == 7, F.date_add("origin_date", 1)).otherwise(F.col("origin_date")).alias("model_cutoff"), F.date_add("origin_date", 1).alias("generated_at"),
    )
    return releases, forecasts


_RELEASES = """rel AS (SELECT DISTINCT area || '/' || origin_date AS release_id, area, origin_date, day(origin_date) AS d FROM base2),
    vio AS (SELECT release_id, CASE d WHEN 10 THEN 'not seven days per category' WHEN 17 THEN 'invalid quantities' WHEN 24 THEN 'scope mismatch' WHEN 31 THEN 'unsupported version or policy' WHEN 7 THEN 'model newer than origin' END AS violation FROM rel WHERE d IN (7, 10, 17, 24, 31))"""
_BASE2 = "base2 AS (SELECT category, area, origin_date FROM (SELECT category, area, demand_date AS origin_date, count(request_count) OVER (PARTITION BY category, area ORDER BY demand_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS n FROM series) WHERE n = 28 AND origin_date BETWEEN DATE '1995-02-04' AND DATE '2001-06-30' AND (origin_date - DATE '1995-02-04') % 7 = 0)"


@query(sql(f", {_BASE2}, {_RELEASES} SELECT * FROM vio", "series"))
def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.release_violations(*_releases(spark, sf_dir))


@query(sql(f", {_BASE2}, {_RELEASES} SELECT 'ALL' AS agency, area, release_id, origin_date, CAST(row_number() OVER (PARTITION BY area ORDER BY origin_date DESC) AS INTEGER) AS release_rank FROM rel WHERE release_id NOT IN (SELECT release_id FROM vio)", "series"))
def release_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases, forecasts = _releases(spark, sf_dir)
    return rl.release_catalog(releases, rl.release_violations(releases, forecasts))


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.baseline_predictions(an.series(spark, sf_dir), FIRST, LAST)


_PLAN = "total AS forecast_requests, CAST(ceil(total / throughput) AS BIGINT) AS required_staff, throughput * staff AS available_capacity, greatest(total - throughput * staff, 0) AS unserved_requests, greatest(CAST(ceil(total / throughput) AS BIGINT) - staff, 0) AS staff_gap"


@query(sql(f"SELECT target_date, {_PLAN} FROM (SELECT target_date, sum(weekday_mean_4w) AS total, CAST(2.5 AS DOUBLE) AS throughput, CAST(3 AS BIGINT) AS staff FROM base WHERE area = 'ASIA' AND category IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY target_date)", "base"))
def staffing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.staffing_plan(_forecast(spark, sf_dir).filter("area = 'ASIA'"), PRIORITIES, "weekday_mean_4w", 2.5, 3)


_SCENARIOS = [("a", "seasonal_naive", 2.0, 2), ("b", "weekday_mean_4w", 2.0, 2), ("c", "weekday_mean_4w", 0.5, 1)]
_PLANS = f"""plans AS (SELECT scenario_id, area, model, target_date, {_PLAN} FROM (SELECT area, target_date, 'seasonal_naive' AS model, sum(seasonal_naive) AS total FROM base GROUP BY ALL UNION ALL SELECT area, target_date, 'weekday_mean_4w', sum(weekday_mean_4w) FROM base GROUP BY ALL)
    JOIN (VALUES {', '.join(f"('{a}', '{b}', CAST({c} AS DOUBLE), CAST({d} AS BIGINT))" for a, b, c, d in _SCENARIOS)}) AS s(scenario_id, model, throughput, staff) USING (model))"""


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.staffing_scenarios(_forecast(spark, sf_dir), spark.createDataFrame(_SCENARIOS, "scenario_id string, model string, throughput double, staff long"), scope=("area",))


@query(sql(f", {_PLANS} SELECT * FROM plans", "base"))
def staffing_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir)


@query("""SELECT o_orderkey AS scenario_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown method' WHEN o_orderkey % 11 = 0 THEN 'no categories' WHEN o_orderkey % 13 = 0 THEN 'unknown categories' WHEN o_totalprice < 20000 THEN 'bad throughput' ELSE 'bad staff' END AS violation
    FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_totalprice < 20000 OR floor(o_totalprice) <> o_totalprice""")
def scenario_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken for scenarios: price less 20,000 as throughput, price as staff."""
    k = F.col("o_orderkey")
    rows = an.table(spark, sf_dir, "orders").select(
        k.alias("scenario_id"), F.when(k % 7 == 0, "guess").otherwise("seasonal_naive").alias("model"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 13 == 0, F.array(F.lit("none"))).otherwise(F.array("o_orderpriority")).alias("categories"),
        F.when(F.col("o_totalprice") < 20000, 0.0).otherwise(1.0).alias("throughput"), F.col("o_totalprice").alias("staff"),
    )
    return st.scenario_violations(rows, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query(sql(f", {_PLANS} SELECT scenario_id, area, sum(forecast_requests) AS total_requests, max(required_staff) AS peak_staff, CAST(sum(required_staff) AS BIGINT) AS staff_days, round(sum(unserved_requests), 6) AS total_unserved FROM plans GROUP BY ALL", "base"))
def scenario_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.scenario_kpis(_plans(spark, sf_dir), "scenario_id", "area"))


@query(sql("SELECT demand_date, max(request_count) FILTER (WHERE category = '1-URGENT') AS \"1-URGENT\", max(request_count) FILTER (WHERE category = '2-HIGH') AS \"2-HIGH\", max(request_count) FILTER (WHERE category = '3-MEDIUM') AS \"3-MEDIUM\" FROM series WHERE area = 'ASIA' AND is_complete GROUP BY demand_date ORDER BY demand_date DESC LIMIT 56", "series"))
def history_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.history_pivot(an.series(spark, sf_dir).filter("area = 'ASIA'"), PRIORITIES)


@query(sql("SELECT model, count(*) AS n, round(avg(absolute_error), 6) AS mae, round(sum(absolute_error) / sum(actual) * 100, 6) AS wape_percent, round(avg(error), 6) AS bias, model = 'weekday_mean_4w' AS is_benchmark FROM pred GROUP BY model", "pred"))
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.metric_report(bt.summarize_errors(_predictions(spark, sf_dir), "model")))


# 2.9 streaming


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = an.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query(sql(f", {_STATE} SELECT request_id, complaint_type, borough, payload_hash, first_seen_run, last_seen_run FROM state", "stage"))
def stream_ingest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows landed as files by run, two runs' files a batch, streamed into state that is kept; it equals the batch result.

    A run is as many files, and the state as many buckets, as its rows need (``tasks``): no task holds a run, or a fixed share of the state."""
    pages, kept = new_path(spark, "landed"), new_path(spark, "state")
    n = tasks(spark, an.table(spark, sf_dir, "lineitem").count())
    an.stage(spark, sf_dir).repartitionByRange(n, "run_id", "request_id").write.partitionBy("run_id").parquet(pages)
    landed = spark.read.parquet(pages)
    files_of_two = -(-2 * len(landed.inputFiles()) // max(1, landed.select("run_id").distinct().count()))
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", max(2, files_of_two)).parquet(pages).withColumn("run_id", F.col("run_id").cast("long"))
    state = KeptState(spark, kept, stream.schema, order=("run_id", *ORDER), buckets=max(16, n), most=2)
    jobs.stream_kept_state(stream, state, new_path(spark, "state-checkpoint")).awaitTermination()
    return state.read().select("request_id", "complaint_type", "borough", "payload_hash", "first_seen_run", "last_seen_run")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_to_table(jobs.stream_dedup_requests(_events(spark, sf_dir), "ts", "user_id", "event_type", late="60 days").select("user_id", "event_type"), "dedup")


@query("SELECT CAST(ts AS DATE) AS demand_date, event_type AS category, count(*) AS request_count FROM events GROUP BY ALL")
def stream_daily_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_to_table(jobs.stream_daily_demand(_events(spark, sf_dir), "ts", "event_type"), "daily", "complete")


@query("SELECT CAST(ts AS DATE) AS demand_date, event_type AS category, count(*) AS request_count FROM events GROUP BY ALL")
def stream_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that land in two parts, the second with rows of days closed by then: the stream's counts, and those days counted anew."""
    events = an.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    landed, counts, checkpoint = (new_path(spark, f"late-{name}") for name in ("landed", "counts", "checkpoint"))
    for part in (events.filter("event_id % 10 <> 0"), events.filter("event_id % 10 = 0")):
        part.write.mode("append").parquet(landed)
        late.stream_counted_days(spark.readStream.schema(events.schema).parquet(landed), counts, checkpoint, "ts", "event_type", 7).awaitTermination()
    return late.rebuilt_counts(spark, counts, spark.read.schema(events.schema).parquet(landed), "ts", "event_type")
