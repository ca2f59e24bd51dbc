"""The tables of the demand jobs, derived from the star schema, in Spark and as SQL common table expressions.

requests: orders with their customer's segment and region. raw: requests as text records with planted defects. stage: line
items as what seven fetch runs staged. ledger: those runs. series: the forecast grid of requests.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import payload_hash, tracked_payload
from ..operators.coverage import calendar_grid, covered_days, daily_forecast_grid, distinct_daily_counts
from ..sources.shared import tasks

START, END = date(1995, 1, 1), date(2001, 8, 1)
FIRST, LAST = date(1995, 2, 4), date(2001, 6, 30)
ORDER = ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")

# run_id, mode, status, window_start, window_end, started_at, fetched_at, rows_fetched, source_count, agency, area
LEDGER = [
    (1, "backfill", "ok", "1995-01-01", "1996-12-31", "1997-01-02 12:00:00", "1997-01-02 12:30:00", 100, 100, "BUILDING", "ASIA"),
    (2, "backfill", "failed", "1997-01-01", "1997-03-31", "1997-04-02 12:00:00", "1997-04-02 12:30:00", 50, 50, "BUILDING", "ASIA"),
    (3, "fixtures", "ok", "1997-01-01", "1997-03-31", "1997-04-03 12:00:00", "1997-04-03 12:30:00", 50, 50, "BUILDING", "ASIA"),
    (4, "incremental", "ok", "1997-04-01", "1998-12-31", "1999-01-01 05:00:00", "1999-01-01 05:30:00", 70, 70, "BUILDING", "ASIA"),
    (5, "incremental", "ok", "1999-01-01", "1999-02-28", "1999-03-02 12:00:00", "1999-03-02 12:30:00", 60, 61, "HOUSEHOLD", "ASIA"),
    (6, "backfill", "ok", "1999-03-01", "1999-12-31", "2000-01-01 02:30:00", "2000-01-01 03:00:00", 80, 80, "HOUSEHOLD", "ASIA"),
    (7, "incremental", "ok", "2000-01-02", "2001-08-01", "2001-08-03 12:00:00", "2001-08-03 12:30:00", 90, 90, "BUILDING", "ASIA"),
]
LEDGER_SCHEMA = "run_id long, mode string, status string, window_start date, window_end date, started_at timestamp, fetched_at timestamp, rows_fetched long, source_count long, agency string, area string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, created_at, demand_date, agency, category, area, status."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    met = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return met.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"), F.to_date("o_orderdate").alias("demand_date"),
        F.col("c_mktsegment").alias("agency"), F.col("o_orderpriority").alias("category"), F.upper("r_name").alias("area"), F.col("o_orderstatus").alias("status"),
    )


def dealt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``requests``, dealt by request to as many tasks as they need: distinct requests are found there without another shuffle."""
    return requests(spark, sf_dir).repartition(tasks(spark, table(spark, sf_dir, "orders").count()), "request_id")


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text records of all requests, with run_id; defects are planted by the request's number."""
    q = requests(spark, sf_dir)
    k = F.col("request_id")

    def every(n: int) -> Column:
        return F.pmod(k, F.lit(n)) == 0

    none = F.lit(None).cast("string")
    at = F.col("created_at")
    return q.select(
        (F.pmod(k, F.lit(7)) + 1).alias("run_id"), k.alias("source_id"),
        F.when(every(101), F.concat(F.lit("K"), k.cast("string"))).when(every(53), F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).otherwise(k.cast("string")).alias("unique_key"),
        F.when(every(97), "N/A").when(every(89), none).when(every(83), "soon").when(every(7), F.concat(_iso(at), F.lit("Z"))).otherwise(_iso(at)).alias("created_date"),
        F.when(~every(3), _iso(at + F.expr("interval 5 days"))).alias("closed_date"),
        F.when(every(41), none).when(every(43), "").otherwise(F.col("agency")).alias("agency"),
        F.concat(F.lit("Agency of "), F.col("agency")).alias("agency_name"),
        F.when(every(79), none).when(every(5), F.concat(F.lit(" "), F.col("category"), F.lit(" "))).otherwise(F.col("category")).alias("complaint_type"),
        F.when(every(11), "").otherwise(F.concat(F.lit("status "), F.col("status"))).alias("descriptor"),
        F.when(~every(13), F.col("status")).alias("status"),
        F.when(every(73), "").otherwise(F.lower("area")).alias("borough"),
        none.alias("community_board"),
        F.when(every(4), "").otherwise(_iso(at + F.expr("interval 9 days"))).alias("resolution_action_updated_date"),
        F.lit("WEB").alias("open_data_channel_type"),
    )


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs staged: run_id, request_id, complaint_type, borough, created_date, payload_hash, payload, and the columns of ORDER.

    Rows are dealt by request to a number of tasks that grows with them (a count of Parquet rows reads footers only). What is grouped by
    request, alone or with more, happens in these tasks without another shuffle."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = tasks(spark, max(li.count(), o.count()))
    li, o = li.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_linenumber").cast("long").alias("run_id"), F.col("l_orderkey").alias("request_id"), F.col("l_returnflag").alias("complaint_type"), F.col("l_linestatus").alias("borough"), F.to_date("o_orderdate").alias("created_date"), *ORDER)
    fields = ("borough", "complaint_type")
    return rows.withColumn("payload_hash", payload_hash(*fields)).withColumn("payload", tracked_payload(*fields))


def ledger(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    rows = [(*r[:3], date.fromisoformat(r[3]), date.fromisoformat(r[4]), datetime.fromisoformat(r[5] + "+00:00"), datetime.fromisoformat(r[6] + "+00:00"), *r[7:]) for r in LEDGER]
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


def labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Categories and areas of the requests."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category")).distinct(), table(spark, sf_dir, "region").select(F.upper("r_name").alias("area")).distinct()


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast grid of all categories and areas: live requests are one row each, so counts need no distinct step."""
    grid = calendar_grid(spark, START, END, *labels(spark, sf_dir))
    return daily_forecast_grid(grid, distinct_daily_counts(dealt_requests(spark, sf_dir)), covered_days(ledger(spark), START, END))


def _values() -> str:
    return ",\n".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in LEDGER)


SQL = {
    "requests": """requests AS (SELECT o_orderkey AS request_id, o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS demand_date, c_mktsegment AS agency,
        o_orderpriority AS category, upper(r_name) AS area, o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "raw": """raw AS (SELECT request_id % 7 + 1 AS run_id, request_id AS source_id,
        CASE WHEN request_id % 101 = 0 THEN 'K' || request_id WHEN request_id % 53 = 0 THEN ' ' || request_id || ' ' ELSE CAST(request_id AS VARCHAR) END AS unique_key,
        CASE WHEN request_id % 97 = 0 THEN 'N/A' WHEN request_id % 89 = 0 THEN NULL WHEN request_id % 83 = 0 THEN 'soon'
             WHEN request_id % 7 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') END AS created_date,
        CASE WHEN request_id % 3 <> 0 THEN strftime(created_at + INTERVAL 5 DAY, '%Y-%m-%dT%H:%M:%S.%g') END AS closed_date,
        CASE WHEN request_id % 41 = 0 THEN NULL WHEN request_id % 43 = 0 THEN '' ELSE agency END AS agency, 'Agency of ' || agency AS agency_name,
        CASE WHEN request_id % 79 = 0 THEN NULL WHEN request_id % 5 = 0 THEN ' ' || category || ' ' ELSE category END AS complaint_type,
        CASE WHEN request_id % 11 = 0 THEN '' ELSE 'status ' || status END AS descriptor, CASE WHEN request_id % 13 <> 0 THEN status END AS status,
        CASE WHEN request_id % 73 = 0 THEN '' ELSE lower(area) END AS borough,
        CASE WHEN request_id % 4 = 0 THEN '' ELSE strftime(created_at + INTERVAL 9 DAY, '%Y-%m-%dT%H:%M:%S.%g') END AS resolution_action_updated_date, 'WEB' AS open_data_channel_type
        FROM requests)""",
    "judged": """judged AS (SELECT *, CASE WHEN coalesce(unique_key, '') = '' THEN 'missing unique_key' WHEN coalesce(created_date, '') = '' THEN 'missing created_date'
        WHEN coalesce(complaint_type, '') = '' THEN 'missing complaint_type' WHEN coalesce(borough, '') = '' THEN 'missing borough'
        WHEN NOT regexp_matches(created_date, '^[0-9]{4}-') THEN 'unparseable created_date' WHEN NOT regexp_full_match(trim(unique_key), '[0-9]+') THEN 'non-numeric unique_key' END AS reject_reason FROM raw)""",
    "payloads": """payloads AS (SELECT *, '{' || concat_ws(',', '"agency":"' || agency || '"', '"agency_name":"' || agency_name || '"', '"borough":"' || borough || '"', '"closed_date":"' || closed_date || '"',
        '"complaint_type":"' || complaint_type || '"', '"created_date":"' || created_date || '"', '"descriptor":"' || descriptor || '"', '"open_data_channel_type":"' || open_data_channel_type || '"',
        '"resolution_action_updated_date":"' || resolution_action_updated_date || '"', '"status":"' || status || '"', '"unique_key":"' || unique_key || '"') || '}' AS payload FROM judged)""",
    "stage": """stage AS (SELECT *, sha256(payload) AS payload_hash FROM (SELECT CAST(l_linenumber AS BIGINT) AS run_id, l_orderkey AS request_id, l_returnflag AS complaint_type, l_linestatus AS borough,
        CAST(o_orderdate AS DATE) AS created_date, l_partkey, l_suppkey, l_shipdate, l_extendedprice, '{"borough":"' || l_linestatus || '","complaint_type":"' || l_returnflag || '"}' AS payload
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    "ledger": f"""ledger AS (SELECT CAST(run_id AS BIGINT) AS run_id, mode, status, CAST(window_start AS DATE) AS window_start, CAST(window_end AS DATE) AS window_end, CAST(started_at AS TIMESTAMP) AS started_at,
        CAST(fetched_at AS TIMESTAMP) AS fetched_at, CAST(rows_fetched AS BIGINT) AS rows_fetched, CAST(source_count AS BIGINT) AS source_count, agency, area
        FROM (VALUES {_values()}) AS t(run_id, mode, status, window_start, window_end, started_at, fetched_at, rows_fetched, source_count, agency, area)),
        trusted AS (SELECT * FROM ledger WHERE mode IN ('backfill', 'incremental') AND status = 'ok' AND source_count = rows_fetched)""",
    # the days near a fetch are winter days: local midnight is 05:00 of the next day
    "covered": """days AS (SELECT CAST(d AS DATE) AS demand_date FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) AS g(d)),
        covered AS (SELECT DISTINCT demand_date FROM days JOIN trusted ON demand_date BETWEEN window_start AND window_end AND fetched_at >= demand_date + INTERVAL 29 HOUR)""",
    "grid": """grid AS (SELECT demand_date, category, area FROM days CROSS JOIN (SELECT DISTINCT o_orderpriority AS category FROM orders) CROSS JOIN (SELECT DISTINCT upper(r_name) AS area FROM region))""",
    "counts": """counts AS (SELECT demand_date, category, area, count(DISTINCT request_id) AS request_count FROM requests GROUP BY ALL)""",
    "series": """series AS MATERIALIZED (SELECT g.demand_date, g.category, g.area, CASE WHEN c.demand_date IS NOT NULL THEN coalesce(n.request_count, 0) END AS request_count, c.demand_date IS NOT NULL AS is_complete
        FROM grid g LEFT JOIN counts n ON g.demand_date = n.demand_date AND g.category = n.category AND g.area = n.area LEFT JOIN covered c ON g.demand_date = c.demand_date)""",
    "win": """win AS (SELECT category, area, demand_date AS origin_date, CAST(request_count AS DOUBLE) AS v, count(request_count) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS n_hist,
        count(request_count) OVER (w ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS n_fut FROM series WINDOW w AS (PARTITION BY category, area ORDER BY demand_date))""",
    "origins": """origins AS (SELECT *, CASE WHEN n_hist < 28 THEN 'incomplete_28_day_history' WHEN n_fut < 7 THEN 'incomplete_target_window' END AS reason FROM win
        WHERE origin_date BETWEEN DATE '1995-02-04' AND DATE '2001-06-30' AND (origin_date - DATE '1995-02-04') % 7 = 0)""",
    "lags": """lags AS MATERIALIZED (SELECT category, area, demand_date AS target_date, CAST(request_count AS DOUBLE) AS actual, lag(CAST(request_count AS DOUBLE), 7) OVER w AS l1, lag(CAST(request_count AS DOUBLE), 14) OVER w AS l2,
        lag(CAST(request_count AS DOUBLE), 21) OVER w AS l3, lag(CAST(request_count AS DOUBLE), 28) OVER w AS l4 FROM series WINDOW w AS (PARTITION BY category, area ORDER BY demand_date))""",
    "pred": """pred AS (SELECT origin_date, target_date, CAST(h AS INTEGER) AS horizon_days, category, area, model, actual, prediction, actual - prediction AS error, abs(actual - prediction) AS absolute_error
        FROM (SELECT o.origin_date, l.target_date, h, category, area, unnest(['seasonal_naive', 'weekday_mean_4w']) AS model, unnest([l1, (l1 + l2 + l3 + l4) / 4]) AS prediction, actual
              FROM origins o CROSS JOIN range(1, 8) AS r(h) JOIN lags l USING (category, area) WHERE o.reason IS NULL AND l.target_date = o.origin_date + CAST(h AS INTEGER)))""",
    "base": """base AS (SELECT o.origin_date, l.target_date, CAST(h AS INTEGER) AS horizon_days, category, area, l1 AS seasonal_naive, (l1 + l2 + l3 + l4) / 4 AS weekday_mean_4w
        FROM origins o CROSS JOIN range(1, 8) AS r(h) JOIN lags l USING (category, area) WHERE o.n_hist = 28 AND l.target_date = o.origin_date + CAST(h AS INTEGER))""",
}
NEEDS = {
    "raw": ["requests"], "judged": ["raw"], "payloads": ["judged"], "covered": ["ledger"], "grid": ["covered"], "counts": ["requests"], "series": ["grid", "counts"],
    "win": ["series"], "origins": ["win"], "lags": ["series"], "pred": ["origins", "lags"], "base": ["origins", "lags"],
}


def sql(body: str, *tables: str) -> str:
    """``body`` after the common table expressions it needs."""
    order: list[str] = []

    def need(t: str) -> None:
        for x in NEEDS.get(t, []):
            need(x)
        if t not in order:
            order.append(t)

    for t in tables:
        need(t)
    head = "WITH " + ",\n".join(SQL[t] for t in order)
    return head + body if body.startswith(",") else f"{head}\n{body}"
