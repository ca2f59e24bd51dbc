"""Raw records to typed rows, rejects, scope filters and date partitions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import TRACKED, local_day, missing, parse_wall_clock, payload_hash, reject_reason, request_number, strip, tracked_payload


def judged(raw: DataFrame) -> DataFrame:
    """Raw rows with created_at, request_id and reject_reason (null where the row is good)."""
    out = raw.withColumn("created_at", parse_wall_clock(F.col("created_date"))).withColumn("request_id", request_number(F.col("unique_key")))
    return out.withColumn("reject_reason", reject_reason(F.col("created_at").isNull(), F.col("request_id").isNull()))


def typed() -> list[Column]:
    """The typed fields of a judged row that is good.

    A record without an agency gets UNKNOWN in the row but not in the payload. Text is stripped, the area is upper case."""

    def text(field: str) -> Column:
        return F.when(~missing(F.col(field)), strip(F.col(field)))

    return [
        F.col("request_id"),
        F.col("created_at"),
        local_day(F.col("created_at")).alias("created_day"),
        parse_wall_clock(F.col("closed_date")).alias("closed_at"),
        F.coalesce(text("agency"), F.lit("UNKNOWN")).alias("agency"),
        strip(F.col("complaint_type")).alias("complaint_type"),
        text("descriptor").alias("descriptor"),
        F.upper(strip(F.col("borough"))).alias("borough"),
        text("status").alias("status"),
        parse_wall_clock(F.col("resolution_action_updated_date")).alias("resolution_updated_at"),
        payload_hash(*TRACKED).alias("payload_hash"),
        tracked_payload(*TRACKED).alias("payload"),
    ]


def normalize_requests(raw: DataFrame, *keep: str) -> DataFrame:
    """Typed rows of the good records, with their payload and its hash; ``keep`` names further columns to carry."""
    return judged(raw).filter("reject_reason is null").select(*keep, *typed())


def reject_requests(raw: DataFrame, *keep: str) -> DataFrame:
    """Records that break a rule, with the first one broken."""
    return judged(raw).filter("reject_reason is not null").select(*keep, "unique_key", "created_date", "reject_reason")


def reject_summary(raw: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run and reason: records; reason null counts the good ones."""
    return judged(raw).groupBy(run, "reject_reason").agg(F.count("*").alias("n_records"))


def scope_filter(requests: DataFrame, agency: str, area: str, start: date, end: date) -> DataFrame:
    """One agency and area, created from the start of ``start`` to before the day after ``end``."""
    upto = F.date_add(F.lit(end), 1).cast("timestamp_ntz")
    at = F.col("created_at")
    return requests.filter((F.col("agency") == agency) & (F.col("area") == area) & (at >= F.lit(start).cast("timestamp_ntz")) & (at < upto))


def category_filter(requests: DataFrame, categories: list[str]) -> DataFrame:
    """Requests of the categories given."""
    return requests.filter(F.col("category").isin(categories))


def month_partitions(spark: SparkSession, start: date, end: date) -> DataFrame:
    """partition_key (YYYY-MM), window_start, window_end: calendar months cut to the range; both ends belong to it."""
    first = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start), "MM"), F.lit(end), F.expr("interval 1 month"))).alias("m"))
    return first.select(F.date_format("m", "yyyy-MM").alias("partition_key"), F.greatest("m", F.lit(start)).alias("window_start"), F.least(F.last_day("m"), F.lit(end)).alias("window_end"))


def rolling_window(requests: DataFrame, asof: date, days: int = 30) -> DataFrame:
    """Requests created from ``days`` before ``asof`` to ``asof``, by local day."""
    day = local_day(F.col("created_at"))
    return requests.filter((day >= F.date_sub(F.lit(asof), days)) & (day <= F.lit(asof)))


def live_fields(payloads: DataFrame) -> DataFrame:
    """Typed fields read back from payloads: only blanks are trimmed, and a missing agency stays null."""

    def field(name: str) -> Column:
        return F.get_json_object("payload", f"$.{name}")

    return payloads.select(
        "request_id",
        local_day(parse_wall_clock(field("created_date"))).alias("demand_date"),
        F.trim(field("agency")).alias("agency"),
        F.trim(field("complaint_type")).alias("category"),
        F.upper(F.trim(field("borough"))).alias("area"),
    )
