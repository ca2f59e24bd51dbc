"""Forecasts to staffing: pooled demand, required staff, what-if scenarios, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("seasonal_naive", "weekday_mean_4w")


def _plan(total: Column, throughput: Column, staff: Column) -> list[Column]:
    total = total.cast("double")
    required, capacity = F.ceil(total / throughput), throughput * staff
    zero = F.lit(0)
    return [total.alias("forecast_requests"), required.alias("required_staff"), capacity.alias("available_capacity"), F.greatest(total - capacity, zero.cast("double")).alias("unserved_requests"), F.greatest(required - staff, zero).alias("staff_gap")]


def _exact(c: str) -> Column:
    """Sums of decimals do not depend on their order, so neither does the ceiling."""
    return F.sum(F.col(c).cast("decimal(28,6)"))


def staffing_plan(forecast: DataFrame, categories: Sequence[str], model: str, throughput: float, staff: int) -> DataFrame:
    """Per day: the forecast over the categories, staff needed at so many requests each, capacity, and what stays unserved. Nothing carries over."""
    daily = forecast.filter(F.col("category").isin(list(categories))).groupBy("target_date").agg(_exact(model).alias("total"))
    return daily.select("target_date", *_plan(F.col("total"), F.lit(float(throughput)), F.lit(int(staff)).cast("long")))


def staffing_scenarios(forecast: DataFrame, scenarios: DataFrame, methods: Sequence[str] = METHODS, scope: Sequence[str] = ("agency", "area")) -> DataFrame:
    """The plan for many scenarios (scenario_id, model, throughput, staff) over every scope at once. Demand is pooled first; scenarios are few and meet totals only."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("decimal(28,6)").alias("v")) for m in methods])).alias("m")
    pooled = forecast.select(*scope, "target_date", long).groupBy(*scope, "target_date", F.col("m.model").alias("model")).agg(F.sum("m.v").alias("total"))
    met = pooled.join(scenarios, "model")
    return met.select("scenario_id", *scope, "model", "target_date", *_plan(F.col("total"), F.col("throughput"), F.col("staff")))


def scenario_violations(scenarios: DataFrame, categories: Sequence[str], methods: Sequence[str] = METHODS) -> DataFrame:
    """scenario_id, violation (the first): throughput not finite or positive; staff negative or fractional; no or unknown categories; unknown method. Needs columns staff (double) and categories (array)."""
    t, s = F.col("throughput"), F.col("staff")
    known = F.array(*[F.lit(c) for c in categories])
    reason = (
        F.when(~F.coalesce(F.col("model").isin(*methods), F.lit(False)), "unknown method")
        .when(F.coalesce(F.size("categories"), F.lit(0)) <= 0, "no categories")
        .when(F.size(F.array_except("categories", known)) > 0, "unknown categories")
        .when(t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")) | (t <= 0), "bad throughput")
        .when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")) | (s < 0) | (F.floor(s) != s), "bad staff")
    )
    return scenarios.select("scenario_id", reason.alias("violation")).filter("violation is not null")


def scenario_kpis(plan: DataFrame, *by: str) -> DataFrame:
    """Total requests, peak staff, staff-days and total unserved of each scenario and scope."""
    return plan.groupBy(*by).agg(F.sum("forecast_requests").alias("total_requests"), F.max("required_staff").alias("peak_staff"), F.sum("required_staff").alias("staff_days"), F.sum("unserved_requests").alias("total_unserved"))


def history_pivot(series: DataFrame, categories: Sequence[str], days: int = 56) -> DataFrame:
    """The last ``days`` days with a complete row, one column per category (an area's series)."""
    own = series.filter(F.col("is_complete") & F.col("category").isin(list(categories)))
    return own.groupBy("demand_date").pivot("category", list(categories)).agg(F.first("request_count")).orderBy(F.desc("demand_date")).limit(days)


def metric_report(metrics: DataFrame, benchmark: str = "weekday_mean_4w") -> DataFrame:
    """model, n, mae, wape_percent, bias, and whether it is the benchmark."""
    return metrics.select("model", "n", "mae", (F.col("wape") * 100).alias("wape_percent"), "bias", (F.col("model") == benchmark).alias("is_benchmark"))
