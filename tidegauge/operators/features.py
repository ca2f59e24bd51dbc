"""Examples for direct seven-day forecasts: calendar, history and weekday features that never look past the origin."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.holidays import holiday_calendar
from ..functions.scalars import row_digest
from .backtest import HISTORY, SEGMENT, lag_value, windows
from .sums import running_totals

# The feature columns and their order.
NUMERIC = (
    "horizon_days", "target_weekday", "target_weekend", "target_day_of_month", "target_month", "target_holiday", "target_before_holiday", "target_after_holiday",
    "origin_last", "origin_lag7", "mean7", "mean14", "mean28", "std7", "std28", "min7", "max7", "recent_trend",
    "weekday_lag1", "weekday_lag2", "weekday_lag3", "weekday_lag4", "weekday_mean4", "weekday_trend",
)
CATEGORICAL = ("category", "area")


def calendar_features(target: Column, horizon: Column) -> dict[str, Column]:
    """Of the target day; Monday is 0."""
    return {"horizon_days": horizon, "target_weekday": F.weekday(target), "target_weekend": (F.weekday(target) >= 5).cast("int"), "target_day_of_month": F.dayofmonth(target), "target_month": F.month(target)}


def with_holidays(rows: DataFrame, first_year: int, last_year: int, target: str = "target_date") -> DataFrame:
    """target_holiday, target_before_holiday (the next day is one), target_after_holiday (the day before was)."""
    days = holiday_calendar(rows.sparkSession, first_year, last_year).agg(F.collect_set("holiday_date").alias("_days"))
    out = rows.crossJoin(F.broadcast(days))  # one row, about eleven days a year
    day = F.col(target)
    for name, d in (("target_holiday", day), ("target_before_holiday", F.date_add(day, 1)), ("target_after_holiday", F.date_sub(day, 1))):
        out = out.withColumn(name, F.array_contains("_days", d).cast("int"))
    return out.drop("_days")


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _std(a: Column) -> Column:
    """Population deviation."""
    mean = _mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))


def _last(n: int, skip: int = 0) -> Column:
    return F.slice("hist", HISTORY - n - skip + 1, n)


def history_features() -> dict[str, Column]:
    """Of the 28 values up to the origin."""
    return {
        "origin_last": F.element_at("hist", HISTORY), "origin_lag7": F.element_at("hist", HISTORY - 7),
        "mean7": _mean(_last(7)), "mean14": _mean(_last(14)), "mean28": _mean(F.col("hist")), "std7": _std(_last(7)), "std28": _std(F.col("hist")),
        "min7": F.array_min(_last(7)), "max7": F.array_max(_last(7)), "recent_trend": _mean(_last(7)) - _mean(_last(7, 7)),
    }


def weekday_features(h: Column) -> dict[str, Column]:
    """The four same weekdays before the target, their mean, and the last one against it."""
    lags = [lag_value(h, k) for k in (1, 2, 3, 4)]
    mean = (lags[0] + lags[1] + lags[2] + lags[3]) / 4
    return {f"weekday_lag{k}": x for k, x in enumerate(lags, 1)} | {"weekday_mean4": mean, "weekday_trend": lags[0] - mean}


def _origins(series: DataFrame, first: date, last: date, step: int) -> DataFrame:
    return windows(series, first, last, 7).filter(F.pmod(F.datediff("origin_date", F.lit(first)), F.lit(step)) == 0)


def build_examples(series: DataFrame, first: date, last: date, step: int = 1, require_targets: bool = True) -> DataFrame:
    """One row per eligible segment-origin and horizon 1 to 7: features, origin_date, target_date, feature_max_date, history_start_date, actual (null where not known)."""
    ready = _origins(series, first, last, step).filter(F.size("hist") == HISTORY)
    ready = ready.filter(F.size("fut") == 7) if require_targets else ready
    before = ready.select(*SEGMENT, "origin_date", "hist", "fut", *[c.alias(k) for k, c in history_features().items()])
    out = before.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("target_date", F.date_add("origin_date", F.col("horizon")))
    h = F.col("horizon")
    out = out.select(
        *SEGMENT, "origin_date", "target_date", F.col("origin_date").alias("feature_max_date"), F.date_sub("origin_date", HISTORY - 1).alias("history_start_date"),
        F.try_element_at("fut", h).alias("actual"), *[c.alias(k) for k, c in calendar_features(F.col("target_date"), h).items()], *history_features(), *[c.alias(k) for k, c in weekday_features(h).items()],
    )
    out = with_holidays(out, first.year, last.year + 1)
    return out.select("origin_date", "target_date", "feature_max_date", "history_start_date", "actual", *CATEGORICAL, *NUMERIC)


def example_skips(series: DataFrame, first: date, last: date, step: int = 1, require_targets: bool = True) -> DataFrame:
    """Segment-origins without examples, with the reason."""
    reason = F.when(F.size("hist") < HISTORY, "incomplete_28_day_history")
    reason = reason.when(F.size("fut") < 7, "incomplete_target_window") if require_targets else reason
    return _origins(series, first, last, step).select("origin_date", *SEGMENT, reason.alias("reason")).filter("reason is not null")


def training_slice(examples: DataFrame, cutoff: date) -> DataFrame:
    """Examples whose target is known by the cutoff."""
    return examples.filter((F.col("target_date") <= F.lit(cutoff)) & F.col("actual").isNotNull())


def training_slices(examples: DataFrame, origins: DataFrame) -> DataFrame:
    """All slices at once: each example with every cutoff (fit_date) not before its target. Aggregate the result, don't keep it."""
    cutoffs = origins.select(F.col("origin_date").alias("fit_date"))
    return examples.filter("actual is not null").join(cutoffs, F.col("target_date") <= F.col("fit_date"))


def leak_free(cutoff: date | None = None) -> Column:
    """feature_max_date <= origin_date < target_date <= cutoff."""
    fine = (F.col("feature_max_date") <= F.col("origin_date")) & (F.col("origin_date") < F.col("target_date"))
    return fine & (F.col("target_date") <= F.lit(cutoff)) if cutoff else fine


def leakage_violations(examples: DataFrame, cutoff: date | None = None) -> DataFrame:
    """Rows that break feature_max_date <= origin_date < target_date <= cutoff."""
    return examples.filter(~F.coalesce(leak_free(cutoff), F.lit(False))).select("origin_date", "target_date", "feature_max_date", *SEGMENT)


def example_weights(examples: DataFrame) -> DataFrame:
    """The examples with ``weight``: one over the rows that share the target and segment, scaled to a mean of one."""
    share = 1.0 / F.count("*").over(Window.partitionBy("target_date", *SEGMENT))
    total = examples.select("target_date", *SEGMENT).agg(F.count("*").alias("_n"), F.countDistinct("target_date", *SEGMENT).alias("_t"))
    return examples.withColumn("weight", share).crossJoin(F.broadcast(total)).withColumn("weight", F.col("weight") * F.col("_n") / F.col("_t")).drop("_n", "_t")


def training_audit(examples: DataFrame, origins: DataFrame) -> DataFrame:
    """Per cutoff: first and last target, rows, distinct targets and an order-free sum of row hashes.

    Days are summed first; cutoffs lie among them as days of no rows, and running totals give all slices in two passes."""
    known = examples.filter("actual is not null")
    digest = F.conv(F.substring(row_digest("origin_date", "target_date", *SEGMENT), 1, 15), 16, 10).cast("decimal(38,0)")
    daily = known.groupBy("target_date").agg(F.count("*").alias("n"), F.countDistinct(*SEGMENT).alias("t"), F.sum(digest).alias("d"))
    cutoffs = origins.select(F.col("origin_date").alias("day")).distinct()
    days = daily.withColumn("day", F.col("target_date")).unionByName(cutoffs, allowMissingColumns=True)
    sums = {"n": ("sum", "n"), "t": ("sum", "t"), "d": ("sum", "d"), "first": ("min", "target_date"), "last": ("max", "target_date")}
    met = running_totals(days, "day", sums).join(cutoffs, "day").filter("n > 0")
    return met.select(F.col("day").alias("fit_date"), F.col("first").alias("min_training_target"), F.col("last").alias("max_training_target"), F.col("n").alias("training_rows"), F.col("t").alias("unique_training_targets"), F.col("d").cast("string").alias("content_sum"))
