"""Checks of daily series, rolling-origin baselines and their errors.

A segment's values are packed into arrays of a block of days with margins; of them, each day slices the last 28 values and
the next ones, and everything else is arithmetic on those arrays. A series has demand_date, category, area, request_count, is_complete; its segment is category
and area.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = ("category", "area")
HISTORY = 28
#: Days of a block of a packed series, without its margins.
BLOCK_DAYS = 64
MODELS = ("seasonal_naive", "weekday_mean_4w")
CUTS = {"overall": ("model",), "by_category": ("model", "category", "area"), "by_horizon": ("model", "horizon_days"), "by_origin": ("model", "origin_date"), "by_category_horizon": ("model", "category", "area", "horizon_days")}
NEEDED = ("demand_date", "category", "area", "request_count", "is_complete")


def series_violations(series: DataFrame) -> DataFrame:
    """violation, demand_date, category, area: missing columns; repeated segment days; complete counts that are null, negative, not finite or fractional."""
    spark = series.sparkSession
    lacking = sorted(set(NEEDED) - set(series.columns))
    if lacking:
        return spark.createDataFrame([(f"missing column {c}",) for c in lacking], "violation string").select("violation", *[F.lit(None).cast(t).alias(c) for c, t in (("demand_date", "date"), ("category", "string"), ("area", "string"))])
    keys = ["demand_date", *SEGMENT]
    twice = series.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate segment day").alias("violation"), *keys)
    x = F.col("request_count").cast("double")
    bad = x.isNull() | F.isnan(x) | (x < 0) | (F.abs(x) == float("inf")) | (F.floor(x) != x)
    return twice.unionByName(series.filter(F.col("is_complete") & bad).select(F.lit("bad complete count").alias("violation"), *keys))


def weekly_origins(spark: SparkSession, first: date, last: date, step: int = 7, modelling: bool = False) -> DataFrame:
    """origin_date from ``first`` to ``last`` every ``step`` days; for modelling the ends must be in order and fall on one weekday."""
    if step < 1 or first > last or (modelling and (last - first).days % 7):
        raise ValueError("origins need ordered ends, on one weekday for modelling, and a positive step")
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr(f"interval {step} day"))).alias("origin_date"))


def protocol_violations(settings: DataFrame, candidates: DataFrame) -> DataFrame:
    """violation: of a one-row frame of dates (data_start, validation_first, validation_last, evaluation_first, evaluation_last) and of candidate ids."""
    d = {k: F.col(k) for k in ("data_start", "validation_first", "validation_last", "evaluation_first", "evaluation_last")}
    rules = [
        (F.date_add(d["validation_last"], 7) > d["evaluation_first"], "validation reaches into evaluation"),
        (F.date_add(d["data_start"], HISTORY) > d["validation_first"], "too little history before validation"),
        ((d["validation_first"] > d["validation_last"]) | (d["evaluation_first"] > d["evaluation_last"]), "origins out of order"),
        ((F.datediff(d["validation_last"], d["validation_first"]) % 7 != 0) | (F.datediff(d["evaluation_last"], d["evaluation_first"]) % 7 != 0), "origins on different weekdays"),
    ]
    found = settings.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))).alias("violation"))
    twice = candidates.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate candidate id").alias("violation"))
    odd = candidates.filter(~F.coalesce(F.col("id"), F.lit("")).rlike("^[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*$")).select(F.lit("bad candidate id").alias("violation"))
    none = candidates.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("no candidates").alias("violation"))
    return found.unionByName(twice).unionByName(odd).unionByName(none)


def packed_series(series: DataFrame, first_day: date, last_day: date, horizon: int = 7, segment: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Per segment and block of BLOCK_DAYS days of the range: ``start``, the block's first day as a number, and ``values``, dense: from HISTORY - 1
    days before it to ``horizon`` days after its last one; null where a day has no complete value. Every segment has all blocks.

    The series shuffles once: a value goes to its own block and, if it lies in their margin, to the blocks beside it."""
    keys = list(segment)
    first, blocks = (first_day - date(1970, 1, 1)).days, (last_day - first_day).days // BLOCK_DAYS + 1
    n = F.unix_date("demand_date")
    at = n - F.lit(first)

    def block(days: Column) -> Column:
        return F.floor(days / BLOCK_DAYS).cast("int")

    own = F.sequence(F.greatest(block(at - horizon), F.lit(0)), F.least(block(at + HISTORY - 1), F.lit(blocks - 1)))
    known = series.filter("is_complete and request_count is not null").filter(F.col("demand_date").between(F.lit(first_day - timedelta(days=HISTORY - 1)), F.lit(last_day + timedelta(days=horizon))))
    placed = known.select(*keys, F.struct(n.alias("n"), F.col("request_count").cast("double").alias("v")).alias("e"), F.explode(own).alias("block"))
    none = F.lit(None).cast("struct<n:int,v:double>").alias("e")
    every = series.select(*keys).distinct().select(*keys, none, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = placed.unionByName(every).groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    start = F.lit(first) + F.col("block") * BLOCK_DAYS
    days = F.sequence(start - (HISTORY - 1), start + BLOCK_DAYS - 1 + horizon)
    return found.select(*keys, start.alias("start"), F.transform(days, lambda d: F.try_element_at("m", d)).alias("values"))


def windows(series: DataFrame, first_day: date, last_day: date, horizon: int = 7, segment: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Per segment and day of the range: hist (complete values of the 28 days up to it, oldest first) and fut (horizon to value after it).

    Both are slices of a packed series, in which a day without a row is a hole and not a shift."""
    packed = packed_series(series, first_day, last_day, horizon, segment)
    day = packed.select(*segment, "start", "values", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_DAYS - 1))).alias("i"))
    day = day.withColumn("origin_date", F.date_from_unix_date(F.col("start") + F.col("i"))).filter(F.col("origin_date") <= F.lit(last_day))
    hist = F.filter(F.slice("values", F.col("i") + 1, HISTORY), lambda v: v.isNotNull())
    ahead = F.transform(F.slice("values", F.col("i") + 1 + HISTORY, horizon), lambda v, k: F.struct((k + 1).alias("k"), v.alias("v")))
    return day.select(*segment, "origin_date", hist.alias("hist"), F.map_from_entries(F.filter(ahead, lambda e: e["v"].isNotNull())).alias("fut"))


def _at_origins(series: DataFrame, first: date, last: date, horizon: int, step: int) -> DataFrame:
    if first > last or step < 1 or not 1 <= horizon <= 7:
        raise ValueError("origins out of order, or a step or horizon out of range")
    return windows(series, first, last, horizon).filter(F.pmod(F.datediff("origin_date", F.lit(first)), F.lit(step)) == 0)


def _reason(horizon: int) -> Column:
    return F.when(F.size("hist") < HISTORY, "incomplete_28_day_history").when(F.size("fut") < horizon, "incomplete_target_window")


def origin_eligibility(series: DataFrame, first: date, last: date, horizon: int = 7, step: int = 7) -> DataFrame:
    """origin_date, category, area, reason (null where eligible; missing history goes before missing targets)."""
    return _at_origins(series, first, last, horizon, step).select("origin_date", *SEGMENT, _reason(horizon).alias("reason"))


def backtest_skips(series: DataFrame, first: date, last: date, horizon: int = 7, step: int = 7) -> DataFrame:
    """Segment-origins left out, with the reason."""
    return origin_eligibility(series, first, last, horizon, step).filter("reason is not null")


def lag_value(h: Column, k: int) -> Column:
    """The value 7 * k days before the target at horizon ``h``, from ``hist``."""
    return F.element_at("hist", (HISTORY + h - 7 * k).cast("int"))


def seasonal_naive(h: Column) -> Column:
    """The value a week before the target."""
    return lag_value(h, 1)


def weekday_mean_4w(h: Column) -> Column:
    """Mean of the four same weekdays before the target."""
    return (lag_value(h, 1) + lag_value(h, 2) + lag_value(h, 3) + lag_value(h, 4)) / 4


def baseline_predictions(series: DataFrame, first: date, last: date, horizon: int = 7, step: int = 7) -> DataFrame:
    """Both baselines for every segment-origin with a full history: origin_date, target_date, horizon_days, category, area, two columns."""
    ready = _at_origins(series, first, last, horizon, step).filter(F.size("hist") == HISTORY)
    out = ready.select(*SEGMENT, "origin_date", "hist", "fut", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_days"))
    h = F.col("horizon_days")
    return out.select("origin_date", F.date_add("origin_date", h).alias("target_date"), "horizon_days", *SEGMENT, seasonal_naive(h).alias("seasonal_naive"), weekday_mean_4w(h).alias("weekday_mean_4w"))


def rolling_backtest(series: DataFrame, first: date, last: date, horizon: int = 7, step: int = 7) -> DataFrame:
    """Predictions of both baselines at every eligible segment-origin and horizon: actual, prediction, error (actual minus prediction), absolute_error."""
    ready = _at_origins(series, first, last, horizon, step).filter(_reason(horizon).isNull())
    out = ready.select(*SEGMENT, "origin_date", "hist", "fut", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_days"))
    h = F.col("horizon_days")
    both = F.array(F.struct(F.lit(MODELS[0]).alias("model"), seasonal_naive(h).alias("p")), F.struct(F.lit(MODELS[1]).alias("model"), weekday_mean_4w(h).alias("p")))
    out = out.select("origin_date", F.date_add("origin_date", h).alias("target_date"), "horizon_days", *SEGMENT, F.try_element_at("fut", h).alias("actual"), F.explode(both).alias("m"))
    error = F.col("actual") - F.col("m.p")
    return out.select("origin_date", "target_date", "horizon_days", *SEGMENT, "m.model", "actual", F.col("m.p").alias("prediction"), error.alias("error"), F.abs(error).alias("absolute_error"))


def _metrics() -> list[Column]:
    total = F.sum("actual")
    wape = F.when(total != 0, F.sum("absolute_error") / total)
    return [F.count("*").alias("n"), F.avg("absolute_error").alias("mae"), wape.alias("wape"), F.avg("error").alias("bias"), total.alias("actual_total")]


def summarize_errors(predictions: DataFrame, *by: str) -> DataFrame:
    """n, mae, wape (sum of errors over sum of actuals; null if that is 0), bias and actual_total per group; null keys are groups."""
    return predictions.groupBy(*by).agg(*_metrics())


def summarize_all_levels(predictions: DataFrame) -> DataFrame:
    """The five customary cuts in one pass over grouping sets; ``cut`` names each."""
    columns = ["model", "category", "area", "horizon_days", "origin_date"]
    sets = [[F.col(c) for c in own] for own in CUTS.values()]
    grouped = predictions.groupingSets(sets, *[F.col(c) for c in columns]).agg(*_metrics(), *[F.grouping(c).alias(f"_{c}") for c in columns[1:]])
    cut = F.when((F.col("_category") == 0) & (F.col("_horizon_days") == 0), "by_category_horizon").when(F.col("_category") == 0, "by_category").when(F.col("_horizon_days") == 0, "by_horizon").when(F.col("_origin_date") == 0, "by_origin").otherwise("overall")
    return grouped.select(cut.alias("cut"), *columns, "n", "mae", "wape", "bias", "actual_total")
