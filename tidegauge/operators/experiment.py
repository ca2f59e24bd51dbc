"""An experiment in its order: choose on validation, record the choice, evaluate on later origins, then publish a forecast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import release_file_violations, write_release
from ..sources.shared import stored
from . import backtest as bt
from . import modeling as md
from .changelog import require_empty
from .features import training_slice
from .release import publication_violations


@dataclass
class Experiment:
    """The choice on validation, its record as it was written, and the walk of the candidate chosen over the evaluation."""

    selection: md.Selection
    record: DataFrame
    evaluation: md.Walk


def experiment(known: DataFrame, out: str, validation: Sequence[date], evaluation: Sequence[date], candidates: Sequence[md.Candidate], minimum_rows: int = 100) -> Experiment:
    """Choose, record, evaluate. ``known``: examples of daily origins with known targets. Refused where the protocol breaks a rule, as where
    a validation target lies after the first origin of the evaluation. The choice is on disk (``out``/selection) before a model of
    the evaluation is fitted; the models of the evaluation's origins go to ``out``/models."""
    spark = known.sparkSession
    start = known.agg(F.min("history_start_date").alias("d")).first()["d"]
    settings = spark.createDataFrame([(start, validation[0], validation[-1], evaluation[0], evaluation[-1])], "data_start date, validation_first date, validation_last date, evaluation_first date, evaluation_last date")
    require_empty(bt.protocol_violations(settings, spark.createDataFrame([(c.id,) for c in candidates], "id string")), "the protocol breaks a rule")
    selection = md.select_candidate(known, known, validation, candidates, minimum_rows)
    record = md.record_selection(selection, f"{out}/selection", validation[-1] + timedelta(days=7), evaluation[0])
    walk = md.walk(known, known, evaluation, selection.best, minimum_rows, f"{out}/models")
    require_empty(md.pairing_violations(walk.predictions), "methods were not scored on the same keys")
    return Experiment(selection, record, walk)


def release(series: DataFrame, examples: DataFrame, out: str, origin: date, validation: Sequence[date], evaluation: Sequence[date], candidates: Sequence[md.Candidate], scope: DataFrame | None = None) -> Experiment:
    """An experiment and the release that stands on it: the candidate chosen, fitted again on all that has matured, forecasts the week
    after ``origin`` for every segment of the series. ``scope``: labels (column category) that the release is for; those of the series if none."""
    spark = series.sparkSession
    found = experiment(examples.filter("actual is not null"), f"{out}-experiment", validation, evaluation, candidates)
    history = stored(series.filter(F.col("demand_date") <= F.lit(origin)), "history")
    model = md.fit_challenger(training_slice(examples, origin), origin, found.selection.best)
    forecast = stored(md.forecast_next_week(examples, origin, model, origin, series), "forecast")
    tried = F.sort_array(F.collect_set("category"))
    settings = found.selection.chosen().agg(tried.alias("experiment_scope")).crossJoin((series if scope is None else scope).agg(tried.alias("release_scope"), tried.alias("categories")))
    settings = settings.withColumn("origin_date", F.lit(origin)).withColumn("evaluation_last_origin", F.lit(evaluation[-1]))
    ends = validation[0], evaluation[-1]
    require_empty(publication_violations(settings, forecast, bt.backtest_skips(history, *ends)), "not fit to publish")
    md.save_model(model, f"{out}-model", origin, spark)
    metrics = {"validation": found.selection.chosen(), "evaluation": found.evaluation.predictions, "baseline_full": bt.rolling_backtest(history, *ends)}
    tables = {"forecast": forecast, "history": history, "model": spark.read.parquet(f"{out}-model/metadata"), "leaderboard": found.selection.board} | {k: bt.summarize_errors(p, "model") for k, p in metrics.items()}
    about = found.record.select(F.lit(1).alias("version"), "policy", "candidate").withColumn("origin_date", F.lit(origin)).withColumn("model_cutoff", F.lit(origin))
    write_release(tables, out, about)
    require_empty(release_file_violations(spark, out), "the release is damaged")
    return found
