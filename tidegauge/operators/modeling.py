"""Challenger models on Spark ML: encoding, fits, walk-forward evaluation and selection.

Spark's boosted trees know no Poisson loss; candidates are boosted trees on squared loss (clipped at 0) and a Poisson
regression with a log link, in the same protocol. The method column says ``gbt``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import tree_digests
from ..sources.shared import stored
from .backtest import SEGMENT, summarize_errors
from .features import CATEGORICAL, NUMERIC, example_weights, leak_free, training_audit, training_slice

KEY = ("origin_date", "target_date", "horizon_days", *SEGMENT)
METHODS = ("gbt", "seasonal_naive", "weekday_mean_4w")
#: Fits that run at the same time, each in a scheduler pool of its own (of use with spark.scheduler.mode FAIR).
FITS_AT_ONCE = 6
#: Rows of a part of a fit's table.
FIT_ROWS = 25_000
#: What a fit or a score may fail with: rows that break a rule, and errors of Spark.
FIT_ERRORS = (ValueError, PySparkException, Py4JError)


@dataclass
class Candidate:
    """A named choice of model: family ``gbt`` or ``poisson``, and its parameters."""

    id: str
    family: str = "gbt"
    params: dict = field(default_factory=dict)


def encoder_stages() -> list:
    """Category codes from training rows only, in label order; an unseen label or a value that is not finite is an error."""
    codes = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_code" for c in CATEGORICAL], stringOrderType="alphabetAsc", handleInvalid="error")
    return [codes, VectorAssembler(inputCols=[*NUMERIC, *[f"{c}_code" for c in CATEGORICAL]], outputCol="features", handleInvalid="error")]


def encode_features(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with category codes and the feature vector, fitted on ``train``."""
    numeric = [F.col(c).cast("double").alias(c) if c in NUMERIC else F.col(c) for c in rows.columns]
    return Pipeline(stages=encoder_stages()).fit(train).transform(rows.select(*numeric))


def _not_finite() -> Column:
    """Rows of which a numeric feature is null, NaN or infinite."""
    out = F.lit(False)
    for c in NUMERIC:
        x = F.col(c).cast("double")
        out = out | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return out


def fit_challenger(train: DataFrame, cutoff: date, candidate: Candidate) -> PipelineModel | None:
    """A model of matured examples; None stands for the constant zero where all labels are zero.

    All rules are checked in one pass over the rows, which also finds the labels of the categories. Rows may have their ``weight``
    already, in any scale, of which the mean is made one; else they get it here."""
    row = train.agg(
        F.count("*").alias("n"), F.sum("actual").alias("s"), F.min("actual").alias("m"), F.count_if(~F.coalesce(leak_free(cutoff), F.lit(False))).alias("leaks"), F.count_if(_not_finite()).alias("odd"),
        *[F.collect_set(c).alias(c) for c in CATEGORICAL], F.sum(F.col("weight") if "weight" in train.columns else F.lit(1.0)).alias("w"),
    ).first()
    if row["leaks"]:
        raise ValueError("immature targets or future features in the training rows")
    if not row["n"] or row["m"] is None or row["m"] < 0:
        raise ValueError("no training rows, or labels below zero")
    if row["odd"]:
        raise ValueError("a feature is missing or not finite in the training rows")
    if row["s"] == 0:
        return None
    scaled = F.round(F.col("weight") * (row["n"] / row["w"]), 12)
    weighted = (train.withColumn("weight", scaled) if "weight" in train.columns else example_weights(train)).withColumn("label", F.col("actual"))
    if candidate.family == "gbt":
        model = GBTRegressor(**({"maxDepth": 3, "maxIter": 20, "minInstancesPerNode": 20, "stepSize": 0.05, "maxBins": 32, "seed": 42, "weightCol": "weight", "checkpointInterval": 10} | candidate.params))
    else:
        model = GeneralizedLinearRegression(**({"family": "poisson", "link": "log", "regParam": 0.1, "maxIter": 15, "weightCol": "weight"} | candidate.params))
    codes = StringIndexerModel.from_arrays_of_labels([sorted(row[c]) for c in CATEGORICAL], list(CATEGORICAL), [f"{c}_code" for c in CATEGORICAL], handleInvalid="error")
    assembler = encoder_stages()[1]
    # a fit reads its rows many times: they are assembled once, and dealt by their keys, so that a refit sees them in the same parts
    dealt = weighted.repartition(max(1, -(-row["n"] // FIT_ROWS)), *[F.col(c) for c in KEY])
    rows = stored(assembler.transform(codes.transform(dealt)).select("features", "label", "weight"), "assembled")
    return PipelineModel([codes, assembler, model.fit(rows)])


def predict_challenger(model: PipelineModel | None, rows: DataFrame) -> DataFrame:
    """``rows`` with prediction, at least 0. A value that is not finite shows as null, for a check to find."""
    if model is None:
        return rows.withColumn("prediction", F.lit(0.0))
    out = model.transform(rows).drop("features", *[f"{c}_code" for c in CATEGORICAL])
    p = F.col("prediction")
    return out.withColumn("prediction", F.when(F.isnan(p) | (F.abs(p) == float("inf")), None).otherwise(F.greatest(p, F.lit(0.0))))


def save_model(model: PipelineModel | None, path: str, cutoff: date, spark: SparkSession | None = None) -> None:
    """Model (None: the constant zero), feature list, cutoff and the digests of the model's files; never over an older one."""
    spark = spark or SparkSession.getActiveSession()
    digests = "array<struct<path: string, sha256: string>>"
    if model is not None:
        model.save(f"{path}/model")
        files = tree_digests(spark, f"{path}/model").agg(F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("files"))  # a few files of a model
    else:
        files = spark.range(1).select(F.array().cast(digests).alias("files"))
    about = spark.createDataFrame([(list((*NUMERIC, *CATEGORICAL)), cutoff, "constant_zero" if model is None else "pipeline")], "features array<string>, cutoff date, kind string")
    about.crossJoin(files).write.mode("errorifexists").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | None, date]:
    """Model and cutoff; refused where the saved feature list is not this one, or a file of the model is not the one saved."""
    row = spark.read.parquet(f"{path}/metadata").first()
    if list(row["features"]) != [*NUMERIC, *CATEGORICAL]:
        raise ValueError("the saved model has other features")
    if row["kind"] == "constant_zero":
        return None, row["cutoff"]
    if sorted((r["path"], r["sha256"]) for r in row["files"]) != sorted(tuple(r) for r in tree_digests(spark, f"{path}/model").collect()):
        raise ValueError("model checksum mismatch")
    return PipelineModel.load(f"{path}/model"), row["cutoff"]


def _scored(rows: DataFrame) -> DataFrame:
    methods = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prediction")) for m, c in (("gbt", "prediction"), ("seasonal_naive", "weekday_lag1"), ("weekday_mean_4w", "weekday_mean4"))])
    out = rows.select(*KEY, F.col("actual"), F.explode(methods).alias("m")).select(*KEY, "m.model", "actual", "m.prediction")
    return out.withColumn("error", F.col("actual") - F.col("prediction")).withColumn("absolute_error", F.abs("error"))


@dataclass
class Walk:
    """A walk's predictions, the origins left out with the reason, and a row about the training of each fit."""

    predictions: DataFrame
    skips: DataFrame
    audit: DataFrame


def at_once(spark: SparkSession, jobs: Sequence[Callable[[], object]], most: int = FITS_AT_ONCE) -> list[object]:
    """What each job returns, or the FIT_ERRORS it ends with, which touches no other. Jobs run side by side, so that one's small
    stages fill the cores that another leaves idle."""

    def alone(i: int) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % most}")
        try:
            return jobs[i]()
        except FIT_ERRORS as e:
            return e

    with ThreadPoolExecutor(max(1, min(most, len(jobs)))) as pool:
        return list(pool.map(inheritable_thread_target(alone), range(len(jobs))))


def _fitted(train: DataFrame, window: DataFrame, origin: date, candidate: Candidate, minimum_rows: int, keep: str | None) -> DataFrame:
    """Scored predictions of one origin's window; ValueError where they cannot be had."""
    if train.limit(minimum_rows).count() < minimum_rows:
        raise ValueError("too few training rows")
    for c in CATEGORICAL:
        if not window.select(c).distinct().join(train.select(c).distinct(), c, "left_anti").isEmpty():
            raise ValueError(f"unseen or missing label in {c}")
    model = fit_challenger(train, origin, candidate)
    out = stored(_scored(predict_challenger(model, window)), "walk")
    if not out.filter("prediction is null").isEmpty():
        raise ValueError("a prediction is not finite")
    if keep:
        save_model(model, f"{keep}/{origin}", origin, train.sparkSession)
    return out


def _walks(training: DataFrame, forecast: DataFrame, origins: Sequence[date], candidates: Sequence[Candidate], minimum_rows: int, keep: str | None) -> list[Walk]:
    """A walk per candidate. All fits, of all candidates and origins, run at once over one stored table, cut by cutoff: an example's
    weight is one over the horizons that share its target, the same at every cutoff."""
    spark = training.sparkSession
    asked = forecast.filter(F.col("origin_date").isin(list(origins)))
    week = F.array(*[F.lit(h) for h in range(1, 8)])
    partial = asked.groupBy("origin_date", *SEGMENT).agg(F.sort_array(F.collect_list(F.col("horizon_days").cast("int"))).alias("h")).filter(F.col("h") != week)
    if not partial.isEmpty():
        raise ValueError("the forecast frame has a partial segment window")
    there = {r[0] for r in asked.select("origin_date").distinct().collect()}  # at most the origins asked for
    known = stored(example_weights(training_slice(training, max(origins))), "training")
    asked = stored(asked, "asked")
    todo = [(c, o) for c in candidates for o in origins if o in there]

    def job(c: Candidate, o: date) -> Callable[[], object]:
        return lambda: _fitted(training_slice(known, o), asked.filter(F.col("origin_date") == F.lit(o)), o, c, minimum_rows, keep)

    found = dict(zip([(c.id, o) for c, o in todo], at_once(spark, [job(c, o) for c, o in todo]), strict=True))
    out = []
    for c in candidates:
        parts, skips, fits = [], [], []
        for o in origins:
            got = found.get((c.id, o))
            if got is None:
                skips.append((o, "*", "*", "no_complete_forecast_windows"))
            elif isinstance(got, DataFrame):
                parts.append(got)
                fits.append((o,))
            else:
                skips.append((o, "*", "*", f"model_ineligible: {str(got).strip().splitlines()[0]}"))
        every = parts[0] if parts else _scored(forecast.limit(0).withColumn("prediction", F.lit(0.0)))
        for p in parts[1:]:
            every = every.unionByName(p)
        out.append(Walk(every, spark.createDataFrame(skips, "origin_date date, category string, area string, reason string"), training_audit(known, spark.createDataFrame(fits, "origin_date date"))))
    return out


def walk(training: DataFrame, forecast: DataFrame, origins: Sequence[date], candidate: Candidate, minimum_rows: int = 100, keep: str | None = None) -> Walk:
    """Per origin: fit on what has matured, score the window, all three methods on the same keys.

    A segment's window must have all seven days (ValueError). An origin without windows, or one that cannot be fitted or
    scored, whatever the error, is left out for all methods and named in ``skips``. ``keep``: a folder for the model of each origin."""
    return _walks(training, forecast, origins, [candidate], minimum_rows, keep)[0]


def walk_forward(training: DataFrame, forecast: DataFrame, origins: Sequence[date], candidate: Candidate, minimum_rows: int = 100) -> DataFrame:
    """The predictions of ``walk``."""
    return walk(training, forecast, origins, candidate, minimum_rows).predictions


def pairing_violations(predictions: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Keys with a method twice, without exactly the expected methods, or with more than one actual."""
    found = predictions.groupBy(*KEY).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("model")).alias("models"), F.countDistinct("actual").alias("actuals"))
    reason = F.when(F.col("n") > F.size("models"), "duplicate predictions").when(F.col("models") != F.array(*[F.lit(m) for m in sorted(methods)]), "methods differ").when(F.col("actuals") != 1, "actuals differ")
    return found.select(*KEY, reason.alias("violation")).filter("violation is not null")


def rank_candidates(errors: DataFrame) -> DataFrame:
    """candidate, n, mae, wape, bias of the challenger, best first by mae, then id (``errors``: candidate and predictions)."""
    return summarize_errors(errors.filter(F.col("model") == "gbt"), "candidate").drop("actual_total").orderBy("mae", "candidate")


@dataclass
class Selection:
    """The candidate chosen, the ranking, and predictions, skips and audit of all candidates (column ``candidate``)."""

    best: Candidate
    board: DataFrame
    predictions: DataFrame
    skips: DataFrame
    audit: DataFrame

    def chosen(self) -> DataFrame:
        """Predictions of the candidate chosen."""
        return self.predictions.filter(F.col("candidate") == self.best.id).drop("candidate")


def select_candidate(training: DataFrame, validation: DataFrame, origins: Sequence[date], candidates: Sequence[Candidate], minimum_rows: int = 100) -> Selection:
    """The best candidate by validation. Refused where a candidate's methods were not scored on the same keys, or candidates cover
    different ones. No target after the last validation origin is learnt from."""
    walks = _walks(training_slice(training, max(origins)), validation, origins, candidates, minimum_rows, None)
    tables = []
    for part in ("predictions", "skips", "audit"):
        own = [getattr(w, part).withColumn("candidate", F.lit(c.id)) for c, w in zip(candidates, walks, strict=True)]
        every = own[0]
        for x in own[1:]:
            every = every.unionByName(x)
        tables.append(every)
    every = tables[0]
    covered = {r["candidate"] for r in every.select("candidate").distinct().collect()}  # candidates are few
    if covered != {c.id for c in candidates}:
        raise ValueError("no eligible paired predictions")
    per = every.groupBy("candidate", *KEY).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("model")).alias("models"), F.countDistinct("actual").alias("actuals"))
    if not per.filter((F.col("n") > F.size("models")) | (F.col("models") != F.array(*[F.lit(m) for m in sorted(METHODS)])) | (F.col("actuals") != 1)).isEmpty():
        raise ValueError("methods were not scored on identical keys")
    uneven = every.groupBy(*KEY).agg(F.countDistinct("candidate").alias("n")).filter(F.col("n") != len(candidates))
    if not uneven.isEmpty():
        raise ValueError("candidates cover different keys")
    board = rank_candidates(every)
    best = board.first()["candidate"]
    return Selection(next(c for c in candidates if c.id == best), board, *tables)


def record_selection(selection: Selection, path: str, target_end: date, evaluation_first: date) -> DataFrame:
    """Write the choice, before anything of the evaluation is fitted: candidate, its parameters, the last target it was chosen on, the
    first origin of the evaluation and the default method. Never over an older one."""
    if target_end > evaluation_first:
        raise ValueError("validation reaches into evaluation")
    spark = selection.predictions.sparkSession
    c = selection.best
    about = (c.id, c.family, json.dumps(c.params, sort_keys=True), "pooled validation mae", target_end, evaluation_first, select_policy(selection.chosen()).first()["model"])
    row = spark.createDataFrame([about], "candidate string, family string, params string, metric string, selection_target_end date, evaluation_first_origin date, policy string")
    row.write.mode("errorifexists").parquet(path)
    return spark.read.schema(row.schema).parquet(path)


def select_policy(predictions: DataFrame) -> DataFrame:
    """The default method: lowest mae over all methods, ties by name. One row."""
    return summarize_errors(predictions, "model").orderBy("mae", "model").limit(1).select("model", "n", "mae")


def paired_errors(predictions: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Absolute errors side by side per key, and the first method's against the others."""
    wide = predictions.groupBy(*KEY).pivot("model", list(methods)).agg(F.first("absolute_error"))
    first, *others = methods
    return wide.select(*KEY, *methods, *[(F.col(first) - F.col(o)).alias(f"{first}_minus_{o}") for o in others])


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """feature, gain, largest first; of a model without importances, no rows."""
    found = getattr(model.stages[-1], "featureImportances", None)
    rows = list(zip([*NUMERIC, *CATEGORICAL], [float(x) for x in found.toArray()], strict=True)) if found is not None else []
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")


def forecast_next_week(examples: DataFrame, origin: date, model: PipelineModel | None = None, cutoff: date | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Seven days of every segment from one origin: the challenger (null without a model) and both baselines. ``examples`` come from ``build_examples``
    without required targets. Refused where one of ``segments`` (all that ``examples`` have, if none are given) lacks its seven days, as
    after a day of its history that is not complete."""
    if cutoff is not None and cutoff > origin:
        raise ValueError("the model is newer than the origin")
    rows = examples.filter(F.col("origin_date") == F.lit(origin))
    wanted = (examples if segments is None else segments).select(*SEGMENT).distinct()
    there = rows.groupBy(*SEGMENT).agg(F.countDistinct("horizon_days").alias("days")).filter("days = 7")
    missing = wanted.join(there, list(SEGMENT), "left_anti").limit(1).collect()
    if missing or rows.isEmpty():
        raise ValueError(f"no complete history at the origin: {missing[0].asDict() if missing else 'no segment has one'}")
    rows = predict_challenger(model, rows) if model is not None else rows.withColumn("prediction", F.lit(None).cast("double"))
    return rows.select("origin_date", "target_date", "horizon_days", *SEGMENT, F.col("weekday_lag1").alias("seasonal_naive"), F.col("weekday_mean4").alias("weekday_mean_4w"), F.col("prediction").alias("gbt"), F.lit(cutoff).cast("date").alias("model_cutoff"))
