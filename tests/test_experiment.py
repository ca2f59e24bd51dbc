"""Fits side by side, what they leave out, the order of an experiment, and what a release refuses."""

import os
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import experiment as ex
from tidegauge.operators import features as ft
from tidegauge.operators import modeling as md
from tidegauge.operators import release as rl

START = date(2026, 1, 1)
SERIES = "demand_date date, category string, area string, request_count long, is_complete boolean"
P = md.Candidate("p", "poisson")
TREES = md.Candidate("t", "gbt", {"maxIter": 3, "maxDepth": 2})


def series(spark, days=120, categories=("a", "b")):
    rows = [(START + timedelta(days=i), c, "X", (i * 7919 + k * 31) % 50 + i % 7, True) for i in range(days) for k, c in enumerate(categories)]
    return spark.createDataFrame(rows, SERIES)


@pytest.fixture(scope="module")
def examples(spark):
    return ft.build_examples(series(spark), START + timedelta(days=27), START + timedelta(days=119), 1, require_targets=False).cache()


def known(x):
    return x.filter("actual is not null")


def test_fits_at_once_give_what_fits_alone_give(spark, examples):
    x, origins = known(examples), [START + timedelta(days=70 + 7 * k) for k in range(3)]
    found = md.select_candidate(x, x, origins, [P, TREES])
    assert found.board.count() == 2 and {r.candidate for r in found.audit.collect()} == {"p", "t"} and found.audit.count() == 6 and found.skips.isEmpty()
    for c in (P, TREES):
        for o in origins:
            train = ft.training_slice(x, o)
            alone = md.predict_challenger(md.fit_challenger(train, o, c), x.filter(F.col("origin_date") == F.lit(o)))
            keys = ["target_date", "category", "area"]
            both = alone.select(*keys, F.col("prediction").alias("alone")).join(found.predictions.filter((F.col("model") == "gbt") & (F.col("candidate") == c.id) & (F.col("origin_date") == F.lit(o))), keys)
            assert both.count() == 14
            assert both.agg(F.max(F.abs(F.col("alone") - F.col("prediction")))).first()[0] < 0.01  # of about 25; iterations end within a tolerance


def test_a_selection_learns_nothing_after_its_last_origin(spark, examples):
    x, origins = known(examples), [START + timedelta(days=70), START + timedelta(days=77)]
    changed = x.withColumn("actual", F.when(F.col("target_date") > F.lit(origins[-1]), F.col("actual") + 1000).otherwise(F.col("actual")))
    a, b = (md.select_candidate(t, x, origins, [P]).predictions.orderBy("target_date", "category", "model").select("prediction").collect() for t in (x, changed))
    assert a == b


def test_one_failing_fit_touches_no_other(spark, examples):
    x, origins = known(examples), [START + timedelta(days=70), START + timedelta(days=90)]
    late = F.col("target_date") == F.lit(origins[1])
    for bad in (float("nan"), float("inf"), None):
        odd = x.withColumn(ft.NUMERIC[-1], F.when(late, F.lit(bad).cast("double")).otherwise(F.col(ft.NUMERIC[-1]).cast("double")))
        got = md.walk(odd, x, origins, P)
        assert {r.origin_date for r in got.predictions.collect()} == {origins[0]}
        assert [(r.origin_date, "finite" in r.reason) for r in got.skips.collect()] == [(origins[1], True)]
    wrong = md.Candidate("w", "gbt", {"maxBins": 1})  # Spark refuses it
    got = md.walk(x, x, origins, wrong)
    assert got.predictions.isEmpty() and got.skips.filter("reason like 'model_ineligible: %'").count() == 2
    with pytest.raises(ValueError, match="no eligible"):
        md.select_candidate(x, x, origins, [P, wrong])


def test_jobs_run_side_by_side(spark):
    began = time.time()
    got = md.at_once(spark, [lambda: time.sleep(0.5) or 1, lambda: int("x"), lambda: time.sleep(0.5) or 3], 3)
    assert (got[0], got[2]) == (1, 3) and isinstance(got[1], ValueError) and time.time() - began < 0.95


def test_a_forecast_with_a_missing_segment_is_refused(spark, examples):
    s = series(spark)
    last = START + timedelta(days=119)
    hole = s.withColumn("is_complete", ~((F.col("category") == "b") & (F.col("demand_date") == F.lit(last - timedelta(days=5)))))
    x = ft.build_examples(hole, START + timedelta(days=27), last, 1, require_targets=False)
    with pytest.raises(ValueError, match="no complete history"):
        md.forecast_next_week(x, last)
    with pytest.raises(ValueError, match="no complete history"):
        md.forecast_next_week(examples, last, segments=series(spark, 1, ("a", "b", "new")))
    with pytest.raises(ValueError, match="no complete history"):
        md.forecast_next_week(examples, last + timedelta(days=400))
    assert md.forecast_next_week(examples, last).count() == 14


def test_a_release_without_the_challengers_column_is_invalid(spark):
    o = date(2026, 3, 7)
    releases = spark.createDataFrame([("r", 1, "weekday_mean_4w", o, "X", ["a"], o)], "release_id string, version int, policy string, origin_date date, area string, categories array<string>, model_cutoff date")
    rows = [("r", o, o + timedelta(days=i), "a", "X", 1.0, 1.0) for i in range(1, 8)]
    forecasts = spark.createDataFrame(rows, "release_id string, origin_date date, target_date date, category string, area string, seasonal_naive double, weekday_mean_4w double")
    assert [r.violation for r in rl.release_violations(releases, forecasts).collect()] == ["invalid quantities"]
    assert rl.release_violations(releases, forecasts.withColumn("gbt", F.lit(1.0))).isEmpty()


def test_an_experiment_in_its_order(spark, examples, tmp_path):
    x = known(examples)
    days = [START + timedelta(days=70 + 7 * k) for k in range(4)]
    out = f"file://{tmp_path}/e"
    got = ex.experiment(x, out, days[:2], days[2:], [P, TREES])
    row = got.record.first()
    assert row.candidate == got.selection.best.id and row.selection_target_end == days[1] + timedelta(days=7) and row.evaluation_first_origin == days[2]
    assert {r.origin_date for r in got.evaluation.predictions.collect()} == set(days[2:])
    assert {d for d in os.listdir(f"{tmp_path}/e/models")} == {str(d) for d in days[2:]}
    assert md.load_model(spark, f"{out}/models/{days[2]}")[1] == days[2]
    with pytest.raises(ValueError, match="validation reaches into evaluation"):
        ex.experiment(x, f"{out}2", days[:2], days[1:], [P])
    with pytest.raises(ValueError, match="duplicate candidate"):
        ex.experiment(x, f"{out}2", days[:2], days[2:], [P, P])
    assert not os.path.exists(f"{tmp_path}/e2")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        ex.experiment(x, out, days[:2], days[2:], [P])


def test_the_forecast_job_publishes_what_selection_never_saw(spark, tmp_path):
    from jobs.forecast import main

    series(spark).write.parquet(f"{tmp_path}/series")
    origin = START + timedelta(days=119)
    main(f"file://{tmp_path}/series", f"file://{tmp_path}/r", str(origin), (P, TREES))
    t = {n: spark.read.parquet(f"{tmp_path}/r/tables/{n}") for n in os.listdir(f"{tmp_path}/r/tables")}
    assert set(t) == {"forecast", "history", "evaluation", "validation", "baseline_full", "model", "leaderboard"}
    assert t["forecast"].count() == 14 and t["forecast"].filter("gbt is null").isEmpty()
    assert {r.n for r in t["evaluation"].collect()} == {4 * 14} and {r.model for r in t["evaluation"].collect()} == set(md.METHODS)
    record = spark.read.parquet(f"{tmp_path}/r-experiment/selection").first()
    assert record.selection_target_end == origin - timedelta(days=28) == record.evaluation_first_origin
    assert spark.read.json(f"{tmp_path}/r/manifest").first().candidate == record.candidate
    # a hole in one segment's last four weeks: nothing is published
    hole = series(spark).withColumn("is_complete", ~((F.col("category") == "b") & (F.col("demand_date") == F.lit(origin - timedelta(days=2)))))
    hole.write.parquet(f"{tmp_path}/hole")
    with pytest.raises(ValueError):
        main(f"file://{tmp_path}/hole", f"file://{tmp_path}/h", str(origin), (P,))
    assert not os.path.exists(f"{tmp_path}/h")
