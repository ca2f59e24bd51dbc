"""Scenarios of the demand operators on small frames."""

import glob
import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.holidays import holiday_calendar
from tidegauge.operators import backtest as bt
from tidegauge.operators import changelog as cl
from tidegauge.operators import coverage as cv
from tidegauge.operators import features as ft
from tidegauge.operators import modeling as md
from tidegauge.operators import normalize as nz
from tidegauge.operators import release as rl
from tidegauge.operators import staffing as st
from tidegauge.sources import files

RECORD = {
    "unique_key": "7", "created_date": "2026-09-09T23:40:00.000", "closed_date": None, "agency": "WORKS", "agency_name": None, "complaint_type": " Noise ", "descriptor": "", "status": "Open", "borough": "north side",
    "community_board": None, "resolution_action_updated_date": None, "open_data_channel_type": None,
}


def raw(spark, *changes):
    return spark.createDataFrame([tuple((RECORD | c)[f] for f in files.RAW.names) for c in changes], files.RAW)


def test_normalize(spark):
    row = nz.normalize_requests(raw(spark, {})).first()
    assert (row.request_id, row.created_day, row.complaint_type, row.borough, row.descriptor) == (7, date(2026, 9, 9), "Noise", "NORTH SIDE", None)
    assert row.created_at == datetime(2026, 9, 9, 23, 40)
    assert list(json.loads(row.payload)) == sorted(k for k, v in RECORD.items() if v is not None)
    missing = nz.normalize_requests(raw(spark, {"agency": None})).first()
    assert missing.agency == "UNKNOWN" and "agency" not in json.loads(missing.payload)


def test_hash_follows_tracked_fields(spark):
    a, b, c = (r.payload_hash for r in nz.normalize_requests(raw(spark, {}, {"status": "Closed"}, {})).collect())
    assert a == c != b


@pytest.mark.parametrize(
    ("change", "reason"),
    [({f: None}, f"missing {f}") for f in ("unique_key", "created_date", "complaint_type", "borough")]
    + [({"created_date": "N/A"}, "unparseable created_date"), ({"created_date": "2026"}, "unparseable created_date"), ({"unique_key": "1_0"}, "non-numeric unique_key"), ({"unique_key": None, "borough": ""}, "missing unique_key")],
)
def test_rejects(spark, change, reason):
    assert nz.reject_requests(raw(spark, change)).first().reject_reason == reason


def test_months_have_no_gap(spark):
    got = [(r.window_start, r.window_end) for r in nz.month_partitions(spark, date(2026, 1, 15), date(2026, 3, 2)).orderBy("window_start").collect()]
    assert got == [(date(2026, 1, 15), date(2026, 1, 31)), (date(2026, 2, 1), date(2026, 2, 28)), (date(2026, 3, 1), date(2026, 3, 2))]


def test_scope_is_half_open(spark):
    df = spark.createDataFrame([("A", "B", datetime(2026, 1, 1)), ("A", "B", datetime(2026, 1, 2, 23, 59)), ("A", "B", datetime(2026, 1, 3)), ("A", "C", datetime(2026, 1, 1))], "agency string, area string, created_at timestamp_ntz")
    assert nz.scope_filter(df, "A", "B", date(2026, 1, 1), date(2026, 1, 2)).count() == 2


STAGE = "run_id long, ordinal long, request_id long, payload_hash string, payload string"


def test_merge_cases(spark):
    s = spark.createDataFrame([(1, 0, 1, "a", "A"), (1, 1, 2, "x", "X"), (2, 0, 1, "a", "A"), (2, 1, 2, "x", "X"), (3, 0, 1, "b", "B"), (4, 0, 3, "p", "P"), (4, 1, 3, "q", "Q"), (5, 0, 1, "a", "A")], STAGE)
    counts = {r.run_id: (r.rows_new, r.rows_changed) for r in cl.merge_counts(s).collect()}
    assert counts == {1: (2, 0), 2: (0, 0), 3: (0, 1), 4: (1, 1), 5: (0, 0)}
    assert cl.append_versions(s).count() == 5
    state = {r.request_id: (r.payload, r.first_seen_run, r.last_seen_run) for r in cl.upsert_requests(s).collect()}
    assert state == {1: ("A", 1, 5), 2: ("X", 1, 2), 3: ("Q", 4, 4)}
    stepwise = cl.upsert_requests(s.filter("run_id = 1"))
    for run in (2, 3, 4, 5, 5):  # running one again changes nothing
        stepwise = cl.merge_into_state(stepwise, s.filter(F.col("run_id") == run))
    assert {r.request_id: (r.payload, r.first_seen_run, r.last_seen_run) for r in stepwise.collect()} == state
    assert cl.new_versions(cl.append_versions(s), s).isEmpty()


def test_provenance_of_six_runs(spark):
    """Fixtures and failed runs never speak; a return to an earlier payload does."""
    day = date(2026, 8, 1)
    runs = [(1, "fixtures", "ok"), (2, "backfill", "ok"), (3, "backfill", "ok"), (4, "backfill", "ok"), (5, "incremental", "failed"), (6, "fixtures", "ok")]
    said = ["Noise", "Noise", "Parking", "Noise", "Parking", "Parking"]
    expected = [None, "Noise", "Parking", "Noise", "Noise", "Noise"]
    fields = "demand_date date, agency string, category string, area string"
    for upto in range(1, 7):
        ledger = spark.createDataFrame([(i, m, s, 1, 1, datetime(2026, 8, 2 + i, 12), datetime(2026, 8, 2 + i, 13), day, day) for i, m, s in runs[:upto]], "run_id long, mode string, status string, rows_fetched long, source_count long, started_at timestamp, fetched_at timestamp, window_start date, window_end date")
        observed = spark.createDataFrame([(1, i, day, None, said[i - 1], "B") for i in range(3, min(upto, 5) + 1)] + ([(1, 6, day, None, said[5], "B")] if upto == 6 else []), f"request_id long, run_id long, {fields}")
        first = {c: min(i for i in range(1, upto + 1) if said[i - 1] == c) for c in said[:upto]}
        versions = spark.createDataFrame([(1, i, i, day, None, c, "B") for c, i in first.items()], f"request_id long, run_id long, version_id long, {fields}")
        state = spark.createDataFrame([(1, upto, day, None, said[upto - 1], "B")], f"request_id long, last_seen_run long, {fields}")
        live = cv.live_requests(observed, versions, state, ledger).collect()
        assert [r.category for r in live] == ([expected[upto - 1]] if expected[upto - 1] else []), upto
        assert cv.covered_days(ledger, day, day + timedelta(days=1)).count() == (1 if upto > 1 else 0)


@pytest.mark.parametrize(("fetched", "n"), [(datetime(2026, 9, 10, 2), 0), (datetime(2026, 9, 10, 4), 1)])
def test_local_midnight(spark, fetched, n):
    d = date(2026, 9, 9)
    ledger = spark.createDataFrame([(1, "backfill", "ok", 0, 0, fetched, d, d, "A", "B")], "run_id long, mode string, status string, rows_fetched long, source_count long, fetched_at timestamp, window_start date, window_end date, agency string, area string")
    assert cv.covered_days(ledger, d, d).count() == n
    assert cv.covered_days_strict(ledger, spark.createDataFrame([("A", "C")], "agency string, area string"), d, d).isEmpty()


def daily(spark, values, start=date(2026, 1, 1), category="c"):
    return spark.createDataFrame([(start + timedelta(days=i), category, "a", v, v is not None) for i, v in enumerate(values)], "demand_date date, category string, area string, request_count long, is_complete boolean")


def test_perfect_week_has_no_error(spark):
    s = daily(spark, [i % 7 + 1 for i in range(42)])
    o = date(2026, 1, 28)
    e = bt.summarize_errors(bt.rolling_backtest(s, o, o), "model").collect()
    assert len(e) == 2 and all(r.n == 7 and r.mae == 0 and r.wape == 0 for r in e)


def test_unknown_is_not_zero(spark):
    o = date(2026, 1, 28)
    assert bt.rolling_backtest(daily(spark, [0] * 42), o, o).count() == 14
    assert bt.summarize_errors(bt.rolling_backtest(daily(spark, [0] * 42), o, o), "model").first().wape is None
    assert bt.backtest_skips(daily(spark, [0] * 10 + [None] + [0] * 31), o, o).first().reason == "incomplete_28_day_history"
    assert bt.backtest_skips(daily(spark, [0] * 30 + [None] + [0] * 11), o, o).first().reason == "incomplete_target_window"
    absent = daily(spark, [0] * 42).filter(F.col("demand_date") != F.lit(date(2026, 1, 10)))
    assert bt.backtest_skips(absent, o, o).first().reason == "incomplete_28_day_history"


def test_future_does_not_leak(spark):
    values = [(i * 7919) % 50 for i in range(60)]
    o = date(2026, 1, 28)
    a = ft.build_examples(daily(spark, values), o, o, require_targets=False).drop("actual")
    b = ft.build_examples(daily(spark, values[:28] + [999] * 32), o, o, require_targets=False).drop("actual")
    assert a.exceptAll(b).isEmpty() and a.count() == 7
    row = a.filter("horizon_days = 3").first()
    assert row.origin_last == values[27] and row.origin_lag7 == values[20] and row.weekday_lag1 == values[23] and row.mean7 == sum(values[21:28]) / 7


def test_example_weights_mean_one(spark):
    x = ft.build_examples(daily(spark, list(range(60))), date(2026, 1, 28), date(2026, 2, 10), require_targets=False)
    w = ft.example_weights(ft.training_slice(x, date(2026, 2, 12)))
    assert abs(w.agg(F.avg("weight")).first()[0] - 1) < 1e-12
    per = [r[0] for r in w.groupBy("target_date").agg(F.sum("weight")).select("sum(weight)").collect()]
    assert max(per) - min(per) < 1e-9


def test_zero_labels_give_zero_model(spark):
    x = ft.build_examples(daily(spark, [0] * 60), date(2026, 1, 28), date(2026, 2, 10))
    model = md.fit_challenger(x, date(2026, 3, 1), md.Candidate("z"))
    assert model is None and md.predict_challenger(model, x).agg(F.max("prediction")).first()[0] == 0
    with pytest.raises(ValueError):
        md.fit_challenger(x, date(2026, 2, 1), md.Candidate("z"))


def test_holidays(spark):
    got = [r.holiday_date for r in holiday_calendar(spark, 2026, 2026).filter("year(holiday_date) = 2026").orderBy("holiday_date").collect()]
    assert got == [date(2026, m, d) for m, d in ((1, 1), (1, 19), (2, 16), (5, 25), (6, 19), (7, 3), (9, 7), (10, 12), (11, 11), (11, 26), (12, 25))]
    assert not holiday_calendar(spark, 2000, 2000).filter(F.col("holiday_date") == F.lit(date(1999, 12, 31))).isEmpty()
    assert holiday_calendar(spark, 2020, 2020).filter("name = 'Juneteenth' and year(holiday_date) = 2020").isEmpty()


def test_staffing_pools_before_it_rounds(spark):
    f = spark.createDataFrame([(date(2026, 1, 1), "a", 10.5), (date(2026, 1, 1), "b", 9.5)], "target_date date, category string, m double")
    row = st.staffing_plan(f, ["a", "b"], "m", 10, 1).first()
    assert (row.required_staff, row.available_capacity, row.unserved_requests, row.staff_gap) == (2, 10.0, 10.0, 1)


def test_archive_files(spark, tmp_path):
    import gzip
    import hashlib

    page = tmp_path / "p1.jsonl.gz"
    page.write_bytes(gzip.compress(b'{"unique_key": "1", "other": 3}\n\n{"unique_key": "2"}\n'))
    pages = files.read_request_pages(spark, f"file://{page}")
    assert [r.unique_key for r in pages.orderBy("ordinal").collect()] == ["1", "2"]
    (tmp_path / "manifest.json").write_text(json.dumps({"coverage_basis": "x", "agency": "A", "borough": "B", "partitions": [{"start": "2026-09-09", "end": "2026-09-09", "mode": "backfill", "status": "ok", "expected_rows": 2, "files": [{"path": "p1.jsonl.gz", "rows": 2, "sha256": hashlib.sha256(page.read_bytes()).hexdigest()}, {"path": "p2", "rows": 1, "sha256": ""}]}]}, indent=1))
    manifest = files.read_archive_manifest(spark, f"file://{tmp_path}/manifest.json")
    content = files.file_digests(spark, f"file://{page}").join(files.file_rows(pages), "path")
    assert [(r.path, r.violation) for r in cv.file_violations(manifest, content).collect()] == [("p2", "file missing")]
    page.write_bytes(page.read_bytes() + b" ")
    content = files.file_digests(spark, f"file://{page}").withColumn("rows", F.lit(2))
    assert {r.violation for r in cv.file_violations(manifest, content).collect()} == {"checksum", "file missing"}


def test_release_is_never_written_over(spark, tmp_path):
    t = spark.range(3).toDF("x")
    files.write_release({"t": t}, f"file://{tmp_path}/r", t.limit(1))
    with pytest.raises(FileExistsError):
        files.write_release({"t": t}, f"file://{tmp_path}/r", t.limit(1))


@pytest.mark.skipif("TIDEGAUGE_GOLDEN" not in os.environ, reason="no folder of published figures given")
def test_published_baseline(spark):
    """A folder with a daily history and the published errors of both baselines over it."""
    (history,) = glob.glob(os.environ["TIDEGAUGE_GOLDEN"] + "/**/history.csv", recursive=True)
    s = files.read_release_csv(spark, f"file://{history}", files.DAILY)
    for name, first, last in (("baseline_full", date(2026, 6, 7), date(2026, 8, 23)), ):
        want = {r.model: r for r in files.read_release_csv(spark, f"file://{os.path.dirname(history)}/{name}.csv", files.METRICS).collect()}
        days = [r[0] for r in s.select("demand_date").distinct().orderBy("demand_date").collect()]
        got = bt.summarize_errors(bt.rolling_backtest(s, days[0] + timedelta(days=30), days[-1] - timedelta(days=8)), "model").collect()
        for r in got:
            w = want[r.model]
            assert r.n == w.n and abs(r.mae - w.mae) < 1e-12 and abs(r.wape - w.wape) < 1e-12 and abs(r.bias - w.bias) < 1e-12


def test_ingest_job_is_idempotent(spark, tmp_path):
    """Landed pages go to the log once; a second call takes only what is new."""
    from tidegauge.operators.changelog import merge_counts
    from tidegauge.streaming.jobs import merged_views, stream_ingest_merge

    def land(run, *records):
        (tmp_path / f"pages/run_id={run}").mkdir(parents=True)
        (tmp_path / f"pages/run_id={run}/p.jsonl").write_text("".join(json.dumps(RECORD | r) + "\n" for r in records))

    def take():
        stream = files.stream_request_pages(spark, f"file://{tmp_path}/pages/run_id=*").withColumn("run_id", F.regexp_extract("file", r"run_id=(\d+)", 1).cast("long"))
        stream_ingest_merge(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/state", lambda rows: nz.normalize_requests(rows, "run_id", "ordinal")).awaitTermination()
        return merged_views(spark, f"file://{tmp_path}/log")

    land(1, {}, {"unique_key": "8"}, {"status": "Late"})
    for _ in range(2):
        views = take()
        assert {r.request_id: r.status for r in views["state"].collect()} == {7: "Late", 8: "Open"}
        assert views["versions"].count() == 3 and views["observations"].count() == 2
    land(2, {"status": "Closed"})
    views = take()
    assert {r.request_id: r.status for r in views["state"].collect()} == {7: "Closed", 8: "Open"}
    assert {r.run_id: (r.rows_new, r.rows_changed) for r in merge_counts(views["observations"]).collect()} == {1: (2, 0), 2: (0, 1)}


PROTOCOL = "data_start date, validation_first date, validation_last date, evaluation_first date, evaluation_last date"


@pytest.mark.parametrize(("first", "broken"), [(date(2026, 2, 1), True), (date(2026, 2, 2), False)])
def test_protocol_asks_for_28_days(spark, first, broken):
    """The first validation origin lies 28 days after the start of the data, or later."""
    days = (date(2026, 1, 5), first, first + timedelta(days=21), first + timedelta(days=28), first + timedelta(days=35))
    ids = spark.createDataFrame([("a",)], "id string")
    settings = spark.createDataFrame([days], PROTOCOL)
    assert [r.violation for r in bt.protocol_violations(settings, ids).collect()] == (["too little history before validation"] if broken else [])
    assert "no candidates" in [r.violation for r in bt.protocol_violations(settings, ids.limit(0)).collect()]


@pytest.fixture(scope="module")
def examples(spark):
    s = daily(spark, [(i * 7919) % 50 + i % 7 for i in range(90)])
    return ft.build_examples(s, date(2026, 1, 28), date(2026, 3, 15)).cache()


def test_walk_tells_what_it_leaves_out(spark, examples):
    poisson, good, none = md.Candidate("p", "poisson"), date(2026, 3, 10), date(2026, 6, 1)
    got = md.walk(examples, examples, [good, none], poisson)
    assert got.predictions.count() == 21 and md.pairing_violations(got.predictions).isEmpty()
    assert [tuple(r) for r in got.skips.collect()] == [(none, "*", "*", "no_complete_forecast_windows")]
    row = got.audit.first()
    assert got.audit.count() == 1 and row.fit_date == good and row.max_training_target <= good and row.training_rows == ft.training_slice(examples, good).count()
    few = md.walk(examples, examples, [good], poisson, minimum_rows=100_000)
    assert few.predictions.isEmpty() and few.audit.isEmpty() and few.skips.first().reason == "model_ineligible: too few training rows"
    unseen = md.walk(examples, examples.withColumn("category", F.lit("new")), [good], poisson)
    assert unseen.predictions.isEmpty() and unseen.skips.first().reason.startswith("model_ineligible: unseen")
    with pytest.raises(ValueError, match="partial"):
        md.walk(examples, examples.filter("horizon_days <> 3"), [good], poisson)
    with pytest.raises(ValueError, match="no eligible"):
        md.select_candidate(examples, examples, [none], [poisson])


def test_a_changed_model_is_refused(spark, examples, tmp_path):
    cutoff = date(2026, 3, 10)
    md.save_model(md.fit_challenger(ft.training_slice(examples, cutoff), cutoff, md.Candidate("p", "poisson")), f"file://{tmp_path}/m", cutoff)
    assert md.load_model(spark, f"file://{tmp_path}/m")[1] == cutoff
    part = next(p for p in glob.glob(f"{tmp_path}/m/model/**/part-*", recursive=True))
    with open(part, "ab") as f:
        f.write(b"\n")
    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(ValueError, match="checksum"):
        md.load_model(spark, f"file://{tmp_path}/m")
    md.save_model(None, f"file://{tmp_path}/zero", cutoff)
    assert md.load_model(spark, f"file://{tmp_path}/zero") == (None, cutoff)


def test_a_changed_release_is_refused(spark, tmp_path):
    t = spark.range(3).toDF("x")
    root = f"{tmp_path}/r"
    files.write_release(dict.fromkeys(files.REQUIRED, t), f"file://{root}", t.limit(1))
    assert files.release_file_violations(spark, f"file://{root}").isEmpty()
    part = glob.glob(f"{root}/tables/forecast/part-*")[0]
    with open(part, "ab") as f:
        f.write(b"x")
    os.remove(os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc"))
    os.remove(glob.glob(f"{root}/tables/history/part-*")[0])
    found = {(r.path.split("/")[0], r.violation) for r in files.release_file_violations(spark, f"file://{root}").collect()}
    assert found == {("forecast", "checksum mismatch"), ("history", "file missing")}
    files.write_release({"forecast": t}, f"file://{tmp_path}/part", t.limit(1))
    lacking = {r.path for r in files.release_file_violations(spark, f"file://{tmp_path}/part").filter("violation = 'incomplete release'").collect()}
    assert lacking == set(files.REQUIRED) - {"forecast"}


@pytest.mark.parametrize(
    ("change", "violation"),
    [({}, None), ({"experiment_scope": ["x"]}, "experiment scope differs"), ({"origin_date": date(2026, 3, 6)}, "origin before the evaluation's end"), ({"categories": ["a", "b"]}, "categories without a forecast")],
)
def test_publication_rules(spark, change, violation):
    settings = {"experiment_scope": ["a"], "release_scope": ["a"], "categories": ["a"], "origin_date": date(2026, 3, 7), "evaluation_last_origin": date(2026, 2, 28)} | change
    row = spark.createDataFrame([tuple(settings.values())], "experiment_scope array<string>, release_scope array<string>, categories array<string>, origin_date date, evaluation_last_origin date")
    forecast = spark.createDataFrame([("a",)], "category string")
    assert [r.violation for r in rl.publication_violations(row, forecast, forecast.limit(0)).collect()] == ([violation] if violation else [])
    assert "incomplete baseline comparison" in [r.violation for r in rl.publication_violations(row, forecast, forecast).collect()]


def test_a_release_checks_every_models_quantities(spark):
    o = date(2026, 3, 7)
    releases = spark.createDataFrame([("r", 1, "gbt", o, "X", ["a"], o)], "release_id string, version int, policy string, origin_date date, area string, categories array<string>, model_cutoff date")
    rows = [("r", o, o + timedelta(days=i), "a", "X", 1.0, 1.0, -1.0 if i == 3 else 1.0) for i in range(1, 8)]
    forecasts = spark.createDataFrame(rows, "release_id string, origin_date date, target_date date, category string, area string, seasonal_naive double, weekday_mean_4w double, gbt double")
    assert [r.violation for r in rl.release_violations(releases, forecasts).collect()] == ["invalid quantities"]
    assert [r.violation for r in rl.release_violations(releases, forecasts.drop("gbt")).collect()] == ["invalid quantities"]
    assert rl.release_violations(releases, forecasts.withColumn("gbt", F.lit(2.0))).isEmpty()


def test_strip_takes_any_white_space(spark):
    row = nz.normalize_requests(raw(spark, {"complaint_type": "  Noise  "})).first()
    assert row.complaint_type == "Noise"


def test_a_runs_checksum_follows_order_and_content(spark):
    rows = [(1, i, i % 7, f"h{i}", "P") for i in range(50)]
    first = cl.run_checksum(spark.createDataFrame(rows, STAGE)).first().checksum
    assert cl.run_checksum(spark.createDataFrame(rows[::-1], STAGE).repartition(5)).first().checksum == first
    swapped = [(1, 1, 0, "h0", "P"), (1, 0, 1, "h1", "P"), *rows[2:]]
    assert cl.run_checksum(spark.createDataFrame(swapped, STAGE)).first().checksum != first


def test_lines_of_a_split_page_keep_their_order(spark, tmp_path):
    n = 3000
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"unique_key": str(i), "descriptor": "x" * 40}) + "\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pages = files.read_request_pages(spark, f"file://{tmp_path}/p.jsonl")
        assert pages.rdd.getNumPartitions() > 3
        assert [int(r.unique_key) for r in pages.orderBy("ordinal").select("unique_key").collect()] == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
