"""Digest trees, merged intervals, running totals, one-pass staging and even database ranges against plain versions."""

import gzip
import json
import random
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import coverage as cv
from tidegauge.operators import digests as dg
from tidegauge.operators import features as ft
from tidegauge.operators import release as rl
from tidegauge.operators import staging as sg
from tidegauge.operators.normalize import normalize_requests, reject_summary
from tidegauge.operators.sums import merged_intervals, running_totals
from tidegauge.sources import files

D = date(2024, 1, 1)
ROW = "day date, area string, `a.b` long"


def snapshot(spark, rows, path):
    dg.write_snapshot(spark.createDataFrame(rows, ROW), str(path), "day")
    return str(path)


def test_drift_by_digests(spark, tmp_path):
    rows = [(D + timedelta(i // 3), None if i % 7 == 0 else "x", None if i % 11 == 0 else i) for i in range(300)] + [(None, "n", 1), (None, "n", 1), (D, "t", 5), (D, "t", 5)]
    other = [r for r in rows if r != (D + timedelta(20), "x", 61)] + [(D + timedelta(99), "new", 1), (D, "t", 5), (None, "n", None)]
    a, b = snapshot(spark, rows, tmp_path / "a"), snapshot(spark, random.sample(other, len(other)), tmp_path / "b")
    assert dg.changed_days(spark, a, b) == ["2024-01-01", "2024-01-21", "2024-04-09", "none"]
    got = sorted(dg.snapshot_drift(spark, a, b).collect(), key=str)
    assert got == sorted(rl.snapshot_drift(spark.createDataFrame(rows, ROW), spark.createDataFrame(other, ROW)).collect(), key=str) and len(got) == 4


def test_equal_snapshots_read_no_rows(spark, tmp_path):
    rows = [(D + timedelta(i), "x", i) for i in range(100)]
    a, b = snapshot(spark, rows, tmp_path / "a"), snapshot(spark, rows[::-1], tmp_path / "b")
    drift = dg.snapshot_drift(spark, a, b)
    assert drift.isEmpty() and "FileScan" not in drift._jdf.queryExecution().executedPlan().toString()
    changed = snapshot(spark, [*rows[:-1], (D + timedelta(99), "x", -1)], tmp_path / "c")
    plan = dg.snapshot_drift(spark, a, changed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan and "2024-04" in plan and "EqualTo(_on,2024-04-09)" in plan


def test_odd_snapshots(spark, tmp_path):
    empty = snapshot(spark, [], tmp_path / "e")
    full = snapshot(spark, [(None, None, None)], tmp_path / "f")
    assert dg.snapshot_drift(spark, empty, empty).isEmpty()
    assert [tuple(r) for r in dg.snapshot_drift(spark, empty, full).collect()] == [(None, None, None, "after")]
    dg.write_snapshot(spark.createDataFrame([(D,)], "day date"), str(tmp_path / "g"), "day")
    with pytest.raises(ValueError, match="different columns"):
        dg.snapshot_drift(spark, full, str(tmp_path / "g"))
    with pytest.raises(ValueError, match="not allowed"):
        dg.write_snapshot(spark.createDataFrame([(D, 1)], "day date, _on int"), str(tmp_path / "h"), "day")


def test_null_and_its_name_differ(spark, tmp_path):
    a, b = snapshot(spark, [(D, "<null>", 1)], tmp_path / "a"), snapshot(spark, [(D, None, 1)], tmp_path / "b")
    assert dg.snapshot_drift(spark, a, b).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_merged_intervals(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), D + timedelta(s := r.randrange(60)), D + timedelta(s + r.randrange(-1, 6))) for _ in range(25)] + [("a", None, D), ("b", D, None)]
    got = merged_intervals(spark.createDataFrame(rows, "k string, s date, e date"), "s", "e", "k").orderBy("k", "s").collect()
    days = {(k, s + timedelta(i)) for k, s, e in rows if s and e for i in range((e - s).days + 1)}
    out = [(g.k, g.s + timedelta(i)) for g in got for i in range((g.e - g.s).days + 1)]
    assert set(out) == days and len(out) == len(days)
    assert all(x.k != y.k or x.e + timedelta(1) < y.s for x, y in zip(got, got[1:], strict=False))


def test_days_that_many_runs_fetch_are_unfolded_once(spark):
    schema = "run_id long, mode string, status string, source_count long, rows_fetched long, window_start date, window_end date, fetched_at timestamp"
    rows = [(i, "incremental", "ok", 1, 1, (end := D + timedelta(i)) - timedelta(29), end, datetime(end.year, end.month, end.day, 17)) for i in range(400) if i % 9]
    days = cv.covered_days(spark.createDataFrame(rows, schema), D - timedelta(10), D + timedelta(365))
    # at noon of the last day of its window a run covers all days but that one
    plain = {r[5] + timedelta(i) for r in rows for i in range(29)}
    got = [x[0] for x in days.collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in plain if D - timedelta(10) <= x <= D + timedelta(365)}


def test_running_totals(spark):
    rows = [(None, 1), (3, 2), (3, None), (1, 5), (2, -4), (9, None), (3, 7)] + [(i % 50, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = [tuple(x) for x in running_totals(df, "k", {"n": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, 5).orderBy(F.col("k").asc_nulls_first()).collect()]
    want = []
    for k in [None, *range(50)]:
        own = [v for x, v in rows if v is not None and (x is None or k is not None and x <= k)]
        want.append((k, sum(own), min(own), max(own)))
    assert got == want
    assert running_totals(df.filter("false"), "k", {"n": ("sum", "v")}).isEmpty()
    nulls = running_totals(spark.createDataFrame([(1, None)], "k int, v int"), "k", {"n": ("sum", "v"), "hi": ("max", "v")}).first()
    assert (nulls.n, nulls.hi) == (0, None)


def test_training_audit_has_no_range_join(spark):
    x = spark.range(300).select(F.date_add(F.lit(D), (F.col("id") % 40).cast("int")).alias("target_date"), F.lit(D).alias("origin_date"), F.lit("c").alias("category"), (F.col("id") % 3).cast("string").alias("area"), F.when(F.col("id") % 5 > 0, 1.0).alias("actual"))
    origins = spark.createDataFrame([(D + timedelta(i),) for i in (-3, 0, 7, 7, 39, 60)], "origin_date date")
    got = ft.training_audit(x, origins)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = [r for r in x.collect() if r.actual is not None]
    want = []
    for c in (D + timedelta(7), D + timedelta(39), D + timedelta(60)):  # no row is known at the others
        own = [r for r in rows if r.target_date <= c]
        want.append((c, min(r.target_date for r in own), max(r.target_date for r in own), len(own), len({(r.target_date, r.area) for r in own})))
    assert [tuple(r)[:5] for r in got.orderBy("fit_date").collect()] == want


GOOD = {"unique_key": "7", "created_date": "2026-09-09T23:40:00.000", "agency": "WORKS", "complaint_type": "Noise", "borough": "north"}


def test_stage_pages(spark, tmp_path):
    lines = [json.dumps(GOOD), "", json.dumps(GOOD | {"unique_key": "8", "extra": 1}), "{broken", "[1, 2]", "5", json.dumps(GOOD | {"borough": ""}), json.dumps(GOOD | {"unique_key": "x"}), json.dumps({}), json.dumps(GOOD)[:-3]]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text("\n".join(lines[:4]) + "\n")
    with gzip.open(tmp_path / "p" / "two.json.gz", "wt") as f:
        f.write("\n".join(lines[4:]))
    out = str(tmp_path / "out")
    spark.sparkContext.setJobGroup(group := f"stage-{uuid.uuid4().hex}", "one pass")
    seen = sg.stage_pages(spark, str(tmp_path / "p"), out)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    assert seen["rows_read"] == 9 and seen["rows_staged"] == 2 and seen["rows_skipped"] == 7
    bad = sg.quarantine(spark, out).groupBy("reject_reason").count().collect()
    assert {r.reject_reason: r["count"] for r in bad} == {k: n for k, n in seen.items() if n and not k.startswith("rows_")} == {sg.BROKEN: 4, "missing borough": 1, "non-numeric unique_key": 1, "missing unique_key": 1}
    assert {r.text for r in sg.quarantine(spark, out).filter(F.col("reject_reason") == sg.BROKEN).collect()} == {"{broken", "[1, 2]", "5", lines[-1]}
    own = sg.staged(spark, out)
    plain = normalize_requests(files.read_request_pages(spark, str(tmp_path / "p")), "ordinal")
    assert sorted(own.drop("ordinal").collect(), key=str) == sorted(plain.select(*own.drop("ordinal").columns).collect(), key=str)
    assert sg.stage_pages(spark, str(tmp_path / "p"), out) == seen and sg.staged(spark, out).count() == 2  # again
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.json").write_text("\n\n")
    assert set(sg.stage_pages(spark, str(tmp_path / "none"), str(tmp_path / "o2")).values()) == {0}


def test_reasons_agree(spark):
    raw = spark.createDataFrame([(1, *[None] * len(files.RAW.names))], "run_id long, " + ", ".join(f"{f} string" for f in files.RAW.names))
    assert reject_summary(raw).first().reject_reason in sg.REASONS


def test_database_in_even_ranges(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    df = spark.range(2000).select((F.pow(F.col("id") / 100, 4)).cast("long").alias("k"), (F.col("id") % 2).cast("string").alias("side"), F.col("id").alias("v"))
    df.write.option("createTableColumnTypes", "side VARCHAR(8)").jdbc(url, "t")
    got = files.read_table_jdbc_evenly(spark, url, "t", "k", 8, {"side": "1"})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.filter("side = '1'").collect()))
    assert "EqualTo(side,1)" in got._jdf.queryExecution().executedPlan().toString()
    whole = files.read_table_jdbc_evenly(spark, url, "t", "k", 8)
    sizes = [r["count"] for r in whole.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 2 * min(sizes)
