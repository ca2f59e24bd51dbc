"""State that is kept: batches against one aggregation of all rows, files read and written, replays and batches that end half-way."""

import glob
import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import changelog as cl
from tidegauge.operators import coverage as cv
from tidegauge.operators.kept import DailyCounts, KeptDemand, KeptState, VersionLog, count_deltas, rebuild_days, write_partitions

SCHEMA = "request_id long, run_id long, ordinal long, demand_date date, category string, area string"
DAY = date(2026, 1, 28)


def batches(spark, n=5, size=120, seed=1):
    """Rows of n runs: new requests, edits of category and day, returns to an earlier value, repeats within a run."""
    r = np.random.default_rng(seed)
    rows = [[(int(r.integers(0, 150)), run, i, DAY + timedelta(days=int(r.integers(0, 9))), str(r.choice(["a", "b"])), None if r.random() < 0.05 else "X") for i in range(size)] for run in range(n)]
    return [spark.createDataFrame(x, SCHEMA) for x in rows]


def union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def content(df, *cols):
    return sorted((tuple(x) for x in df.select(*(cols or df.columns)).collect()), key=repr)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture
def parts(spark):
    return batches(spark)


def state_of(spark, tmp_path, parts, **more):
    return KeptState(spark, f"file://{tmp_path}/state", parts[0].schema, **({"buckets": 8, "most": 2} | more))


def test_state_after_batches_is_that_of_all_rows(spark, tmp_path, parts):
    state = state_of(spark, tmp_path, parts)
    columns = ("request_id", "demand_date", "category", "area", "first_seen_run", "last_seen_run")
    for i, b in enumerate(parts):
        assert state.apply(b, i)
        assert content(state.read(), *columns) == content(cl.upsert_requests(union(parts[: i + 1])), *columns)
    assert max(len(f) for f in state.manifest().folders.values()) <= 2  # compacted


def test_a_late_batch_of_older_runs_replaces_nothing_newer(spark, tmp_path, parts):
    state = state_of(spark, tmp_path, parts)
    state.apply(parts[3], 0)
    state.apply(parts[1], 1)
    assert content(state.read(), "request_id", "category", "first_seen_run", "last_seen_run") == content(cl.upsert_requests(parts[3].unionByName(parts[1])), "request_id", "category", "first_seen_run", "last_seen_run")


def test_a_batch_reads_and_writes_its_buckets_only(spark, tmp_path, parts):
    state = state_of(spark, tmp_path, parts, buckets=64, most=50)
    for i, b in enumerate(parts[:3]):
        state.apply(b, i)
    small = parts[4].filter("request_id in (3, 4)")
    own = {r[0] for r in small.select(F.pmod(F.xxhash64("request_id"), F.lit(64))).collect()}
    read = state.touched(small).inputFiles()
    assert read and {int(f.split("bucket=")[1].split("/")[0]) for f in read} == own
    before, folders = files(f"{tmp_path}/state/data"), state.manifest().folders
    state.apply(small, 3)
    new = set(files(f"{tmp_path}/state/data")) - set(before)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == own
    assert all(state.manifest().folders[b] == folders[b] for b in folders if b not in own)


def test_replayed_and_half_written_batches_change_nothing(spark, tmp_path, parts):
    state = state_of(spark, tmp_path, parts)
    state.apply(parts[0], 0)
    state.apply(parts[1], 1)
    seen = content(state.read())
    assert not state.apply(parts[1], 1) and not state.apply(parts[2], 0) and content(state.read()) == seen
    # data without a manifest, and a manifest that was not written to its end
    parts[2].withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/state/data/batch=2")
    os.makedirs(f"{tmp_path}/state/manifest/9")
    assert content(state.read()) == seen
    assert state.apply(parts[2], 2) and content(state.read(), "request_id", "category") == content(cl.upsert_requests(union(parts[:3])), "request_id", "category")


def test_an_empty_batch_and_an_empty_state(spark, tmp_path, parts):
    state = state_of(spark, tmp_path, parts)
    assert state.read().isEmpty() and state.touched(parts[0]).isEmpty()
    assert state.apply(parts[0].limit(0), 0) and state.read().isEmpty()
    assert state.apply(parts[0], 1) and not state.read().isEmpty()


def demand(spark, tmp_path, parts):
    return KeptDemand(state_of(spark, tmp_path, parts), DailyCounts(spark, f"file://{tmp_path}/counts"))


def full_counts(rows):
    return cv.distinct_daily_counts(cl.upsert_requests(rows).filter("area is not null"))


def test_counts_by_deltas_are_full_counts(spark, tmp_path, parts):
    kept = demand(spark, tmp_path, parts)
    for i, b in enumerate(parts):
        assert kept.apply(b, i)
        assert content(kept.counts.read()) == content(full_counts(union(parts[: i + 1])), "demand_date", "category", "area", "request_count")


def test_edits_returns_and_moves_of_day(spark, tmp_path):
    def b(*rows):
        return spark.createDataFrame([(k, run, 0, DAY + timedelta(days=d), c, "X") for k, run, d, c in rows], SCHEMA)

    kept = demand(spark, tmp_path, [b((1, 0, 0, "a"))])
    kept.apply(b((1, 0, 0, "a"), (2, 0, 0, "a"), (3, 0, 1, "a")), 0)
    untouched = files(f"{tmp_path}/counts/demand_date={DAY + timedelta(days=1)}")
    kept.apply(b((1, 1, 5, "a"), (2, 1, 0, "b")), 1)  # across a month's end, and to another category
    assert files(f"{tmp_path}/counts/demand_date={DAY + timedelta(days=1)}") == untouched
    assert content(kept.counts.read()) == [(DAY, "b", "X", 1), (DAY + timedelta(days=1), "a", "X", 1), (DAY + timedelta(days=5), "a", "X", 1)]
    kept.apply(b((1, 2, 0, "a")), 2)  # back again: the other day's last request goes
    assert content(kept.counts.read()) == [(DAY, "a", "X", 1), (DAY, "b", "X", 1), (DAY + timedelta(days=1), "a", "X", 1)]
    kept.apply(b((1, 3, 0, "a")), 3)  # nothing changes
    assert kept.counts.stored_rows().filter("batch_id = 3").isEmpty()


def test_a_batch_that_ended_between_counts_and_state_comes_again(spark, tmp_path, parts):
    kept = demand(spark, tmp_path, parts)
    kept.apply(parts[0], 0)
    before = kept.state.touched(parts[1])
    mine = before.join(parts[1].select("request_id").distinct(), "request_id", "left_semi").select(*before.columns)
    after = kept.state._merged(mine.unionByName(kept.state._batch_rows(parts[1])))
    kept.counts.apply(count_deltas(mine, after), 1)  # and then the driver was lost
    assert kept.apply(parts[1], 1) and not kept.apply(parts[1], 1)
    assert content(kept.counts.read()) == content(full_counts(union(parts[:2])), "demand_date", "category", "area", "request_count")


def test_partitions_that_get_no_rows_keep_their_files(spark, tmp_path):
    grid = spark.createDataFrame([(date(2026, 1, 1) + timedelta(days=i), "a", i) for i in range(90)], "demand_date date, category string, request_count long")
    path = f"file://{tmp_path}/grid"
    rebuild_days(path, grid)
    january, march = (files(f"{tmp_path}/grid/month=2026-0{m}") for m in (1, 3))
    new = grid.filter("demand_date between '2026-02-10' and '2026-02-12'").withColumn("request_count", F.lit(-5).cast("long"))
    for _ in range(2):
        rebuild_days(path, new)
        assert (files(f"{tmp_path}/grid/month=2026-01"), files(f"{tmp_path}/grid/month=2026-03")) == (january, march)
        got = spark.read.parquet(f"{tmp_path}/grid")
        assert got.count() == 90 and got.filter("request_count = -5").count() == 3
    # an edit that moves a request from one month to another writes both
    rebuild_days(path, grid.filter("demand_date in ('2026-01-31', '2026-02-01')").withColumn("request_count", F.lit(-6).cast("long")))
    assert files(f"{tmp_path}/grid/month=2026-03") == march and spark.read.parquet(f"{tmp_path}/grid").filter("request_count = -6").count() == 2
    write_partitions(spark.createDataFrame([(1, "x"), (2, "y")], "run_id long, v string"), f"file://{tmp_path}/runs", "run_id")
    first = files(f"{tmp_path}/runs/run_id=1")
    write_partitions(spark.createDataFrame([(2, "z")], "run_id long, v string"), f"file://{tmp_path}/runs", "run_id")
    assert files(f"{tmp_path}/runs/run_id=1") == first and content(spark.read.parquet(f"{tmp_path}/runs"), "run_id", "v") == [(1, "x"), (2, "z")]


def test_a_version_log_does_not_shuffle(spark, parts):
    rows = [p.withColumn("payload_hash", F.concat_ws("/", "category", "demand_date")) for p in parts]
    log = VersionLog(spark, "versions_of_requests", 4)
    log.start(cl.append_versions(rows[0]))
    try:
        for r in rows[1:]:
            log.append(cl.append_versions(r))
        log.append(cl.append_versions(rows[2]))
        assert content(log.read(), "request_id", "payload_hash", "run_id") == content(cl.append_versions(union(rows)), "request_id", "payload_hash", "run_id")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = log.new(cl.append_versions(rows[4]))._jdf.queryExecution().executedPlan().toString()
        of_log = plan[plan.rindex("FileScan") - 1500 if plan.rindex("FileScan") > 1500 else 0 :]
        right = of_log[of_log.rindex("Sort") if "Sort" in of_log else 0 :]
        assert "Bucketed: true" in plan and "Exchange" not in right
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS versions_of_requests")
