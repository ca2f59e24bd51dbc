"""What one task holds stays as tables grow: rows are dealt to a number of tasks that grows with them."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from compare import DATA, rows, sql_rows
from tidegauge.operators.kept import KeptState
from tidegauge.plans import analogues, registry
from tidegauge.sources import shared

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_state_is_merged_a_task_a_bucket(spark, tmp_path):
    batch = spark.range(4000).select((F.col("id") % 3000).alias("request_id"), F.lit(1).cast("long").alias("run_id"), F.col("id").alias("ordinal"))
    state = KeptState(spark, f"file://{tmp_path}/state", batch.schema, buckets=24, most=1)
    for i in range(2):
        state.apply(batch.withColumn("run_id", F.lit(i).cast("long")), i)
    for written in ("batch=0", "batch=1", "compact=1"):
        assert len(glob.glob(f"{tmp_path}/state/data/{written}/*/*.parquet")) == 24  # a file a bucket: one task wrote it
    sizes = [r["count"] for r in state.read().groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 24 and sum(sizes) == 3000


def test_a_run_is_landed_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 300)
    monkeypatch.setattr(registry, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert rows(registry.stream_ingest_merge(spark, DATA)) == sql_rows(registry.ORACLES["stream_ingest_merge"])
    landed = spark.read.parquet(f"file://{tmp_path}/landed").groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert landed[0] <= 2 * 300 and landed[1] == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert len(glob.glob(f"{tmp_path}/state/data/batch=0/bucket=*")) == -(-landed[1] // 300)
    assert len(glob.glob(f"{tmp_path}/state/manifest/[0-9]*")) == 4  # two runs a batch, however many files


def shuffles(df, *keys):
    """The lines of a plan that deal rows by one of the keys."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and any(k in x for k in keys)]


def test_live_evidence_is_dealt_by_request_only(spark, monkeypatch):
    """A join with the ledger that deals evidence by run would put a run in one task."""
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    live = registry.live_requests(spark, DATA)
    assert not shuffles(live, "run_id")
    by_request = shuffles(live, "l_orderkey", "request_id")
    assert len(by_request) == 3 and all("l_orderkey" in x and ", 12), REPARTITION_BY_NUM" in x for x in by_request)
    assert rows(live) == sql_rows(registry.ORACLES["live_requests"])


def test_staged_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    stage = analogues.stage(spark, DATA).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in stage.groupBy("task").count().collect()]
    assert len(sizes) == -(-sum(sizes) // 500) and max(sizes) <= 2 * 500
    assert stage.groupBy("request_id").agg(F.countDistinct("task").alias("n")).filter("n > 1").isEmpty()


def test_versions_and_first_runs_are_counted_where_requests_are(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    counts = registry.merge_counts(spark, DATA)
    by_request = shuffles(counts, "l_orderkey", "request_id")
    assert len(by_request) == 3 and all("l_orderkey" in x and ", 12), REPARTITION_BY_NUM" in x for x in by_request)
    assert rows(counts) == sql_rows(registry.ORACLES["merge_counts"])


@pytest.mark.parametrize(("name", "key", "n"), [("distinct_daily_counts", "l_orderkey", 12), ("daily_display_grid", "request_id", 15), ("daily_forecast_grid", "request_id", 15)])
def test_distinct_requests_are_found_in_dealt_tasks(spark, monkeypatch, name, key, n):
    monkeypatch.setattr(shared, "TASK_ROWS", 500 if n == 12 else 100)
    counts = registry.QUERIES[name](spark, DATA)
    by_request = shuffles(counts, key, "request_id")
    assert len(by_request) == 1 and f", {n}), REPARTITION_BY_NUM" in by_request[0]
    assert rows(counts) == sql_rows(registry.ORACLES[name])
