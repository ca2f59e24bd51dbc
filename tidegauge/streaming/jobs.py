"""Streaming forms of ingestion: merge per micro-batch, deduplication, daily counts.

Latest-per-key state over all time would grow without bound in a state store; it is kept in hash buckets on disk
(``operators.kept``), beside the log, which each micro-batch appends to under its own batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changelog import append_versions, record_observations, upsert_requests
from ..operators.kept import KeptState
from ..sources.shared import new_path


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there now. append: rows added as Parquet; complete or update: the last result replaces the table."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return writer.foreachBatch(replace).start()


def stream_dedup_requests(stream: DataFrame, time: str, *keys: str, late: str = "30 days") -> DataFrame:
    """Rows without later repeats of their keys inside the lateness bound. ``time`` is an instant (cast local times under a UTC session)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def stream_daily_demand(stream: DataFrame, time: str, category: str, late: str = "30 days") -> DataFrame:
    """demand_date, category, request_count in tumbling days; rows up to ``late`` behind still count, later ones are left to the batch rebuild."""
    daily = stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), F.col(category).alias("category")).agg(F.count("*").alias("request_count"))
    return daily.select(F.to_date("w.start").alias("demand_date"), "category", "request_count")


def stream_ingest_merge(stream: DataFrame, log_path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each micro-batch's staged rows to the log, in a folder per batch id that a replay replaces; views over the log give state and versions."""

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(land).start()


def stream_kept_state(stream: DataFrame, state: KeptState, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge each micro-batch into state that is kept: a batch writes into the buckets it touches, one that is replayed changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        state.apply(prepare(batch) if prepare else batch, batch_id)

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge).start()


def merged_views(spark: SparkSession, log_path: str, order: tuple[str, ...] = ("ordinal",)) -> dict[str, DataFrame]:
    """Current state, versions and observations of a log of micro-batches."""
    log = spark.read.option("basePath", log_path).parquet(f"{log_path}/batch=*").drop("batch", "batch_id")
    return {"state": upsert_requests(log, order), "versions": append_versions(log, order), "observations": record_observations(log, order)}


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a table of the shared folder and read that."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    drain(stream, path, new_path(spark, f"{name}-state"), mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
