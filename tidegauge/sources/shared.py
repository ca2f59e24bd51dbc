"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset: one of our own on a single machine (tests), an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = spark.conf.get("spark.tidegauge.shared.dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.tidegauge.shared.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tidegauge/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Rows that one task of a dealt table gets, about. Adaptive execution joins shuffle partitions up to so many bytes, and a task's rows grow with them.
TASK_ROWS = 200_000


def tasks(spark: SparkSession, rows: int) -> int:
    """The number of tasks that so many rows are dealt to: it grows with the rows, so that what one task holds does not."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def stored(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    ``by``: a column whose values get folders of their own, for readers that want one of them."""
    path = new_path(df.sparkSession, name)
    out = df.write.partitionBy(by) if by else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
