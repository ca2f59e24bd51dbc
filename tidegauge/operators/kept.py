"""State that is kept between batches: latest rows in hash buckets, daily counts by day, a version log in buckets.

A batch writes small delta files into the buckets it touches and then a new manifest, which alone says what counts: a
batch that ended half-way has none and changes nothing, and one that comes again is known by its number. A bucket with
many deltas is written anew; the others stay as they are. The daily counts follow by signed deltas: minus one where a
request was, plus one where it is now, so only the days of changed requests are written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

_MANIFEST = "last_batch long, buckets array<struct<bucket: int, folders: array<string>>>"


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace those partitions of a table that ``df`` has rows of; the files of all others stay. Running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


@dataclass
class Manifest:
    """The last batch that counts and, by bucket, the folders that hold its rows."""

    number: int = -1
    last_batch: int = -1
    folders: dict[int, list[str]] = field(default_factory=dict)


class KeptState:
    """The latest row per key, in ``buckets`` hash buckets below ``path``. ``schema``: a batch's columns; ``order``: those that say which of a key's rows
    is the latest (of all batches), greatest last. A bucket with more than ``most`` delta folders is written anew."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "request_id", order: Sequence[str] = ("run_id", "ordinal"), buckets: int = 64, most: int = 8) -> None:
        self.spark, self.path, self.schema, self.key, self.order, self.buckets, self.most = spark, path.rstrip("/"), schema, key, tuple(order), buckets, most
        self.rest = [f.name for f in schema if f.name not in (key, *self.order)]
        extra = [T.StructField("first_seen_run", schema[self.order[0]].dataType), T.StructField("last_seen_run", schema[self.order[0]].dataType)]
        self.rows = T.StructType([schema[key], *[schema[c] for c in (*self.order, *self.rest)], *extra])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key: the latest, with the first and last run that had the key."""
        return self._by_bucket(rows).select(self.key, *self.order, *self.rest, "first_seen_run", "last_seen_run")

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        """As ``_merged``, with the bucket, a task a bucket. The one sort of a task, by bucket and key, serves the merge and a write by buckets;
        its size is that of a bucket, whatever the size of the files read or of the partitions that adaptive execution would join."""
        latest = F.max_by(F.struct(*self.order, *self.rest), F.struct(*self.order)).alias("_r")
        dealt = rows.withColumn("bucket", self._bucket()).repartitionById(self.buckets, "bucket")
        out = dealt.groupBy("bucket", self.key).agg(latest, F.min("first_seen_run").alias("first_seen_run"), F.max("last_seen_run").alias("last_seen_run"))
        return out.select(self.key, *[f"_r.{c}" for c in (*self.order, *self.rest)], "first_seen_run", "last_seen_run", "bucket")

    def _batch_rows(self, batch: DataFrame) -> DataFrame:
        run = F.col(self.order[0])
        return batch.select(self.key, *self.order, *self.rest, run.alias("first_seen_run"), run.alias("last_seen_run"))

    def manifest(self) -> Manifest:
        """The newest manifest that was written to its end."""
        for n in sorted((int(x) for x in _listed(self.spark, f"{self.path}/manifest") if x.isdigit()), reverse=True):
            if "_SUCCESS" in _listed(self.spark, f"{self.path}/manifest/{n}"):
                row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{n}").first()  # a row: buckets and their few folders
                return Manifest(n, row["last_batch"], {b["bucket"]: list(b["folders"]) for b in row["buckets"]})
        return Manifest()

    def _read(self, m: Manifest, only: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}" for b, fs in sorted(m.folders.items()) if only is None or b in only for f in fs]
        if not paths:
            return self.spark.createDataFrame([], self.rows)
        return self.spark.read.schema(self.rows).parquet(*paths)

    def read(self) -> DataFrame:
        """The state: one row per key."""
        return self._merged(self._read(self.manifest()))

    def touched(self, batch: DataFrame) -> DataFrame:
        """Rows of the state in the buckets that a batch's keys are in, before it; no other files are read."""
        own = [r[0] for r in batch.select(self._bucket()).distinct().collect()]  # at most the number of buckets
        return self._merged(self._read(self.manifest(), own))

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Merge a batch; False, and nothing changed, if it is there already. Batches come in order of their ids."""
        m = self.manifest()
        if batch_id <= m.last_batch:
            return False
        data = f"data/batch={batch_id}"
        self._by_bucket(self._batch_rows(batch)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{data}")
        new = [int(x.split("=")[1]) for x in _listed(self.spark, f"{self.path}/{data}") if x.startswith("bucket=")]
        folders = dict(m.folders)
        for b in new:
            folders[b] = [*folders.get(b, []), f"{data}/bucket={b}"]
        full = [b for b in new if len(folders[b]) > self.most]
        if full:
            self._by_bucket(self._read(Manifest(folders=folders), full)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/compact={batch_id}")
            folders |= {b: [f"data/compact={batch_id}/bucket={b}"] for b in full}
        row = (batch_id, [(b, f) for b, f in sorted(folders.items())])
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{m.number + 1}")
        return True


def count_deltas(before: DataFrame, after: DataFrame, key: str = "request_id", by: Sequence[str] = ("demand_date", "category", "area")) -> DataFrame:
    """by, delta: what the change of the rows in ``after`` does to the counts. ``before`` may hold other keys, too; a row of
    which a count's column is null counts nowhere."""
    a, b = F.struct(*[F.col(f"a.{c}") for c in by]), F.struct(*[F.col(f"b.{c}") for c in by])
    met = after.alias("a").join(before.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "left").filter(~a.eqNullSafe(b))
    sides = F.array(F.struct(b.alias("at"), F.lit(-1).alias("delta")), F.struct(a.alias("at"), F.lit(1).alias("delta")))
    each = met.select(F.explode(sides).alias("s")).select(*[F.col(f"s.at.{c}").alias(c) for c in by], "s.delta")
    full = F.lit(True)
    for c in by:
        full = full & F.col(c).isNotNull()
    return each.filter(full).groupBy(*by).agg(F.sum("delta").alias("delta")).filter("delta <> 0")


class DailyCounts:
    """Distinct requests per day, category and area, a partition per day. A day names the batch that wrote it last, so a batch that comes
    again leaves the days it has written already."""

    by = ("demand_date", "category", "area")
    schema = "category string, area string, request_count long, batch_id long, demand_date date"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def stored_rows(self) -> DataFrame:
        if not _listed(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored_rows().filter("request_count > 0").select(*self.by, "request_count")

    def apply(self, deltas: DataFrame, batch_id: int) -> None:
        """Add signed deltas; only their days are read and written."""
        deltas = stored(deltas, "deltas")
        old = self.stored_rows().join(deltas.select("demand_date").distinct(), "demand_date", "left_semi")
        done = old.filter(F.col("batch_id") >= batch_id).select("demand_date").distinct()
        fresh = deltas.join(done, "demand_date", "left_anti")
        kept = old.join(done, "demand_date", "left_anti").select(*self.by, F.col("request_count").alias("n"))
        total = kept.unionByName(fresh.select(*self.by, F.col("delta").alias("n"))).groupBy(*self.by).agg(F.sum("n").alias("request_count"))
        # zeroes stay as rows, so that a day that loses its last request is written, too
        out = stored(total.withColumn("batch_id", F.lit(batch_id).cast("long")).select("category", "area", "request_count", "batch_id", "demand_date"), "days")
        if not out.isEmpty():
            write_partitions(out.repartition("demand_date"), self.path, "demand_date")


class KeptDemand:
    """The latest trusted row per request and the daily counts of these rows, kept up batch by batch. A batch's rows are of trusted runs
    and have demand_date, category and area. Counts are written before the state's manifest: a batch that ends between the two comes
    again, finds its days written and only completes them."""

    def __init__(self, state: KeptState, counts: DailyCounts) -> None:
        self.state, self.counts = state, counts

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        if batch_id <= self.state.manifest().last_batch:
            return False
        batch = stored(batch, "batch")
        before = stored(self.state.touched(batch), "before")
        key = self.state.key
        mine = before.join(batch.select(key).distinct(), key, "left_semi").select(*before.columns)
        after = self.state._merged(mine.unionByName(self.state._batch_rows(batch)))
        self.counts.apply(count_deltas(mine, after, key, self.counts.by), batch_id)
        return self.state.apply(batch, batch_id)


def rebuild_days(path: str, new: DataFrame, day: str = "demand_date") -> None:
    """Replace the days of ``new`` in a daily grid that has a partition per month (column month). Months that ``new`` has no day of keep their files;
    an edit that moves a request from one month to another is a ``new`` with days of both. Running it again changes nothing."""
    spark = new.sparkSession
    fresh = stored(new.withColumn("month", F.date_format(day, "yyyy-MM")), "fresh")
    if _listed(spark, path):
        old = spark.read.schema(fresh.schema).parquet(path).join(fresh.select("month").distinct(), "month", "left_semi").join(fresh.select(day).distinct(), day, "left_anti")
        fresh = stored(old.select(*fresh.columns).unionByName(fresh), "months")
    write_partitions(fresh.repartition("month"), path, "month")


class VersionLog:
    """The version log as a table in buckets of request and hash: a batch meets it bucket by bucket, and the log does not shuffle."""

    keys = ("request_id", "payload_hash")

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *self.keys)

    def _write(self, rows: DataFrame, mode: str) -> None:
        self._dealt(rows).write.mode(mode).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def start(self, versions: DataFrame) -> None:
        self._write(versions, "errorifexists")

    def new(self, versions: DataFrame) -> DataFrame:
        """Those of a batch's versions (``append_versions``) whose request and hash the log does not hold."""
        return self._dealt(versions).join(self.read().select(*self.keys).hint("merge"), list(self.keys), "left_anti")

    def append(self, versions: DataFrame) -> None:
        """Add the new ones; a batch that comes again adds nothing."""
        self._write(stored(self.new(versions), "versions"), "append")
