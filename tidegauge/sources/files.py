"""Landed pages, archives, tables, reports and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import TRACKED

RAW = T.StructType([T.StructField(f, T.StringType()) for f in TRACKED])
MANIFEST = "coverage_basis string, agency string, borough string, partitions array<struct<start: date, end: date, mode: string, status: string, expected_rows: long, files: array<struct<path: string, rows: long, sha256: string>>>>"
DAILY = "demand_date date, category string, area string, request_count long, is_complete boolean"
METRICS = "model string, n long, mae double, wape double, bias double, actual_total double"
FORECAST = "origin_date date, target_date date, horizon_days int, category string, area string, seasonal_naive double, weekday_mean_4w double, gbt double"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("text"))


def read_request_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines pages, plain or gzip: the tracked fields as text, ``file`` and ``ordinal`` (file, then place in it).

    Blank lines are passed over; unknown fields are ignored. Files are read line by line, plain ones in splits, so pages may be of any
    size; a place is the split's start and the line's number within what one task reads, which grow in line order."""
    return _parsed(_lines(spark, path))


def read_page_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_request_pages``, with each line's ``text`` and whether it is ``broken``: no JSON object, as Spark's reader tells."""
    schema = T.StructType([*RAW.fields, T.StructField("_broken", T.StringType())])
    record = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = _lines(spark, path).filter(F.trim("text") != "").select(F.struct("file", "line").alias("ordinal"), "text", record.alias("r"))
    return rows.select("ordinal", "text", (F.col("r").isNull() | F.col("r._broken").isNotNull()).alias("broken"), *[f"r.{f}" for f in RAW.names])


def stream_request_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files as they land; a page is a small file and is read in one piece."""
    return records_of(spark.readStream.option("wholetext", True).text(path))


def records_of(pages: DataFrame) -> DataFrame:
    """Records of pages read in one piece each."""
    lines = pages.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return _parsed(lines)


def _parsed(lines: DataFrame) -> DataFrame:
    rows = lines.filter(F.trim("text") != "").select("file", "line", F.from_json("text", RAW).alias("r"))
    return rows.select("file", F.struct("file", "line").alias("ordinal"), "r.*")


#: Records of a page, and rows of a file of a report or release.
PAGE_RECORDS, FILE_ROWS = 50_000, 1_000_000


def write_request_pages(raw: DataFrame, path: str, run: str = "run_id") -> None:
    """The untouched records as gzip JSON lines, a folder per run, pages of bounded size in it."""
    raw.write.mode("append").partitionBy(run).option("maxRecordsPerFile", PAGE_RECORDS).option("compression", "gzip").json(path)


def read_archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per partition and file of a manifest: scope, dates, mode, status, expected_rows, path, rows, sha256."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    parts = whole.select("coverage_basis", "agency", "borough", F.explode("partitions").alias("p"))
    return parts.select("coverage_basis", "agency", "borough", F.col("p.start").alias("window_start"), F.col("p.end").alias("window_end"), "p.mode", "p.status", "p.expected_rows", F.explode("p.files").alias("f")).select("*", "f.path", "f.rows", "f.sha256").drop("f")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path (name), sha256 of each file's bytes; a file is a page and fits a task."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def tree_digests(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), sha256 of every file of a folder and those in it; files are bounded by their writers."""
    root = path.split("://", 1)[-1].rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").substr(F.instr("path", F.lit(root)) + F.lit(len(root) + 1), F.length("path")).alias("path"), F.sha2("content", 256).alias("sha256"))


def read_table(spark: SparkSession, path: str, scope: dict[str, str] | None = None, day: str | None = None, start=None, end=None) -> DataFrame:
    """A Parquet table cut to a scope and to days; the conditions reach the scan."""
    df = spark.read.parquet(path)
    for column, value in (scope or {}).items():
        df = df.filter(F.col(column) == value)
    return df.filter(F.col(day).between(F.lit(start), F.lit(end))) if day else df


def read_table_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """The same from a database, read in ``parts`` ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.options(**options).load()


def even_ranges(values: DataFrame, column: str, parts: int, quote: str = '"') -> list[str]:
    """SQL conditions that cut a numeric column into ``parts`` ranges of about as many rows each, by quantiles to a tenth of a part.

    Equal values stay together, so very frequent ones make fewer ranges. Nulls are in the first. A table without values has one range."""
    name = f"{quote}{column}{quote}"
    cuts = values.approxQuantile(column, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    whole = dict(values.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")
    cuts = sorted({int(c) if whole else c for c in cuts})
    if not cuts:
        return ["1 = 1"]
    middle = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"({name} < {cuts[0]} OR {name} IS NULL)", *middle, f"{name} >= {cuts[-1]}"]


def read_table_jdbc_evenly(spark: SparkSession, url: str, table: str, column: str, parts: int, scope: dict[str, str] | None = None, **options: str) -> DataFrame:
    """A database table cut to a scope, read in ``parts`` ranges of a numeric column that hold about as many rows each, however its
    values lie. The database looks through the column once for the ranges; conditions of the scope are sent to it."""
    values = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(column).dropna()
    df = spark.read.jdbc(url, table, predicates=even_ranges(values, column, parts), properties=options)
    for name, value in (scope or {}).items():
        df = df.filter(F.col(name) == value)
    return df


def read_release_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of a release or report, with the schema given."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_report_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table in a folder of its own; an existing one is never written over."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("header", True).option("maxRecordsPerFile", FILE_ROWS).format(form).save(f"{path}/{name}")


def write_release(tables: dict[str, DataFrame], path: str, manifest: DataFrame) -> None:
    """A new release: all tables under the path, the digests of their files, then its manifest. A reader takes a release without a manifest for unfinished; an existing one is refused."""
    spark = manifest.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileExistsError(path)
    write_report_tables(tables, f"{path}/tables")
    tree_digests(spark, f"{path}/tables").write.mode("errorifexists").parquet(f"{path}/checksums")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


# The tables that a complete release has.
REQUIRED = ("forecast", "history", "evaluation", "validation", "baseline_full", "model")


def release_file_violations(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """path, violation: tables that a release's digests lack, files that are gone, that nobody listed, or whose bytes differ."""
    listed, found = spark.read.parquet(f"{path}/checksums").alias("l"), tree_digests(spark, f"{path}/tables").alias("f")
    met = listed.join(found, F.col("l.path") == F.col("f.path"), "full_outer")
    reason = F.when(F.col("f.path").isNull(), "file missing").when(F.col("l.path").isNull(), "file not listed").when(F.col("l.sha256") != F.col("f.sha256"), "checksum mismatch")
    names = spark.createDataFrame([(t,) for t in required], "path string")
    lacking = names.join(listed.select(F.substring_index("path", "/", 1).alias("path")), "path", "left_anti").select("path", F.lit("incomplete release").alias("violation"))
    return met.select(F.coalesce("l.path", "f.path").alias("path"), reason.alias("violation")).filter("violation is not null").unionByName(lacking)


def read_release_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tables/{name}")


def file_rows(pages: DataFrame) -> DataFrame:
    """path (name), rows: records per page."""
    return pages.groupBy(F.element_at(F.split("file", "/"), -1).alias("path")).agg(F.count("*").alias("rows"))


def with_line_numbers(rows: DataFrame, run: str, *order: str) -> DataFrame:
    """A dense place within each run, where a numeric one is asked for."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long") - 1)
