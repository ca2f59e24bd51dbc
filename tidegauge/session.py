"""The Spark session the jobs expect, and the package sent to its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(name: str = "tidegauge", **more: str) -> SparkSession:
    """A session with UTC, ANSI mode and adaptive execution; ``more`` uses ``__`` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of an Arrow batch to Python workers. Batches are cut by rows only unless this is low; rows of long texts would make large ones.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that their Python workers can import it, and bound their batches."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if not getattr(context, "_tidegauge_shipped", False):
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="tidegauge-ship-")) / "tidegauge.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        context.addPyFile(str(out))
        context._tidegauge_shipped = True
    return spark
