"""Shared plumbing: shipping the package to workers, and cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of Parquet or of a shuffle that a task should take: some 500,000 cells.
TASK_BYTES = 8 << 20
#: Bytes of Parquet files that a task should read: it aggregates them before a shuffle, or holds them until they are written to one.
READ_BYTES = 16 << 20
_ADVISORY, _SPLIT = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; needed where it isn't installed there."""
    context = spark.sparkContext
    with _SHIPPING:  # fits that run side by side may be the first to need it
        if context.applicationId in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="factorloom-")) / "factorloom.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, os.path.join(root.name, path.relative_to(root)))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that the session names; where it names none and all runs on one machine, one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends in files that outlive executors."""
    path = shared_dir(df.sparkSession) + "/table"
    df.write.parquet(path)
    return widen(df.sparkSession.read.schema(df.schema).parquet(path))


def widen(table: DataFrame) -> DataFrame:
    """The table, after the session has got as many shuffle partitions as its files need at TASK_BYTES each, which the adaptive merging of partitions keeps to too,
    and as many read splits as its files need at READ_BYTES each: so what a task of a join, sort or aggregation holds does not grow with the table. The session's settings are never loosened."""
    spark = table.sparkSession
    tasks = -(-int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    for name, most in ((_ADVISORY, TASK_BYTES), (_SPLIT, READ_BYTES)):
        if tasks > 1 and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, most)
    return table
