"""What a session needs before it runs this package's Python functions, and the folder that executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Let a local session's workers import the package, whatever their working directory.

    On a cluster the package is installed or on the executors' Python path.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local[") and sc.applicationId not in _shipped:
        sc.addFile(str(Path(__file__).resolve().parent), recursive=True)
        SparkFiles.getRootDirectory()
        _shipped.add(sc.applicationId)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where that is unset, as in tests, in one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="mailloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder; its plan begins there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, order: list[str], name: str, number: str = "number") -> DataFrame:
    """The rows, as a table in the shared folder, with their number (from 1) in an order; ties are numbered in any order.

    Rows are sorted in ranges, and a range's first number follows from the sizes of those before it; no task sees all rows.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(sorted_rows.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    starts, before = {}, 0
    for r in kept.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_range").collect():  # one row a range
        starts[r["_range"]] = before - r["first"] + 1
        before += r["n"]
    shift = F.get(F.array(*(F.lit(starts.get(k, 0)).cast("bigint") for k in range(max(starts, default=0) + 1))), F.col("_range"))
    return kept.withColumn(number, F.col("_at") + shift).drop("_range", "_at")
