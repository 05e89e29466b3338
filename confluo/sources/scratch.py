"""The shared folder for intermediate and checkpoint files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local session that names none gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="confluo-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_written(spark: SparkSession, path: str) -> bool:
    """A write of Parquet to this path has ended, and its folder is still there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def materialised(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again: computed once, whatever reads it, and of a size that plans know."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def in_slices(rows: DataFrame, at: str, cuts: list[str], name: str) -> str:
    """A folder of files that arrive in order of time: rows up to the first cut, from it to the next, and so on."""
    path = scratch_path(rows.sparkSession, name)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.where(F.col(at) >= low)
        (part if high is None else part.where(F.col(at) < high)).coalesce(1).write.mode("append").parquet(path)
    return path
