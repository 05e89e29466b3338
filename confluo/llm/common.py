"""What the training-data operators share: reading tables, writing intermediate tables, column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session that names none, as in tests, gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="confluo-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends, and every later plan knows its size."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers wait between tasks, and count for the executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


SIEVE_BITS = 24


def sieved(rows: DataFrame, keys: DataFrame, *columns: str, name: str) -> DataFrame:
    """rows with a boolean column: false only where the columns' values stand in no row of keys.

    A table of 1 << SIEVE_BITS bits, one for each hash, is broadcast: at most 1 << (SIEVE_BITS - 6) rows of two numbers,
    whatever the size of keys. The more keys, the more rows are true by chance; a join that follows settles them.
    """
    slot = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(1 << SIEVE_BITS))
    places = keys.select(slot.alias("_slot")).select(F.shiftright("_slot", 6).alias("_word"), (F.col("_slot") % 64).cast("int").alias("_bit"))
    table = places.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask"))
    marked = rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(table), "_word", "left")
    return marked.withColumn(name, F.coalesce(F.expr("getbit(_mask, CAST(_slot % 64 AS INT))") == 1, F.lit(False))).drop("_slot", "_word", "_mask")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names an operator is about to add (an operator's own columns win)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
