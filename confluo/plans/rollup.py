"""Counts of what happened in each country by hour, kept as rows arrive; windows are sums of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.operators.core import both_sides, since, union_all
from confluo.sources.store import read_table, upsert_table

SCHEMA = "batch string, kind string, country string, at timestamp_ntz, sharp boolean, n long, negative long, tense long, amount double"
KEYS = ["batch", "kind", "country", "at", "sharp"]


def partial(kind: str, rows: DataFrame, at: str, amount: Column | None = None, tense_below: float = -3.0) -> DataFrame:
    """Rows with a country as counts by hour. What lies exactly on the hour is counted apart (sharp), so that windows that
    are closed on both sides are sums, too; rows with a score also give the negative and the hostile ones."""
    score = F.col("goldstein_scale") if "goldstein_scale" in rows.columns else F.lit(None).cast("double")
    hour = F.date_trunc("hour", F.col(at)).cast("timestamp_ntz")
    counted = rows.where((F.col("country") != "") & F.col(at).isNotNull()).groupBy("country", hour.alias("at"), (F.col(at) == hour).alias("sharp")).agg(
        F.count("*").alias("n"), F.count_if(score < 0).alias("negative"), F.count_if(score < tense_below).alias("tense"), F.coalesce(F.sum(F.lit(0.0) if amount is None else amount), F.lit(0.0)).alias("amount")
    )
    return counted.withColumn("kind", F.lit(kind))


def partials(events: DataFrame, conflicts: DataFrame, sanctions: DataFrame, outages: DataFrame, transfers: DataFrame) -> DataFrame:
    """The counts of a batch of each table; an event counts for every country it involves."""
    imports = transfers.select(F.col("recipient_country").alias("country"), "date", "tiv")
    return union_all([
        partial("event", both_sides(events), "date"), partial("conflict", conflicts.select("country", "date"), "date"), partial("sanction", sanctions.select("country", "first_seen"), "first_seen"),
        partial("outage", outages.select("country", "start_time"), "start_time"), partial("transfer", imports, "date", F.col("tiv")),
    ])


def add(rows: DataFrame, path: str, batch: str) -> None:
    """Keep a batch's counts. Batches add up; the same batch again replaces its own rows."""
    upsert_table(rows.withColumn("batch", F.lit(batch)), path, KEYS, ["batch"], at="at")


def read(like: DataFrame, path: str, as_of: str, days: float) -> DataFrame:
    """The counts of the last days up to as_of, a whole hour; months before are not opened."""
    spark = like.sparkSession
    schema = spark.createDataFrame([], SCHEMA).schema
    first = spark.range(1).select(F.date_format(since(as_of, days), "yyyy-MM")).first()[0]
    return window(read_table(spark, path, schema, (first, as_of[:7])), as_of, days)


def window(rollup: DataFrame, as_of: str, days: float) -> DataFrame:
    """The counts within [as_of - days, as_of]."""
    at, end = F.col("at"), since(as_of, 0)
    return rollup.where((at >= since(as_of, days)) & ((at < end) | ((at == end) & F.col("sharp"))))


def by_country(rollup: DataFrame, kind: str, as_of: str, days: float, value: str = "n") -> DataFrame:
    """(country, value) of one kind within a window."""
    return window(rollup.where(F.col("kind") == kind), as_of, days).groupBy("country").agg(F.sum(value).alias("value"))
