"""Dashboard queries: panel(tables..., from_ts, to_ts, country) as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.scalars import QUAD_CLASSES, category
from confluo.operators.core import date_histogram, latest_per_key, top_per_group, top_terms


def in_range(rows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    return rows.where((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz")))


def latest(rows: DataFrame, at: str, k: int, *ties: str | Column) -> DataFrame:
    """The k newest rows."""
    return rows.orderBy(F.desc(at), *ties).limit(k)


def actor_pairs(events: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent first actors, each with its most frequent second actor."""
    named = events.where((F.col("actor1_name") != "") & (F.col("actor2_name") != ""))
    first = top_terms(named, ["actor1_name"], k).withColumnRenamed("value", "n_first")
    both = named.join(first, "actor1_name", "left_semi").groupBy("actor1_name", "actor2_name").agg(F.count("*").alias("n_pair"))
    best = top_per_group(both, ["actor1_name"], 1, F.desc("n_pair"), F.col("actor2_name")).drop("rank")
    return first.join(best, "actor1_name")


def event_types(events: DataFrame) -> DataFrame:
    counted = events.where(F.col("quad_class").between(1, 4)).groupBy("quad_class").agg(F.count("*").alias("n"))
    return counted.withColumn("label", category(F.col("quad_class"), QUAD_CLASSES))


def country_timeline(events: DataFrame, conflicts: DataFrame, country: str, start: str, end: str) -> DataFrame:
    """Daily events and conflicts of a country, every day of the range."""
    involved = events.where((F.col("source_country") == country) | (F.col("target_country") == country))
    a = date_histogram(involved, "date", "day", start, end).withColumn("series", F.lit("events"))
    b = date_histogram(conflicts.where(F.col("country") == country), "date", "day", start, end).withColumn("series", F.lit("conflicts"))
    return a.unionByName(b)


def trade_partners(transfers: DataFrame, country: str, k: int = 10) -> DataFrame:
    """The largest import and export partners of a country."""
    bought = transfers.where(F.col("recipient_country") == country).select(F.lit("import").alias("direction"), F.col("supplier_country").alias("partner"), "tiv")
    sold = transfers.where(F.col("supplier_country") == country).select(F.lit("export").alias("direction"), F.col("recipient_country").alias("partner"), "tiv")
    total = bought.union(sold).groupBy("direction", "partner").agg(F.round(F.sum("tiv"), 2).alias("tiv"))
    return top_per_group(total, ["direction"], k, F.desc("tiv"), F.col("partner"))


def latest_year(spending: DataFrame) -> DataFrame:
    return latest_per_key(spending, ["country"], F.desc("year"))


def table_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and newest time of each table, as one plan."""
    out = None
    for name, (rows, at) in tables.items():
        one = rows.agg(F.count("*").alias("n"), F.date_format(F.max(at), "yyyy-MM-dd").alias("newest")).select(F.lit(name).alias("name"), "n", "newest")
        out = one if out is None else out.unionByName(one)
    return out
