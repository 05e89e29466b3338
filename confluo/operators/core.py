"""Relational operators that rules, panels and jobs are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_pair(a: str, b: str) -> tuple[Column, Column]:
    """An unordered pair's members in order."""
    return F.least(a, b).alias("country_a"), F.greatest(a, b).alias("country_b")


def both_sides(events: DataFrame) -> DataFrame:
    """Each event once for every country it involves; an event within one country counts once."""
    sides = F.array_distinct(F.array("source_country", "target_country"))
    return events.withColumn("country", F.explode(sides)).where("country <> ''")


def since(as_of: str, days: float) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(days * 24)))


def between(column: str | Column, as_of: str, days: float, until: float = 0) -> Column:
    """column lies in [as_of - days, as_of - until]."""
    c = F.col(column) if isinstance(column, str) else column
    return (c >= since(as_of, days)) & (c <= since(as_of, until))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, hours_before: int, hours_after: int) -> DataFrame:
    """Rows of both sides with equal key and left_at - hours_before <= right_at <= left_at + hours_after.

    Time is cut into buckets of the window's width. A left row goes to its window's one or two buckets, a right row to
    its own, so the join is an equi-join on (key, bucket) and no key's whole history meets in one task.
    """
    width = 3600 * (hours_before + hours_after)
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    low = F.floor((epoch(left_at) - 3600 * hours_before) / width)
    high = F.floor((epoch(left_at) + 3600 * hours_after) / width)
    a = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    b = right.withColumn("_bucket", F.floor(epoch(right_at) / width))
    found = a.join(b, [key, "_bucket"]).drop("_bucket")
    step = lambda h: F.make_dt_interval(hours=F.lit(h))
    return found.where((F.col(right_at) >= F.col(left_at) - step(hours_before)) & (F.col(right_at) <= F.col(left_at) + step(hours_after)))


def latest_per_key(rows: DataFrame, keys: Sequence[str], *newest_first: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_per_group(rows: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_terms(rows: DataFrame, keys: Sequence[str], k: int | None, metric: Column | None = None) -> DataFrame:
    """Groups by count, or by another metric, largest first, ties by key; all groups without k."""
    counted = rows.groupBy(*keys).agg((F.count("*") if metric is None else metric).alias("value"))
    return counted.orderBy(F.desc("value"), *keys).limit(k) if k else counted


def date_histogram(rows: DataFrame, at: str, unit: str, start: str, end: str, keys: Sequence[str] = (), metric: Column | None = None) -> DataFrame:
    """(bucket, keys, n) with a row for every bucket from start to end, 0 where nothing happened."""
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}[unit]
    inside = rows.where((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz")))
    counted = inside.groupBy(F.to_date(F.date_trunc(unit, F.col(at))).alias("bucket"), *keys).agg((F.count("*") if metric is None else metric).alias("n"))
    first, last = F.to_date(F.date_trunc(unit, F.lit(start).cast("timestamp_ntz"))), F.to_date(F.lit(end))
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(f"interval {step}"))).alias("bucket")).where(F.col("bucket") < last)
    if keys:  # the keys that occur at all, a small set
        every = F.sequence(first, last, F.expr(f"interval {step}"))
        days = counted.select(*keys).distinct().withColumn("bucket", F.explode(every)).where(F.col("bucket") < last)
    return days.join(counted, ["bucket", *keys], "left").fillna(0, ["n"])


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *newest_first: Column) -> DataFrame:
    """Whole rows by key, the newest wins; on ties what comes in."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, *newest_first, F.desc("_side")).drop("_side")


def only_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Rows whose key is not stored yet, of each key the first in the given order (by a hash of the row, if none is given)."""
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    return latest_per_key(fresh, keys, *(order or [F.xxhash64(*incoming.columns)]))


def partial_update(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the given fields of matched keys set; other fields and other rows stay."""
    fields = [c for c in changes.columns if c not in keys]
    found = rows.alias("r").join(changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields]), list(keys), "left")
    for c in fields:
        found = found.withColumn(c, F.coalesce(f"_new_{c}", c) if c in rows.columns else F.col(f"_new_{c}"))
    return found.drop(*[f"_new_{c}" for c in fields])


def _inside(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def moments(value: Column) -> Column:
    """An aggregate: (n, total, mean, m2) of a group's values, m2 the sum of squared deviations. Nulls and NaN do not count.

    The mean lies between the least and the greatest value, also where the total was rounded, and a constant group has
    exactly that mean and m2 = 0, which Spark's own variance may miss by what its merging of partitions rounds.
    """
    known = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = {"n": F.count(known), "total": zero(F.sum(known)), "mean": zero(_inside(F.avg(known), F.min(known), F.max(known))), "m2": F.when(F.min(known) < F.max(known), F.var_pop(known) * F.count(known)).otherwise(0.0)}
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def merged_moments(parts: Column) -> Column:
    """The moments of all values from an array of the moments of parts, pairwise: no difference of large sums is taken."""

    def merge(x: Column, y: Column) -> Column:
        n, total, step = x["n"] + y["n"], x["total"] + y["total"], y["mean"] - x["mean"]
        both = _inside(total / n, F.least(x["mean"], y["mean"]), F.greatest(x["mean"], y["mean"]))
        mean = F.when(x["n"] == 0, y["mean"]).when(y["n"] == 0, x["mean"]).otherwise(both)
        m2 = x["m2"] + y["m2"] + F.when((x["n"] > 0) & (y["n"] > 0), step * step * x["n"] * (y["n"] / n)).otherwise(0.0)
        return F.struct(n.alias("n"), total.alias("total"), mean.alias("mean"), m2.alias("m2"))

    return F.reduce(parts, F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("total", "mean", "m2")]), merge)


def deviation(of: Column) -> Column:
    """The population deviation; null without values."""
    return F.when(of["n"] > 0, F.sqrt(of["m2"] / of["n"]))


def trailing_scores(daily: DataFrame, keys: Sequence[str], short: int = 7, long: int = 30) -> DataFrame:
    """(keys, day, moments), one row a day -> with the means of the last `short` and `long` days and the z-score of the first
    in the second's population deviation (null where that is 0). A window holds one row a day, `long` at most."""
    over = lambda days: Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    out = daily.withColumns({f"_{name}": merged_moments(F.collect_list("moments").over(over(days))) for name, days in (("short", short), ("long", long))})
    mean = lambda name: F.when(F.col(f"_{name}.n") > 0, F.col(f"_{name}.mean"))
    out = out.withColumns({"mean_short": mean("short"), "mean_long": mean("long"), "std_long": deviation(F.col("_long"))}).drop("_short", "_long")
    return out.withColumn("z", F.when(F.col("std_long") > 0, (F.col("mean_short") - F.col("mean_long")) / F.col("std_long")))


def with_month(rows: DataFrame, at: str, as_of: str) -> DataFrame:
    """rows with month, of the as_of month where there is no date."""
    return rows.withColumn("month", F.date_format(F.coalesce(F.col(at), F.lit(as_of).cast("timestamp_ntz")), "yyyy-MM"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
