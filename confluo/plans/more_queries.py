"""Registered queries of market, article and map panels, text filters and streaming jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions import scalars
from confluo.operators import core
from confluo.operators.names import names_in
from confluo.plans import panels, rules
from confluo.plans import rule_queries as R
from confluo.plans.adapters import AS_OF, cte, table
from confluo.sources import normalise
from confluo.sources.scratch import in_slices, scratch_path
from confluo.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *tables: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = f"WITH {cte(*tables)}\n{sql}" if tables else sql
        return f

    return register


WEEKS = ("2023-12-25 00:00:00", "2024-02-12 00:00:00")
WEEK_SQL = "SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL '7 DAY')) AS DATE) AS w"
CHANGES = ", c AS (SELECT *, round(price - lag(price) OVER (PARTITION BY case_id ORDER BY ts, event_id), 4) AS delta FROM t_prices)\n"


@query("shifts_weekly", f"{CHANGES}, w AS ({WEEK_SQL}) SELECT strftime(w, '%Y-%m-%d') AS bucket, count(delta) AS n FROM w LEFT JOIN c ON date_trunc('week', ts) = w AND abs(delta) >= 0.1 GROUP BY 1", "prices")
def shifts_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts of each week, 0 where there are none."""
    moved = rules.price_changes(table(spark, sf_dir, "prices")).where(F.abs("delta") >= 0.1)
    return core.date_histogram(moved, "ts", "week", *WEEKS).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("volume_weekly", f", w AS ({WEEK_SQL}) SELECT strftime(w, '%Y-%m-%d') AS bucket, coalesce(CAST(sum(volume) AS BIGINT), 0) AS n FROM w LEFT JOIN t_prices ON date_trunc('week', ts) = w GROUP BY 1", "prices")
def volume_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traded volume of each week."""
    rows = core.date_histogram(table(spark, sf_dir, "prices"), "ts", "week", *WEEKS, metric=F.sum("volume"))
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("shift_alerts", f"{CHANGES} SELECT case_id, event_id, strftime(ts, '%Y-%m-%d') AS day, delta FROM c WHERE abs(delta) >= 0.1 ORDER BY ts DESC, event_id LIMIT 20", "prices")
def shift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = rules.price_changes(table(spark, sf_dir, "prices")).where(F.abs("delta") >= 0.1)
    return panels.latest(moved, "ts", 20, "event_id").select("case_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "delta")


@query("active_count", "SELECT count(*) AS n FROM t_cases WHERE status = 'active'", "cases")
def active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cases").where("status = 'active'").agg(F.count("*").alias("n"))


@query("active_markets", "SELECT case_id, question, round(price, 4) AS price, round(volume, 2) AS volume FROM t_cases WHERE status = 'active' ORDER BY t_cases.volume DESC, case_id LIMIT 50", "cases")
def active_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cases").where("status = 'active'").orderBy(F.desc("volume"), "case_id").limit(50)
    return rows.select("case_id", "question", F.round("price", 4).alias("price"), F.round("volume", 2).alias("volume"))


@query("related_events_total", f""", k AS (SELECT unnest(string_split(countries, '||')) AS country, case_id FROM t_cases), n AS (SELECT market, count(*) AS c FROM (SELECT source_country AS market FROM t_events WHERE date >= {R.day(168)} AND date <= {R.T0} UNION ALL
  SELECT target_country FROM t_events WHERE date >= {R.day(168)} AND date <= {R.T0} AND target_country <> source_country) GROUP BY 1)
SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM t_cases JOIN n ON market = 'NATION_' || CAST(case_id % 25 AS VARCHAR) WHERE status = 'active'""", "cases", "events")
def related_events_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the last week in active cases' countries, summed over cases."""
    active = table(spark, sf_dir, "cases").where("status = 'active'").groupBy(F.concat(F.lit("NATION_"), (F.col("case_id") % 25).cast("string")).alias("country")).agg(F.count("*").alias("cases"))
    recent = core.both_sides(table(spark, sf_dir, "events").where(core.between("date", AS_OF, 7))).groupBy("country").agg(F.count("*").alias("events"))
    return active.join(recent, "country").agg(F.coalesce(F.sum(F.col("cases") * F.col("events")), F.lit(0)).alias("n"))


@query("divergences", R.CONSENSUS + "SELECT case_id, consensus, divergence, n_prices FROM cs WHERE divergence > 0.1 ORDER BY cs.divergence DESC, case_id LIMIT 50", "cases", "predictions")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.consensus(spark, sf_dir).where(F.col("divergence") > 0.1).orderBy(F.desc("divergence"), "case_id").limit(50)


JUNE = ("1998-06-01 00:00:00", "1998-07-01 00:00:00")
JUNE_SQL = "SELECT CAST(unnest(generate_series(TIMESTAMP '1998-06-01', TIMESTAMP '1998-06-30', INTERVAL '1 DAY')) AS DATE) AS d"


@query("divergence_daily", R.CONSENSUS + "SELECT strftime(DATE '1998-06-01' + CAST(case_id % 30 AS INTEGER), '%Y-%m-%d') AS bucket, round(CAST(sum(CAST(round(divergence * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000, 4) AS mean FROM cs GROUP BY 1", "cases", "predictions")
def divergence_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean divergence of each day's cases."""
    dated = R.consensus(spark, sf_dir).withColumn("day", F.date_add(F.lit("1998-06-01").cast("date"), (F.col("case_id") % 30).cast("int")))
    mean = F.sum(F.round(F.col("divergence") * 10000).cast("long")).cast("double") / F.count("*") / 10000
    return dated.groupBy(F.date_format("day", "yyyy-MM-dd").alias("bucket")).agg(F.round(mean, 4).alias("mean"))


@query("map_points", "SELECT event_id, source_country, round(lat, 4) AS lat, round(lon, 4) AS lon FROM t_live_events WHERE lat <> 0 OR lon <> 0 ORDER BY date DESC, event_id, source_country, t_live_events.lat, t_live_events.lon LIMIT 500", "live_events")
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "live_events").where((F.col("lat") != 0) | (F.col("lon") != 0))
    return panels.latest(placed, "date", 500, "event_id", "source_country", "lat", "lon").select("event_id", "source_country", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query("country_cases", "SELECT case_id, question, round(price, 4) AS price FROM t_cases WHERE list_contains(string_split(countries, '||'), 'Brand#3') ORDER BY volume DESC, case_id LIMIT 20", "cases")
def country_cases(spark: SparkSession, sf_dir: str, country: str = "Brand#3") -> DataFrame:
    rows = table(spark, sf_dir, "cases").where(F.array_contains(F.split("countries", r"\|\|"), country)).orderBy(F.desc("volume"), "case_id").limit(20)
    return rows.select("case_id", "question", F.round("price", 4).alias("price"))


@query("outage_history", "SELECT outage_id, scope, severity, strftime(start_time, '%Y-%m-%d') AS day FROM t_outages WHERE country = 'NATION_3' ORDER BY start_time DESC, outage_id LIMIT 20", "outages")
def outage_history(spark: SparkSession, sf_dir: str, country: str = "NATION_3") -> DataFrame:
    rows = panels.latest(table(spark, sf_dir, "outages").where(F.col("country") == country), "start_time", 20, "outage_id")
    return rows.select("outage_id", "scope", "severity", F.date_format("start_time", "yyyy-MM-dd").alias("day"))


@query("articles_volume", f", d AS ({JUNE_SQL}) SELECT strftime(d, '%Y-%m-%d') AS bucket, count(doc_id) AS n FROM d LEFT JOIN t_reports ON CAST(date AS DATE) = d GROUP BY 1", "reports")
def articles_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.date_histogram(table(spark, sf_dir, "reports").withColumn("at", F.col("date").cast("timestamp_ntz")), "at", "day", *JUNE)
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


NAMES = tuple(f"Nation_{i}" for i in range(25))
NAMES_SQL = r"list_sort(list_distinct(list_transform(regexp_extract_all(upper(text), '\b(?:NATION_(?:1[0-9]|2[0-4]|[0-9])|NORTHERN STATE)\b'), lambda x: CASE x WHEN 'NORTHERN STATE' THEN 'NATION_7' ELSE x END)))"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of countries, and another name of one."""
    names = table(spark, sf_dir, "nations").select(F.col("n_name").alias("alias"), F.col("n_name").alias("name"))
    return names.union(spark.sql("SELECT 'Northern State', 'Nation_7'"))


@query("article_countries", f", k AS (SELECT doc_id, {NAMES_SQL} AS m FROM t_reports) SELECT doc_id, array_to_string(m, ',') AS countries FROM k WHERE len(m) > 0", "reports")
def article_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries that articles name, also by another name."""
    found = names_in(table(spark, sf_dir, "reports"), _aliases(spark, sf_dir), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.array_join("names", ",").alias("countries"))


@query("country_articles", f", k AS (SELECT doc_id, date, {NAMES_SQL} AS m FROM t_reports) SELECT doc_id, strftime(date, '%Y-%m-%d') AS day FROM k WHERE list_contains(m, 'NATION_3') ORDER BY date DESC, doc_id LIMIT 20", "reports")
def country_articles(spark: SparkSession, sf_dir: str, country: str = "NATION_3") -> DataFrame:
    """The latest articles that name a country."""
    reports = table(spark, sf_dir, "reports")
    naming = names_in(reports, _aliases(spark, sf_dir), "doc_id", "text").where(F.array_contains("names", country)).select(F.col("id").alias("doc_id"))
    rows = reports.join(naming, "doc_id", "left_semi")
    return panels.latest(rows, "date", 20, "doc_id").select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("relevant_markets_a", r""", k AS (SELECT *, lower(question || ' ' || description) AS t, len(list_distinct(regexp_extract_all(upper(question || ' ' || description), '\bNATION_(?:1[0-9]|2[0-4]|[0-9])\b'))) AS n, contains(lower(question || ' ' || description), 'trade council') AS org FROM t_questions)
SELECT market_id FROM k WHERE tag NOT IN ('PROMO') AND NOT regexp_matches(t, '\bsmall\b')
  AND ((regexp_matches(t, '\b(?:bolt|ring)\b') AND (n > 0 OR org)) OR n >= 2 OR (org AND regexp_matches(t, '\b(?:widget)\b')))""", "questions")
def relevant_markets_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets that a strong word with a country or organisation, two countries, or an organisation with a context word make relevant."""
    text = F.concat_ws(" ", "question", "description")
    keep = normalise.is_market_relevant(text, F.array("tag"), scalars.mentioned(text, NAMES), ("bolt", "ring"), ("widget",), ("trade council",), r"\bsmall\b", ("promo",))
    return table(spark, sf_dir, "questions").where(keep).select("market_id")


@query("relevant_markets_b", r""", k AS (SELECT market_id, lower(question) AS t, len(regexp_extract_all(upper(question), '\bNATION_(?:1[0-9]|2[0-4]|[0-9])\b')) AS n FROM t_questions)
SELECT market_id FROM k WHERE NOT contains(t, 'small') AND (contains(t, 'bolt') OR contains(t, 'red') OR n >= 2)""", "questions")
def relevant_markets_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets that hold a keyword, or name countries twice or more."""
    keep = normalise.names_relevant(F.col("question"), ("bolt", "red"), NAMES, ("small",))
    return table(spark, sf_dir, "questions").where(keep).select("market_id")


@query("market_countries", r"SELECT market_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(upper(question), '\bNATION_(?:1[0-9]|2[0-4]|[0-9])\b'), lambda x: CASE x WHEN 'NATION_0' THEN 'NATION_24' ELSE x END))), ',') AS countries FROM t_questions", "questions")
def market_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scalars.mentioned(F.col("question"), NAMES, {"nation_0": "nation_24"})
    return table(spark, sf_dir, "questions").select("market_id", F.array_join(found, ",").alias("countries"))


@query("conflict_history", """, r AS (SELECT country, strftime(date, '%Y-%m-%d') || ':' || CAST(event_id AS VARCHAR) AS e, date, event_id, row_number() OVER (PARTITION BY country ORDER BY date DESC, event_id) AS rn FROM t_conflicts)
SELECT country, string_agg(e, ',' ORDER BY date, event_id) AS events FROM r WHERE rn <= 5 GROUP BY 1""", "conflicts")
def conflict_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each country's last five conflicts as an array in order of date."""
    last = core.top_per_group(table(spark, sf_dir, "conflicts"), ["country"], 5, F.desc("date"), F.col("event_id"))
    rows = last.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("date", "event_id"))).alias("events"))
    return rows.select("country", F.array_join(F.transform("events", lambda e: F.concat_ws(":", F.date_format(e["date"], "yyyy-MM-dd"), e["event_id"].cast("string"))), ",").alias("events"))


@query("pair_statistics", """SELECT least(source_country, target_country) AS country_a, greatest(source_country, target_country) AS country_b, count(*) AS n, round(avg(tone), 4) AS mean, round(min(tone), 4) AS low, round(max(tone), 4) AS high, round(stddev_pop(tone), 4) AS std FROM t_events GROUP BY 1, 2""", "events")
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended statistics of tone by pair of countries."""
    pairs = table(spark, sf_dir, "events").groupBy(*core.canonical_pair("source_country", "target_country"))
    return pairs.agg(F.count("*").alias("n"), *[F.round(f("tone"), 4).alias(n) for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"), (F.stddev_pop, "std"))])


@query("market_totals", "SELECT country, count(*) AS n, round(sum(volume), 2) AS volume, round(avg(price), 4) AS mean_price FROM t_cases GROUP BY 1", "cases")
def market_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cases").groupBy("country").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 2).alias("volume"), F.round(F.avg("price"), 4).alias("mean_price"))


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once all its input has been read."""
    path = scratch_path(spark, "stream")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = jobs.tumbling_counts(jobs.parquet_stream(spark, f"{sf_dir}/events.parquet", "ts"), "ts", ["event_type"])
    return _drained(spark, counts, "complete").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("stream_sliding", """SELECT strftime(time_bucket(INTERVAL '1 day', ts) + CAST(k AS INTEGER) * INTERVAL '1' DAY, '%Y-%m-%d') AS day, event_type, round(avg(value), 4) AS mean, count(*) AS n
FROM events, generate_series(1, 7) AS g(k) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone = jobs.sliding_tone(jobs.parquet_stream(spark, f"{sf_dir}/events.parquet", "ts"), "ts", ["event_type"], "value")
    return _drained(spark, tone, "complete").select(F.date_format("end", "yyyy-MM-dd").alias("day"), "event_type", F.round("mean", 4).alias("mean"), "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user, kind of event and day, as a stream with a day of state; files arrive in order of time, one a batch."""
    landed = in_slices(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["2024-01-08", "2024-01-15", "2024-01-23"], "sorted-events")
    stream = jobs.parquet_stream(spark, landed, "ts", per_trigger=1).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("key", F.concat_ws(":", "user_id", "event_type", "day"))
    return _drained(spark, jobs.deduplicated(stream, "key", "ts").select("user_id", "event_type", "day"), "append")


@query("stream_price_shift", """WITH c AS (SELECT user_id AS case_id, event_id, round(value / 500 - lag(value / 500) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS delta FROM events)
SELECT case_id, event_id, delta, CASE WHEN delta > 0 THEN 'rising' ELSE 'falling' END AS trend FROM c WHERE abs(delta) >= 0.1""")
def stream_price_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = jobs.parquet_stream(spark, f"{sf_dir}/events.parquet", "ts")
    prices = stream.select(F.col("user_id").alias("case_id"), "event_id", "ts", (F.col("value") / 500).alias("price"))
    out = scratch_path(spark, "shifts")
    jobs.price_shifts(prices, out, scratch_path(spark, "offsets"))
    return spark.read.schema(jobs.SHIFT).parquet(out).select("case_id", "event_id", "delta", "trend")


@query("stream_dedup_ids", "SELECT event_id, user_id FROM events")
def stream_dedup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that arrives twice: each id once, with state of a day only."""
    landed = scratch_path(spark, "twice")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    rows.union(rows).write.parquet(landed)
    stream = jobs.deduplicated(jobs.parquet_stream(spark, landed, "ts"), "event_id", "ts")
    return _drained(spark, stream.select("event_id", "user_id"), "append")


SCORES = """, t AS (SELECT key, d, sum(s) OVER w7 / CAST(sum(n) OVER w7 AS DOUBLE) AS m7, sum(s) OVER w30 AS s30, sum(q) OVER w30 AS q30, sum(n) OVER w30 AS n30 FROM d
  WINDOW w7 AS (PARTITION BY key ORDER BY d RANGE BETWEEN INTERVAL '6 DAY' PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY key ORDER BY d RANGE BETWEEN INTERVAL '29 DAY' PRECEDING AND CURRENT ROW)),
z AS (SELECT *, s30 / CAST(n30 AS DOUBLE) AS m30, sqrt(CAST(n30 * q30 - s30 * s30 AS DOUBLE)) / n30 AS sd FROM t)
SELECT key, strftime(d, '%Y-%m-%d') AS day, round(m7, 4) AS mean_short, round(m30, 4) AS mean_long, round(CASE WHEN sd > 0 THEN (m7 - m30) / sd END, 3) AS z FROM z"""


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("mean_short", 4).alias("mean_short"), F.round("mean_long", 4).alias("mean_long"), F.round("z", 3).alias("z"))


@query("tone_scores", ", d AS (SELECT source_country AS key, CAST(date AS DATE) AS d, sum(CAST(round(tone) AS BIGINT)) AS s, sum(CAST(round(tone) AS BIGINT) * CAST(round(tone) AS BIGINT)) AS q, count(*) AS n FROM t_live_events GROUP BY 1, 2)" + SCORES, "live_events")
def tone_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each country's tone of the last week against its last month, for every day."""
    daily = table(spark, sf_dir, "live_events").groupBy(F.col("source_country").alias("key"), F.to_date("date").alias("day"))
    daily = daily.agg(core.moments(F.round("tone")).alias("moments"))
    return _scores(core.trailing_scores(daily, ["key"]))


@query("stream_scores", "WITH d AS (SELECT event_type AS key, CAST(ts AS DATE) AS d, sum(CAST(round(value) AS BIGINT)) AS s, sum(CAST(round(value) AS BIGINT) * CAST(round(value) AS BIGINT)) AS q, count(*) AS n FROM events GROUP BY 1, 2)" + SCORES)
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream."""
    stream = jobs.parquet_stream(spark, f"{sf_dir}/events.parquet", "ts").select("ts", F.col("event_type").alias("key"), F.round("value").alias("value"))
    out = scratch_path(spark, "scores")
    jobs.tone_scores(stream, "ts", ["key"], "value", out, scratch_path(spark, "offsets"))
    return _scores(jobs.read_scores(spark, out, spark.sql("SELECT '' AS key")))
