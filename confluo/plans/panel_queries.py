"""Registered dashboard and operator queries, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.functions import scalars
from confluo.operators import core
from confluo.plans import panels, rules
from confluo.plans.adapters import AS_OF, cte, table
from confluo.plans.rule_queries import T0, YOY, day, sid

START, END = "1998-06-01 00:00:00", "1998-07-01 00:00:00"
RANGE = "TIMESTAMP '1998-06-01 00:00:00' AND {c} < TIMESTAMP '1998-07-01 00:00:00'"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *tables: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = f"WITH {cte(*tables)}\n{sql}"
        return f

    return register


def within(c: str) -> str:
    return f"{c} >= TIMESTAMP '{START}' AND {c} < TIMESTAMP '{END}'"


def month(spark: SparkSession, sf_dir: str, name: str, at: str = "date") -> DataFrame:
    return panels.in_range(table(spark, sf_dir, name), at, START, END)


def days_sql(end: str = "1998-07-01", start: str = "1998-06-01", step: str = "1 DAY") -> str:
    return f"SELECT CAST(unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}' - INTERVAL '1 DAY', INTERVAL '{step}')) AS DATE) AS d"


@query("latest_events", f"SELECT event_id, strftime(date, '%Y-%m-%d') AS day, source_country, target_country, round(goldstein_scale, 4) AS g FROM t_events WHERE {within('date')} ORDER BY date DESC, event_id, goldstein_scale, source_country, target_country LIMIT 20", "events")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.latest(month(spark, sf_dir, "events"), "date", 20, "event_id", "goldstein_scale", "source_country", "target_country")
    return rows.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "source_country", "target_country", F.round("goldstein_scale", 4).alias("g"))


@query("events_over_time", f", d AS ({days_sql()}) SELECT strftime(d, '%Y-%m-%d') AS bucket, count(event_id) AS n FROM d LEFT JOIN t_events ON CAST(date AS DATE) = d GROUP BY 1", "events")
def events_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.date_histogram(table(spark, sf_dir, "events"), "date", "day", START, END).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("total_events", f"SELECT count(*) AS n FROM t_events WHERE {within('date')}", "events")
def total_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month(spark, sf_dir, "events").agg(F.count("*").alias("n"))


@query("top_countries", f"SELECT source_country AS country, count(*) AS value FROM t_events WHERE {within('date')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "events")
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.top_terms(month(spark, sf_dir, "events").withColumnRenamed("source_country", "country"), ["country"], 10)


@query("actor_pairs", f""", e AS (SELECT * FROM t_events WHERE {within('date')} AND actor1_name <> '' AND actor2_name <> ''),
f AS (SELECT actor1_name, count(*) AS n_first FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15),
b AS (SELECT actor1_name, actor2_name, count(*) AS n_pair, row_number() OVER (PARTITION BY actor1_name ORDER BY count(*) DESC, actor2_name) AS rn FROM e GROUP BY 1, 2)
SELECT actor1_name, n_first, actor2_name, n_pair FROM f JOIN b USING (actor1_name) WHERE rn = 1""", "events")
def actor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.actor_pairs(month(spark, sf_dir, "events"))


@query("quad_types", f"SELECT quad_class, count(*) AS n, CASE quad_class WHEN 1 THEN 'Verbal cooperation' WHEN 2 THEN 'Material cooperation' WHEN 3 THEN 'Verbal conflict' ELSE 'Material conflict' END AS label FROM t_events WHERE {within('date')} GROUP BY 1", "events")
def quad_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.event_types(month(spark, sf_dir, "events"))


@query("top_markets", "SELECT case_id, question, round(volume, 4) AS volume FROM t_cases ORDER BY t_cases.volume DESC, case_id LIMIT 5", "cases")
def top_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cases").orderBy(F.desc("volume"), "case_id").limit(5)
    return rows.select("case_id", "question", F.round("volume", 4).alias("volume"))


@query("latest_outages", "SELECT outage_id, country, severity, strftime(start_time, '%Y-%m-%d') AS day FROM t_outages ORDER BY start_time DESC, outage_id LIMIT 20", "outages")
def latest_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.latest(table(spark, sf_dir, "outages"), "start_time", 20, "outage_id")
    return rows.select("outage_id", "country", "severity", F.date_format("start_time", "yyyy-MM-dd").alias("day"))


@query("top_importers", "SELECT recipient_country AS country, round(sum(tiv), 2) AS value FROM t_transfers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "transfers")
def top_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.top_terms(table(spark, sf_dir, "transfers").withColumnRenamed("recipient_country", "country"), ["country"], 10, F.round(F.sum("tiv"), 2))


@query("country_timeline", f""", d AS ({days_sql()}) SELECT strftime(d, '%Y-%m-%d') AS bucket, 'events' AS series, count(event_id) AS n FROM d LEFT JOIN t_events ON CAST(date AS DATE) = d AND (source_country = 'NATION_3' OR target_country = 'NATION_3') GROUP BY 1
UNION ALL SELECT strftime(d, '%Y-%m-%d'), 'conflicts', count(event_id) FROM d LEFT JOIN t_conflicts ON CAST(date AS DATE) = d AND country = 'NATION_3' GROUP BY 1""", "events", "conflicts")
def country_timeline(spark: SparkSession, sf_dir: str, country: str = "NATION_3") -> DataFrame:
    rows = panels.country_timeline(table(spark, sf_dir, "events"), table(spark, sf_dir, "conflicts"), country, START, END)
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("severity_daily", f""", s AS (SELECT DISTINCT severity FROM t_outages WHERE {within('start_time')}), d AS ({days_sql()})
SELECT strftime(d, '%Y-%m-%d') AS bucket, s.severity, count(outage_id) AS n FROM d CROSS JOIN s LEFT JOIN t_outages o ON CAST(start_time AS DATE) = d AND o.severity = s.severity GROUP BY 1, 2""", "outages")
def severity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.date_histogram(table(spark, sf_dir, "outages"), "start_time", "day", START, END, ["severity"])
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("imports_exports", """, p AS (SELECT 'import' AS direction, supplier_country AS partner, tiv FROM t_transfers WHERE recipient_country = 'NATION_3' UNION ALL SELECT 'export', recipient_country, tiv FROM t_transfers WHERE supplier_country = 'NATION_3'),
g AS (SELECT direction, partner, round(sum(tiv), 2) AS tiv FROM p GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY tiv DESC, partner) AS INTEGER) AS rank FROM g)
SELECT * FROM r WHERE rank <= 10""", "transfers")
def imports_exports(spark: SparkSession, sf_dir: str, country: str = "NATION_3") -> DataFrame:
    return panels.trade_partners(table(spark, sf_dir, "transfers"), country)


@query("spending_trend", YOY + "SELECT country, year, round(spending, 2) AS spending, round(yoy, 4) AS yoy FROM yoy", "spending")
def spending_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.with_yoy(table(spark, sf_dir, "spending"))
    return rows.select("country", "year", F.round("spending", 2).alias("spending"), F.round("yoy", 4).alias("yoy"))


@query("spending_latest", "SELECT country, max(year) AS year, round(arg_max(spending, year), 2) AS spending FROM t_spending GROUP BY 1", "spending")
def spending_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.latest_year(table(spark, sf_dir, "spending")).select("country", "year", F.round("spending", 2).alias("spending"))


@query("country_groups", "SELECT name, confidence FROM t_groups WHERE country = 'NATION_3' ORDER BY confidence DESC, name LIMIT 20", "groups")
def country_groups(spark: SparkSession, sf_dir: str, country: str = "NATION_3") -> DataFrame:
    return table(spark, sf_dir, "groups").where(F.col("country") == country).orderBy(F.desc("confidence"), "name").limit(20).select("name", "confidence")


@query("country_sanctions", "SELECT entity_id, program, strftime(first_seen, '%Y-%m-%d') AS day FROM t_sanctions WHERE country = 'NATION_3' ORDER BY first_seen DESC, entity_id LIMIT 20", "sanctions")
def country_sanctions(spark: SparkSession, sf_dir: str, country: str = "NATION_3") -> DataFrame:
    rows = panels.latest(table(spark, sf_dir, "sanctions").where(F.col("country") == country), "first_seen", 20, "entity_id")
    return rows.select("entity_id", "program", F.date_format("first_seen", "yyyy-MM-dd").alias("day"))


@query("country_names", "SELECT DISTINCT source_country AS country FROM t_events WHERE source_country <> ''", "events")
def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("source_country <> ''").select(F.col("source_country").alias("country")).distinct()


@query("articles_by_source", "SELECT source, count(*) AS value FROM t_articles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "articles")
def articles_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.top_terms(table(spark, sf_dir, "articles"), ["source"], 15)


@query("articles_latest", "SELECT doc_id, title, source, strftime(date, '%Y-%m-%d') AS day FROM t_articles ORDER BY date DESC, doc_id LIMIT 50", "articles")
def articles_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest articles, with their first line as a title."""
    return panels.latest(table(spark, sf_dir, "articles"), "date", 50, "doc_id").select("doc_id", "title", "source", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("article_keywords", ", k AS (SELECT doc_id, list_filter([" + ", ".join(f"'{w}'" for w in scalars.ARTICLE_KEYWORDS) + "], lambda x: regexp_matches(lower(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' war' ELSE ' warm coup' END), '\\b' || x || '\\b')) AS m FROM t_articles) SELECT doc_id, array_to_string(m, ',') AS keywords, len(m) AS n FROM k WHERE len(m) > 0", "articles")
def article_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").withColumn("m", scalars.matched_keywords(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " war").otherwise(" warm coup")))).where(F.size("m") > 0)
    return rows.select("doc_id", F.array_join("m", ",").alias("keywords"), F.size("m").cast("long").alias("n"))


@query("names_in_text", r", k AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(upper(text), '\b(?:NATION|THAT|THE|HER|OF)\b'), lambda x: CASE x WHEN 'HER' THEN 'SHE' ELSE x END))) AS m FROM t_articles) SELECT doc_id, array_to_string(m, ',') AS names FROM k WHERE len(m) > 0", "articles")
def names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scalars.mentioned(F.col("text"), ("the", "of", "nation", "that"), {"her": "she"})
    return table(spark, sf_dir, "articles").select("doc_id", found.alias("m")).where(F.size("m") > 0).select("doc_id", F.array_join("m", ",").alias("names"))


@query("doc_counts", """SELECT 'events' AS name, count(*) AS n, strftime(max(date), '%Y-%m-%d') AS newest FROM t_events UNION ALL SELECT 'conflicts', count(*), strftime(max(date), '%Y-%m-%d') FROM t_conflicts
UNION ALL SELECT 'outages', count(*), strftime(max(start_time), '%Y-%m-%d') FROM t_outages UNION ALL SELECT 'sanctions', count(*), strftime(max(first_seen), '%Y-%m-%d') FROM t_sanctions""", "events", "conflicts", "outages", "sanctions")
def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return panels.table_counts({"events": (t("events"), "date"), "conflicts": (t("conflicts"), "date"), "outages": (t("outages"), "start_time"), "sanctions": (t("sanctions"), "first_seen")})


@query("activity_weekly", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS bucket, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS total, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(*) AS mean FROM t_activity GROUP BY 1, 2", "activity")
def activity_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = table(spark, sf_dir, "activity").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("bucket"), "event_type")
    total = F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0  # in cents, so that no order of summing shows
    return weekly.agg(F.count("*").alias("n"), total.alias("total"), (total / F.count("*")).alias("mean"))


@query("rule_mix", f""", o AS (SELECT 'outage' AS rule_name, country FROM t_outages WHERE {within('start_time')} UNION ALL SELECT 'sanction', country FROM t_sanctions WHERE {within('first_seen')} UNION ALL SELECT 'conflict', country FROM t_conflicts WHERE {within('date')})
SELECT rule_name, count(*) AS value, count(DISTINCT country) AS countries FROM o GROUP BY 1""", "outages", "sanctions", "conflicts")
def rule_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [month(spark, sf_dir, n, at).select(F.lit(rule).alias("rule_name"), "country") for rule, n, at in (("outage", "outages", "start_time"), ("sanction", "sanctions", "first_seen"), ("conflict", "conflicts", "date"))]
    return core.union_all(parts).groupBy("rule_name").agg(F.count("*").alias("value"), F.count_distinct("country").alias("countries"))


@query("upsert_latest", "SELECT event_id, strftime(arg_max(date, struct_pack(d := date, g := goldstein_scale, t := tone)), '%Y-%m-%d') AS day, round(arg_max(goldstein_scale, struct_pack(d := date, g := goldstein_scale, t := tone)), 4) AS g FROM t_events GROUP BY 1", "events")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new halves of the events, upserted by id, the latest version of each."""
    events = table(spark, sf_dir, "events")
    old, new = events.where("date < '1998-01-01'"), events.where("date >= '1998-01-01'")
    rows = core.upsert(old, new, ["event_id"], F.desc("date"), F.desc("goldstein_scale"), F.desc("tone"))
    return rows.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"), F.round("goldstein_scale", 4).alias("g"))


@query("anti_join_new", "SELECT DISTINCT event_id FROM t_events WHERE date >= TIMESTAMP '1998-01-01' AND event_id NOT IN (SELECT event_id FROM t_events WHERE date < TIMESTAMP '1998-01-01')", "events")
def anti_join_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "date")
    return core.only_new(events.where("date >= '1998-01-01'"), events.where("date < '1998-01-01'"), ["event_id"]).select("event_id")


@query("partial_update", "SELECT case_id, round(CASE WHEN case_id % 20 = 0 THEN price + 1 ELSE price END, 4) AS price, CASE WHEN case_id % 20 = 0 THEN 'updated' END AS note, question FROM t_cases", "cases")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "cases")
    changes = cases.where("case_id % 20 = 0").select("case_id", (F.col("price") + 1).alias("price"), F.lit("updated").alias("note"))
    return core.partial_update(cases, changes, ["case_id"]).select("case_id", F.round("price", 4).alias("price"), "note", "question")


@query("monthly_routing", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM t_conflicts GROUP BY 1", "conflicts")
def monthly_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.with_month(table(spark, sf_dir, "conflicts"), "date", AS_OF).groupBy("month").agg(F.count("*").alias("n"))


@query("relevant_events", "SELECT substring(event_code, 1, 2) AS root, count(*) AS n FROM t_events WHERE substring(event_code, 1, 2) IN ('04', '05', '06', '13', '14', '15', '16', '17', '18', '19', '20') GROUP BY 1", "events")
def relevant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(scalars.is_relevant_code(F.col("event_code")))
    return rows.groupBy(F.substring("event_code", 1, 2).alias("root")).agg(F.count("*").alias("n"))


@query("event_ids", f"SELECT {sid('event_id', 'source_country', 'target_country')} AS id, count(*) AS n FROM t_events GROUP BY 1", "events")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(scalars.surrogate_id(F.col("event_id"), F.col("source_country"), F.col("target_country")).alias("id")).agg(F.count("*").alias("n"))


@query("tone_trailing", """, d AS (SELECT source_country AS country, CAST(date AS DATE) AS d, CAST(sum(CAST(round(tone) AS BIGINT)) AS DOUBLE) AS s, count(*) AS n FROM t_events GROUP BY 1, 2)
SELECT country, strftime(d, '%Y-%m-%d') AS day, round(sum(s) OVER w7 / sum(n) OVER w7, 4) AS tone_7d, round(sum(s) OVER w30 / sum(n) OVER w30, 4) AS tone_30d FROM d
WINDOW w7 AS (PARTITION BY country ORDER BY d RANGE BETWEEN INTERVAL '6 DAY' PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY country ORDER BY d RANGE BETWEEN INTERVAL '29 DAY' PRECEDING AND CURRENT ROW)""", "events")
def tone_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing means over days: events are first reduced to days, so the window sees one row a country and day."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("source_country").alias("country"), F.to_date("date").alias("d")).agg(F.sum(F.round("tone").cast("long")).cast("double").alias("s"), F.count("*").alias("n"))
    w = lambda days: Window.partitionBy("country").orderBy(F.unix_date("d")).rangeBetween(1 - days, 0)
    mean = lambda days: F.round(F.sum("s").over(w(days)) / F.sum("n").over(w(days)), 4)
    return daily.select("country", F.date_format("d", "yyyy-MM-dd").alias("day"), mean(7).alias("tone_7d"), mean(30).alias("tone_30d"))


@query("parse_locations", ", s AS (SELECT n_nationkey, n_name, n_regionkey FROM t_nations) SELECT n_nationkey, n_name AS name, round(n_nationkey * 1.5 - 10, 4) AS lat, round(n_regionkey * 2.25, 4) AS lon FROM s WHERE NOT (n_nationkey * 1.5 - 10 = 0 AND n_regionkey = 0)", "nations")
def parse_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nations")
    text = F.concat(F.lit("1#"), "n_name", F.lit("#XX#a#"), (F.col("n_nationkey") * 1.5 - 10).cast("string"), F.lit("#"), (F.col("n_regionkey") * 2.25).cast("string"), F.lit("#f;;broken#x;"))
    found = n.select("n_nationkey", F.explode(scalars.parse_locations(text)).alias("p"))
    return found.select("n_nationkey", F.col("p.country").alias("_c"), F.col("p.name").alias("name"), F.round("p.lat", 4).alias("lat"), F.round("p.lon", 4).alias("lon")).drop("_c")


@query("parse_tone", "SELECT event_id, round(CAST(value AS DOUBLE), 4) AS tone, round(value / 2, 4) AS positive, 0.0::DOUBLE AS words FROM t_activity", "activity")
def parse_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("value").cast("string"), F.lit(","), (F.col("value") / 2).cast("string"), F.lit(",x"))
    rows = table(spark, sf_dir, "activity").select("event_id", scalars.parse_tone(text).alias("t"))
    return rows.select("event_id", F.round("t.tone", 4).alias("tone"), F.round("t.positive", 4).alias("positive"), F.col("t.words").alias("words"))


@query("parse_scores", "SELECT p_partkey, 'a=' || CAST(p_size + 1 AS VARCHAR) || ',b=' || CAST(p_partkey AS VARCHAR) AS scores FROM t_parts", "parts")
def parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a:"), F.col("p_size").cast("string"), F.lit(",b:"), F.col("p_partkey").cast("string"), F.lit(",bad,c:1:2,a:"), (F.col("p_size") + 1).cast("string"))
    rows = table(spark, sf_dir, "parts").select("p_partkey", scalars.parse_scores(text).alias("s"))
    return rows.select("p_partkey", F.array_join(F.transform("s", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ",").alias("scores"))


@query("json_prices", "SELECT p_partkey, round(p_size / 100.0::DOUBLE, 4) AS yes, round(1 - p_size / 100.0::DOUBLE, 4) AS no FROM t_parts", "parts")
def json_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = (F.col("p_size") / 100.0).cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('["'), yes, F.lit('"]'))).otherwise(F.concat(F.lit('["'), yes, F.lit('", "'), (1 - F.col("p_size") / 100.0).cast("string"), F.lit('"]')))
    return table(spark, sf_dir, "parts").select("p_partkey", scalars.outcome_prices(text).alias("o")).select("p_partkey", "o.yes", "o.no")


@query("piecewise_scores", "SELECT p_partkey, round(CASE WHEN p_size <= 0 THEN 0.0 WHEN p_size >= 40 THEN 100.0 WHEN p_size >= 15 THEN 50.0 + 50.0 * (p_size - 15) / 25.0 ELSE 50.0 * p_size / 15.0 END::DOUBLE, 4) AS score FROM t_parts", "parts")
def piecewise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parts").select("p_partkey", F.round(scalars.piecewise(F.col("p_size").cast("double"), 15, 40), 4).alias("score"))


@query("signals_before_after", f"SELECT source_country AS country, count(*) FILTER (date < {T0}) AS before, count(*) FILTER (date >= {T0}) AS after FROM t_events WHERE date >= {day(2160)} AND date <= {T0} + INTERVAL '2160' HOUR GROUP BY 1", "events")
def signals_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(AS_OF).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").where((F.col("date") >= core.since(AS_OF, 90)) & (F.col("date") <= core.since(AS_OF, -90)))
    return rows.groupBy(F.col("source_country").alias("country")).agg(F.count_if(F.col("date") < at).alias("before"), F.count_if(F.col("date") >= at).alias("after"))


@query("price_trend", "SELECT case_id, event_id, round(price, 6) AS price, round(lag(price) OVER (PARTITION BY case_id ORDER BY ts, event_id), 6) AS previous FROM t_prices", "prices")
def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.price_changes(table(spark, sf_dir, "prices"))
    return rows.select("case_id", "event_id", F.round("price", 6).alias("price"), F.round("previous", 6).alias("previous"))
