"""Registered queries of the correlation rules, scores and matching, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions import scalars
from confluo.operators import core
from confluo.plans import rules, scores
from confluo.plans.adapters import AS_OF, cte, table

T0 = "TIMESTAMP '1998-07-01 00:00:00'"
QUERIES: dict = {}
SQL: dict[str, str] = {}
BODIES: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str, *tables: str):
    """Register the function below under a name, with SQL over the named adapter tables."""

    def register(f):
        QUERIES[name] = f
        SQL[name] = f"WITH {cte(*tables)}\n{sql}"
        BODIES[name] = sql, tables
        return f

    return register


def day(hours: int) -> str:
    return f"{T0} - INTERVAL '{hours}' HOUR"


def sid(*parts: str) -> str:
    return "substring(sha256(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 20)"


RECENT = """, recent AS (SELECT lower(name) AS key, max(confidence) AS confidence FROM t_groups
  WHERE modified >= {since} AND modified <= {t0} GROUP BY 1),
active AS (SELECT DISTINCT a.country, a.name, r.confidence FROM t_attribution a JOIN recent r ON lower(a.name) = r.key)
"""


def recent(days: int) -> str:
    return RECENT.format(since=day(24 * days), t0=T0)


@query("event_severity", """, p AS (SELECT event_id, date, source_country,
  CASE WHEN goldstein_scale <= -9 THEN 4 WHEN goldstein_scale <= -7 THEN 3 WHEN goldstein_scale <= -5 THEN 2 WHEN goldstein_scale <= -2 THEN 1 ELSE 0 END
  + CASE WHEN num_articles >= 100 THEN 2 WHEN num_articles >= 50 THEN 1.5 WHEN num_articles >= 20 THEN 1 WHEN num_articles >= 5 THEN 0.5 ELSE 0 END
  + CASE WHEN tone <= -8 THEN 2 WHEN tone <= -5 THEN 1.5 WHEN tone <= -3 THEN 1 WHEN tone <= -1 THEN 0.5 ELSE 0 END AS pts FROM t_events)
SELECT CASE WHEN pts >= 6 THEN 'critical' WHEN pts >= 4 THEN 'high' WHEN pts >= 2 THEN 'medium' ELSE 'low' END AS severity,
  source_country AS country, count(*) AS n FROM p GROUP BY 1, 2""", "events")
def event_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    graded = e.withColumn("severity", scalars.event_severity(F.col("goldstein_scale"), F.col("num_articles"), F.col("tone")))
    return graded.groupBy("severity", F.col("source_country").alias("country")).agg(F.count("*").alias("n"))


RANGE = ("1998-01-01 00:00:00", "1998-07-01 00:00:00")


@query("severity_breakdown", SQL["event_severity"].removeprefix(f"WITH {cte('events')}\n").replace("FROM t_events)", f"FROM t_events WHERE date >= TIMESTAMP '{RANGE[0]}' AND date < TIMESTAMP '{RANGE[1]}')").replace("  source_country AS country, count(*) AS n FROM p GROUP BY 1, 2", "  count(*) AS n FROM p GROUP BY 1"), "events")
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a time range by severity, of all countries."""
    start, end = (F.lit(x).cast("timestamp_ntz") for x in RANGE)
    e = table(spark, sf_dir, "events").where((F.col("date") >= start) & (F.col("date") < end))
    return e.groupBy(scalars.event_severity(F.col("goldstein_scale"), F.col("num_articles"), F.col("tone")).alias("severity")).agg(F.count("*").alias("n"))


@query("move_texts", """, c AS (SELECT *, round(price - lag(price) OVER (PARTITION BY case_id ORDER BY ts, event_id), 4) AS delta FROM t_prices)
SELECT case_id, event_id, printf('Case %d moved %+.2f%% to %.4f', case_id, 100 * delta, price) AS text FROM c WHERE abs(delta) >= 0.1""", "prices")
def move_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an alert says of a market's move, in formatted numbers."""
    moved = rules.price_changes(table(spark, sf_dir, "prices")).where(F.abs("delta") >= 0.1)
    return moved.select("case_id", "event_id", F.format_string("Case %d moved %+.2f%% to %.4f", "case_id", 100 * F.col("delta"), "price").alias("text"))


@query("diplomatic_apt", recent(30) + f""", p AS (SELECT least(source_country, target_country) AS a, greatest(source_country, target_country) AS b,
  count(*) AS n_events, min(goldstein_scale) AS worst, arg_min(event_id, struct_pack(g := goldstein_scale, d := date, e := event_id)) AS worst_event FROM t_events
  WHERE goldstein_scale < -5 AND date >= {day(168)} AND date <= {T0} GROUP BY 1, 2),
m AS (SELECT p.*, count(DISTINCT name) AS n_groups, max(confidence) AS max_confidence, list_sort(list(DISTINCT name))[1:3] AS g
  FROM p JOIN active ON active.country = p.a OR active.country = p.b GROUP BY ALL),
l AS (SELECT *, least(3, CASE WHEN worst <= -8 THEN 3 WHEN worst <= -6 THEN 2 ELSE 1 END + CASE WHEN max_confidence >= 80 THEN 1 ELSE 0 END) AS lv FROM m)
SELECT {sid("'diplomatic_escalation_apt'", 'a', 'b', "'1998-07-01'")} AS correlation_id, 'diplomatic_escalation_apt' AS rule_name,
  CASE lv WHEN 3 THEN 'critical' WHEN 2 THEN 'high' ELSE 'medium' END AS severity, a || '||' || b AS countries, n_events, round(worst, 4) AS worst, worst_event,
  n_groups, max_confidence, array_to_string(g, ',') AS first_groups FROM l""", "events", "groups", "attribution")
def diplomatic_apt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return rules.diplomatic_apt(t("events"), t("groups"), t("attribution"), AS_OF).withColumn("worst", F.round("worst", 4))


@query("escalation_pairs", f"""SELECT least(source_country, target_country) AS country_a, greatest(source_country, target_country) AS country_b,
  count(*) AS n, round(min(goldstein_scale), 4) AS worst FROM t_events WHERE goldstein_scale < -5 AND date >= {day(168)} AND date <= {T0} GROUP BY 1, 2""", "events")
def escalation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = table(spark, sf_dir, "events").where((F.col("goldstein_scale") < -5) & core.between("date", AS_OF, 7))
    return hot.groupBy(*core.canonical_pair("source_country", "target_country")).agg(F.count("*").alias("n"), F.round(F.min("goldstein_scale"), 4).alias("worst"))


def sanction_sql(ratio: float) -> str:
    return f""", s AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY first_seen, entity_id) AS rn FROM t_sanctions WHERE first_seen >= {day(336)} AND first_seen <= {T0}),
c AS (SELECT country, count(*) AS n_sanctions, array_to_string(list_sort(list(DISTINCT program) FILTER (rn <= 5)), ',') AS programs FROM s GROUP BY 1),
w AS (SELECT country, count(*) FILTER (ingested_at >= {day(1440)}) AS post, count(*) FILTER (ingested_at < {day(1440)}) AS base FROM t_indicators
  WHERE ingested_at >= {day(2880)} AND ingested_at <= {T0} GROUP BY 1),
r AS (SELECT *, CASE WHEN base > 0 THEN CAST(post AS DOUBLE) / base WHEN post > 0 THEN {ratio + 1} END AS ratio FROM c JOIN w USING (country))
SELECT {sid("'sanction_cyber_spike'", 'country', "'1998-07-01'")} AS correlation_id, 'sanction_cyber_spike' AS rule_name,
  CASE WHEN ratio >= 5 THEN 'critical' WHEN ratio >= 3 THEN 'high' WHEN ratio >= 2 THEN 'medium' ELSE 'low' END AS severity,
  country AS countries, n_sanctions, programs, post, base, round(ratio, 4) AS ratio FROM r WHERE ratio >= {ratio}"""


@query("sanction_spike", sanction_sql(1.2), "sanctions", "indicators")
def sanction_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.sanction_spike(table(spark, sf_dir, "sanctions"), table(spark, sf_dir, "indicators"), AS_OF, ratio=1.2)
    return found.withColumn("ratio", F.round("ratio", 4))


@query("conflict_cyber", recent(30) + f""", f AS (SELECT country, count(*) AS n_events, CAST(sum(fatalities) AS BIGINT) AS fatalities, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types
  FROM t_conflicts WHERE event_type IN ('Battles', 'Violence against civilians', 'Explosions/Remote violence', 'Strategic developments') AND date >= {day(336)} AND date <= {T0} GROUP BY 1),
g AS (SELECT country, count(DISTINCT name) AS n_groups, max(confidence) AS max_confidence FROM active GROUP BY 1),
s AS (SELECT *, CASE WHEN n_events >= 50 THEN 2 WHEN n_events >= 10 THEN 1 ELSE 0 END + CASE WHEN fatalities >= 100 THEN 2 WHEN fatalities >= 10 THEN 1 ELSE 0 END
  + CASE WHEN n_groups >= 3 THEN 1 ELSE 0 END + CASE WHEN max_confidence >= 80 THEN 1 ELSE 0 END AS score FROM f JOIN g USING (country))
SELECT {sid("'conflict_cyber_infrastructure'", 'country', "'1998-07-01'")} AS correlation_id, 'conflict_cyber_infrastructure' AS rule_name,
  CASE WHEN score >= 5 THEN 'critical' WHEN score >= 3 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS severity,
  country AS countries, n_events, fatalities, event_types, n_groups, max_confidence, score FROM s""", "conflicts", "groups", "attribution")
def conflict_cyber(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return rules.conflict_cyber(t("conflicts"), t("groups"), t("attribution"), AS_OF)


def rhetoric_sql(t0: str, short: int, long: int, least: int, z: float) -> str:
    """t0 as a timestamp's text, windows in days."""
    ago = lambda days: f"TIMESTAMP '{t0}' - INTERVAL '{24 * days}' HOUR"
    return f""", d AS (SELECT source_country, target_country, count(tone) FILTER (date >= {ago(short)}) AS n_short, sum(tone) FILTER (date >= {ago(short)}) AS s_short,
  count(tone) AS n_long, sum(tone) AS s_long, stddev_pop(tone) AS sd FROM t_events WHERE date >= {ago(long)} AND date <= TIMESTAMP '{t0}' GROUP BY 1, 2),
p AS (SELECT least(source_country, target_country) AS a, greatest(source_country, target_country) AS b, sum(n_short) AS n_short, sum(s_short) AS s_short, sum(n_long) AS n_long, sum(s_long) AS s_long, max(sd) AS sd FROM d GROUP BY 1, 2),
z AS (SELECT *, s_short / n_short AS m_short, s_long / n_long AS m_long, CASE WHEN sd > 0 THEN (s_short / n_short - s_long / n_long) / sd END AS z FROM p)
SELECT {sid("'rhetoric_shift'", 'a', 'b', f"'{t0[:10]}'")} AS correlation_id, 'rhetoric_shift' AS rule_name,
  CASE WHEN abs(z) >= 4 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity, a || '||' || b AS countries,
  CAST(n_short AS BIGINT) AS n_short, CAST(n_long AS BIGINT) AS n_long, round(m_short, 4) AS mean_short, round(m_long, 4) AS mean_long, round(z, 4) AS z,
  CASE WHEN z < 0 THEN 'deteriorating' ELSE 'improving' END AS direction FROM z WHERE n_short >= {least} AND n_long >= {least} AND abs(z) >= {z}"""


@query("rhetoric_shift", rhetoric_sql(AS_OF, 30, 180, 2, 1), "events")
def rhetoric_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.rhetoric_shift(table(spark, sf_dir, "events"), AS_OF, short=30, long=180, least=2, z=1.0)
    return found.withColumns({c: F.round(c, 4) for c in ("mean_short", "mean_long", "z")})


@query("outage_escalation", f""", c AS (SELECT outage_id, start_time, country, severity AS sev FROM t_outages WHERE start_time >= {day(168)} AND start_time <= {T0}),
x AS (SELECT source_country AS country, date, event_id, goldstein_scale FROM t_events WHERE goldstein_scale < -5
  UNION ALL SELECT target_country, date, event_id, goldstein_scale FROM t_events WHERE goldstein_scale < -5 AND target_country <> source_country),
n AS (SELECT c.outage_id, goldstein_scale, row_number() OVER (PARTITION BY c.outage_id ORDER BY goldstein_scale, date, event_id) AS rn FROM c JOIN x ON c.country = x.country
  AND x.date >= c.start_time - INTERVAL '48' HOUR AND x.date <= c.start_time + INTERVAL '48' HOUR),
f AS (SELECT c.outage_id, row_number() OVER (PARTITION BY c.outage_id ORDER BY fatalities DESC, k.date, k.event_id) AS rn FROM c JOIN t_conflicts k ON c.country = k.country
  AND k.date >= c.start_time - INTERVAL '48' HOUR AND k.date <= c.start_time + INTERVAL '48' HOUR),
j AS (SELECT c.*, coalesce(d.n, 0) AS n_diplomatic, coalesce(e.n, 0) AS n_conflict, d.worst FROM c
  LEFT JOIN (SELECT outage_id, count(*) AS n, min(goldstein_scale) AS worst FROM n WHERE rn <= 10 GROUP BY 1) d USING (outage_id)
  LEFT JOIN (SELECT outage_id, count(*) AS n FROM f WHERE rn <= 10 GROUP BY 1) e USING (outage_id))
SELECT {sid("'internet_outage_escalation'", 'country', "strftime(start_time, '%Y-%m-%d')", 'outage_id')} AS correlation_id, 'internet_outage_escalation' AS rule_name,
  CASE WHEN sev = 'total' AND n_conflict > 0 THEN 'critical' ELSE 'high' END AS severity, country AS countries, strftime(start_time, '%Y-%m-%d') AS day, outage_id, n_diplomatic, n_conflict, round(worst, 4) AS worst
FROM j WHERE n_diplomatic > 0 OR n_conflict > 0""", "outages", "events", "conflicts")
def outage_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return rules.outage_escalation(t("outages"), t("events"), t("conflicts"), AS_OF).withColumn("worst", F.round("worst", 4))


YOY = """, y AS (SELECT *, lag(spending) OVER (PARTITION BY country ORDER BY year) AS last FROM t_spending),
yoy AS (SELECT country, year, spending, CASE WHEN last > 0 THEN 100.0::DOUBLE * (spending - last) / last END AS yoy FROM y)
"""


@query("military_buildup", recent(365) + YOY + f""", st AS (SELECT country, count(DISTINCT name) AS n FROM t_attribution GROUP BY 1), ac AS (SELECT country, count(DISTINCT name) AS n FROM active GROUP BY 1)
SELECT {sid("'military_buildup_cyber'", 'country', 'year')} AS correlation_id, 'military_buildup_cyber' AS rule_name, CASE WHEN yoy > 20 THEN 'high' ELSE 'medium' END AS severity,
  country AS countries, year, round(yoy, 4) AS yoy, CAST(coalesce(ac.n, st.n) AS INTEGER) AS n_groups, ac.n IS NOT NULL AS validated
FROM yoy JOIN st USING (country) LEFT JOIN ac USING (country) WHERE yoy > 10 AND year <= 1998""", "spending", "groups", "attribution")
def military_buildup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return rules.military_buildup(t("spending"), t("groups"), t("attribution"), AS_OF).withColumn("yoy", F.round("yoy", 4))


@query("arms_escalation", f""", b AS (SELECT recipient_country AS country, min(date) AS ref, arg_max(tiv, struct_pack(t := tiv, i := transfer_id)) AS largest FROM t_transfers WHERE date >= {day(8760)} AND date <= {T0} GROUP BY 1),
n AS (SELECT b.*, neighbour, least(b.country, neighbour) AS x, greatest(b.country, neighbour) AS z FROM b JOIN t_neighbours USING (country)),
e AS (SELECT least(source_country, target_country) AS x, greatest(source_country, target_country) AS z, date FROM t_events WHERE goldstein_scale < -3),
c AS (SELECT country, neighbour, ref, largest, count(*) FILTER (e.date <= ref) AS before, count(*) FILTER (e.date >= ref) AS after FROM n JOIN e USING (x, z)
  WHERE e.date >= ref - INTERVAL '2160' HOUR AND e.date <= ref + INTERVAL '2160' HOUR GROUP BY 1, 2, 3, 4),
p AS (SELECT *, CASE WHEN before = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * (after - before) / before END AS change FROM c)
SELECT {sid("'arms_transfer_escalation'", 'country', 'neighbour', "'1998-07-01'")} AS correlation_id, 'arms_transfer_escalation' AS rule_name, CASE WHEN change > 100 THEN 'critical' ELSE 'high' END AS severity,
  country || '||' || neighbour AS countries, before, after, round(change, 4) AS change, largest AS largest_tiv FROM p WHERE change >= 50""", "transfers", "neighbours", "events")
def arms_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return rules.arms_escalation(t("transfers"), t("neighbours"), t("events"), AS_OF).withColumn("change", F.round("change", 4))


@query("price_shift", f""", c AS (SELECT *, round(price - lag(price) OVER (PARTITION BY case_id ORDER BY ts, event_id), 4) AS delta FROM t_prices)
SELECT {sid("'prediction_market_shift'", 'case_id', 'event_id')} AS correlation_id, 'prediction_market_shift' AS rule_name, CASE WHEN abs(delta) >= 0.2 THEN 'high' ELSE 'medium' END AS severity,
  '' AS countries, strftime(ts, '%Y-%m-%d') AS day, case_id, event_id, delta, CASE WHEN delta > 0 THEN 'rising' ELSE 'falling' END AS trend FROM c WHERE abs(delta) >= 0.1""", "prices")
def price_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.price_shift(table(spark, sf_dir, "prices"))


MARKET_AS_OF = "2024-01-31 00:00:00"
MOVES = """, k AS (SELECT case_id, max(struct_pack(ts := ts, e := event_id, p := price)) AS now,
  max(struct_pack(ts := ts, e := event_id, p := price)) FILTER (ts <= TIMESTAMP '2024-01-30 00:00:00') AS d1, max(struct_pack(ts := ts, e := event_id, p := price)) FILTER (ts <= TIMESTAMP '2024-01-24 00:00:00') AS d7
  FROM t_prices WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
moves AS (SELECT case_id, now.ts AS seen, round(now.p, 4) AS price, round(now.p - d1.p, 4) AS change_24h, round(now.p - d7.p, 4) AS change_7d FROM k)
"""


@query("case_changes", MOVES + "SELECT case_id, strftime(seen, '%Y-%m-%d') AS seen, price, change_24h, change_7d FROM moves", "prices")
def case_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.case_changes(table(spark, sf_dir, "prices"), MARKET_AS_OF).withColumn("seen", F.date_format("at", "yyyy-MM-dd")).drop("at").withColumn("price", F.round("price", 4))


# the price history is of 2024, the events of the nineties: cases are shifted to the events' time by whole days
@query("prediction_event_match", MOVES + f""", v AS (SELECT case_id, seen - INTERVAL '9345' DAY AS seen, CASE WHEN abs(coalesce(change_24h, 0)) > abs(coalesce(change_7d, 0)) THEN change_24h ELSE change_7d END AS change,
  'NATION_' || CAST(case_id % 25 AS VARCHAR) AS country FROM moves), m AS (SELECT * FROM v WHERE abs(change) > 0.1 AND seen >= {day(168)} AND seen <= {T0}),
x AS (SELECT source_country AS country, date, event_id, goldstein_scale FROM t_events WHERE abs(goldstein_scale) > 7 AND date >= {day(72)} AND date <= {T0}
  UNION ALL SELECT target_country, date, event_id, goldstein_scale FROM t_events WHERE abs(goldstein_scale) > 7 AND date >= {day(72)} AND date <= {T0} AND target_country <> source_country),
j AS (SELECT DISTINCT ON (case_id, event_id) m.case_id, m.seen, change, event_id, goldstein_scale, date FROM m JOIN x USING (country) ORDER BY case_id, event_id, goldstein_scale, date),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY goldstein_scale, date, event_id) AS rn FROM j),
g AS (SELECT case_id, seen, change, count(*) AS n_events, arg_min(event_id, struct_pack(g := goldstein_scale, d := date, e := event_id)) AS w, arg_min(date, struct_pack(g := goldstein_scale, d := date, e := event_id)) AS wd FROM r WHERE rn <= 10 GROUP BY 1, 2, 3)
SELECT {sid("'prediction_event_match'", 'case_id', "'1998-07-01'")} AS correlation_id, 'prediction_event_match' AS rule_name, CASE WHEN seen < wd THEN 'high' ELSE 'medium' END AS severity, '' AS countries,
  case_id, change, n_events, w AS worst_event, CASE WHEN seen < wd THEN 'anticipation' ELSE 'reaction' END AS direction FROM g""", "prices", "events")
def prediction_event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = rules.case_changes(table(spark, sf_dir, "prices"), MARKET_AS_OF)
    cases = moves.withColumn("at", F.col("at") - F.make_dt_interval(days=F.lit(9345)))
    cases = cases.withColumn("countries", F.array(F.concat(F.lit("NATION_"), (F.col("case_id") % 25).cast("string"))))
    return rules.prediction_event_match(cases, table(spark, sf_dir, "events"), AS_OF)


def outage_apt_sql(hours: int, targeting: str = "SELECT nb.neighbour AS country, a.name FROM t_neighbours nb JOIN t_attribution a ON a.country = nb.country") -> str:
    return recent(30) + f""", ac AS (SELECT country, count(DISTINCT name) AS n FROM active GROUP BY 1), st AS (SELECT country, least(3, count(DISTINCT name)) AS n FROM t_attribution GROUP BY 1),
tr AS (SELECT country, least(5, count(DISTINCT name)) AS n FROM t_attribution WHERE lower(name) IN (SELECT lower(name) FROM t_groups) GROUP BY 1),
tg AS (SELECT country, least(5, count(DISTINCT name)) AS n FROM ({targeting}) GROUP BY 1),
j AS (SELECT o.*, coalesce(ac.n, tr.n, st.n, 0) AS n_off, coalesce(tg.n, 0) AS n_tgt FROM t_outages o LEFT JOIN ac USING (country) LEFT JOIN tr USING (country) LEFT JOIN st USING (country) LEFT JOIN tg USING (country) WHERE start_time >= {day(hours)} AND start_time <= {T0})
SELECT {sid("'outage_apt_activity'", 'country', 'outage_id')} AS correlation_id, 'outage_apt_activity' AS rule_name, CASE WHEN scope = 'national' AND n_off > 0 THEN 'critical' ELSE 'high' END AS severity,
  country AS countries, strftime(start_time, '%Y-%m-%d') AS day, outage_id, CAST(n_off AS INTEGER) AS n_offensive, n_tgt AS n_targeting FROM j WHERE n_off > 0 OR n_tgt > 0"""


@query("outage_apt", outage_apt_sql(168), "outages", "groups", "attribution", "neighbours")
def outage_apt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    aimed = t("neighbours").join(t("attribution"), "country").select(F.col("neighbour").alias("country"), "name")
    return rules.outage_apt(t("outages"), t("groups"), t("attribution"), aimed, AS_OF, hours=168)


TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z]+')), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in scalars.STOP_WORDS) + "))"
# questions that share a word, then sets of countries, not rows, are compared
MATCH = f""", qa AS (SELECT DISTINCT question, {TOKENS.format('question')} AS tk FROM t_cases), qb AS (SELECT DISTINCT question, {TOKENS.format('question')} AS tk FROM t_predictions),
wa AS (SELECT question, len(tk) AS n, unnest(tk) AS w FROM qa), wb AS (SELECT question, len(tk) AS n, unnest(tk) AS w FROM qb),
sm AS (SELECT wa.question AS qa, wb.question AS qb, CAST(count(*) AS DOUBLE) / (wa.n + wb.n - count(*)) AS sim FROM wa JOIN wb ON wa.w = wb.w GROUP BY wa.question, wb.question, wa.n, wb.n),
ka AS (SELECT DISTINCT question, countries FROM t_cases), kb AS (SELECT *, row_number() OVER (PARTITION BY question, countries ORDER BY market_id) AS nth FROM t_predictions),
m AS (SELECT ka.question, ka.countries, kb.market_id, round(least(1.0, sim + CASE WHEN list_has_any(string_split(ka.countries, '||'), string_split(kb.countries, '||')) THEN 0.15 ELSE 0.0 END), 4) AS score
  FROM sm JOIN ka ON ka.question = sm.qa JOIN kb ON kb.question = sm.qb AND nth <= 3 WHERE sim >= 0.2 - 1e-12),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question, countries ORDER BY score DESC, market_id) AS INTEGER) AS rank FROM m WHERE score >= 0.35),
best AS (SELECT c.case_id, r.market_id, r.score, r.rank, p.price, p.volume, p.platform FROM t_cases c JOIN r ON r.question = c.question AND r.countries = c.countries AND r.rank <= 3 JOIN t_predictions p ON p.market_id = r.market_id)
"""


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.withColumn("countries", F.split("countries", r"\|\|"))


@query("market_match", MATCH + "SELECT case_id, market_id, score, rank FROM best", "cases", "predictions")
def market_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.match_markets(_arrays(table(spark, sf_dir, "cases")), _arrays(table(spark, sf_dir, "predictions")))


CONSENSUS = MATCH + """, pr AS (SELECT case_id, price, 1.0::DOUBLE AS w FROM t_cases WHERE case_id IN (SELECT case_id FROM best)
  UNION ALL SELECT case_id, price, CASE WHEN platform = 'C' THEN 0.5 ELSE greatest(0.3, least(1.0, greatest(volume, 1.0) / 1000)) END FROM best),
cs AS (SELECT case_id, round(sum(price * w) / sum(w), 4) AS consensus, round(CASE WHEN count(*) >= 2 THEN stddev_pop(price) ELSE 0.0 END, 4) AS divergence, count(*) AS n_prices FROM pr WHERE price > 0 GROUP BY 1)
"""


@query("consensus", CONSENSUS + "SELECT * FROM cs", "cases", "predictions")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, markets = _arrays(table(spark, sf_dir, "cases")), _arrays(table(spark, sf_dir, "predictions"))
    return scores.consensus(cases, scores.match_markets(cases, markets), markets)


@query("divergence", CONSENSUS + f"SELECT {sid(chr(39) + 'prediction_divergence' + chr(39), 'case_id', chr(39) + '1998-07-01' + chr(39))} AS correlation_id, 'prediction_divergence' AS rule_name, CASE WHEN divergence > 0.2 THEN 'high' ELSE 'medium' END AS severity, '' AS countries, case_id, consensus, divergence FROM cs WHERE divergence > 0.15",
       "cases", "predictions")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.divergence_alerts(consensus(spark, sf_dir), AS_OF)
