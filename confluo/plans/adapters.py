"""The driver's tables as the library's tables. Each text is SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-07-01 00:00:00"
SMALL = 16 << 20  # bytes of a table of names that every executor may hold


def _hours(at: str) -> str:
    """Days between a date and AS_OF, taken as hours: seven years become about a hundred days, so that windows of days hold enough rows."""
    return f"CAST(abs((1998 - CAST(extract(year FROM {at}) AS INT)) * 365 + 182 - CAST(extract(doy FROM {at}) AS INT)) AS INT)"


def _ago(hours: str) -> str:
    return f"TIMESTAMP '1998-07-01 00:00:00' - {hours} * INTERVAL '1' HOUR"


def _late(power: int) -> str:
    """Hours up to 120 days, the more of them small the higher the power."""
    spread = "CAST((l_partkey * 7 + l_suppkey * 13 + l_orderkey) % 2880 AS INT)"
    return f"CAST(floor({' * '.join([f'({spread} / 2880.0E0)'] * (power - 1) + [spread])}) AS INT)"


def _question() -> str:
    """Five to twelve words by rule: one of five, one of 64 names, and three to ten that neighbouring parts share."""
    digits = lambda number: f"translate(CAST({number} AS STRING), '0123456789', 'bcdfghjklm')"
    near = [f"' ' || '{c * 2}' || {digits(f'CAST(floor(p_partkey / {n}) AS INT)')}" for c, n in zip("bcdefghijk", (3, 5, 9, 4, 6, 13, 17, 23, 29, 37))]
    more = [f"CASE WHEN p_size % 8 > {i} THEN {word} ELSE '' END" for i, word in enumerate(near[3:])]
    return " || ".join(["replace(p_name, ' ', '')", f"' aa' || {digits('p_size % 5')}", *near[:3], *more])


TABLES = {
    "events": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS event_id, l_shipdate AS date,
  cn.n_name AS source_country, sn.n_name AS target_country, (l_quantity - 25) * 0.4 AS goldstein_scale,
  l_tax * 100 - l_discount * 100 AS tone, CAST(l_quantity AS INT) * l_linenumber AS num_articles,
  1 + l_linenumber % 4 AS quad_class, c_mktsegment AS actor1_name, s_name AS actor2_name,
  CAST(10 + l_partkey % 11 AS STRING) || '0' AS event_code, l_extendedprice AS price, l_partkey AS part
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} sn ON s_nationkey = sn.n_nationkey""",
    "conflicts": """
SELECT o_orderkey AS event_id, o_orderdate AS date, n_name AS country,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Battles' WHEN '2' THEN 'Explosions/Remote violence'
    WHEN '3' THEN 'Violence against civilians' WHEN '4' THEN 'Protests' ELSE 'Riots' END AS event_type,
  CAST(floor(o_totalprice / 50000) AS BIGINT) AS fatalities
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "outages": """
SELECT o_orderkey AS outage_id, o_orderdate AS start_time, n_name AS country, 'country-level' AS outage_type,
  CASE WHEN o_totalprice > 200000 THEN 'national' ELSE 'regional' END AS scope,
  CASE o_orderstatus WHEN 'F' THEN 'total' WHEN 'O' THEN 'major' ELSE 'partial' END AS severity
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE o_orderpriority = '1-URGENT'""",
    "sanctions": """
SELECT o_orderkey AS entity_id, n_name AS country, c_mktsegment AS program, o_orderdate AS first_seen
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE o_orderpriority = '5-LOW'""",
    "groups": """
SELECT s_name AS name, n_name AS country, CAST(s_suppkey % 101 AS INT) AS confidence,
  TIMESTAMP '1998-07-01 00:00:00' - CAST(s_suppkey % 60 AS INT) * INTERVAL '1' DAY AS modified
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "attribution": "SELECT n_name AS country, s_name AS name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "indicators": """
SELECT n_name AS country, l_shipdate AS ingested_at
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE l_returnflag = 'R'""",
    "transfers": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS transfer_id,
  sn.n_name AS supplier_country, cn.n_name AS recipient_country, l_extendedprice AS tiv, l_shipdate AS date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} sn ON s_nationkey = sn.n_nationkey
WHERE l_quantity >= 48""",
    "neighbours": """
SELECT a.n_name AS country, b.n_name AS neighbour FROM {nation} a JOIN {nation} b
  ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
    "spending": """
SELECT n_name AS country, CAST(extract(year FROM o_orderdate) AS INT) AS year,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spending
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_name, CAST(extract(year FROM o_orderdate) AS INT)""",
    "cases": f"""
SELECT p_partkey AS case_id, {_question()} AS question, p_type || '||' || p_brand AS countries, p_type AS country, p_size / 50.0E0 AS price, p_retailprice AS volume,
  CASE WHEN p_size % 5 = 0 THEN 'closed' ELSE 'active' END AS status
FROM {{part}}""",
    "predictions": f"""
SELECT p_partkey AS market_id, {_question()} AS question, p_type || '||' || p_brand AS countries, p_size / 50.0E0 AS price, p_retailprice AS volume,
  CASE WHEN p_partkey % 4 = 1 THEN 'B' ELSE 'C' END AS platform
FROM {{part}}""",
    "prices": "SELECT user_id AS case_id, event_id, ts, value / 500 AS price, 10 + CAST(event_id % 97 AS BIGINT) AS volume FROM {events}",
    "activity": "SELECT event_id, ts, user_id, event_type, value FROM {events}",
    "articles": "SELECT doc_id, split_part(text, chr(10), 1) AS title, text, source, lang, TIMESTAMP '1998-07-01 00:00:00' - CAST(doc_id * 7 % 720 AS INT) * INTERVAL '1' HOUR AS date FROM {documents}",
    "nations": "SELECT n_nationkey, n_name, n_regionkey, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "parts": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {part}",
}


# the same rows in condensed time, dense enough for the rules' own thresholds; half of all pairs turn hostile at the end
TABLES |= {
    "live_events": f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS event_id, {_ago(_hours("l_shipdate"))} AS date,
  cn.n_name AS source_country, sn.n_name AS target_country, (l_quantity - 25) * 0.4 AS goldstein_scale,
  l_tax * 100 - l_discount * 100 - CASE WHEN {_hours("l_shipdate")} < 96 AND (cn.n_nationkey + sn.n_nationkey) % 2 = 0 THEN 40 ELSE 0 END AS tone,
  CAST(l_quantity AS INT) * l_linenumber AS num_articles, cn.n_nationkey * 1.5E0 - 6 AS lat, sn.n_nationkey * 2.0E0 - 20 AS lon
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
  JOIN {{nation}} cn ON c_nationkey = cn.n_nationkey JOIN {{supplier}} ON l_suppkey = s_suppkey
  JOIN {{nation}} sn ON s_nationkey = sn.n_nationkey""",
    "live_conflicts": TABLES["conflicts"].replace("o_orderdate AS date", f"{_ago(_hours('o_orderdate'))} AS date"),
    "live_outages": TABLES["outages"].replace("o_orderdate AS start_time", f"{_ago(_hours('o_orderdate'))} AS start_time"),
    "live_sanctions": TABLES["sanctions"].replace("o_orderdate AS first_seen", f"{_ago(_hours('o_orderdate'))} AS first_seen"),
    "live_transfers": TABLES["transfers"].replace("l_shipdate AS date", f"{_ago(_hours('l_shipdate'))} AS date"),
    # in three of four countries most rows lie at the end
    "live_indicators": f"""
SELECT n_name AS country, {_ago(f"CASE n_nationkey % 4 WHEN 0 THEN {_late(2)} WHEN 1 THEN {_late(3)} WHEN 2 THEN {_late(5)} ELSE {_late(1)} END")} AS ingested_at
FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey
WHERE l_returnflag = 'R'""",
    "profiles": """
SELECT s_name AS name, 'Active since ' || CAST(1990 + s_suppkey % 9 AS STRING) || ', aims at NATION_' || CAST(s_suppkey * 7 % 25 AS STRING) || ' and Nation_' || CAST(s_suppkey % 25 AS STRING) || '; not NATION_1x.' AS description
FROM {supplier}""",
    "reports": """
SELECT doc_id, coalesce(text, '') || ' NATION_' || CAST(doc_id % 25 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN ' and the Northern State, again Nation_' || CAST((doc_id + 1) % 25 AS STRING) ELSE '' END AS text,
  source, TIMESTAMP '1998-07-01 00:00:00' - CAST(doc_id % 720 AS INT) * INTERVAL '1' HOUR AS date
FROM {documents}""",
    "questions": """
SELECT p_partkey AS market_id, 'Will Nation_' || CAST(p_partkey % 25 AS STRING) || ' buy a ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' from NATION_' || CAST(p_partkey % 7 AS STRING) ELSE '' END || '?' AS question,
  p_type AS tag, CASE WHEN p_partkey % 4 = 0 THEN 'with the Trade Council' ELSE '' END AS description
FROM {part}""",
}


def live(name: str) -> str:
    return f"live_{name}" if f"live_{name}" in TABLES else name


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A given table; those that only name others' keys are sent to all tasks while they are small, so that the rows that
    name them stay where they are."""
    rows = spark.read.parquet(path)
    if name not in ("nation", "customer", "supplier"):
        return rows
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(rows) if size <= SMALL else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TABLES[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: _read(spark, f"{sf_dir}/{t}.parquet", t) for t in used})


def cte(*names: str, live_time: bool = False) -> str:
    """The WITH items of some tables for DuckDB."""
    return ",\n".join(f"t_{n} AS ({re.sub(r'{(\w+)}', r'\1', TABLES[live(n) if live_time else n])})" for n in names)
