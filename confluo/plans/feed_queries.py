"""Registered queries of feed readers, normalisers, stored tables and ingest streams.

Each writes the given tables in a feed's own format to the scratch folder, reads them back with the library's reader,
normalises them and gives what the SQL computes from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions import scalars
from confluo.plans import rules
from confluo.plans.adapters import AS_OF, cte, table
from confluo.plans.rule_queries import T0, sid
from confluo.sources import feeds, normalise, store
from confluo.sources.scratch import in_slices, scratch_path
from confluo.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAGE = 500  # rows of a landed page


def query(name: str, sql: str, *tables: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = f"WITH {cte(*tables)}\n{sql}"
        return f

    return register


def pages(rows: DataFrame, key: str, item: Column, name: str, wrap) -> str:
    """A folder of JSON documents, each with the items of PAGE keys; wrap(items, page) is the document."""
    path = scratch_path(rows.sparkSession, name)
    paged = rows.select(F.floor(F.col(key) / PAGE).cast("int").alias("page"), item.alias("item"))
    listed = paged.groupBy("page").agg(F.collect_list("item").alias("items"))
    listed.select("page", F.to_json(wrap(F.col("items"), F.col("page"))).alias("value")).repartition("page").write.partitionBy("page").text(path)
    return path


def fields(**columns: Column | str) -> Column:
    return F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


# --- events, graph and article feeds --------------------------------------------------------------------------------------

SEVERITY = """CASE WHEN pts >= 6 THEN 'critical' WHEN pts >= 4 THEN 'high' WHEN pts >= 2 THEN 'medium' ELSE 'low' END"""
POINTS = """CASE WHEN g <= -9 THEN 4 WHEN g <= -7 THEN 3 WHEN g <= -5 THEN 2 WHEN g <= -2 THEN 1 ELSE 0 END
  + CASE WHEN n >= 100 THEN 2 WHEN n >= 50 THEN 1.5 WHEN n >= 20 THEN 1 WHEN n >= 5 THEN 0.5 ELSE 0 END
  + CASE WHEN t <= -8 THEN 2 WHEN t <= -5 THEN 1.5 WHEN t <= -3 THEN 1 WHEN t <= -1 THEN 0.5 ELSE 0 END AS pts"""


# the library's own id where the export has none
EVENT_ID = f"""CASE WHEN part % 4 = 0 THEN {sid("CASE WHEN part % 3 = 0 THEN strftime(date, '%Y%m%d%H%M%S') ELSE strftime(date, '%Y%m%d') END", "'u/' || event_id", "source_country", "target_country")} ELSE event_id END"""


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines as an export has them, with stray quotes, and for every tenth row a line that is cut off."""
    values = dict.fromkeys(feeds.EVENT_COLUMNS, F.lit("")) | {
        "GlobalEventID": F.when(F.col("part") % 4 == 0, "").otherwise(F.col("event_id")), "DATEADDED": F.when(F.col("part") % 3 == 0, F.date_format("date", "yyyyMMddHHmmss")).otherwise(""),
        "Day": F.date_format("date", "yyyyMMdd"), "Actor1Name": F.concat(F.lit('"'), "actor1_name"), "Actor2Name": F.col("actor2_name"),
        "Actor1CountryCode": F.lower("source_country"), "Actor2CountryCode": F.col("target_country"), "EventCode": F.col("event_code"), "QuadClass": F.col("quad_class").cast("string"),
        "GoldsteinScale": F.round("goldstein_scale", 2).cast("string"), "NumArticles": F.col("num_articles").cast("string"), "AvgTone": F.round("tone", 2).cast("string"), "SOURCEURL": F.concat(F.lit("u/"), "event_id"),
    }
    whole = F.concat_ws("\t", *[F.coalesce(values[c], F.lit("")) for c in feeds.EVENT_COLUMNS])
    return table(spark, sf_dir, "events").select("date", F.explode(F.when(F.col("part") % 10 == 0, F.array(whole, F.lit('cut "off\tline'))).otherwise(F.array(whole))).alias("value"))


@query("feed_events", f""", e AS (SELECT *, {EVENT_ID} AS id,
  round(goldstein_scale, 2) AS g, CASE WHEN num_articles = 0 THEN 1 ELSE num_articles END AS n, round(tone, 2) AS t FROM t_events), p AS (SELECT *, {POINTS} FROM e)
SELECT id AS event_id, strftime(date, '%Y-%m-%d') AS day, CASE WHEN ns.n_nationkey < 20 THEN 'LAND ' || CAST(ns.n_nationkey AS VARCHAR) ELSE source_country END AS source_country, target_country, event_code,
  g AS goldstein_scale, t AS tone, CAST(n AS INTEGER) AS num_articles, CAST(quad_class AS INTEGER) AS quad_class, '"' || actor1_name AS actor1_name, {SEVERITY} AS severity
FROM p JOIN t_nations ns ON ns.n_name = source_country""", "events", "nations")
def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event export -> events, with countries named by a table that knows only some."""
    path = scratch_path(spark, "feed-events")
    _event_lines(spark, sf_dir).select("value").write.text(path)
    names = table(spark, sf_dir, "nations").where("n_nationkey < 20").select(F.col("n_name").alias("code"), F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("name"))
    rows = normalise.with_country_names(normalise.events(feeds.event_export(spark, path), AS_OF), ["source_country"], names)
    return rows.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "source_country", "target_country", "event_code", "goldstein_scale", "tone", "num_articles", "quad_class", "actor1_name", "severity")


@query("feed_window", "SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS n FROM t_events WHERE date >= TIMESTAMP '1998-03-01' AND date < TIMESTAMP '1998-05-01' GROUP BY 1", "events")
def feed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the files of two months are read; each lies in a folder with its time."""
    path = scratch_path(spark, "feed-window")
    rows = table(spark, sf_dir, "events").select(F.date_format("date", "yyyyMM01000000").alias("stamp"), F.date_format("date", "yyyy-MM-dd").alias("value"))
    rows.repartition("stamp").write.partitionBy("stamp").text(path)
    files = feeds.files_since(spark.read.text(path), "1998-03-01 00:00:00", "1998-05-01 00:00:00")
    return files.groupBy(F.col("value").alias("day")).agg(F.count("*").alias("n"))


@query("feed_graph", """SELECT 'g' || CAST(p_partkey AS VARCHAR) AS gkg_id, p_type || ',' || p_brand AS themes, p_name AS place, round(p_size - 25.5, 4) AS tone, round(p_size / 4.0, 4) AS positive, 'a=' || CAST(p_size AS VARCHAR) || ',b=2' AS scores FROM t_parts""", "parts")
def feed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "feed-graph")
    text = lambda c: F.col(c).cast("string")
    values = dict.fromkeys(feeds.GRAPH_COLUMNS, F.lit("")) | {
        "GKGRECORDID": F.concat(F.lit("g"), text("p_partkey")), "DATE": F.lit("19980601"), "Themes": F.lit("OLD;"), "V2Themes": F.concat_ws(";", "p_type", F.lit(""), "p_brand", F.lit("")),
        "V2Locations": F.concat(F.lit("1#"), "p_name", F.lit("#XX#XX00#1.5#2.5#f;1#Nowhere#XX#XX00#0#0#f;short#x")), "V2Tone": F.concat((F.col("p_size") - 25.5).cast("string"), F.lit(","), (F.col("p_size") / 4.0).cast("string")),
        "GCAM": F.concat(F.lit("a:1,b:2,a:"), text("p_size"), F.lit(",bad")),
    }
    table(spark, sf_dir, "parts").select(F.concat_ws("\t", *[values[c] for c in feeds.GRAPH_COLUMNS])).write.text(path)
    rows = normalise.graph(feeds.graph_export(spark, path), AS_OF)
    scores = F.array_join(F.transform("scores", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ",")
    return rows.select("gkg_id", F.array_join("themes", ",").alias("themes"), F.array_join(F.transform("locations", lambda p: p["name"]), ",").alias("place"), F.round("tone.tone", 4).alias("tone"), F.round("tone.positive", 4).alias("positive"), scores.alias("scores"))


@query("feed_conflicts", "SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(date, '%Y-%m-%d') AS day, country, event_type, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE fatalities END AS INTEGER) AS fatalities, event_id % 3 = 0 AS placed FROM t_conflicts WHERE floor(event_id / 500) % 5 <> 4", "conflicts")
def feed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conflict service; every fifth one failed and gives no rows."""
    item = fields(
        data_id=F.when(F.col("event_id") % 2 == 0, F.col("event_id")), event_id_cnty=F.col("event_id").cast("string"), event_date=F.date_format("date", "yyyy-MM-dd"), event_type="event_type", country="concat(' ', lower(country))",
        fatalities=F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("fatalities").cast("string")), latitude=F.when(F.col("event_id") % 3 == 0, "1.5").otherwise("?"), longitude=F.lit("2.5"),
    )
    path = pages(table(spark, sf_dir, "conflicts"), "event_id", item, "feed-conflicts", lambda items, page: fields(success=page % 5 != 4, data=items))
    rows = normalise.conflicts(feeds.conflict_payload(spark, path))
    return rows.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "country", "event_type", "fatalities", F.col("geo").isNotNull().alias("placed"))


@query("feed_articles", f""", e AS (SELECT *, -1.0 * fatalities AS g, CASE WHEN fatalities = 0 THEN 1 ELSE fatalities END AS n, -0.5 * fatalities AS t FROM t_conflicts), p AS (SELECT *, {POINTS} FROM e)
SELECT {sid("strftime(date, '%Y%m%dT%H%M%SZ')", "'http://x/' || CAST(event_id AS VARCHAR)", "country", "'NEUTRAL'")} AS event_id, strftime(date, '%Y-%m-%d') AS day, country AS source_country, 'NEUTRAL' AS target_country, '190' AS event_code, CAST(n AS INTEGER) AS num_articles, round(t, 4) AS tone, {SEVERITY} AS severity FROM p""", "conflicts")
def feed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article lists, whose events stand in a nested field."""
    event = fields(eventCode=F.lit("190"), goldsteinScale="-1.0D * fatalities", numArticles="CAST(fatalities AS INT)", actor1CountryCode="lower(country)", actor2CountryCode=F.lit("neutral"))
    item = fields(url="concat('http://x/', event_id)", title="event_type", seendate=F.date_format("date", "yyyyMMdd'T'HHmmss'Z'"), sourcecountry=F.lit("Elsewhere"), tone="-0.5D * fatalities", cameo=event)
    path = pages(table(spark, sf_dir, "conflicts"), "event_id", item, "feed-articles", lambda items, page: fields(articles=items))
    rows = normalise.events(feeds.article_list(spark, path), AS_OF)
    return rows.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "source_country", "target_country", "event_code", "num_articles", F.round("tone", 4).alias("tone"), "severity")


@query("feed_places", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey * 1.5 END AS lat, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey * 2.0 END AS lon FROM t_nations", "nations")
def feed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.when(F.col("n_nationkey") % 5 != 0, fields(coordinates="array(n_regionkey * 2.0D, n_nationkey * 1.5D)"))
    item = fields(properties=F.create_map(F.lit("name"), F.col("n_name")), geometry=point)
    rows = feeds.geo_features(spark, pages(table(spark, sf_dir, "nations"), "n_nationkey", item, "feed-places", lambda items, page: fields(features=items)))
    return rows.select(F.col("properties")["name"].alias("name"), "geo.lat", "geo.lon")


@query("feed_news", ", k AS (SELECT doc_id, source, length(text) AS n, list_filter([" + ", ".join(f"'{w}'" for w in scalars.ARTICLE_KEYWORDS) + "], lambda x: regexp_matches(lower('Report ' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN ' of war' ELSE ' of a warm coup' END || ' ' || coalesce(text, '')), '\\b' || x || '\\b')) AS m, text FROM t_articles) SELECT doc_id, source, array_to_string(m, ',') AS keywords, least(length(coalesce(text, '')), 500) AS n_summary FROM k WHERE len(m) > 0", "articles")
def feed_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "feed-news")
    title = F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, " of war").otherwise(" of a warm coup"))
    table(spark, sf_dir, "articles").select(title.alias("title"), F.col("text").alias("content"), F.concat(F.lit("http://n/"), F.col("doc_id").cast("string")).alias("link"), "source", F.lit("1998-06-01T00:00:00Z").alias("isoDate")).write.json(path)
    rows = normalise.articles(feeds.feed_articles(spark, path))
    return rows.select(F.substring("url", 10, 20).cast("long").alias("doc_id"), "source", F.array_join("keywords", ",").alias("keywords"), F.length("summary").cast("long").alias("n_summary"))


# --- sanctions, threats, outages ------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """The three lists as XML, written and read."""
    parts = table(spark, sf_dir, "parts")
    path = scratch_path(spark, "feed-lists")
    write = lambda rows, tag: rows.write.format("xml").option("rowTag", tag).option("rootTag", "list").save(f"{path}/{tag}")
    uid, odd = F.col("p_partkey").cast("string").alias("uid"), F.col("p_partkey") % 2 == 1
    write(parts.select(
        uid, F.when(F.col("p_partkey") % 3 == 0, "Individual").when(F.col("p_partkey") % 3 == 1, "Entity").otherwise("Vessel").alias("sdnType"), F.when(odd, F.col("p_name")).alias("lastName"),
        fields(aka=F.array(fields(firstName="p_brand", lastName="p_type"))).alias("akaList"), fields(program=F.array("p_type", F.lit("ALL"))).alias("programList"),
        fields(address=F.array(fields(country=F.lit("")), fields(country=F.lower("p_brand")))).alias("addressList"),
        fields(dateOfBirthItem=F.array(fields(dateOfBirth=F.lit("circa")), fields(dateOfBirth=F.concat(F.lit("3 Feb "), (F.col("p_size") + 1920).cast("string"))))).alias("dateOfBirthList"),
    ), "sdnEntry")
    write(parts.select(
        F.concat(F.lit("EU-"), "p_partkey").alias("_euReferenceNumber"), F.array(fields(_wholeName=F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")), _lastName=F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_brand")))).alias("nameAlias"),
        F.when(odd, "a natural person").otherwise("enterprise").alias("subjectType"), F.array(F.lower("p_brand")).alias("countryDescription"), F.array("p_type").alias("programme"),
    ), "sanctionEntity")
    write(parts.where(odd).select(F.col("p_name").alias("FIRST_NAME"), F.col("p_brand").alias("SECOND_NAME"), uid.alias("DATAID"), fields(VALUE=F.array(F.lower("p_type"))).alias("NATIONALITY"), F.array(fields(ALIAS_NAME="p_type")).alias("INDIVIDUAL_ALIAS"), F.lit("UN").alias("UN_LIST_TYPE")), "INDIVIDUAL")
    write(parts.where(~odd).select(F.col("p_name").alias("FIRST_NAME"), uid.alias("DATAID"), F.array(fields(ALIAS_NAME="p_type")).alias("ENTITY_ALIAS"), F.lit("UN").alias("UN_LIST_TYPE")), "ENTITY")
    people, bodies = feeds.un_lists(spark, f"{path}/INDIVIDUAL")[0], feeds.un_lists(spark, f"{path}/ENTITY")[1]
    return feeds.ofac_list(spark, f"{path}/sdnEntry"), feeds.eu_list(spark, f"{path}/sanctionEntity"), (people, bodies)


def _uid(kind: str, value: str) -> str:
    return f"substring(sha256('{kind}:' || {value}), 1, 24)"


LISTS = f"""SELECT {_uid('OFAC', 'CAST(p_partkey AS VARCHAR)')} AS entity_id, 'OFAC' AS list, CASE WHEN p_partkey % 2 = 1 THEN p_name ELSE 'SDN-' || CAST(p_partkey AS VARCHAR) END AS name, p_brand || ' ' || p_type AS aliases,
  CASE p_partkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'vessel' END AS type, upper(p_brand) AS country, p_type || ',ALL' AS programs, CAST(p_size + 1920 AS VARCHAR) || '-02-03' AS born FROM t_parts
UNION ALL SELECT {_uid('EU', "'EU-' || CAST(p_partkey AS VARCHAR)")}, 'EU', CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END, '', CASE WHEN p_partkey % 2 = 1 THEN 'person' ELSE 'organization' END, upper(p_brand), p_type, NULL FROM t_parts WHERE p_partkey % 10 <> 0
UNION ALL SELECT {_uid('UN', 'CAST(p_partkey AS VARCHAR)')}, 'UN', CASE WHEN p_partkey % 2 = 1 THEN p_name || ' ' || p_brand ELSE p_name END, p_type, CASE WHEN p_partkey % 2 = 1 THEN 'person' ELSE 'organization' END, CASE WHEN p_partkey % 2 = 1 THEN upper(p_type) ELSE '' END, 'UN', NULL FROM t_parts"""


@query("feed_sanctions", LISTS, "parts")
def feed_sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of sanctions in XML as one table."""
    rows = normalise.sanctions(*_lists(spark, sf_dir), AS_OF)
    return rows.select("entity_id", "list", "name", F.array_join("aliases", ",").alias("aliases"), "type", "country", F.array_join("programs", ",").alias("programs"), F.date_format("birth_date", "yyyy-MM-dd").alias("born"))


@query("sanctions_first_seen", f"SELECT country, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (list = 'UN') AS BIGINT) AS recent FROM ({LISTS}) GROUP BY 1", "parts")
def sanctions_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one stored table: what the second run brings again keeps the time of the first, what is new has its own."""
    ofac, eu, un = _lists(spark, sf_dir)
    path = scratch_path(spark, "sanctions")
    whole = normalise.sanctions(ofac, eu, un, AS_OF)
    earlier = whole.where("list <> 'UN'").withColumn("first_seen", F.lit("1998-03-01").cast("timestamp_ntz"))
    for run in (earlier, whole, whole):
        store.upsert_table(run, path, ["entity_id"], ["list"], at="first_seen", keep=("first_seen",))
    recent = F.count_if(F.col("first_seen") == F.lit(AS_OF).cast("timestamp_ntz")).alias("recent")
    return store.read_table(spark, path, whole.schema).groupBy("country").agg(F.count("*").alias("n"), recent)


@query("feed_threats", """SELECT 'g' || CAST(row_number() OVER (ORDER BY name) AS VARCHAR) AS stix_id, 'group' AS kind, name, 'apt,' || country AS labels, country, CAST(CASE WHEN confidence % 2 = 0 THEN confidence ELSE 0 END AS INTEGER) AS confidence,
  strftime(modified, '%Y-%m-%d') AS last_seen, CASE WHEN confidence % 3 = 0 THEN 'delivery' ELSE 'chain' END AS phases FROM t_groups
UNION ALL SELECT 'c' || CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 'campaign', 'Campaign ' || name, 'x', NULL, CAST(0 AS INTEGER), strftime(modified, '%Y-%m-%d'), '' FROM t_groups""", "groups")
def feed_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat objects as a graph query answers; labels come as a graph or as a flat list."""
    groups = table(spark, sf_dir, "groups")
    # names end in the supplier's number, so their order is that of the numbers
    rows = groups.withColumn("n", F.regexp_extract("name", r"(\d+)$", 1).cast("long"))
    label = lambda x: fields(node=fields(value=x))
    node = fields(
        id=F.concat(F.lit("g"), F.col("n") + 1), name="name", objectLabel=fields(edges=F.array(label(F.lit("apt")), label(F.col("country")))), countryOfOrigin=fields(edges=F.array(fields(node=fields(name=F.lower("country"))))),
        confidence=F.when(F.col("confidence") % 2 == 0, F.col("confidence")), created=F.lit("1990-01-01T00:00:00Z"), modified=F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        killChainPhases=F.when(F.col("confidence") % 3 == 0, F.array(fields(kill_chain_name=F.lit("chain"), phase_name=F.lit("delivery")))).otherwise(F.array(fields(kill_chain_name=F.lit("chain"), phase_name=F.lit(None).cast("string")))),
    )
    campaign = fields(id=F.concat(F.lit("c"), F.col("n") + 1), name=F.concat(F.lit("Campaign "), "name"), objectLabel=F.array(F.lit("x")), created=F.lit("1990-01-01T00:00:00Z"), modified=F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    both = fields(set=fields(node=node), campaign=fields(node=campaign))
    path = pages(rows, "n", both, "feed-threats", lambda items, page: fields(data=fields(intrusionSets=fields(edges=F.transform(items, lambda x: x["set"])), campaigns=fields(edges=F.transform(items, lambda x: x["campaign"])))))
    found = normalise.threats(feeds.threat_objects(spark, path))
    return found.select("stix_id", "kind", "name", F.array_join("labels", ",").alias("labels"), "country", "confidence", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), F.array_join("kill_chain_phases", ",").alias("phases"))


@query("feed_outages", f""", o AS (SELECT *, unnest(CASE outage_id % 4 WHEN 0 THEN [country] WHEN 1 THEN [country, 'NATION_99'] WHEN 2 THEN [''] ELSE [country] END) AS place FROM t_outages WHERE floor(outage_id / 500) % 3 <> 2)
SELECT {sid("outage_id", "place", "CASE WHEN outage_id % 4 = 3 THEN '64500' ELSE '' END")} AS outage_id, place AS country, CASE outage_id % 4 WHEN 0 THEN 'country-level' WHEN 1 THEN 'region' WHEN 2 THEN 'nationwide' ELSE 'asn-level' END AS outage_type,
  CASE outage_id % 4 WHEN 0 THEN 'national' WHEN 1 THEN 'national' WHEN 2 THEN 'regional' ELSE 'local' END AS scope,
  CASE WHEN severity = 'total' THEN 'total' WHEN outage_id % 2 = 0 THEN 'major' ELSE 'partial' END AS severity, CASE WHEN outage_id % 5 = 0 THEN NULL ELSE 2.5 END AS hours, CASE WHEN outage_id % 5 = 0 THEN 'ongoing' ELSE 'resolved' END AS status FROM o""", "outages")
def feed_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outage notes: one row a place, else a network, else the note; grades are read off the description where none is given."""
    kind = F.col("outage_id") % 4
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = fields(
        id=F.col("outage_id").cast("string"), startDate=F.when(kind != 0, stamp("start_time")), eventDate=stamp("start_time"), endDate=F.when(F.col("outage_id") % 5 != 0, stamp(F.col("start_time") + F.expr("INTERVAL '150' MINUTE"))),
        locations=F.when(kind == 0, F.array("country")).when(kind == 1, F.array(F.to_json(fields(code=F.lit("XX"), name=F.lower("country"))), F.lit("nation_99"))),
        asns=F.when(kind == 3, F.array(F.to_json(fields(asn=F.lit(64500), country=F.lower("country"))))), type=F.lit("nationwide"), severity=F.when(F.col("severity") == "total", "Total"),
        description=F.when(F.col("outage_id") % 2 == 0, "A Major cut").otherwise("some trouble"),
    )
    path = pages(table(spark, sf_dir, "outages"), "outage_id", item, "feed-outages", lambda items, page: fields(success=page % 3 != 2, result=fields(annotations=items)))
    return normalise.outages(feeds.outage_annotations(spark, path)).select("outage_id", "country", "outage_type", "scope", "severity", "hours", "status")


# --- arms, spending, markets ----------------------------------------------------------------------------------------------


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


@query("feed_transfers", f"SELECT {sid('CAST(extract(year FROM date) AS INT)', 'supplier_country', 'recipient_country', 'transfer_id', chr(39) + '3' + chr(39))} AS id, CAST(extract(year FROM date) AS INT) AS year, supplier_country, recipient_country, 3 AS quantity, round(tiv, 2) AS tiv, CAST(extract(year FROM date) AS VARCHAR) || '-06-15' AS day FROM t_transfers WHERE tiv < 90000", "transfers")
def feed_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register of arms transfers in CSV; rows without a recipient go."""
    path = scratch_path(spark, "feed-transfers")
    rows = table(spark, sf_dir, "transfers")
    _csv(rows.select(F.year("date").alias("year"), F.lower("supplier_country").alias("supplier"), F.when(F.col("tiv") < 90000, F.concat(F.lit(" "), "recipient_country")).alias("recipient"), F.lit("ships").alias("weapon_type"), F.col("transfer_id").alias("designation"), F.lit(3).alias("number_ordered"), F.round("tiv", 2).alias("tiv_delivery_values")), path)
    found = normalise.transfers(feeds.csv_table(spark, path, "*.csv"))
    return found.select(F.col("transfer_id").alias("id"), "year", "supplier_country", "recipient_country", "quantity", "tiv", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("feed_spending", ", r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY year DESC) AS rn FROM t_spending) SELECT country, year, round(spending / 1e6, 4) AS spending, CAST(1 + year % 7 AS DOUBLE) AS share, CASE WHEN year % 2 = 0 THEN 12.5 ELSE 0.0 END AS yoy FROM r WHERE rn = 1", "spending")
def feed_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Military spending in CSV: each country's latest share of its product."""
    from confluo.plans import panels

    path = scratch_path(spark, "feed-spending")
    rows = table(spark, sf_dir, "spending")
    _csv(rows.select("year", F.lower("country").alias("country"), F.round(F.col("spending") / 1e6, 4).alias("spending_usd_millions"), (1 + F.col("year") % 7).alias("spending_pct_gdp"), F.when(F.col("year") % 2 == 0, "12.5").otherwise("n.a.").alias("spending_change_yoy_pct")), path)
    return panels.latest_year(normalise.spending(feeds.csv_table(spark, path, "*.csv"))).select("country", "year", "spending", "share", "yoy")


@query("feed_markets_a", """SELECT 'polymarket_' || substring(sha256('m' || CAST(p_partkey AS VARCHAR)), 1, 16) AS case_id, p_name || ' of Nation_' || CAST(p_partkey % 25 AS VARCHAR) AS question, round(p_size / 100.0, 4) AS yes_price, round(1 - p_size / 100.0, 4) AS no_price,
  CASE WHEN p_partkey % 5 = 0 THEN 'closed' ELSE 'active' END AS status, least(lower(p_type), p_brand) || ',' || greatest(lower(p_type), p_brand) AS keywords, 'NATION_' || CAST(p_partkey % 25 AS VARCHAR) AS countries FROM t_parts""", "parts")
def feed_markets_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets whose prices come as tokens, or as a list in a text; a market on two pages counts once."""
    yes, no = F.col("p_size") / 100.0, F.round(1 - F.col("p_size") / 100.0, 4)
    token = lambda side, price: fields(outcome=F.lit(side), price=price.cast("string"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), yes.cast("string"), F.lit('"]'))).otherwise(F.concat(F.lit('["'), yes.cast("string"), F.lit('", "'), no.cast("string"), F.lit('"]')))
    item = fields(
        condition_id=F.concat(F.lit("m"), F.col("p_partkey").cast("string")), question=F.concat("p_name", F.lit(" of Nation_"), (F.col("p_partkey") % 25).cast("string")), tags=F.array(F.lower("p_type"), F.col("p_brand")),
        tokens=F.when(F.col("p_partkey") % 2 == 0, F.array(token("Yes", yes), token("No", no))), outcomePrices=text, active=F.lit(True), closed=F.col("p_partkey") % 5 == 0,
    )
    parts = table(spark, sf_dir, "parts")
    path = pages(parts.union(parts), "p_partkey", item, "feed-markets-a", lambda items, page: items)
    rows = normalise.markets_a(feeds.market_pages(spark, path, feeds.MARKET_A), tuple(f"Nation_{i}" for i in range(25)))
    return rows.select("case_id", "question", "yes_price", "no_price", "status", F.array_join("keywords", ",").alias("keywords"), F.array_join("countries_involved", ",").alias("countries"))


@query("feed_markets_bc", """SELECT 'b' || CAST(p_partkey AS VARCHAR) AS market_id, 'B' AS platform, p_name AS question, round(p_size / 64.0, 4) AS price, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE CAST(7 AS DOUBLE) END AS volume, CASE WHEN p_size % 3 = 0 THEN 'resolved' ELSE 'active' END AS status, '1970-01-02' AS closes FROM t_parts
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'C', p_name, round(CASE p_partkey % 3 WHEN 0 THEN p_size / 64.0 WHEN 1 THEN p_size / 80.0 ELSE 0 END, 4), 0.0, CASE WHEN p_size % 3 = 0 THEN 'resolved' ELSE 'active' END, '1999-01-01' FROM t_parts""", "parts")
def feed_markets_bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of two other kinds."""
    parts, over = table(spark, sf_dir, "parts"), F.col("p_size") % 3 == 0
    b = fields(id=F.concat(F.lit("b"), F.col("p_partkey").cast("string")), question="p_name", probability="p_size / 64.0D", volume=F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")), totalLiquidity=F.lit(7.0), closeTime=F.lit(86_400_000), isResolved=over)
    q2 = F.when(F.col("p_partkey") % 3 == 0, fields(full=fields(q2="p_size / 64.0D")))
    centre = F.when(F.col("p_partkey") % 3 == 1, fields(recency_weighted=fields(latest=fields(centers="array(p_size / 80.0D)"))))
    c = fields(id="p_partkey", title="p_name", community_prediction=q2, aggregations=centre, close_time=F.lit("1999-01-01T00:00:00Z"), resolution=F.when(over, "yes"))
    read = lambda item, name, schema: feeds.market_pages(spark, pages(parts, "p_partkey", item, name, lambda items, page: items), schema)
    rows = normalise.markets_b(read(b, "feed-markets-b", feeds.MARKET_B)).unionByName(normalise.markets_c(read(c, "feed-markets-c", feeds.MARKET_C)))
    return rows.select("market_id", "platform", "question", "price", "volume", "status", F.date_format("closes", "yyyy-MM-dd").alias("closes"))


# --- stored tables ------------------------------------------------------------------------------------------------------------


@query("store_upsert", """, v AS (SELECT event_id, country, date, fatalities, 0 AS run FROM t_conflicts WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, country, date + INTERVAL '40' DAY, fatalities + 1, 1 FROM t_conflicts WHERE event_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id, country ORDER BY run DESC) AS rn FROM v)
SELECT event_id, country, CAST(fatalities AS BIGINT) AS fatalities, strftime(date, '%Y-%m') AS month FROM r WHERE rn = 1""", "conflicts")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created empty, filled, and upserted twice by two keys with rows whose month has changed."""
    rows = table(spark, sf_dir, "conflicts").select("event_id", "country", "date", "fatalities").withColumn("version", F.lit(0))
    path = scratch_path(spark, "store")
    schema = rows.withColumn("month", F.lit("")).schema
    missing = store.read_table(spark, path, schema)  # nothing has been written yet
    store.ensure_table(spark, path)
    store.upsert_table(rows.where("event_id % 3 <> 0").unionByName(missing.drop("month")), path, ["event_id", "country"], ["version"])
    later = rows.where("event_id % 2 = 0").withColumns({"date": F.col("date") + F.expr("INTERVAL '40' DAY"), "fatalities": F.col("fatalities") + 1, "version": F.lit(1)})
    for _ in range(2):
        store.upsert_table(later, path, ["event_id", "country"], ["version"])
    return store.read_table(spark, path, schema).select("event_id", "country", "fatalities", "month")


@query("high_water_mark", "SELECT country, count(*) AS n FROM t_conflicts WHERE date > (SELECT max(date) FROM t_conflicts WHERE date < TIMESTAMP '1998-03-01') GROUP BY 1", "conflicts")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is newer than the newest stored row."""
    rows = table(spark, sf_dir, "conflicts")
    mark = feeds.high_water_mark(rows.where("date < '1998-03-01'"), "date", "1970-01-01")
    return rows.where(F.col("date").cast("timestamp") > mark).groupBy("country").agg(F.count("*").alias("n"))


# --- ingest streams -----------------------------------------------------------------------------------------------------------


def _drain(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    jobs.drain(stream, scratch_path(spark, "offsets"), lambda batch, _: batch.write.mode("append").parquet(out), once=True)
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_ingest", f""", e AS (SELECT *, {EVENT_ID} AS id FROM t_events) SELECT id AS event_id, strftime(max(date), '%Y-%m-%d') AS day FROM e GROUP BY 1""", "events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files as a stream, upserted by id; a second stream over the same files changes nothing. The files are packed,
    as lines of 61 columns, most of them empty, would take more room than all else."""
    folder, path = scratch_path(spark, "landing"), scratch_path(spark, "ingested")
    lines = _event_lines(spark, sf_dir)
    lines.select("value").write.option("compression", "gzip").text(folder)
    for _ in range(2):
        jobs.ingest_events(spark, folder, path, scratch_path(spark, "offsets"), AS_OF)
    stored = spark.createDataFrame([], "event_id string, date timestamp_ntz").schema
    return store.read_table(spark, path, stored).select("event_id", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("stream_near", "SELECT o.outage_id, e.event_id, e.fatalities FROM t_live_outages o JOIN t_live_conflicts e ON o.country = e.country AND e.date BETWEEN o.start_time - INTERVAL '48' HOUR AND o.start_time + INTERVAL '48' HOUR", "live_outages", "live_conflicts")
def stream_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined within two days; their files arrive in order of time, one of each a batch."""
    cuts = ["1998-04-20", "1998-05-15", "1998-06-08"]
    streams = [jobs.parquet_stream(spark, in_slices(table(spark, sf_dir, name), at, cuts, name), at, per_trigger=1) for name, at in (("live_outages", "start_time"), ("live_conflicts", "date"))]
    return _drain(jobs.outages_near_events(*streams).select("o.outage_id", "e.event_id", "e.fatalities"), "near")


@query("stream_enriched", "SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICKED' WHEN 'view' THEN 'VIEWED' ELSE upper(event_type) END AS event_type FROM t_activity", "activity")
def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's codes replaced by a static table's names."""
    names = spark.sql("SELECT * FROM VALUES ('click', 'Clicked'), ('view', 'Viewed') AS t(code, name)")
    stream = jobs.parquet_stream(spark, f"{sf_dir}/events.parquet", "ts")
    return _drain(jobs.enriched(stream, names, "event_type").select("event_id", "event_type"), "enriched")


@query("stream_alerts", """, c AS (SELECT *, round(price - lag(price) OVER (PARTITION BY case_id ORDER BY ts, event_id), 4) AS delta FROM t_prices)
SELECT substring(sha256('prediction_market_shift:' || CAST(case_id AS VARCHAR) || ':' || CAST(event_id AS VARCHAR)), 1, 20) AS correlation_id, 'high' AS severity FROM c WHERE abs(delta) >= 0.2""", "prices")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations that arrive twice in two files: those worth an alert are stored once."""
    landed, path = scratch_path(spark, "correlations"), scratch_path(spark, "alerts")
    found = rules.price_shift(table(spark, sf_dir, "prices"))
    for _ in range(2):
        found.write.mode("append").parquet(landed)
    jobs.alert_stream(spark.readStream.schema(found.schema).parquet(landed), path, scratch_path(spark, "offsets"))
    return store.read_table(spark, path, found.select("correlation_id", "severity").schema)
