"""Readers of raw feed files: lazy DataFrames with declared schemas, from landed files in any store Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.operators.core import latest_per_key

# fixed values: the columns of an event export, in file order
EVENT_COLUMNS = (
    "GlobalEventID", "Day", "MonthYear", "Year", "FractionDate",
    "Actor1Code", "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode", "Actor1EthnicCode",
    "Actor1Religion1Code", "Actor1Religion2Code", "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Code", "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode", "Actor2EthnicCode",
    "Actor2Religion1Code", "Actor2Religion2Code", "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass",
    "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    "Actor1Geo_Type", "Actor1Geo_Fullname", "Actor1Geo_CountryCode", "Actor1Geo_ADM1Code", "Actor1Geo_ADM2Code",
    "Actor1Geo_Lat", "Actor1Geo_Long", "Actor1Geo_FeatureID",
    "Actor2Geo_Type", "Actor2Geo_Fullname", "Actor2Geo_CountryCode", "Actor2Geo_ADM1Code", "Actor2Geo_ADM2Code",
    "Actor2Geo_Lat", "Actor2Geo_Long", "Actor2Geo_FeatureID",
    "ActionGeo_Type", "ActionGeo_Fullname", "ActionGeo_CountryCode", "ActionGeo_ADM1Code", "ActionGeo_ADM2Code",
    "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_FeatureID",
    "DATEADDED", "SOURCEURL",
)

# fixed values: the columns of a knowledge-graph export, in file order
GRAPH_COLUMNS = (
    "GKGRECORDID", "DATE", "SourceCollectionIdentifier", "SourceCommonName", "DocumentIdentifier",
    "Counts", "V2Counts", "Themes", "V2Themes", "Locations", "V2Locations", "Persons", "V2Persons",
    "Organizations", "V2Organizations", "V2Tone", "Dates", "GCAM", "SharingImage", "RelatedImages",
    "SocialImageEmbeds", "SocialVideoEmbeds", "Quotations", "AllNames", "Amounts", "TranslationInfo", "Extras",
)


def split_lines(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(value) -> the columns of tab-separated lines by position; shorter lines go, further fields are ignored.

    There are no quotes in these files, so a stray quote cannot swallow the lines after it.
    """
    fields = lines.select(F.split("value", "\t", -1).alias("f")).where(F.size("f") >= len(columns))
    return fields.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def event_export(spark: SparkSession, path: str) -> DataFrame:
    return split_lines(spark.read.text(path), EVENT_COLUMNS)


def graph_export(spark: SparkSession, path: str) -> DataFrame:
    return split_lines(spark.read.text(path), GRAPH_COLUMNS)


def window_of(at: Column, minutes: int = 15) -> Column:
    """The start of the time window a file of that time belongs to."""
    return F.window(at, f"{minutes} minutes")["start"]


def files_since(files: DataFrame, since: str, until: str) -> DataFrame:
    """Rows of a read from files whose name, or whose folder's, carries a 14-digit time in [since, until). The condition is
    on the file's own metadata, so files of other times are not opened."""
    stamp = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{14})[^/]*(?:/[^/]*)?$", 1)
    digits = lambda at: F.date_format(F.lit(at).cast("timestamp_ntz"), "yyyyMMddHHmmss")
    return files.where((stamp != "") & (stamp >= digits(since)) & (stamp < digits(until))).withColumn("file_time", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))


def window_globs(spark: SparkSession, folder: str, since: str, until: str) -> list[str]:
    """Paths of the days that a time window [since, until) touches, of those there are: files or folders in `folder` whose
    names start with the day (yyyymmdd). A read of these lists no other day's folder; files_since cuts to the window."""
    from datetime import datetime, timedelta

    first, last = datetime.fromisoformat(since), datetime.fromisoformat(until) - timedelta(microseconds=1)
    days = [first.date() + timedelta(days=k) for k in range((last.date() - first.date()).days + 1)]
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    globs = [f"{folder.rstrip('/')}/{day:%Y%m%d}*" for day in days]
    return [g for g in globs if (found := files.globStatus(of(g))) is not None and len(found)]


def high_water_mark(target: DataFrame, at: str, fallback: str) -> Column:
    """The newest time of a table, from which the next read starts, as a value."""
    newest = target.agg(F.max(at).cast("timestamp").alias("m")).first()["m"]
    return F.coalesce(F.lit(newest).cast("timestamp"), F.lit(fallback).cast("timestamp"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


CONFLICT = "data_id bigint, event_id_cnty string, event_date string, event_type string, sub_event_type string, actor1 string, actor2 string, country string, admin1 string, location string, latitude string, longitude string, fatalities string, source string, notes string"


def conflict_payload(spark: SparkSession, path: str) -> DataFrame:
    """Rows of successful answers; others give none."""
    return _json(spark, path, f"success boolean, data array<struct<{_struct(CONFLICT)}>>").where("success").select(F.explode("data").alias("d")).select("d.*")


def _struct(columns: str) -> str:
    return ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in columns.split(", "))


# fixed values: the fields of an article, its places and its event
ARTICLE_PLACE = "struct<geoType: int, geoName: string, countryCode: string, adm1Code: string, latitude: double, longitude: double, featureId: string>"
ARTICLE_EVENT = "struct<eventCode: string, eventBaseCode: string, eventRootCode: string, goldsteinScale: double, numArticles: int, actor1CountryCode: string, actor2CountryCode: string, actor1Name: string, actor2Name: string>"
ARTICLE = (
    "struct<url: string, url_mobile: string, title: string, seendate: string, socialimage: string, domain: string, language: string, sourcecountry: string, tone: double, "
    f"themes: array<string>, persons: array<string>, organizations: array<string>, locations: array<{ARTICLE_PLACE}>, cameo: {ARTICLE_EVENT}>"
)


def article_list(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, f"articles array<{ARTICLE}>").select(F.explode("articles").alias("a")).select("a.*")


def geo_features(spark: SparkSession, path: str) -> DataFrame:
    """Properties (as a map) and the [lon, lat] point of each feature; null where there is none."""
    rows = _json(spark, path, "features array<struct<properties: map<string, string>, geometry: struct<coordinates: array<double>>>>").select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    point = F.when(F.size(at) >= 2, F.struct(F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon")))
    return rows.select(F.col("f.properties").alias("properties"), point.alias("geo"))


THREAT_NODE = "id string, name string, description string, aliases array<string>, created string, modified string, first_seen string, last_seen string, confidence int, objectLabel string, countryOfOrigin string, pattern string, valid_from string, valid_until string, goals array<string>, killChainPhases array<struct<kill_chain_name: string; phase_name: string>>"


def threat_objects(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """Nodes of all kinds of threat objects as one table with `kind`; labels and origins stay JSON for names_of()."""
    kinds = kinds or {"intrusionSets": "group", "campaigns": "campaign", "indicators": "indicator", "malwares": "malware", "vulnerabilities": "vulnerability"}
    node = _struct(THREAT_NODE).replace(";", ",")
    edges = ", ".join(f"{k}: struct<edges: array<struct<node: struct<{node}>>>>" for k in kinds)
    rows = _json(spark, path, f"data struct<{edges}>")
    out = None
    for source, kind in kinds.items():
        one = rows.select(F.explode(f"data.{source}.edges").alias("e")).select(F.lit(kind).alias("kind"), "e.node.*")
        out = one if out is None else out.unionByName(one)
    return out


def names_of(text: Column, field: str) -> Column:
    """The names in a label list: a flat list of texts or objects, or a graph of edges and nodes."""
    nested = F.from_json(text, f"struct<edges: array<struct<node: struct<{field}: string>>>>")
    flat_objects = F.from_json(text, f"array<struct<{field}: string>>")
    flat = F.from_json(text, "array<string>")
    found = F.coalesce(F.transform(nested["edges"], lambda e: e["node"][field]), F.transform(flat_objects, lambda o: o[field]), flat)
    texts = F.when(F.exists(F.coalesce(found, F.array()), lambda x: x.isNotNull()), found).otherwise(flat)
    return F.coalesce(F.filter(texts, lambda x: x.isNotNull()), F.array().cast("array<string>"))


OUTAGE = "id string, startDate string, eventDate string, endDate string, locations array<string>, asns array<string>, outageType string, type string, scope string, severity string, description string"


def outage_annotations(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, f"success boolean, result struct<annotations: array<struct<{_struct(OUTAGE)}>>>")
    return rows.where("success").select(F.explode("result.annotations").alias("a")).select("a.*")


def csv_table(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Headered CSV files of a folder whose names fit a pattern, all columns as text."""
    return spark.read.option("header", True).option("pathGlobFilter", pattern).csv(path)


MARKET_A = "condition_id string, id string, question string, title string, description string, tags array<string>, tokens array<struct<outcome: string, price: string>>, outcomePrices string, volume string, liquidity string, active boolean, closed boolean, slug string, end_date string, created_at string"
MARKET_B = "id string, question string, probability double, volume double, totalLiquidity double, closeTime bigint, url string, isResolved boolean"
MARKET_C = "id bigint, title string, community_prediction struct<full: struct<q2: double>>, aggregations struct<recency_weighted: struct<latest: struct<centers: array<double>>>>, close_time string, resolution string, actual_close_time string, url string"


def market_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed pages of markets, each a JSON array; of repeated ids the first row of the first page by name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    key = [c for c in ("condition_id", "id") if c in rows.columns]
    numbered = rows.select("*", F.col("_metadata.file_path").alias("_page"), F.monotonically_increasing_id().alias("_row"))
    return latest_per_key(numbered, key, F.col("_page"), F.col("_row")).drop("_page", "_row")


FEED_ARTICLE = "title string, contentSnippet string, content string, link string, url string, isoDate string, pubDate string, source string, source_category string"


def feed_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_ARTICLE).json(path)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(path)


OFAC = "uid string, sdnType string, firstName string, lastName string, remarks string, akaList struct<aka: array<struct<firstName: string, lastName: string>>>, programList struct<program: array<string>>, addressList struct<address: array<struct<country: string>>>, dateOfBirthList struct<dateOfBirthItem: array<struct<dateOfBirth: string>>>"
EU = "_euReferenceNumber string, _logicalId string, nameAlias array<struct<_wholeName: string, _lastName: string>>, subjectType struct<_VALUE: string, _classificationCode: string>, citizenship array<struct<_countryDescription: string>>, regulation struct<_programme: string>, countryDescription array<string>, programme array<string>"
UN_PERSON = "FIRST_NAME string, SECOND_NAME string, DATAID string, NATIONALITY struct<VALUE: array<string>>, INDIVIDUAL_ALIAS array<struct<ALIAS_NAME: string>>, UN_LIST_TYPE string"
UN_ENTITY = "FIRST_NAME string, DATAID string, ENTITY_ALIAS array<struct<ALIAS_NAME: string>>, UN_LIST_TYPE string"


def ofac_list(spark: SparkSession, path: str) -> DataFrame:
    return xml_rows(spark, path, "sdnEntry", OFAC)


def eu_list(spark: SparkSession, path: str) -> DataFrame:
    return xml_rows(spark, path, "sanctionEntity", EU)


def un_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return xml_rows(spark, path, "INDIVIDUAL", UN_PERSON), xml_rows(spark, path, "ENTITY", UN_ENTITY)
