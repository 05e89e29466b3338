"""Normalising projections: raw feed rows to the library's tables. Each is one select without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.scalars import ARTICLE_KEYWORDS, any_word, event_severity, first_date, first_given, matched_keywords, mentioned, outcome_prices, parse_locations, parse_scores, parse_tone, resolve_timestamp, safe_double, safe_int, surrogate_id


def _texts(text: Column, most: int | None = None) -> Column:
    return _first(F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x != ""), most)


def _first(values: Column, most: int | None) -> Column:
    """The first values; all, if no number is given."""
    return values if most is None else F.slice(values, 1, most)


def _geo(lat: Column, lon: Column) -> Column:
    return F.when((lat != 0) | (lon != 0), F.struct(lat.alias("lat"), lon.alias("lon")))


def with_country_names(rows: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Codes replaced by names (code, name); an unknown code stays, in capitals."""
    for c in columns:
        found = names.select(F.upper("code").alias("_code"), F.upper("name").alias("_name"))
        rows = rows.withColumn(c, F.upper(F.trim(F.coalesce(c, F.lit(""))))).join(found, F.col(c) == F.col("_code"), "left")
        rows = rows.withColumn(c, F.coalesce("_name", c)).drop("_code", "_name")
    return rows


# fixed values: the names under which feeds carry a field, in the order in which they are tried
EVENT_ALIASES = {
    "event_id": ("event_id", "GlobalEventID"),
    "date": ("seendate", "DATEADDED", "dateadded", "SQLDATE", "Day", "date"),
    "source_country": ("source_country", "Actor1CountryCode", "cameo.actor1CountryCode", "sourcecountry"),
    "target_country": ("target_country", "Actor2CountryCode", "cameo.actor2CountryCode", "targetcountry"),
    "event_code": ("cameo_code", "EventCode", "cameo.eventCode", "eventcode"),
    "goldstein_scale": ("goldstein_scale", "GoldsteinScale", "cameo.goldsteinScale", "goldsteinscale"),
    "tone": ("tone", "AvgTone", "avgtone"),
    "num_articles": ("num_articles", "NumArticles", "cameo.numArticles", "numarticles"),
    "quad_class": ("QuadClass",),
    "lat": ("geo_lat", "ActionGeo_Lat", "actiongeolat"),
    "lon": ("geo_lon", "ActionGeo_Long", "actiongeolong"),
    "actor1_name": ("Actor1Name", "cameo.actor1Name"),
    "actor2_name": ("Actor2Name", "cameo.actor2Name"),
    "url": ("url", "source_url", "SOURCEURL"),
}


def _paths(raw: DataFrame) -> dict[str, Column]:
    """The columns of a table and the fields of its structs, by path; names differ by case."""
    found = {}
    for field in raw.schema.fields:
        found[field.name] = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "struct":
            found |= {f"{field.name}.{inner.name}": F.col(f"`{field.name}`.`{inner.name}`") for inner in field.dataType.fields}
    return found


def events(raw: DataFrame, as_of: str) -> DataFrame:
    """Event exports or article lists -> events. Of each field the first alias counts that is given and not empty or
    zero; the date added comes before the event's day."""
    paths = _paths(raw)

    def given(name: str) -> Column:
        return first_given(*[paths[p] for p in EVENT_ALIASES[name] if p in paths])

    date = resolve_timestamp(given("date"), F.lit(as_of).cast("timestamp"))
    goldstein, tone, articles = safe_double(given("goldstein_scale")), safe_double(given("tone")), safe_int(given("num_articles"), 1)
    source, target = F.upper(F.coalesce(given("source_country"), F.lit(""))), F.upper(F.coalesce(given("target_country"), F.lit("")))
    return raw.select(
        F.coalesce(given("event_id"), surrogate_id(given("date"), given("url"), source, target)).alias("event_id"),
        date.alias("date"), source.alias("source_country"), target.alias("target_country"),
        F.coalesce(given("event_code"), F.lit("")).alias("event_code"), goldstein.alias("goldstein_scale"), tone.alias("tone"), articles.alias("num_articles"),
        safe_int(given("quad_class")).alias("quad_class"), F.trim(given("actor1_name")).alias("actor1_name"), F.trim(given("actor2_name")).alias("actor2_name"),
        _geo(safe_double(given("lat")), safe_double(given("lon"))).alias("geo"), given("url").alias("url"),
        event_severity(goldstein, articles, tone).alias("severity"),
    )


def graph(raw: DataFrame, as_of: str, themes: int | None = None, places: int | None = None, persons: int | None = None, organizations: int | None = None, scores: int | None = None) -> DataFrame:
    """Knowledge-graph rows; the numbers cap lists, which are whole unless asked for."""
    c = F.col
    newer = lambda name: F.when(F.coalesce(c(f"V2{name}"), F.lit("")) != "", c(f"V2{name}")).otherwise(c(name))
    return raw.select(
        F.coalesce(first_given(c("GKGRECORDID")), surrogate_id(c("DATE"), c("DocumentIdentifier"))).alias("gkg_id"),
        resolve_timestamp(c("DATE"), F.lit(as_of).cast("timestamp")).alias("date"), c("SourceCommonName").alias("source"), c("DocumentIdentifier").alias("url"),
        _texts(newer("Themes"), themes).alias("themes"), _first(parse_locations(newer("Locations")), places).alias("locations"),
        _texts(newer("Persons"), persons).alias("persons"), _texts(newer("Organizations"), organizations).alias("organizations"),
        parse_tone(c("V2Tone")).alias("tone"), parse_scores(c("GCAM"), scores).alias("scores"), F.lit(1).alias("num_articles"),
    )


def conflicts(raw: DataFrame) -> DataFrame:
    c = F.col
    lat, lon = c("latitude").try_cast("double"), c("longitude").try_cast("double")
    day = F.try_to_timestamp(c("event_date"), F.lit("yyyy-MM-dd"))
    return raw.select(
        F.coalesce(c("data_id").cast("string"), c("event_id_cnty")).alias("event_id"), day.alias("event_date"), day.alias("date"),
        F.upper(F.trim("country")).alias("country"), "event_type", "sub_event_type", "actor1", "actor2", "admin1", "location",
        safe_int(c("fatalities")).alias("fatalities"), F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("geo"),
    )


def _kind(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("individual", "p") | t.contains("person"), "person").when(t.isin("entity", "enterprise", "e", "organization"), "organization").when(t.isin("vessel", "aircraft"), "vessel").otherwise("unknown")


def _entity(list_name: str, uid: Column, name: Column, aliases: Column, kind: Column, country: Column, programs: Column, born: Column) -> list[Column]:
    given = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != ""))
    return [
        surrogate_id(list_name, uid, length=24).alias("entity_id"), F.lit(list_name).alias("list"), name.alias("name"), given.alias("aliases"),
        kind.alias("type"), F.upper(F.coalesce(country, F.lit(""))).alias("country"), F.coalesce(programs, F.array().cast("array<string>")).alias("programs"), born.alias("birth_date"),
    ]


def _full(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *parts))


def sanctions_ofac(raw: DataFrame) -> DataFrame:
    c = F.col
    name = _full(c("firstName"), c("lastName"))
    aliases = F.transform("akaList.aka", lambda a: F.trim(F.concat_ws(" ", a["firstName"], a["lastName"])))
    country = F.get(F.filter(F.transform("addressList.address", lambda a: a["country"]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    born = first_date(F.transform("dateOfBirthList.dateOfBirthItem", lambda d: d["dateOfBirth"]))
    return raw.select(*_entity("OFAC", c("uid"), F.when(name != "", name).otherwise(F.concat(F.lit("SDN-"), "uid")), aliases, _kind(c("sdnType")), country, c("programList.program"), born))


def sanctions_eu(raw: DataFrame) -> DataFrame:
    """Entities by their first name that is given; those without any go. Fields stand as attributes or as texts."""
    c = F.col
    given = lambda x: F.when(F.trim(x) != "", F.trim(x))
    names = F.filter(F.transform("nameAlias", lambda a: F.coalesce(given(a["_wholeName"]), given(a["_lastName"]))), lambda n: n.isNotNull())
    texts = lambda column: F.filter(F.coalesce(c(column), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    country = F.coalesce(F.get(F.filter(F.transform("citizenship", lambda x: given(x["_countryDescription"])), lambda x: x.isNotNull()), F.lit(0)), F.trim(F.get(texts("countryDescription"), F.lit(0))))
    programs = F.array_distinct(F.concat(F.array_compact(F.array("regulation._programme")), F.transform(texts("programme"), lambda x: F.trim(x))))
    # who is no person is an organisation
    kind = F.coalesce(given(c("subjectType._classificationCode")), given(c("subjectType._VALUE")))
    kind = F.when(_kind(kind) == "unknown", "organization").otherwise(_kind(kind))
    uid = F.coalesce("_euReferenceNumber", "_logicalId", F.get(names, F.lit(0)))
    rows = raw.where(F.size(names) > 0)
    return rows.select(*_entity("EU", uid, F.get(names, F.lit(0)), F.slice(names, F.lit(2), F.greatest(F.lit(0), F.size(names) - 1)), kind, country, programs, F.lit(None).cast("date")))


def sanctions_un(persons: DataFrame, entities: DataFrame) -> DataFrame:
    alias = lambda column: F.transform(column, lambda a: a["ALIAS_NAME"])
    none = F.lit(None).cast("date")
    listed = F.array_compact(F.array("UN_LIST_TYPE"))
    p = persons.select(*_entity("UN", F.col("DATAID"), _full(F.col("FIRST_NAME"), F.col("SECOND_NAME")), alias("INDIVIDUAL_ALIAS"), F.lit("person"), F.get("NATIONALITY.VALUE", F.lit(0)), listed, none))
    e = entities.select(*_entity("UN", F.col("DATAID"), F.trim("FIRST_NAME"), alias("ENTITY_ALIAS"), F.lit("organization"), F.lit(""), listed, none))
    return p.unionByName(e)


def sanctions(ofac: DataFrame, eu: DataFrame, un: tuple[DataFrame, DataFrame], as_of: str) -> DataFrame:
    """The three lists as one table; first_seen is this run's time, which an upsert that keeps it holds on to."""
    lists = sanctions_ofac(ofac).unionByName(sanctions_eu(eu)).unionByName(sanctions_un(*un))
    return lists.withColumn("first_seen", F.lit(as_of).cast("timestamp_ntz"))


def threats(raw: DataFrame, since: str | None = None) -> DataFrame:
    from confluo.sources.feeds import names_of

    c = F.col
    at = lambda x: c(x).try_cast("timestamp")
    out = raw.select(
        c("id").alias("stix_id"), "kind", "name", "description", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        names_of(c("objectLabel"), "value").alias("labels"), F.upper(F.get(names_of(c("countryOfOrigin"), "name"), F.lit(0))).alias("country"),
        F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce(at("first_seen"), at("created")).alias("first_seen"),
        F.coalesce(at("last_seen"), at("modified")).alias("last_seen"), at("modified").alias("modified"), "pattern",
        F.filter(F.transform(F.coalesce("killChainPhases", F.array()), lambda k: F.coalesce(k["phase_name"], k["kill_chain_name"])), lambda x: x != "").alias("kill_chain_phases"),
    )
    return out if since is None else out.where(F.coalesce("modified", "first_seen") >= F.lit(since).cast("timestamp"))


def outages(raw: DataFrame) -> DataFrame:
    """One row a location, else one a network, else one; graded by what the note says where it gives no grade."""
    c = F.col
    start, end = F.coalesce("startDate", "eventDate").try_cast("timestamp"), c("endDate").try_cast("timestamp")
    empty = F.array().cast("array<string>")
    places, nets = F.coalesce("locations", empty), F.coalesce("asns", empty)
    kind = F.when((F.size(places) == 0) & (F.size(nets) > 0), "asn-level").when(F.size(places) == 1, "country-level").when(F.size(places) > 1, "region").otherwise(F.coalesce("outageType", "type", F.lit("unknown")))
    scope = F.coalesce(F.lower("scope"), F.when(F.size(places) >= 1, "national").when(F.size(nets) > 0, "local").otherwise("regional"))
    hint = F.lower(F.concat_ws(" ", "outageType", "type", "description"))
    severity = F.coalesce(F.lower("severity"), F.when(hint.contains("total") | hint.contains("complete"), "total").when(hint.contains("major"), "major").when(hint.contains("significant"), "significant").otherwise("partial"))
    name = lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.code"), x)
    spread = F.when(F.size(places) > 0, F.transform(places, lambda p: F.struct(F.upper(name(p)).alias("country"), F.lit(None).cast("string").alias("network")))).when(
        F.size(nets) > 0, F.transform(nets, lambda n: F.struct(F.upper(F.coalesce(F.get_json_object(n, "$.country"), F.lit(""))).alias("country"), F.coalesce(F.get_json_object(n, "$.asn"), n).alias("network")))
    )
    rows = raw.withColumns({"_kind": kind, "_scope": scope, "_severity": severity, "_start": start, "_end": end}).withColumn("_at", F.explode_outer(spread))
    return rows.select(
        surrogate_id(c("id"), c("_at.country"), c("_at.network")).alias("outage_id"), c("_start").alias("start_time"), c("_end").alias("end_time"),
        F.coalesce("_at.country", F.lit("")).alias("country"), c("_at.network").alias("network"), c("_kind").alias("outage_type"), c("_scope").alias("scope"), c("_severity").alias("severity"),
        F.round(F.timestamp_diff("SECOND", c("_start"), c("_end")) / 3600, 2).alias("hours"), F.when(c("_end").isNotNull(), "resolved").otherwise("ongoing").alias("status"),
    )


# fixed values: the columns under which transfer files carry a field, in the order in which they are tried
TRANSFER_ALIASES = {
    "supplier": ("supplier_country", "supplier"),
    "recipient": ("recipient_country", "recipient"),
    "weapon_type": ("weapon_type", "armament_category"),
    "designation": ("weapon_description", "designation"),
    "quantity": ("quantity", "number_ordered"),
    "tiv": ("tiv_value", "tiv_delivery_values"),
    "order_date": ("order_date", "year_of_order"),
    "delivery_date": ("delivery_date", "year_of_deliveries"),
    "status": ("status", "deal_status"),
}


def transfers(raw: DataFrame) -> DataFrame:
    """Arms transfers, under either name of each column; a file may lack columns."""
    found = {name: F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns if c in raw.columns], F.lit("unknown" if name == "status" else "")) for name, columns in TRANSFER_ALIASES.items()}
    year = safe_int(F.col("year"))
    supplier, recipient = F.upper(F.trim(found["supplier"])), F.upper(F.trim(found["recipient"]))
    return raw.select(
        surrogate_id(year, supplier, recipient, found["designation"], found["quantity"]).alias("transfer_id"), F.make_date(year, F.lit(6), F.lit(15)).cast("timestamp").alias("date"), year.alias("year"),
        supplier.alias("supplier_country"), recipient.alias("recipient_country"), found["weapon_type"].alias("weapon_type"), found["designation"].alias("designation"), safe_int(found["quantity"]).alias("quantity"),
        safe_double(found["tiv"]).alias("tiv"), found["order_date"].alias("order_date"), found["delivery_date"].alias("delivery_date"), F.lower(found["status"]).alias("status"),
    ).where((F.col("year") > 0) & (F.col("recipient_country") != ""))


def spending(raw: DataFrame) -> DataFrame:
    c = F.col
    year = safe_int(c("year"))
    return raw.select(
        F.upper(F.trim("country")).alias("country"), year.alias("year"), F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp").alias("date"),
        safe_double(c("spending_usd_millions")).alias("spending"), safe_double(c("spending_pct_gdp")).alias("share"), safe_double(c("spending_change_yoy_pct")).alias("yoy"),
    ).where((F.col("year") > 0) & (F.coalesce("country", F.lit("")) != ""))


def markets_a(raw: DataFrame, countries: tuple[str, ...] = (), aliases: dict[str, str] | None = None, keywords: int | None = None) -> DataFrame:
    """Markets of the first kind; countries are those that question or description name of the given ones."""
    c = F.col
    named = mentioned(F.concat_ws(" ", "question", "title", "description"), countries, aliases) if countries else F.array().cast("array<string>")
    key = F.coalesce(F.when(c("condition_id") != "", c("condition_id")), c("id"))
    question = F.coalesce(F.when(c("question") != "", c("question")), c("title"), F.lit(""))
    side = lambda name: F.get(F.filter("tokens", lambda t: F.lower(t["outcome"]) == name), F.lit(0))["price"].try_cast("double")
    quoted = outcome_prices(c("outcomePrices"))
    return raw.select(
        F.concat(F.lit("polymarket_"), surrogate_id(F.coalesce(key, question), length=16)).alias("case_id"), key.alias("market_id"), question.alias("question"),
        F.round(F.coalesce(side("yes"), quoted["yes"]), 4).alias("yes_price"), F.round(F.coalesce(side("no"), quoted["no"]), 4).alias("no_price"),
        safe_double(c("volume")).alias("volume"), safe_double(c("liquidity")).alias("liquidity"), F.when(c("active") & ~F.coalesce("closed", F.lit(False)), "active").otherwise("closed").alias("status"),
        _first(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), keywords).alias("keywords"), named.alias("countries_involved"),
        c("created_at").try_cast("timestamp").alias("created"), c("end_date").try_cast("timestamp").alias("closes"),
    )


def markets_b(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("market_id"), F.lit("B").alias("platform"), "question", F.round("probability", 4).alias("price"),
        F.coalesce("volume", "totalLiquidity", F.lit(0.0)).alias("volume"), F.timestamp_millis("closeTime").alias("closes"), F.when(F.col("isResolved"), "resolved").otherwise("active").alias("status"),
    )


def markets_c(raw: DataFrame) -> DataFrame:
    price = F.coalesce("community_prediction.full.q2", F.get("aggregations.recency_weighted.latest.centers", F.lit(0)), F.lit(0.0))
    ended = F.coalesce("resolution", "actual_close_time").isNotNull()
    return raw.select(
        F.col("id").cast("string").alias("market_id"), F.lit("C").alias("platform"), F.col("title").alias("question"), F.round(price, 4).alias("price"),
        F.lit(0.0).alias("volume"), F.col("close_time").try_cast("timestamp").alias("closes"), F.when(ended, "resolved").otherwise("active").alias("status"),
    )


def is_market_relevant(text: Column, tags: Column, countries: Column, words: tuple[str, ...], context: tuple[str, ...], orgs: tuple[str, ...], excluded: str, excluded_tags: tuple[str, ...]) -> Column:
    """A strong word with a country or organisation, two countries, or an organisation with a context word; never with an
    excluded tag or pattern. Words and names count as whole words."""
    t = F.lower(text)
    barred = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(x).isin(*excluded_tags)) | t.rlike(excluded)
    org = t.rlike(any_word(orgs))
    return ~barred & ((t.rlike(any_word(words)) & ((F.size(countries) > 0) | org)) | (F.size(countries) >= 2) | (org & t.rlike(any_word(context))))


def names_relevant(question: Column, keywords: tuple[str, ...], names: tuple[str, ...], excluded: tuple[str, ...]) -> Column:
    """A keyword anywhere, or countries named twice or more, repeats included; never with an excluded text."""
    t = F.lower(question)
    mentions = F.size(F.regexp_extract_all(t, F.lit(any_word([n.lower() for n in names])), F.lit(0)))
    return ~t.rlike(any_word(excluded, whole=False)) & (t.rlike(any_word(keywords, whole=False)) | (mentions >= 2))


def articles(raw: DataFrame, keywords: tuple[str, ...] = ARTICLE_KEYWORDS) -> DataFrame:
    """Feed articles that hold a keyword."""
    text = F.concat_ws(" ", "title", F.coalesce("contentSnippet", "content"))
    rows = raw.select(
        "title", F.substring(F.coalesce("contentSnippet", "content", F.lit("")), 1, 500).alias("summary"), F.coalesce("link", "url").alias("url"),
        F.coalesce("isoDate", "pubDate").try_cast("timestamp").alias("date"), "source", "source_category", matched_keywords(text, keywords).alias("keywords"),
    )
    return rows.where(F.size("keywords") > 0)
