"""Nested articles, lists in full, sanctions as texts, files by time, and stored keys that move."""

import json

from confluo.plans import rules
from confluo.sources import feeds, normalise, store
from pyspark.sql import functions as F

AS_OF = "2025-06-20 00:00:00"


def test_article_with_a_nested_event(spark, tmp_path):
    place = {"geoName": "Oslo", "latitude": 59.9, "longitude": 10.7}
    event = {"eventCode": "190", "goldsteinScale": -10.0, "numArticles": 47, "actor1CountryCode": "nor", "actor2CountryCode": "swe", "actor1Name": " NAVY ", "actor2Name": "ARMY"}
    articles = [{"url": "u1", "seendate": "20250615T120000Z", "sourcecountry": "Norway", "tone": -6.8, "locations": [place], "persons": ["P"], "cameo": event}, {"url": "u2", "seendate": "20250616T120000Z", "sourcecountry": "Mali", "tone": 0.0}]
    (tmp_path / "a.json").write_text(json.dumps({"articles": articles}))
    raw = feeds.article_list(spark, str(tmp_path / "a.json"))
    assert raw.where("url = 'u1'").first().locations[0].geoName == "Oslo"
    rows = {r.url: r for r in normalise.events(raw, AS_OF).collect()}
    r = rows["u1"]
    assert (r.source_country, r.target_country, r.event_code, r.goldstein_scale, r.num_articles, r.severity, r.actor1_name, str(r.date)) == ("NOR", "SWE", "190", -10.0, 47, "critical", "NAVY", "2025-06-15 12:00:00")
    r = rows["u2"]
    assert (r.source_country, r.target_country, r.num_articles, r.goldstein_scale, len(r.event_id)) == ("MALI", "", 1, 0.0, 20)


def test_lists_are_whole_unless_capped(spark, tmp_path):
    v = dict.fromkeys(feeds.GRAPH_COLUMNS, "") | {"GKGRECORDID": "g", "DATE": "20250615", "Themes": ";".join(f"T{i}" for i in range(150)), "GCAM": ",".join(f"k{i:03}:{i}" for i in range(90))}
    (tmp_path / "g.csv").write_text("\t".join(v[c] for c in feeds.GRAPH_COLUMNS))
    raw = feeds.graph_export(spark, str(tmp_path / "g.csv"))
    r = normalise.graph(raw, AS_OF).first()
    assert (len(r.themes), len(r.scores)) == (150, 90)
    r = normalise.graph(raw, AS_OF, themes=100, scores=50).first()
    assert (len(r.themes), len(r.scores)) == (100, 50)
    pages = [{"id": "1", "question": "q", "tags": [f"t{i:02}" for i in range(30)]}]
    (tmp_path / "m.json").write_text(json.dumps(pages))
    market = feeds.market_pages(spark, str(tmp_path / "m.json"), feeds.MARKET_A)
    assert len(normalise.markets_a(market).first().keywords) == 30 and len(normalise.markets_a(market, keywords=20).first().keywords) == 20


def test_european_entities_as_texts(spark, tmp_path):
    entity = lambda ref, alias, rest: f'<sanctionEntity euReferenceNumber="{ref}">{alias}{rest}</sanctionEntity>'
    rest = "<subjectType>Natural person</subjectType><countryDescription> Mali </countryDescription><programme>P1</programme><programme>P2</programme>"
    (tmp_path / "e.xml").write_text("<x>" + entity("E1", '<nameAlias wholeName="A B"/><nameAlias wholeName="C"/>', rest) + entity("E2", '<nameAlias wholeName=" "/>', rest) + entity("E3", '<nameAlias lastName="D"/>', "") + "</x>")
    rows = {r.name: r for r in normalise.sanctions_eu(feeds.eu_list(spark, str(tmp_path / "e.xml"))).collect()}
    assert set(rows) == {"A B", "D"}
    assert (rows["A B"].type, rows["A B"].country, rows["A B"].programs, rows["A B"].aliases) == ("person", "MALI", ["P1", "P2"], ["C"]) and rows["D"].type == "organization"


def test_files_of_other_times_are_not_opened(spark, tmp_path):
    for day in (1, 2, 3):
        (tmp_path / f"2025060{day}000000.csv").write_text(f"d{day}")
    found = feeds.files_since(spark.read.text(str(tmp_path)), "2025-06-02 00:00:00", "2025-06-03 00:00:00")
    assert [r.value for r in found.collect()] == ["d2"]
    assert found.rdd.getNumPartitions() == 1  # one file of three


def test_a_key_that_moves_leaves_its_month(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, part string, v int, date string, seen string").withColumn("date", F.col("date").cast("timestamp_ntz"))
    store.upsert_table(rows(("a", "x", 1, "2025-05-03", "s1"), ("a", "y", 1, "2025-05-03", "s1"), ("b", "x", 1, "2025-07-01", "s1")), path, ["k", "part"], ["v"])
    for _ in range(2):
        store.upsert_table(rows(("a", "x", 2, "2025-06-03", "s2"), ("b", "x", 2, "2025-07-02", "s2"), ("c", "x", 1, "2025-07-02", "s2")), path, ["k", "part"], ["v"], keep=("seen",))
    read = lambda: sorted((r.k, r.part, r.v, r.seen, str(r.month)[:7]) for r in store.read_table(spark, path, spark.createDataFrame([], "k string, part string, v int, date timestamp_ntz, seen string, month string").schema).collect())
    assert read() == [("a", "x", 2, "s1", "2025-06"), ("a", "y", 1, "s1", "2025-05"), ("b", "x", 2, "s1", "2025-07"), ("c", "x", 1, "s2", "2025-07")]
    store.upsert_table(rows(("a", "y", 3, "2025-06-09", "s3")), path, ["k", "part"], ["v"])  # May is empty now
    assert ("a", "y", 3, "s3", "2025-06") in read() and len(read()) == 4 and store.read_table(spark, path, spark.createDataFrame([], "k string").schema, ("2025-05", "2025-05")).count() == 0


def test_spike_rule_on_normalised_lists(spark, tmp_path):
    (tmp_path / "u.xml").write_text("<c><INDIVIDUAL><FIRST_NAME>Q</FIRST_NAME><DATAID>1</DATAID><NATIONALITY><VALUE>Mali</VALUE></NATIONALITY></INDIVIDUAL></c>")
    (tmp_path / "o.xml").write_text("<l><sdnEntry><uid>5</uid><firstName>A</firstName><programList><program>P</program></programList><addressList><address><country>Mali</country></address></addressList></sdnEntry></l>")
    (tmp_path / "e.xml").write_text("<x></x>")
    listed = normalise.sanctions(feeds.ofac_list(spark, str(tmp_path / "o.xml")), feeds.eu_list(spark, str(tmp_path / "e.xml")), feeds.un_lists(spark, str(tmp_path / "u.xml")), AS_OF)
    table = listed.withColumn("program", F.get("programs", F.lit(0)))
    seen = [("MALI", "2025-06-10"), ("MALI", "2025-06-11"), ("MALI", "2025-06-12"), ("MALI", "2025-03-01")]
    indicators = spark.createDataFrame(seen, "country string, at string").select("country", F.col("at").cast("timestamp_ntz").alias("ingested_at"))
    (row,) = rules.sanction_spike(table, indicators, AS_OF).collect()
    assert (row.countries, row.n_sanctions, row.post, row.base, row.severity) == ("MALI", 2, 3, 1, "high")
