import json

from confluo.sources import feeds, normalise, store
from pyspark.sql import functions as F

AS_OF = "2025-06-20 00:00:00"


def event_line(event_id, added="20250615120000", **other):
    values = dict.fromkeys(feeds.EVENT_COLUMNS, "")
    values |= {"GlobalEventID": event_id, "Day": "20240101", "DATEADDED": added, "Actor1CountryCode": "usa", "GoldsteinScale": "-9.5", "AvgTone": "-8", "NumArticles": "100", "ActionGeo_Lat": "1.5", "ActionGeo_Long": "2"} | other
    return "\t".join(values[c] for c in feeds.EVENT_COLUMNS)


def test_event_export(spark, tmp_path):
    (tmp_path / "20250615120000.export.csv").write_text("\n".join([event_line("1"), 'a"b\tshort', event_line("", SOURCEURL='x"y') + "\textra", event_line("3", NumArticles="", ActionGeo_Lat="0", ActionGeo_Long="", added="bad")]))
    rows = {r.event_id: r for r in normalise.events(feeds.event_export(spark, str(tmp_path)), AS_OF).collect()}
    assert len(rows) == 3 and rows["1"].severity == "critical" and rows["1"].source_country == "USA" and str(rows["1"].date) == "2025-06-15 12:00:00"
    assert rows["3"].num_articles == 1 and rows["3"].geo is None and str(rows["3"].date) == "2025-06-20 00:00:00"
    assert any(len(k) == 20 for k in rows)
    names = spark.createDataFrame([("USA", "United States")], "code string, name string")
    named = normalise.with_country_names(normalise.events(feeds.event_export(spark, str(tmp_path)), AS_OF), ["source_country"], names)
    assert {r.source_country for r in named.collect()} == {"UNITED STATES"}
    files = feeds.files_since(spark.read.text(str(tmp_path)), "2025-06-15 12:00:00", "2025-06-15 12:15:00")
    assert files.count() == 4 and feeds.files_since(spark.read.text(str(tmp_path)), "2025-06-15 12:15:00", "2025-06-16").count() == 0


def test_graph_export(spark, tmp_path):
    v = dict.fromkeys(feeds.GRAPH_COLUMNS, "") | {"GKGRECORDID": "g1", "DATE": "20250615", "Themes": "A;;B;", "V2Themes": "", "V2Locations": "1#Paris#FR#FR00#48.8#2.3#x;1#None#X#X#0#0#y", "V2Tone": "-1.5,2", "GCAM": "a:1,b:2,a:3"}
    (tmp_path / "x.csv").write_text("\t".join(v[c] for c in feeds.GRAPH_COLUMNS))
    (row,) = normalise.graph(feeds.graph_export(spark, str(tmp_path)), AS_OF).collect()
    assert row.themes == ["A", "B"] and [(p.name, p.lat) for p in row.locations] == [("Paris", 48.8)]
    assert (row.tone.tone, row.tone.positive, row.tone.words) == (-1.5, 2.0, 0.0) and [tuple(s) for s in row.scores] == [("a", 3.0), ("b", 2.0)]


def test_json_feeds(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    c = normalise.conflicts(feeds.conflict_payload(spark, put("c.json", {"success": True, "data": [{"data_id": 7, "event_date": "2025-06-10", "country": "Libya", "fatalities": "8", "latitude": "1", "longitude": "x"}]})))
    row = c.first()
    assert (row.event_id, row.country, row.fatalities, row.geo) == ("7", "LIBYA", 8, None)
    assert feeds.conflict_payload(spark, put("n.json", {"success": False, "data": [{"data_id": 1}]})).count() == 0
    assert feeds.article_list(spark, put("a.json", {"articles": [{"url": "u", "tone": -1.0}]})).first().url == "u"
    geo = feeds.geo_features(spark, put("g.json", {"features": [{"properties": {"name": "p"}, "geometry": {"coordinates": [2.0, 48.0]}}, {"properties": {}, "geometry": None}]})).collect()
    assert (geo[0].geo.lat, geo[0].geo.lon, geo[1].geo) == (48.0, 2.0, None)
    node = {"id": "g", "name": "Bear", "created": "2025-01-01T00:00:00Z", "modified": "2025-06-01T00:00:00Z"}
    graph = {"edges": [{"node": {"value": "apt"}}]}
    t = {"data": {"intrusionSets": {"edges": [{"node": node | {"objectLabel": graph, "countryOfOrigin": {"edges": [{"node": {"name": "Russia"}}]}}}]}, "campaigns": {"edges": [{"node": node | {"id": "c", "objectLabel": ["x", "y"]}}]}}}
    rows = {r.stix_id: r for r in normalise.threats(feeds.threat_objects(spark, put("t.json", t)), "2025-02-01").collect()}
    assert rows["g"].labels == ["apt"] and rows["g"].country == "RUSSIA" and rows["c"].labels == ["x", "y"] and rows["c"].confidence == 0 and str(rows["g"].first_seen).startswith("2025-01-01")
    o = {"success": True, "result": {"annotations": [{"id": "1", "startDate": "2025-06-01T00:00:00Z", "endDate": "2025-06-01T02:30:00Z", "locations": ["FR", {"code": "DE", "name": "Germany"}], "description": "total blackout"}, {"id": "2", "eventDate": "2025-06-01T00:00:00Z", "asns": [{"asn": 1, "country": "it"}]}, {"id": "3", "startDate": "2025-06-01T00:00:00Z"}]}}
    rows = normalise.outages(feeds.outage_annotations(spark, put("o.json", o))).collect()
    assert sorted((r.country, r.outage_type, r.scope, r.severity, r.hours) for r in rows) == [("", "unknown", "regional", "partial", None), ("FR", "region", "national", "total", 2.5), ("GERMANY", "region", "national", "total", 2.5), ("IT", "asn-level", "local", "partial", None)]
    a = feeds.market_pages(spark, put("m.json", [{"id": "1", "question": "Q", "outcomePrices": '["0.4"]', "active": True, "tags": ["b", "a"]}, {"id": "1", "question": "Q"}, {"condition_id": "2", "tokens": [{"outcome": "Yes", "price": "0.7"}]}]), feeds.MARKET_A)
    rows = {r.market_id: r for r in normalise.markets_a(a).collect()}
    assert len(rows) == 2 and rows["2"].yes_price == 0.7
    b = normalise.markets_b(feeds.market_pages(spark, put("b.json", [{"id": "x", "question": "q", "probability": 0.12345, "totalLiquidity": 5.0, "closeTime": 0}]), feeds.MARKET_B)).first()
    assert (b.price, b.volume, b.status) == (0.1235, 5.0, "active")
    m = normalise.markets_c(feeds.market_pages(spark, put("z.json", [{"id": 1, "title": "t", "aggregations": {"recency_weighted": {"latest": {"centers": [0.3]}}}, "resolution": "yes"}]), feeds.MARKET_C)).first()
    assert (m.price, m.status, m.volume) == (0.3, "resolved", 0.0)
    (tmp_path / "feed.json").write_text("\n".join(json.dumps(x) for x in [{"title": "A coup", "content": "z" * 600, "link": "l"}, {"title": "Cakes"}]))
    (row,) = normalise.articles(feeds.feed_articles(spark, str(tmp_path / "feed.json"))).collect()
    assert row.keywords == ["coup"] and len(row.summary) == 500


def test_sanction_lists(spark, tmp_path):
    (tmp_path / "o.xml").write_text("<l><sdnEntry><uid>5</uid><sdnType>Individual</sdnType><firstName>A</firstName><lastName>B</lastName><akaList><aka><lastName>C</lastName></aka></akaList><programList><program>P</program></programList><addressList><address/><address><country>Iran</country></address></addressList><dateOfBirthList><dateOfBirthItem><dateOfBirth>3 Feb 1970</dateOfBirth></dateOfBirthItem></dateOfBirthList></sdnEntry><sdnEntry><uid>6</uid></sdnEntry></l>")
    rows = {r.name: r for r in normalise.sanctions_ofac(feeds.ofac_list(spark, str(tmp_path / "o.xml"))).collect()}
    r = rows["A B"]
    assert (r.aliases, r.type, r.country, r.programs, str(r.birth_date)) == (["C"], "person", "IRAN", ["P"], "1970-02-03") and "SDN-6" in rows
    (tmp_path / "e.xml").write_text('<x><sanctionEntity euReferenceNumber="E1"><nameAlias wholeName="Z Corp"/><nameAlias lastName="ZZ"/><subjectType classificationCode="E"/></sanctionEntity></x>')
    r = normalise.sanctions_eu(feeds.eu_list(spark, str(tmp_path / "e.xml"))).first()
    assert (r.name, r.aliases, r.type) == ("Z Corp", ["ZZ"], "organization")
    (tmp_path / "u.xml").write_text("<c><INDIVIDUAL><FIRST_NAME>Q</FIRST_NAME><SECOND_NAME>R</SECOND_NAME><DATAID>1</DATAID><NATIONALITY><VALUE>Mali</VALUE></NATIONALITY></INDIVIDUAL><ENTITY><FIRST_NAME>Org</FIRST_NAME><DATAID>2</DATAID></ENTITY></c>")
    rows = normalise.sanctions_un(*feeds.un_lists(spark, str(tmp_path / "u.xml"))).collect()
    assert {(r.name, r.type, r.country) for r in rows} == {("Q R", "person", "MALI"), ("Org", "organization", "")}


def test_csv_feeds(spark, tmp_path):
    (tmp_path / "a_transfers.csv").write_text("year,supplier,recipient,weapon_type,designation,number_ordered,tiv_delivery_values\n2020,France,india,aircraft,R,36,1.5\n0,X,Y,,,,\n2020,X,,,,,\n")
    (tmp_path / "b_spending.csv").write_text("year,country,spending_usd_millions,spending_pct_gdp,spending_change_yoy_pct\n2021,mali,10,1,12.5\n,x,,,\n")
    (t,) = normalise.transfers(feeds.csv_table(spark, str(tmp_path), "*transfers*.csv")).collect()
    (s,) = normalise.spending(feeds.csv_table(spark, str(tmp_path), "*spending*.csv")).collect()
    assert (t.recipient_country, t.quantity, str(t.date)[:10], s.country, s.yoy) == ("INDIA", 36, "2020-06-15", "MALI", 12.5)


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int, date timestamp_ntz").withColumn("date", F.to_timestamp_ntz(F.lit("2025-05-03")))
    store.upsert_table(rows(("a", 1, None), ("b", 1, None)), path, ["k"], ["v"])
    for _ in range(2):
        store.upsert_table(rows(("b", 2, None), ("c", 1, None)), path, ["k"], ["v"])
    whole = spark.createDataFrame([], "k string, v int, month string").schema
    got = sorted(map(tuple, store.read_table(spark, path, whole).collect()))
    assert got == [("a", 1, "2025-05"), ("b", 2, "2025-05"), ("c", 1, "2025-05")]
    new = spark.createDataFrame([("x", 1, "2025-05-03"), ("x", 2, "2025-05-03")], "id string, v int, day string")
    store.append_new(new, str(tmp_path / "n"), ["id"])
    store.append_new(new, str(tmp_path / "n"), ["id"])
    assert store.read_table(spark, str(tmp_path / "n"), new.schema).count() == 1
    schema = new.schema
    assert store.read_table(spark, str(tmp_path / "none"), schema).count() == 0
    store.ensure_table(spark, str(tmp_path / "none"))
    assert store.read_table(spark, str(tmp_path / "none"), schema).count() == 0
