"""Dictionary joins against the pattern of all names, windows of the rollup against the rows, options of rules and feeds."""

import random
from datetime import datetime, timedelta

import pytest
from confluo.functions.scalars import mentioned
from confluo.operators import core
from confluo.operators.names import names_in
from confluo.plans import panel_queries, rollup, rules
from confluo.sources import feeds, normalise
from pyspark.sql import functions as F

AS_OF = "2024-06-30 00:00:00"


def test_ten_thousand_aliases_equal_the_pattern(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["of", "the"]
    aliases = sorted({" ".join(rng.choices(words, k=rng.choice((1, 2, 2, 3)))) for _ in range(12_000)} | {"u-k", "the", "a.b c"})[:10_000]
    aliases = [a for a in aliases if len(a.split()) > 1 or a in ("w1", "w2", "the", "u-k", "a.b c")] + ["w1", "u-k"]
    rows = [(i, "".join(rng.choice(words + ["U-K", "W1", "x_w1"]) + rng.choice([" ", " ", " ", "  ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(900, None), (901, "")]
    texts = spark.createDataFrame(rows, "id int, text string")
    names = spark.createDataFrame([(a, a) for a in sorted(set(aliases))], "alias string, name string")
    got = {r.id: r.names for r in names_in(texts, names, "id", "text").collect()}
    # longest first at a place, as strings: the join takes the one of most words, which is the same where one starts with the other
    want = {r.id: r.m for r in texts.where("text IS NOT NULL").select("id", mentioned(F.col("text"), sorted(set(aliases))).alias("m")).collect() if r.m}
    assert got == want and len(set(aliases)) > 5000


def test_aliases_are_cleaned_and_long_texts_stay_small(spark):
    names = spark.createDataFrame([("(U.S.)", "USA"), ("...", "none"), ("united  states", "USA")], "alias string, name string")
    texts = spark.createDataFrame([(1, "the u.s. and"), (2, "United States"), (3, "united  states"), (4, "u.s " * 50_000)], "id int, text string")
    assert {r.id: r.names for r in names_in(texts, names, "id", "text").collect()} == {1: ["USA"], 3: ["USA"], 4: ["USA"]}
    assert names_in(texts, names.where("alias = '...'"), "id", "text").count() == 0


def _batch(spark, seed):
    rng = random.Random(seed)
    at = lambda: datetime(2024, 6, 30) - timedelta(hours=rng.randint(0, 40 * 24), minutes=rng.choice((0, 0, 17)))
    events = spark.createDataFrame([(f"{seed}-{i}", at(), rng.choice("ABC"), rng.choice(["A", "B", ""]), rng.uniform(-9, 5)) for i in range(300)], "event_id string, date timestamp_ntz, source_country string, target_country string, goldstein_scale double")
    other = spark.createDataFrame([(rng.choice("AB"), at()) for _ in range(80)], "country string, date timestamp_ntz")
    tiv = spark.createDataFrame([(rng.choice("AB"), at(), float(rng.randint(1, 9))) for _ in range(40)], "recipient_country string, date timestamp_ntz, tiv double")
    return events, other, other.withColumnRenamed("date", "first_seen"), other.withColumnRenamed("date", "start_time"), tiv


def test_windows_of_the_rollup_equal_the_rows(spark, tmp_path):
    path = str(tmp_path / "rollup")
    batches = [_batch(spark, seed) for seed in (1, 2)]
    for n, tables in enumerate(batches):
        for _ in range(2):  # a replayed batch replaces itself
            rollup.add(rollup.partials(*tables), path, f"b{n}")
    events = batches[0][0].union(batches[1][0])
    kept = rollup.read(events, path, AS_OF, 30)
    pairs = lambda rows: {(r[0], r[1]) for r in rows.collect() if r[1]}
    raw = rules.event_activity(events, AS_OF)
    assert pairs(rollup.by_country(kept, "event", AS_OF, 30, "negative")) == pairs(raw.select("country", "negative"))
    assert pairs(rollup.by_country(kept, "event", AS_OF, 7, "tense")) == pairs(raw.select("country", "tense"))
    fights = batches[0][1].union(batches[1][1])
    assert pairs(rollup.by_country(kept, "conflict", AS_OF, 7)) == pairs(fights.where(core.between("date", AS_OF, 7)).groupBy("country").count())
    bought = batches[0][4].union(batches[1][4])
    assert pairs(rollup.by_country(kept, "transfer", AS_OF, 30, "amount")) == pairs(bought.where(core.between("date", AS_OF, 30)).groupBy("recipient_country").agg(F.sum("tiv")))


def test_days_outside_a_window_are_not_listed(spark, tmp_path):
    for day in ("20240601", "20250601", "20250602", "20250603"):
        (tmp_path / day).mkdir()
        (tmp_path / day / f"{day}120000.csv").write_text(day)
    globs = feeds.window_globs(spark, str(tmp_path), "2025-06-01 18:00:00", "2025-06-03 00:00:00")
    assert [g[-9:] for g in globs] == ["20250601*", "20250602*"]
    found = feeds.files_since(spark.read.text(globs), "2025-06-01 18:00:00", "2025-06-03 00:00:00")
    assert [r.value for r in found.collect()] == ["20250602"]


def test_transfers_under_both_names(spark, tmp_path):
    (tmp_path / "x_transfers.csv").write_text("year,supplier_country,recipient_country,armament_category,weapon_description,quantity,tiv_value,order_date,year_of_deliveries,deal_status\n2021,France,india,aircraft,R,4,2.5,2019,2021,Delivered\n")
    (row,) = normalise.transfers(feeds.csv_table(spark, str(tmp_path), "*transfers*.csv")).collect()
    assert (row.supplier_country, row.weapon_type, row.designation, row.quantity, row.tiv, row.order_date, row.delivery_date, row.status) == ("FRANCE", "aircraft", "R", 4, 2.5, "2019", "2021", "delivered")


def test_options_of_rules(spark):
    at = lambda d, h=0: datetime(2024, 6, d, h)
    e = spark.createDataFrame([("1", at(29), "A", "B", -8.0), ("2", at(20), "A", "B", -9.0), ("3", at(21), "A", "B", -9.0)], "event_id string, date timestamp_ntz, source_country string, target_country string, goldstein_scale double")
    groups = spark.createDataFrame([("Bear", 80, datetime(2024, 7, 5), "C")], "name string, confidence int, modified timestamp_ntz, country string")
    who = spark.createDataFrame([("A", "Bear")], "country string, name string")
    assert rules.diplomatic_apt(e, groups, who, AS_OF).count() == 0
    assert rules.diplomatic_apt(e, groups, who, AS_OF, window="around_event").first().n_groups == 1
    with pytest.raises(ValueError):
        rules.diplomatic_apt(e, groups, who, AS_OF, window="later")
    bought = spark.createDataFrame([("t", "A", 5.0, at(20))], "transfer_id string, recipient_country string, tiv double, date timestamp_ntz")
    near = spark.createDataFrame([("A", "B")], "country string, neighbour string")
    (row,) = rules.arms_escalation(bought, near, e, AS_OF).collect()
    assert (row.before, row.after) == (1, 3)
    (row,) = rules.arms_escalation(bought, near, e, AS_OF, exclusive_after=True).collect()
    assert (row.before, row.after) == (1, 2)
    fights = spark.createDataFrame([("C", "Battles", 3, at(29))], "country string, event_type string, fatalities int, date timestamp_ntz")
    recent = groups.withColumn("modified", F.lit("2024-06-25").cast("timestamp_ntz"))
    assert rules.conflict_cyber(fights, recent, who, AS_OF).count() == 0
    assert rules.conflict_cyber(fights, recent, who, AS_OF, validate=False).count() == 1


def test_panels_take_a_country(spark):
    sf = "/root/testdata/sf0.001"
    found = [panel_queries.country_sanctions(spark, sf, country=c).collect() for c in ("NATION_3", "NATION_5")]
    assert found[0] != found[1]
