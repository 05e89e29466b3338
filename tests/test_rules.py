from datetime import datetime

from confluo.functions.scalars import event_severity, first_date, mentioned, parse_scores, safe_int
from confluo.operators import core
from confluo.plans import rules, scores
from pyspark.sql import functions as F

AS_OF = "2024-06-30 00:00:00"


def at(day):
    return datetime(2024, 6, day)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, date timestamp_ntz, source_country string, target_country string, goldstein_scale double, tone double")


def test_severity_marks(spark):
    df = spark.createDataFrame([(-9.0, 100, 0.0), (-8.5, 80, 0.0), (-5.0, 20, -1.0), (-2.0, 5, -0.5), (3.0, 0, 0.0), (None, None, None)], "g double, n int, t double")
    got = [r.s for r in df.select(event_severity(F.col("g"), F.col("n"), F.col("t")).alias("s")).collect()]
    assert got == ["critical", "high", "medium", "low", "low", "low"]


def test_escalation_is_strictly_below_and_pairs_have_no_order(spark):
    e = events(spark, [("1", at(29), "A", "B", -8.0, 0.0), ("2", at(28), "B", "A", -5.5, 0.0), ("3", at(28), "A", "C", -5.0, 0.0), ("4", at(10), "A", "D", -9.0, 0.0)])
    groups = spark.createDataFrame([("Bear", 80, at(20)), ("old", 99, at(1))], "name string, confidence int, modified timestamp_ntz")
    who = spark.createDataFrame([("A", "BEAR"), ("A", "old")], "country string, name string")
    (row,) = rules.diplomatic_apt(e, groups, who, AS_OF).collect()
    assert (row.countries, row.n_events, row.worst_event, row.severity, row.n_groups) == ("A||B", 2, "1", "critical", 2)
    (row,) = rules.diplomatic_apt(e, groups, who, AS_OF, group_days=15).collect()
    assert row.n_groups == 1


def test_tone_shift_needs_enough_events_and_deviation(spark):
    old = [(f"o{i}", at(5 + i % 15), "A", "B", 0.0, float(i % 2)) for i in range(20)]
    new = [(f"n{i}", at(29), "B", "A", 0.0, -3.0) for i in range(10)]
    (row,) = rules.rhetoric_shift(events(spark, old + new), AS_OF, z=1.0).collect()
    assert (row.direction, row.n_short, row.n_long) == ("deteriorating", 10, 30)
    assert not rules.rhetoric_shift(events(spark, old + new[:9]), AS_OF, z=1.0).collect()


def test_interval_join_equals_theta_join(spark):
    left = spark.createDataFrame([(i, "k", datetime(2024, 1, 1 + i, i)) for i in range(20)], "a int, key string, x timestamp_ntz")
    right = spark.createDataFrame([(i, "k", datetime(2024, 1, 1 + i, 23 - i)) for i in range(20)], "b int, key string, y timestamp_ntz")
    got = {(r.a, r.b) for r in core.interval_join(left, right, "key", "x", "y", 48, 24).collect()}
    want = {(r.a, r.b) for r in left.crossJoin(right.drop("key")).where("y >= x - interval 48 hours and y <= x + interval 24 hours").collect()}
    assert got == want and got


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 1), ("c", 3)], "k string, v int")
    once = core.upsert(old, new, ["k"], F.desc("v"))
    twice = core.upsert(once, new, ["k"], F.desc("v"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_engine_stores_each_id_once(spark):
    rule = lambda: spark.createDataFrame([("i1", "r", "high", "A"), ("i1", "r", "high", "A"), ("i2", "r", "low", "B")], "correlation_id string, rule_name string, severity string, countries string")
    stored = rule().where("correlation_id = 'i2'")
    found = scores.run_rules({1: rule, 2: rule}, stored)
    assert [r.correlation_id for r in found.collect()] == ["i1"]
    assert scores.alerts(found).count() == 1


def test_ratio_without_baseline(spark):
    s = spark.createDataFrame([(1, "A", "p", at(29)), (2, "B", "p", at(29)), (3, " ", "p", at(29))], "entity_id long, country string, program string, first_seen timestamp_ntz")
    i = spark.createDataFrame([("A", at(28)), ("B", datetime(2024, 4, 1))], "country string, ingested_at timestamp_ntz")
    (row,) = rules.sanction_spike(s, i, AS_OF).collect()
    assert (row.countries, row.ratio, row.severity) == ("A", 3.0, "high")


def test_small_functions(spark):
    df = spark.range(1)
    assert df.select(safe_int(F.lit("12.0"))).first()[0] == 0
    assert str(df.select(first_date(F.array(F.lit("x"), F.lit("3 Feb 1970")))).first()[0]) == "1970-02-03"
    assert df.select(mentioned(F.lit("Who will tell us of the uk?"), ["us", "united kingdom"], {"uk": "united kingdom"})).first()[0] == ["UNITED KINGDOM", "US"]
    assert [tuple(x) for x in df.select(parse_scores(F.lit("b:1,a:2,b:3,bad,c:x"))).first()[0]] == [("a", 2.0), ("b", 3.0)]


def test_event_scans_are_bounded(spark, tmp_path):
    """Both rules that look around a date read only the events that any window can reach."""
    rows = [(f"e{i}", datetime(2020 + i % 5, 6, 28), "A", "B", -9.0, 0.0) for i in range(20)]
    events(spark, rows).write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    fights = stored.select("event_id", "date", F.col("source_country").alias("country"), F.lit(3).alias("fatalities"))
    fights.write.parquet(str(tmp_path / "f"))
    cut = spark.createDataFrame([(1, at(29), "A", "country-level", "national", "total")], "outage_id int, start_time timestamp_ntz, country string, outage_type string, scope string, severity string")
    bought = spark.createDataFrame([("t", "A", 5.0, at(1))], "transfer_id string, recipient_country string, tiv double, date timestamp_ntz")
    near = spark.createDataFrame([("A", "B")], "country string, neighbour string")
    found = rules.outage_escalation(cut, stored, spark.read.parquet(str(tmp_path / "f")), AS_OF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plans = [found, rules.arms_escalation(bought, near, stored, AS_OF)]
    for frame in plans:
        frame.collect()
        scans = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line and "date" in line]
        assert scans and all("GreaterThanOrEqual(date" in line and "LessThanOrEqual(date" in line for line in scans)
    assert found.first().n_diplomatic == 4 and plans[1].first().after == 4


def test_matching_equals_all_pairs(spark):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("arr", "orr", "ill", "unn")]
    ask = lambda: " ".join(["gadget", *rng.sample(words, rng.randint(1, 5))])  # noqa: E731  a word that every question has
    rows = lambda n: [(i, ask(), rng.sample("ABCDEF", rng.randint(1, 2))) for i in range(n)]
    cases, markets = rows(60), rows(80)
    got = {}
    frames = [spark.createDataFrame(r, f"{k}_id int, question string, countries array<string>") for r, k in ((cases, "case"), (markets, "market"))]
    for r in scores.match_markets(*frames).collect():
        got.setdefault(r.case_id, []).append((r["rank"], r.market_id, r.score))
    for i, question, where in cases:
        a, found = set(question.split()), []
        for j, other, there in markets:
            b = set(other.split())
            score = round(min(1.0, len(a & b) / len(a | b) + (0.15 if set(where) & set(there) else 0)), 4)
            if score >= 0.35:
                found.append((-score, j))
        assert sorted(got.get(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:3])]


def test_engine_prefers_the_gravest(spark):
    rule = lambda *rows: lambda: spark.createDataFrame(rows, "correlation_id string, rule_name string, severity string, countries string, day string")
    found = scores.run_rules({1: rule(("i", "r", "low", "A", "2024-01-01")), 2: rule(("i", "r", "high", "B", "2024-01-02"), ("j", "r", "low", "C", "2024-01-03"))})
    assert sorted((r.correlation_id, r.severity, r.day) for r in found.collect()) == [("i", "high", "2024-01-02"), ("j", "low", "2024-01-03")]
    assert {r.day for r in scores.run_rules({1: lambda: rule(("i", "r", "low", "A", "x"))().drop("day")}, as_of=AS_OF).collect()} == {"2024-06-30"}


def test_targets_in_descriptions(spark):
    profiles = spark.createDataFrame([("Bear", "attacks MALI, Niger and maliens"), ("Cat", None), ("Dog", "Nigeria only")], "name string, description string")
    assert sorted((r.country, r.name) for r in rules.targeted(profiles, spark.createDataFrame([("Mali", "Mali"), ("Niger", "Niger")], "alias string, name string")).collect()) == [("MALI", "Bear"), ("NIGER", "Bear")]


def test_own_groups_fall_back_twice(spark):
    cut = spark.createDataFrame([(i, at(29), c, "regional") for i, c in enumerate("ABCD")], "outage_id int, start_time timestamp_ntz, country string, scope string")
    groups = spark.createDataFrame([("Bear", 9, at(28)), ("cat", 9, datetime(2020, 1, 1)), ("Crow", 9, datetime(2020, 1, 1))], "name string, confidence int, modified timestamp_ntz")
    who = spark.createDataFrame([("A", "bear"), ("A", "x"), ("B", "Cat"), ("B", "crow"), ("B", "y"), *[("C", f"z{i}") for i in range(9)]], "country string, name string")
    nobody = who.limit(0)
    assert sorted((r.countries, r.n_offensive) for r in rules.outage_apt(cut, groups, who, nobody, AS_OF).collect()) == [("A", 1), ("B", 2), ("C", 3)]


def test_constant_tones_have_no_deviation_and_raise_nothing(spark):
    for tone in (0.7, 3.3, -2.3, 1e9 + 0.1):
        rows = [(f"{i}", datetime(2024, 6, 1 + i % 29, i % 24), "AB"[i % 2], "BA"[i % 2], 0.0, tone) for i in range(137)]
        frame = events(spark, rows)
        for exact in (True, False):
            assert rules.rhetoric_shift(frame, AS_OF, exact_std=exact).count() == 0
        daily = frame.groupBy("source_country", F.to_date("date").alias("day")).agg(core.moments(F.col("tone")).alias("moments"))
        scored = core.trailing_scores(daily, ["source_country"]).collect()
        assert {(r.std_long, r.z, r.mean_long) for r in scored} == {(0.0, None, tone)}
    many = spark.range(1_000_000).select((F.col("id") % 13).alias("k"), F.lit(0.1).alias("x"))
    whole = many.groupBy("k").agg(core.moments(F.col("x")).alias("m")).agg(core.merged_moments(F.collect_list("m")).alias("m")).first().m
    assert (whole.n, whole.mean, whole.m2) == (1_000_000, 0.1, 0.0)


def test_merged_moments_equal_those_of_all_values(spark):
    values = [(i % 5, 1e6 + (i * 37 % 101) / 7) for i in range(999)] + [(5, None), (6, float("nan"))]
    frame = spark.createDataFrame(values, "k int, x double")
    parts = frame.groupBy("k").agg(core.moments(F.col("x")).alias("m"))
    m, std = parts.agg(core.merged_moments(F.collect_list("m")).alias("m")).select("m", core.deviation(F.col("m"))).first()
    want = [x for _, x in values if x is not None and x == x]
    mean = sum(want) / len(want)
    assert m.n == 999 and abs(m.mean - mean) < 1e-6 and abs(std - (sum((x - mean) ** 2 for x in want) / 999) ** 0.5) < 1e-9


def test_a_busy_country_sends_few_events_to_the_join(spark):
    """Ten events a country meet its cases, however many there are; the result is that of all pairs."""
    e = events(spark, [(f"e{i}", datetime(2024, 6, 29, i % 20, i // 60), "A", "AB"[i % 7 == 0], -7.5 - (i * 31 % 97) / 40, 0.0) for i in range(600)])
    cases = spark.createDataFrame([(i, ["A", "A", "B"] if i % 2 else ["B"], at(29), 0.5, 0.0) for i in range(200)], "case_id int, countries array<string>, at timestamp_ntz, change_24h double, change_7d double")
    found = rules.prediction_event_match(cases, e, AS_OF)
    rows = found.collect()
    worst = {c: sorted((r.goldstein_scale, r.date, r.event_id) for r in e.collect() if c in (r.source_country, r.target_country))[:10] for c in "AB"}
    for r in rows:
        want = sorted({*worst["B"], *(worst["A"] if r.case_id % 2 else [])})[:10]
        assert (r.n_events, r.worst_event) == (len(want), want[0][2])
    assert len(rows) == 200
    assert {r["count"] for r in rules.worst_events(e, 10).groupBy("country").count().collect()} == {10}
