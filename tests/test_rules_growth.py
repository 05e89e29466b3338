"""What rules do as tables grow: rows between steps, not results, which test_rules and test_oracles compare."""

from datetime import datetime, timedelta

from confluo.plans import adapters, live_queries, rules

SF = "/root/testdata/sf0.001"
AT = datetime(1998, 6, 30)


def _counting(monkeypatch, name):
    made, plain = [], getattr(rules, name)

    def counted(*args, **kwargs):
        found = plain(*args, **kwargs)
        made.append(found.count())
        return found

    monkeypatch.setattr(rules, name, counted)
    return made


def test_times_meet_not_rows(spark, monkeypatch):
    """Fifty outages, events and conflicts of one country in two hours: hours meet, and the numbers stay those of rows."""
    made = _counting(monkeypatch, "interval_join")
    hour = lambda i: AT + timedelta(hours=i % 2)
    outages = spark.createDataFrame([(i, hour(i), "A", "country-level", "regional", "total") for i in range(50)], "outage_id int, start_time timestamp_ntz, country string, outage_type string, scope string, severity string")
    events = spark.createDataFrame([(str(i), hour(i), "A", "B", -5.5 - i / 100) for i in range(50)], "event_id string, date timestamp_ntz, source_country string, target_country string, goldstein_scale double")
    conflicts = spark.createDataFrame([(i, hour(i), "A", 1) for i in range(7)], "event_id int, date timestamp_ntz, country string, fatalities int")
    found = rules.outage_escalation(outages, events, conflicts, adapters.AS_OF).collect()
    assert len(found) == 50 and {(r.n_diplomatic, r.n_conflict, round(r.worst, 4), r.severity) for r in found} == {(10, 7, -5.99, "critical")}
    assert made and max(made) <= 4


def test_an_outage_carries_no_names(spark):
    """Of a country's groups an outage gets numbers."""
    outages = spark.createDataFrame([(1, AT, "A", "national")], "outage_id int, start_time timestamp_ntz, country string, scope string")
    groups = spark.createDataFrame([(f"G{i}", "A", 50, AT) for i in range(9)], "name string, country string, confidence int, modified timestamp_ntz")
    named = groups.select("country", "name")
    plan = rules.outage_apt(outages, groups, named, named, adapters.AS_OF)
    assert "collect_set" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.n_offensive, r.n_targeting) for r in plan.collect()] == [(9, 5)]


def test_small_tables_of_names_go_to_the_rows(spark, monkeypatch):
    """Rows that name a supplier or customer are not shuffled for it, whatever Spark's own bound, while those are small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = lambda: adapters.table(spark, SF, "events")._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")
        assert joins() >= 4
        monkeypatch.setattr(adapters, "SMALL", 0)
        assert joins() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_engine_runs_each_rule_once(spark, monkeypatch):
    """Rules whose hits are stored are not run again for the engine's result."""
    calls = []
    plain = rules.rhetoric_shift
    monkeypatch.setattr(rules, "rhetoric_shift", lambda *args, **kwargs: calls.append(1) or plain(*args, **kwargs))
    monkeypatch.setattr(live_queries, "_kept", {})
    live_queries.rule_engine(spark, SF)
    assert len(calls) == 1
