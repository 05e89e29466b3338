"""Correlation rules: each takes tables and an explicit as_of, and returns an unevaluated DataFrame of correlations.

Every rule's rows have correlation_id, rule_name, severity and countries, besides what is the rule's own. Windows are
closed intervals that end at as_of. Reference tables (attribution, neighbours) are joined without hints: Spark
broadcasts them by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions.scalars import surrogate_id
from confluo.operators.names import names_in
from confluo.operators.core import between, both_sides, canonical_pair, deviation, interval_join, merged_moments, moments, since, top_per_group

# fixed values: event types that mean armed conflict
CONFLICT_TYPES = ("Battles", "Violence against civilians", "Explosions/Remote violence", "Strategic developments")


def _day(as_of: str) -> str:
    return as_of[:10]


def _ladder(value: Column, *steps: tuple[float, str], otherwise: str | None) -> Column:
    out = F.lit(otherwise)
    for bound, name in reversed(steps):
        out = F.when(value >= bound, F.lit(name)).otherwise(out)
    return out


def recent_groups(groups: DataFrame, attribution: DataFrame, as_of: str, days: int, validate: bool = True) -> DataFrame:
    """(country, name, confidence) of groups changed lately that the attribution table gives to a country, or, without
    validation, that the group table itself does."""
    recent = groups.where(between("modified", as_of, days))
    if not validate:
        return recent.where("country <> ''").groupBy("country", "name").agg(F.max("confidence").alias("confidence"))
    recent = recent.select(F.lower("name").alias("key"), "confidence")
    recent = recent.groupBy("key").agg(F.max("confidence").alias("confidence"))
    named = attribution.select("country", "name", F.lower("name").alias("key")).distinct()
    return named.join(recent, "key").select("country", "name", "confidence")


def diplomatic_apt(events: DataFrame, groups: DataFrame, attribution: DataFrame, as_of: str, below: float = -5.0, days: int = 7, group_days: int = 30, confident: int = 80, window: str = "now") -> DataFrame:
    """Escalating country pairs with activity of threat groups attributed to either side: recent, or with
    window="around_event" within as many days of the pair's worst event."""
    if window not in ("now", "around_event"):
        raise ValueError(window)
    hot = events.where((F.col("goldstein_scale") < below) & between("date", as_of, days) & (F.col("source_country") != "") & (F.col("target_country") != ""))
    pairs = hot.groupBy(*canonical_pair("source_country", "target_country")).agg(
        F.count("*").alias("n_events"),
        F.min("goldstein_scale").alias("worst"),
        F.min(F.struct("goldstein_scale", "date", "event_id")).alias("_worst"),
    ).select("*", F.col("_worst.event_id").alias("worst_event"), F.col("_worst.date").alias("worst_at")).drop("_worst")
    sides = pairs.withColumn("country", F.explode(F.array_distinct(F.array("country_a", "country_b"))))
    if window == "now":
        found = sides.join(recent_groups(groups, attribution, as_of, group_days), "country")
    else:
        named = attribution.select("country", "name", F.lower("name").alias("key")).distinct()
        active = groups.select(F.lower("name").alias("key"), "confidence", "modified").join(named, "key").drop("key")
        found = interval_join(sides, active, "country", "worst_at", "modified", 24 * group_days, 24 * group_days)
    out = found.groupBy("country_a", "country_b", "n_events", "worst", "worst_event").agg(
        F.count_distinct("name").alias("n_groups"), F.max("confidence").alias("max_confidence"),
        F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("first_groups"),
    )
    level = F.when(F.col("worst") <= -8, 3).when(F.col("worst") <= -6, 2).otherwise(1)
    level = F.least(F.lit(3), level + F.when(F.col("max_confidence") >= confident, 1).otherwise(0))
    return out.select(
        surrogate_id("diplomatic_escalation_apt", F.col("country_a"), F.col("country_b"), _day(as_of)).alias("correlation_id"),
        F.lit("diplomatic_escalation_apt").alias("rule_name"),
        F.element_at(F.array(F.lit("medium"), F.lit("high"), F.lit("critical")), level).alias("severity"),
        F.concat_ws("||", "country_a", "country_b").alias("countries"),
        "n_events", "worst", "worst_event", "n_groups", "max_confidence", F.concat_ws(",", "first_groups").alias("first_groups"),
    )


def sanction_spike(sanctions: DataFrame, indicators: DataFrame, as_of: str, days: int = 14, window: int = 60, ratio: float = 2.0) -> DataFrame:
    """Newly sanctioned countries whose indicators of the last window outnumber those of the window before."""
    named = sanctions.where(between("first_seen", as_of, days)).withColumn("country", F.trim("country")).where("country <> ''")
    first = top_per_group(named, ["country"], 5, F.col("first_seen"), F.col("entity_id"))
    programs = first.groupBy("country").agg(F.array_join(F.array_sort(F.collect_set("program")), ",").alias("programs"))
    counts = named.groupBy("country").agg(F.count("*").alias("n_sanctions"))
    windows = indicators.where(between("ingested_at", as_of, 2 * window)).groupBy("country").agg(
        F.count_if(F.col("ingested_at") >= since(as_of, window)).alias("post"), F.count_if(F.col("ingested_at") < since(as_of, window)).alias("base")
    )
    joined = counts.join(programs, "country").join(windows, "country")
    value = F.when(F.col("base") > 0, F.col("post") / F.col("base")).when(F.col("post") > 0, F.lit(ratio + 1.0))
    out = joined.withColumn("ratio", value).where(F.col("ratio") >= ratio)
    return out.select(
        surrogate_id("sanction_cyber_spike", F.col("country"), _day(as_of)).alias("correlation_id"),
        F.lit("sanction_cyber_spike").alias("rule_name"),
        _ladder(F.col("ratio"), (5, "critical"), (3, "high"), (2, "medium"), otherwise="low").alias("severity"),
        F.col("country").alias("countries"), "n_sanctions", "programs", "post", "base", "ratio",
    )


def conflict_cyber(conflicts: DataFrame, groups: DataFrame, attribution: DataFrame, as_of: str, days: int = 14, group_days: int = 30, validate: bool = True) -> DataFrame:
    """Countries in armed conflict with recent threat-group activity."""
    fights = conflicts.where(F.col("event_type").isin(*CONFLICT_TYPES) & between("date", as_of, days) & (F.col("country") != ""))
    fights = fights.groupBy("country").agg(
        F.count("*").alias("n_events"), F.sum("fatalities").alias("fatalities"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("event_types")
    )
    active = recent_groups(groups, attribution, as_of, group_days, validate).groupBy("country").agg(F.count_distinct("name").alias("n_groups"), F.max("confidence").alias("max_confidence"))
    out = fights.join(active, "country")
    score = (
        F.when(F.col("n_events") >= 50, 2).when(F.col("n_events") >= 10, 1).otherwise(0)
        + F.when(F.col("fatalities") >= 100, 2).when(F.col("fatalities") >= 10, 1).otherwise(0)
        + F.when(F.col("n_groups") >= 3, 1).otherwise(0)
        + F.when(F.col("max_confidence") >= 80, 1).otherwise(0)
    )
    out = out.withColumn("score", score)
    return out.select(
        surrogate_id("conflict_cyber_infrastructure", F.col("country"), _day(as_of)).alias("correlation_id"),
        F.lit("conflict_cyber_infrastructure").alias("rule_name"),
        _ladder(F.col("score"), (5, "critical"), (3, "high"), (1, "medium"), otherwise="low").alias("severity"),
        F.col("country").alias("countries"), "n_events", "fatalities", "event_types", "n_groups", "max_confidence", "score",
    )


def rhetoric_shift(events: DataFrame, as_of: str, short: int = 7, long: int = 30, least: int = 10, z: float = 2.0, exact_std: bool = False) -> DataFrame:
    """Country pairs whose mean tone of the last days is off the longer baseline.

    Both windows are aggregated in one pass to moments, by direction first, then merged to pairs; the deviation is the
    larger of the two directions' (or, with exact_std, that of the pair). Constant tones have deviation 0 and no score.
    """
    tone = F.col("tone")
    now = F.when(F.col("date") >= since(as_of, short), tone)
    used = events.where(between("date", as_of, long) & (F.col("source_country") != "") & (F.col("target_country") != "") & tone.isNotNull())
    directed = used.groupBy("source_country", "target_country").agg(moments(now).alias("short"), moments(tone).alias("long"))
    pairs = directed.groupBy(*canonical_pair("source_country", "target_country")).agg(  # two directions at most
        merged_moments(F.collect_list("short")).alias("short"), merged_moments(F.collect_list("long")).alias("long"), F.max(deviation(F.col("long"))).alias("std_long")
    )
    pairs = pairs.select("country_a", "country_b", *[F.col(f"{w}.{c}").alias(f"{c}_{w}") for w in ("short", "long") for c in ("n", "mean")], (deviation(F.col("long")) if exact_std else F.col("std_long")).alias("std"))
    pairs = pairs.withColumn("z", F.when(F.col("std") > 0, (F.col("mean_short") - F.col("mean_long")) / F.col("std")))
    out = pairs.where((F.col("n_short") >= least) & (F.col("n_long") >= least) & (F.abs("z") >= z))
    return out.select(
        surrogate_id("rhetoric_shift", F.col("country_a"), F.col("country_b"), _day(as_of)).alias("correlation_id"),
        F.lit("rhetoric_shift").alias("rule_name"),
        _ladder(F.abs("z"), (4, "high"), (3, "medium"), otherwise="low").alias("severity"),
        F.concat_ws("||", "country_a", "country_b").alias("countries"), "n_short", "n_long", "mean_short", "mean_long", "z",
        F.when(F.col("z") < 0, "deteriorating").otherwise("improving").alias("direction"),
    )


def outage_escalation(outages: DataFrame, events: DataFrame, conflicts: DataFrame, as_of: str, days: int = 7, hours: int = 48, below: float = -5.0, most: int = 10) -> DataFrame:
    """Severe internet outages near diplomatic escalation or conflict in the same country."""
    severe = (F.col("outage_type") == "country-level") | (F.col("scope") == "national") | F.col("severity").isin("major", "total")
    cut = outages.where(between("start_time", as_of, days) & (F.col("country") != "") & severe)
    cut = cut.select("outage_id", "start_time", "country", F.col("severity").alias("outage_severity"))
    # no window reaches further than this, so both scans are cut to it
    around = between("date", as_of, days + hours / 24, -hours / 24)
    # only numbers of rows and the worst score count, so times of a country meet, not rows
    tense = both_sides(events.where((F.col("goldstein_scale") < below) & around)).groupBy("country", F.col("date").alias("seen_at")).agg(F.count("*").alias("n"), F.min("goldstein_scale").alias("worst"))
    fights = conflicts.where(around).groupBy("country", F.col("date").alias("seen_at")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("worst"))
    starts = cut.select("country", "start_time").distinct()

    def near(seen: DataFrame, name: str) -> DataFrame:
        """(outage_id, name, worst): how many rows of `seen` lie around an outage, `most` at most."""
        found = interval_join(starts, seen, "country", "start_time", "seen_at", hours, hours).groupBy("country", "start_time").agg(F.sum("n").alias("n"), F.min("worst").alias("worst"))
        met = cut.select("outage_id", "country", "start_time").join(found, ["country", "start_time"])
        return met.groupBy("outage_id").agg(F.least(F.lit(most), F.sum("n")).cast("long").alias(name), F.min("worst").alias("worst"))

    diplomatic, fought = near(tense, "n_diplomatic"), near(fights, "n_conflict").drop("worst")
    out = cut.join(diplomatic, "outage_id", "left").join(fought, "outage_id", "left").fillna(0, ["n_diplomatic", "n_conflict"])
    total, fight = F.col("outage_severity") == "total", F.col("n_conflict") > 0
    return out.where((F.col("n_diplomatic") > 0) | fight).select(
        surrogate_id("internet_outage_escalation", F.col("country"), F.date_format("start_time", "yyyy-MM-dd"), F.col("outage_id")).alias("correlation_id"),
        F.lit("internet_outage_escalation").alias("rule_name"),
        F.when(total & fight, "critical").otherwise("high").alias("severity"),
        F.col("country").alias("countries"), F.date_format("start_time", "yyyy-MM-dd").alias("day"), "outage_id", "n_diplomatic", "n_conflict", "worst",
    )


def with_yoy(spending: DataFrame) -> DataFrame:
    """Yearly change in percent of each country's spending."""
    w = Window.partitionBy("country").orderBy("year")
    last = F.lag("spending").over(w)
    return spending.withColumn("yoy", F.when(last > 0, 100.0 * (F.col("spending") - last) / last))


def military_buildup(spending: DataFrame, groups: DataFrame, attribution: DataFrame, as_of: str, above: float = 10.0, steep: float = 20.0, group_days: int = 365) -> DataFrame:
    """Years of strong military growth in countries with attributed groups; recently active ones if there are any."""
    grown = with_yoy(spending).where((F.col("yoy") > above) & (F.col("year") <= int(as_of[:4])))
    static = attribution.groupBy("country").agg(F.count_distinct("name").alias("static"))
    active = recent_groups(groups, attribution, as_of, group_days).groupBy("country").agg(F.count_distinct("name").alias("active"))
    out = grown.join(static, "country").join(active, "country", "left")
    return out.select(
        surrogate_id("military_buildup_cyber", F.col("country"), F.col("year")).alias("correlation_id"),
        F.lit("military_buildup_cyber").alias("rule_name"), F.when(F.col("yoy") > steep, "high").otherwise("medium").alias("severity"),
        F.col("country").alias("countries"), "year", "yoy", F.coalesce("active", "static").cast("int").alias("n_groups"), F.col("active").isNotNull().alias("validated"),
    )


def arms_escalation(transfers: DataFrame, neighbours: DataFrame, events: DataFrame, as_of: str, days: int = 365, window: int = 90, below: float = -3.0, percent: float = 50.0, exclusive_after: bool = False) -> DataFrame:
    """Arms imports followed by more hostile events with a neighbour than before them. Both windows hold the moment
    itself, or with exclusive_after only the one before."""
    bought = transfers.where(between("date", as_of, days) & (F.col("recipient_country") != "")).groupBy(F.col("recipient_country").alias("country")).agg(
        F.min("date").alias("reference"), F.max(F.struct("tiv", "transfer_id")).alias("largest")
    )
    near = bought.join(neighbours, "country").withColumn("country_a", F.least("country", "neighbour")).withColumn("country_b", F.greatest("country", "neighbour"))
    tense = events.where((F.col("goldstein_scale") < below) & between("date", as_of, days + window, -window)).select(*canonical_pair("source_country", "target_country"), F.col("date").alias("event_at"))
    near = near.withColumn("pair", F.concat_ws("||", "country_a", "country_b"))
    tense = tense.groupBy(F.concat_ws("||", "country_a", "country_b").alias("pair"), "event_at").agg(F.count("*").alias("n"))
    found = interval_join(near, tense, "pair", "reference", "event_at", 24 * window, 24 * window)
    within = lambda met: F.sum(F.when(met, F.col("n")).otherwise(0))
    counts = found.groupBy("country", "neighbour", "reference", "largest").agg(
        within(F.col("event_at") <= F.col("reference")).alias("before"), within(F.col("event_at") > F.col("reference") if exclusive_after else F.col("event_at") >= F.col("reference")).alias("after")
    )
    change = F.when(F.col("before") == 0, 100.0).otherwise(100.0 * (F.col("after") - F.col("before")) / F.col("before"))
    out = counts.withColumn("change", change).where(F.col("change") >= percent)
    return out.select(
        surrogate_id("arms_transfer_escalation", F.col("country"), F.col("neighbour"), _day(as_of)).alias("correlation_id"),
        F.lit("arms_transfer_escalation").alias("rule_name"), F.when(F.col("change") > 100, "critical").otherwise("high").alias("severity"),
        F.concat_ws("||", "country", "neighbour").alias("countries"), "before", "after", "change", F.col("largest.tiv").alias("largest_tiv"),
    )


def price_changes(prices: DataFrame) -> DataFrame:
    """Each price with the one before it of its case, the change and its direction."""
    w = Window.partitionBy("case_id").orderBy("ts", "event_id")
    out = prices.withColumn("previous", F.lag("price").over(w)).withColumn("delta", F.round(F.col("price") - F.col("previous"), 4))
    return out.withColumn("trend", F.when(F.col("delta") > 0, "rising").when(F.col("delta") < 0, "falling").when(F.col("delta") == 0, "stable"))


def price_shift(prices: DataFrame, at_least: float = 0.10, strong: float = 0.20) -> DataFrame:
    """Prices that moved by at least ten points against the case's last price."""
    out = price_changes(prices).where(F.abs("delta") >= at_least)
    return out.select(
        surrogate_id("prediction_market_shift", F.col("case_id"), F.col("event_id")).alias("correlation_id"),
        F.lit("prediction_market_shift").alias("rule_name"), F.when(F.abs("delta") >= strong, "high").otherwise("medium").alias("severity"),
        F.lit("").alias("countries"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "case_id", "event_id", "delta", "trend",
    )


def case_changes(prices: DataFrame, as_of: str) -> DataFrame:
    """(case_id, at, price, change_24h, change_7d): each case's last price against the last ones a day and a week before."""

    def last(days: int) -> Column:
        seen = F.when(F.col("ts") <= since(as_of, days), F.struct("ts", "event_id", "price"))
        return F.max(seen)

    known = prices.where(F.col("ts") <= since(as_of, 0)).groupBy("case_id").agg(last(0).alias("now"), last(1).alias("day"), last(7).alias("week"))
    change = lambda c: F.round(F.col("now.price") - F.col(f"{c}.price"), 4)
    return known.select("case_id", F.col("now.ts").alias("at"), F.col("now.price").alias("price"), change("day").alias("change_24h"), change("week").alias("change_7d"))


def worst_events(events: DataFrame, most: int) -> DataFrame:
    """(country, event_id, goldstein_scale, event_at): so many of each country's worst events. Of any set of countries the
    so many worst are among these, so a join with cases meets few rows a country."""
    rows = both_sides(events).select("country", "event_id", "goldstein_scale", F.col("date").alias("event_at"))
    order = (F.col("goldstein_scale"), F.col("event_at"), F.col("event_id"))
    once = top_per_group(rows, ["country", "event_id"], 1, *order).drop("rank")
    return top_per_group(once, ["country"], most, *order).drop("rank")


def prediction_event_match(cases: DataFrame, events: DataFrame, as_of: str, moved: float = 0.10, intensity: float = 7.0, days: int = 7, hours: int = 72, most: int = 10) -> DataFrame:
    """Cases (case_id, countries, at, change_24h, change_7d) that moved while an intense event befell one of their countries."""
    change = F.when(F.abs(F.coalesce("change_24h", F.lit(0.0))) > F.abs(F.coalesce("change_7d", F.lit(0.0))), F.col("change_24h")).otherwise(F.col("change_7d"))
    movers = cases.where(between("at", as_of, days)).withColumn("change", change).where(F.abs("change") > moved)
    order = (F.col("goldstein_scale"), F.col("event_at"), F.col("event_id"))
    strong = worst_events(events.where((F.abs("goldstein_scale") > intensity) & between("date", as_of, hours / 24)), most)
    found = movers.withColumn("country", F.explode(F.array_distinct("countries"))).join(strong, "country")
    found = top_per_group(found, ["case_id", "event_id"], 1, *order).drop("rank")
    worst = top_per_group(found, ["case_id"], most, *order)
    out = worst.groupBy("case_id", "at", "change").agg(F.count("*").alias("n_events"), F.min(F.struct("goldstein_scale", "event_at", "event_id")).alias("worst"))
    early = F.col("at") < F.col("worst.event_at")
    return out.select(
        surrogate_id("prediction_event_match", F.col("case_id"), _day(as_of)).alias("correlation_id"),
        F.lit("prediction_event_match").alias("rule_name"), F.when(early, "high").otherwise("medium").alias("severity"),
        F.lit("").alias("countries"), "case_id", "change", "n_events", F.col("worst.event_id").alias("worst_event"),
        F.when(early, "anticipation").otherwise("reaction").alias("direction"),
    )


def targeted(profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(country, name) of the groups whose description names a country (alias, name), as whole words in any case."""
    described = profiles.groupBy("name").agg(F.concat_ws("\n", F.array_sort(F.collect_set("description"))).alias("description"))
    found = names_in(described, aliases, "name", "description")
    return found.select(F.explode("names").alias("country"), F.col("id").alias("name"))


def event_activity(events: DataFrame, as_of: str, days: int = 30, tense_days: int = 7, below: float = -3.0) -> DataFrame:
    """(country, negative, tense): negative events of the last days and hostile ones of the last week, in one pass."""
    recent = both_sides(events.where(between("date", as_of, days)).select("source_country", "target_country", "goldstein_scale", "date"))
    tense = (F.col("goldstein_scale") < below) & (F.col("date") >= since(as_of, tense_days))
    return recent.groupBy("country").agg(F.count_if(F.col("goldstein_scale") < 0).alias("negative"), F.count_if(tense).alias("tense"))


def by_country(correlations: DataFrame) -> DataFrame:
    """Correlations once for each country they name."""
    return correlations.withColumn("country", F.explode(F.array_distinct(F.split("countries", r"\|\|")))).where("country <> ''")


def outage_apt(outages: DataFrame, groups: DataFrame, attribution: DataFrame, targeting: DataFrame, as_of: str, hours: int = 48, group_days: int = 30, static: int = 3, most: int = 5, validate: bool = True) -> DataFrame:
    """Outages in countries with offensive groups of their own or groups targeting them (country, name).

    A country's own groups are those active lately, else those that the group table knows at all, else the first ones of
    the attribution.
    """
    cut = outages.where(between("start_time", as_of, hours / 24) & (F.col("country") != ""))
    # of the groups only numbers count
    counted = lambda rows, name, k=None: rows.groupBy("country").agg(F.count_distinct("name").alias("_n")).select("country", (F.least(F.lit(k), "_n") if k else F.col("_n")).cast("long").alias(name))
    active = counted(recent_groups(groups, attribution, as_of, group_days, validate), "active")
    named = attribution.select("country", "name").distinct()
    tracked = counted(named.join(groups.select(F.lower("name").alias("_key")), F.lower("name") == F.col("_key"), "left_semi"), "tracked", most)
    known = counted(named, "known", static)
    aimed = counted(targeting, "n_targeting", most)
    out = cut.join(active, "country", "left").join(tracked, "country", "left").join(known, "country", "left").join(aimed, "country", "left")
    out = out.withColumn("n_offensive", F.coalesce("active", "tracked", "known", F.lit(0)).cast("int")).withColumn("n_targeting", F.coalesce("n_targeting", F.lit(0)))
    return out.where((F.col("n_offensive") > 0) | (F.col("n_targeting") > 0)).select(
        surrogate_id("outage_apt_activity", F.col("country"), F.col("outage_id")).alias("correlation_id"),
        F.lit("outage_apt_activity").alias("rule_name"),
        F.when((F.col("scope") == "national") & (F.col("n_offensive") > 0), "critical").otherwise("high").alias("severity"),
        F.col("country").alias("countries"), F.date_format("start_time", "yyyy-MM-dd").alias("day"), "outage_id", "n_offensive", "n_targeting",
    )


def convergence(signals: list[tuple[str, DataFrame]], risk: DataFrame, as_of: str, risk_above: float = 40.0, least: int = 3) -> DataFrame:
    """Countries at risk where several signals stand at once.

    signals: (name, DataFrame with one column country); each is reduced to its distinct countries and joined left.
    """
    out = risk.where(F.col("risk_score") > risk_above).select("country", "risk_score")
    for name, frame in signals:
        out = out.join(frame.select("country").distinct().withColumn(name, F.lit(1)), "country", "left")
    names = [n for n, _ in signals]
    out = out.fillna(0, names).withColumn("n_signals", sum((F.col(n) for n in names), F.lit(0)))
    return out.where(F.col("n_signals") >= least).select(
        surrogate_id("multi_signal_convergence", F.col("country"), _day(as_of)).alias("correlation_id"),
        F.lit("multi_signal_convergence").alias("rule_name"), F.when(F.col("n_signals") >= 4, "critical").otherwise("high").alias("severity"),
        F.col("country").alias("countries"), "risk_score", "n_signals", (F.col("n_signals") >= 5).alias("flagged"),
        F.array_join(F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]), lambda x: x.isNotNull()), ",").alias("signals"),
    )
