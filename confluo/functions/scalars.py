"""Column functions shared by ingest jobs, rules and panels. All are built-in expressions, none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")

# fixed values: words that say nothing about a question's subject
STOP_WORDS = (
    "will", "the", "be", "by", "in", "on", "of", "to", "and", "or",
    "a", "an", "is", "it", "for", "at", "this", "that", "with",
    "before", "after", "end", "year", "month",
)

# fixed values: keywords of the article filter
ARTICLE_KEYWORDS = (
    "war", "conflict", "sanctions", "military", "nato", "ceasefire",
    "invasion", "nuclear", "treaty", "diplomacy", "geopolitical",
    "cyber attack", "apt", "espionage", "intelligence", "defense",
    "missile", "drone", "territorial", "sovereignty", "alliance",
    "embargo", "coup", "insurgency", "peacekeeping", "un security council",
    "arms deal",
)

# fixed values: two-digit roots of the event codes that matter
RELEVANT_CODE_ROOTS = ("04", "05", "06", "13", "14", "15", "16", "17", "18", "19", "20")


def surrogate_id(*parts: Column | str, length: int = 20) -> Column:
    """The first hex digits of SHA-256 over the parts joined by colons; a null part counts as empty."""
    texts = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(":", *texts), 256), 1, length)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1, F.lit(-1))


def first_given(*candidates: Column) -> Column:
    """The first candidate that is neither null, empty nor zero."""
    texts = [c.cast("string") for c in candidates]
    return F.coalesce(*[F.when(~t.isin("", "0", "0.0"), t) for t in texts], F.lit(None).cast("string"))


def safe_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def safe_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def resolve_timestamp(value: Column, fallback: Column) -> Column:
    """14 digits, 8 digits, ISO in its basic or extended form; otherwise the fallback."""
    text = F.trim(value)
    parsed = F.coalesce(
        F.when(F.length(text) == 14, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))),
        F.when(F.length(text) == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd"))),
        F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssX")),
        text.try_cast("timestamp"),
    )
    return F.coalesce(parsed, fallback)


def first_date(values: Column) -> Column:
    """The first parseable date of an array of texts in the forms lists of entities use."""
    patterns = ("d MMM yyyy", "yyyy", "M/d/yyyy", "yyyy-MM-dd")
    parsed = F.transform(values, lambda v: F.coalesce(*[F.try_to_timestamp(F.trim(v), F.lit(p)) for p in patterns]))
    return F.to_date(F.get(F.filter(parsed, lambda d: d.isNotNull()), F.lit(0)))


def event_severity(goldstein: Column, articles: Column, tone: Column) -> Column:
    """Points for conflict intensity, coverage and tone, summed and graded."""

    def steps(value: Column, *rules: tuple[bool, float, float]) -> Column:
        out = F.lit(0.0)
        for above, bound, points in reversed(rules):
            out = F.when(value >= bound if above else value <= bound, F.lit(points)).otherwise(out)
        return out

    points = (
        steps(goldstein, (False, -9, 4.0), (False, -7, 3.0), (False, -5, 2.0), (False, -2, 1.0))
        + steps(articles, (True, 100, 2.0), (True, 50, 1.5), (True, 20, 1.0), (True, 5, 0.5))
        + steps(tone, (False, -8, 2.0), (False, -5, 1.5), (False, -3, 1.0), (False, -1, 0.5))
    )
    return F.when(points >= 6, "critical").when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def parse_locations(text: Column, latitude_at: int = 4, longitude_at: int = 5) -> Column:
    """';'-separated entries of '#'-separated fields -> array of name, country, lat, lon; entries without a place go."""
    fields = F.transform(F.filter(F.split(text, ";"), lambda e: e != ""), lambda e: F.split(e, "#"))
    known = F.filter(fields, lambda f: F.size(f) > longitude_at)
    points = F.transform(
        known,
        lambda f: F.struct(
            F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(2)).alias("country"),
            safe_double(F.get(f, F.lit(latitude_at))).alias("lat"), safe_double(F.get(f, F.lit(longitude_at))).alias("lon"),
        ),
    )
    return F.filter(points, lambda p: (p["lat"] != 0) | (p["lon"] != 0))


TONE_FIELDS = ("tone", "positive", "negative", "polarity", "activity", "self_reference", "words")


def parse_tone(text: Column) -> Column:
    """Seven comma-separated numbers; what is missing is 0."""
    values = F.split(text, ",")
    return F.struct(*[safe_double(F.get(values, F.lit(i))).alias(name) for i, name in enumerate(TONE_FIELDS)])


def parse_scores(text: Column, most: int | None = None) -> Column:
    """'k:v' pairs (the first ones, if a number is given) -> array of entries in key order; of a repeated key the last
    value counts."""
    parts = F.split(text, ",") if most is None else F.slice(F.split(text, ","), 1, most)
    pairs = F.filter(F.transform(parts, lambda p: F.split(p, ":")), lambda p: F.size(p) == 2)
    entries = F.transform(pairs, lambda p, i: F.struct(F.get(p, F.lit(0)).alias("key"), (-i).alias("back"), F.get(p, F.lit(1)).try_cast("double").alias("value")))
    # in order of key, the last of a key first: an entry counts if the one before it has another key
    entries = F.array(F.array_sort(F.filter(entries, lambda e: e["value"].isNotNull() & (e["key"] != ""))))
    last = F.transform(entries, lambda es: F.filter(es, lambda e, i: (i == 0) | (F.get(es, i - 1)["key"] != e["key"])))
    return F.transform(F.get(last, F.lit(0)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def outcome_prices(text: Column) -> Column:
    """A JSON text of one or two prices -> struct(yes, no); one price gives no = 1 - yes."""
    prices = F.transform(F.from_json(text, "array<string>"), lambda p: p.try_cast("double"))
    yes = F.when(F.size(prices).between(1, 2), F.get(prices, F.lit(0)))
    no = F.when(F.size(prices) == 2, F.get(prices, F.lit(1))).when(F.size(prices) == 1, 1 - yes)
    return F.struct(F.round(yes, 4).alias("yes"), F.round(no, 4).alias("no"))


def piecewise(value: Column, mid: float, high: float) -> Column:
    """0 at 0, 50 at mid, 100 from high on, linear between."""
    return (
        F.when(value <= 0, 0.0)
        .when(value >= high, 100.0)
        .when(value >= mid, 50.0 + 50.0 * (value - mid) / (high - mid))
        .otherwise(50.0 * value / mid)
    )


def tokens(text: Column) -> Column:
    """The distinct lower-case words of a text without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def any_word(words: Sequence[str], whole: bool = True) -> str:
    """A regular expression that finds any of the words, longest first, as whole words unless told otherwise."""
    import re

    found = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"\b(?:{found})\b" if whole else f"(?:{found})"


def mentioned(text: Column, names: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """The names a text mentions, as a sorted array of upper-case canonical names; aliases map to theirs."""
    aliases = {k.upper(): v.upper() for k, v in (aliases or {}).items()}
    found = F.regexp_extract_all(F.upper(text), F.lit(any_word([n.upper() for n in names] + list(aliases))), F.lit(0))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        found = F.transform(found, lambda n: F.coalesce(F.try_element_at(table, n), n))
    return F.array_sort(F.array_distinct(found))


def matched_keywords(text: Column, keywords: Sequence[str] = ARTICLE_KEYWORDS, whole: bool = True) -> Column:
    """The keywords that stand in a text, as whole words unless told otherwise, in their own order."""
    lower = F.array(F.lower(F.coalesce(text, F.lit(""))))  # an array of one binds it, so it is made once a text
    # one search says which texts hold any; only these are asked for each keyword
    tests = [(k, any_word([k], whole)) for k in keywords]
    one = lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in tests]))
    found = F.transform(lower, lambda t: F.when(t.rlike(any_word(keywords, whole)), one(t)).otherwise(F.array().cast("array<string>")))
    return F.get(found, F.lit(0))


def is_relevant_code(code: Column) -> Column:
    return F.substring(code, 1, 2).isin(*RELEVANT_CODE_ROOTS)


def category(code: Column, names: dict[str, str], unknown: str = "Unknown") -> Column:
    """A code's name in a small fixed table."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.cast("string")), F.lit(unknown))


QUAD_CLASSES = {"1": "Verbal cooperation", "2": "Material cooperation", "3": "Verbal conflict", "4": "Material conflict"}
