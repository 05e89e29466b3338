"""Personal data in texts [native].

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges for addresses
and identity numbers), and words near a span adjust its score; a span counts from THRESHOLD on. Nearby is at most NEAR characters away and not past
a neighbouring match of the same kind. The kinds of BASE (email, ip, card, phone) count whenever their own rule holds.
The method adds to these: IBANs (of the length that their country has), identity numbers in the form ddd-dd-dddd, MAC
addresses, dates of birth, and card numbers written with dots.

Everything is DataFrame functions. A pattern is searched in linear time: runs are taken possessively, and a match may
start inside a run only where the one before it ended. Offsets come from the lengths of the pieces between matches.

Defined cases: a null text counts as empty and has no spans; a redacted null stays null; texts of any length are
searched whole; overlapping spans of different kinds are all reported, and are redacted as one; repeated rows have
equal spans; an empty table gives an empty table; columns of the input named like those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import without

THRESHOLD = 0.6
NEAR = 40
NEEDED = "[0-9@:]"
CHUNK = 256
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = r"[A-Za-z0-9._%+-]"

# fixed values: how long the account numbers of each country are
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Country, check digits and the rest in groups of four with or without a space before each."""
    kinds = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        last = rf" ?[A-Z0-9]{{{rest}}}" if rest else ""
        kinds.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(kinds)})(?![A-Za-z0-9])"


# kind: (what a text must hold, pattern, score by itself, score once confirmed, words that raise it by 0.35)
BASE = ("email", "ip", "card", "phone")
KINDS: dict[str, tuple[str, str, float, str]] = {
    "email": (r"@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write|kontakt|correo|courriel"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|login"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", 0.8, r"card|visa|payment|karte|tarjeta|carte"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"phone|call|tel|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone"),
    "iban": (r"[A-Z]{2}[0-9]{2}", _iban(), 0.9, r"iban|account|konto|compte|cuenta"),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, r"ssn|social security|identity|national id|tax id"),
    "mac": (r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", 0.7, r"mac|device|ethernet|hardware"),
    "birth": (r"[0-9][-/.][0-9]", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/.-])", 0.3, r"born|birth|\bdob\b|geboren|geburt|nacid|nacimiento|n[eé]e? le|naissance"),
    "dotcard": (r"[0-9]{4}\.[0-9]{4}", r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])", 0.7, r"card|visa|payment|karte|tarjeta|carte"),
}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether a number's digits pass the Luhn check."""
    digits = F.transform(F.regexp_extract_all(F.reverse(hit), F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an IBAN's check number holds: its first four characters last, letters as 10 to 35, remainder 1."""
    moved = F.concat(F.substring(hit, F.lit(5), F.length(hit)), F.substring(hit, 1, 4))
    values = F.transform(F.regexp_extract_all(moved, F.lit("[0-9A-Z]"), F.lit(0)), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind in ("card", "dotcard"):
        return luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(hit)
    if kind == "ssn":
        return hit.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    if kind == "birth":
        return hit.rlike(r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|[12][0-9]|3[01])[./](?:19|20)[0-9]{2})$")
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """All spans of a kind that count, in order, with code-point offsets (end exclusive)."""
    needs, pattern, score, words = KINDS[kind]
    none = F.array().cast(SPAN)

    def scored(hit: Column, before: Column, after: Column) -> Column:
        around = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))))
        value = F.least(F.lit(1.0), score + F.when(around.rlike(words), 0.35).otherwise(0.0))
        if kind in BASE:  # these count by their own rule
            value = F.greatest(F.lit(THRESHOLD), value)
        return F.when(confirmed(kind, hit), value).otherwise(0.0)

    def rows(found: Column) -> Column:
        """For each match the length of the text between the last match and it, its own length and its score."""
        return F.transform(
            found["hits"],
            lambda hit, i: F.struct(
                F.length(F.get(found["pieces"], i)).alias("gap"),
                F.length(hit).alias("size"),
                scored(hit, F.get(found["pieces"], i), F.get(found["pieces"], i + 1)).alias("score"),
            ),
        )

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        end = start + row["size"]
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), row["score"].alias("score")))
        return F.struct(end.alias("at"), F.when(row["score"] >= THRESHOLD, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    # an array of one binds both results, so that each is made once a text and not once a match
    found = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces")))
    matches = F.transform(found, rows)
    nothing = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def in_chunks(all_rows: Column) -> Column:
        """Walk along CHUNK matches at a time, then shift each chunk's spans to its place."""
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_rows)), F.lit(CHUNK))
        chunks = F.transform(starts, lambda i: F.aggregate(F.slice(all_rows, i, F.lit(CHUNK)), nothing, step))
        return F.aggregate(chunks, nothing, append, lambda state: state["found"])

    def append(state: Column, chunk: Column) -> Column:
        moved = F.transform(
            chunk["found"],
            lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + state["at"]).alias("start"), (x["end"] + state["at"]).alias("end"), x["score"].alias("score")),
        )
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["found"], moved).alias("found"))

    walked = F.flatten(F.transform(matches, in_chunks))
    return F.when(text.rlike(needs), walked).otherwise(none)


def spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>>: all spans of a text, by kind as in KINDS, then start."""
    whole = F.coalesce(text, F.lit(""))
    found = F.concat(*[spans_of(kind, whole) for kind in KINDS])
    # every kind holds a digit, an at sign or a colon, and most texts do not
    return F.when(whole.rlike(NEEDED), found).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with spans."""
    return without(docs, "spans").withColumn("spans", spans(F.col(f"`{text}`")))


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; overlapping spans become one, of the kind that starts first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their personal data replaced in place."""
    whole = F.col(f"`{text}`")
    # an array of one binds the spans, so that they are searched once
    return docs.withColumn(text, F.get(F.transform(F.array(spans(whole)), lambda found: redacted(whole, found)), F.lit(0)))
