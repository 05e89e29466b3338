"""Document fingerprints as Merkle trees over sections, paragraphs and pieces [native].

A text splits into sections at empty lines, into paragraphs at newlines, and a paragraph into pieces of at most 16
characters, cut at sentence ends: the leaves, whose digest is the first half of SHA-256 of their text. A paragraph's
digest is SHA-256 of its pieces' digests, a section's of its paragraphs', the root of its sections'. Joining the parts
gives the text back, so roots are equal exactly for equal texts (but for collisions).

Two trees are compared from the root down: children at the same place with equal digests are shared with all their
leaves and are not opened. What is open at the end are the paragraphs that differ, which locate() lists. Their pieces
are compared as two sets, so that text which only moved is found again. Likeness is the Dice coefficient over the
leaves: 1 for equal texts, near 0 for unrelated ones.

Defined cases: a null text counts as empty; two empty texts have likeness 1, an empty and a non-empty one 0; texts of
any length are read whole, in time that grows with their length; repeated rows have equal trees; rows of one id follow
each other by text, those equal in both in any order, as they are interchangeable; an empty table gives an empty table;
columns of the input named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import stored, without

PIECE = r"[^.!?]{1,16}[.!?]*|[.!?]+"
LEAF = 32  # hex digits of a piece's digest


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest, pieces: array<string>>>>>: the sections of a text."""

    def paragraph(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.left(F.sha2(x, 256), F.lit(LEAF)))
        return _bound(found, lambda pieces: F.struct(_digest(pieces).alias("digest"), pieces.alias("pieces")))

    def section(text: Column) -> Column:
        found = F.transform(F.split(text, "\n", -1), paragraph)
        return _bound(found, lambda ps: F.struct(_digest(F.transform(ps, lambda p: p["digest"])).alias("digest"), ps.alias("paragraphs")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)


def root(sections: Column) -> Column:
    return _digest(F.transform(sections, lambda s: s["digest"]))


def compare(a: Column, b: Column) -> Column:
    """struct(shared, own, other, differing): leaves in equal branches of two trees, the sets of pieces in the paragraphs
    that differ, and the places (section, paragraph) of these, from 0."""
    same = lambda x: x["a"]["digest"].eqNullSafe(x["b"]["digest"])
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda x, y: x + y)
    leaves = lambda paragraph: F.size(paragraph["pieces"])
    numbered = F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda x, i: F.struct(i.alias("at"), x["a"].alias("a"), x["b"].alias("b")))

    def opened(x: Column) -> Column:
        pairs = F.zip_with(F.coalesce(x["a"]["paragraphs"], F.array()), F.coalesce(x["b"]["paragraphs"], F.array()), lambda p, q: F.struct(p.alias("a"), q.alias("b")))
        return F.transform(pairs, lambda y, j: F.struct(x["at"].alias("section"), j.alias("paragraph"), y["a"].alias("a"), y["b"].alias("b")))

    def pieces(side: str, rows: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.filter(rows, lambda y: y[side].isNotNull()), lambda y: y[side]["pieces"])))

    def below(sections: Column) -> Column:
        whole = total(F.transform(F.filter(sections, same), lambda x: total(F.transform(x["a"]["paragraphs"], leaves))))

        def finish(paragraphs: Column) -> Column:
            shared = whole + total(F.transform(F.filter(paragraphs, same), lambda y: leaves(y["a"])))
            open_ = F.filter(paragraphs, lambda y: ~same(y))
            return F.struct(
                shared.alias("shared"), pieces("a", open_).alias("own"), pieces("b", open_).alias("other"),
                F.transform(open_, lambda y: F.struct(y["section"].alias("section"), y["paragraph"].alias("paragraph"))).alias("differing"),
            )

        return _bound(F.flatten(F.transform(F.filter(sections, lambda x: ~same(x)), opened)), finish)

    return _bound(numbered, below)


def likeness(found: Column) -> Column:
    """The Dice coefficient over leaves of two trees, from what compare() found."""
    total = 2 * found["shared"] + F.size(found["own"]) + F.size(found["other"])
    both = found["shared"] + F.size(F.array_intersect(found["own"], found["other"]))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def locate(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> of the paragraphs in which two trees differ."""
    return compare(a, b)["differing"]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with tree and fingerprint (the root in hex)."""
    out = without(docs, "tree", "fingerprint").withColumn("tree", tree(F.col(f"`{text}`")))
    return out.withColumn("fingerprint", root(F.col("tree")))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of the last bound at or below key, 0 if there is none: a binary search over a constant array."""
    if len(bounds) < 2:
        return F.lit(0)
    array = F.lit(bounds)
    steps = [1 << i for i in reversed(range((len(bounds) - 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step < len(bounds)) & (F.get(array, at + step) <= key), at + step).otherwise(at),
    )


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 2000, most_buckets: int = 65536) -> DataFrame:
    """docs with next_text, the text of the next row by key; the last row gets the first row's.

    Rows of the same key follow each other by text; a null key comes first. Keys are cut into ranges of about equal
    counts, whose bounds (at most most_buckets numbers) are keys themselves. Each range is one window group, and the
    first row of a range stands again at the end of the range before, so texts move once and no task gets them all.
    """
    order = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))
    keys = docs.select(order.alias("k"))
    n = keys.count()
    ranges = max(1, min(most_buckets, -(-n // rows_per_bucket)))
    firsts = keys.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("range")).agg(F.min("k").alias("k"))
    bounds = sorted(r["k"] for r in firsts.collect())
    rows = without(docs, "next_text").withColumn("_k", order)
    at = _bucket(F.col("_k"), bounds)
    is_first = F.get(F.lit(bounds), at) == F.col("_k") if bounds else F.lit(False)
    before = F.when(at == 0, max(0, len(bounds) - 1)).otherwise(at - 1)
    places = F.when(is_first, F.array(F.struct(at.alias("bucket"), F.lit(0).alias("guest")), F.struct(before.alias("bucket"), F.lit(1).alias("guest"))))
    places = places.otherwise(F.array(F.struct(at.alias("bucket"), F.lit(0).alias("guest"))))
    rows = rows.withColumn("_at", F.explode(places))
    w = Window.partitionBy("_at.bucket").orderBy("_at.guest", "_k", F.col(f"`{text}`").asc_nulls_first())
    rows = rows.withColumn("next_text", F.lead(F.struct(F.col(f"`{text}`").alias("t"))).over(w)["t"])
    return rows.where("_at.guest = 0").drop("_k", "_at")


def edited(text: Column, following: Column) -> Column:
    """text, whose last half is replaced by as many leading characters of the following text (all, if it has fewer)."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> fingerprints of each text and its edited text, likenesses to the edited and the next text, and
    where the edit lies: the number of paragraphs that differ and the first one's place in its section (-1: none)."""
    rows = with_next(docs.select("doc_id", "text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("new"), tree(F.col("next_text")).alias("next"),
    )
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", root(F.col("own")).alias("fingerprint"), root(F.col("new")).alias("edited_fingerprint"),
        compare(F.col("own"), F.col("new")).alias("edit"), compare(F.col("own"), F.col("next")).alias("far"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("edit")).alias("near_edited"), likeness(F.col("far")).alias("near_next"),
        F.size("edit.differing").cast("long").alias("n_differing"), F.coalesce(F.get("edit.differing", F.lit(0))["paragraph"], F.lit(-1)).cast("long").alias("first_paragraph"),
    )
