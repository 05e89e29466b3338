"""Similarity joins of token sets."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.operators.core import top_per_group, union_all
from confluo.sources.scratch import materialised

HOT = 512
MANY, DEPTH = 64, 4


def _needed(size_a: Column, size_b: Column, at_least: float) -> Column:
    """How many tokens two sets of these sizes share at least, if their Jaccard similarity reaches the bound."""
    return F.ceil((size_a + size_b) * (at_least / (1 + at_least)) - 1e-9).cast("int")


def _signed(sets: DataFrame, often: DataFrame, at_least: float) -> DataFrame:
    """(id, tokens rarest first, size, sign, last): single tokens, for partners that need one token in common, and pairs of
    tokens, for those that need two or more. last is the position of a signature's last token."""
    counted = sets.select("id", F.explode("tokens").alias("token")).join(often, "token")
    words = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("words"))
    words = words.select("id", F.transform("words", lambda w: w["token"]).alias("tokens"), F.size("words").alias("size"))
    smallest, largest = F.ceil(F.col("size") * at_least - 1e-9).cast("int"), F.floor(F.col("size") / at_least + 1e-9).cast("int")
    one = F.transform("tokens", lambda t, i: F.struct(t.alias("sign"), i.alias("last")))
    # sets that share k tokens share two among the first size - k + 2 of each
    reach = F.col("size") - F.greatest(F.lit(2), _needed(F.col("size"), smallest, at_least)) + 2
    two = F.flatten(F.transform(F.slice("tokens", F.lit(1), reach), lambda t, i: F.transform(F.slice("tokens", F.lit(1), i), lambda u: F.struct(F.concat_ws(" ", u, t).alias("sign"), i.alias("last")))))
    none = F.array().cast("array<struct<sign:string,last:int>>")
    signs = F.concat(
        F.when(_needed(F.col("size"), smallest, at_least) <= 1, one).otherwise(none),
        F.when(_needed(F.col("size"), largest, at_least) >= 2, two).otherwise(none),
    )
    return words.select("id", "tokens", "size", F.explode(signs).alias("s")).select("id", "tokens", "size", "s.sign", "s.last")


def _dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part: a signature of many sets is dealt out, its left sets to parts, its right sets to all of them."""
    hot = a.groupBy("sign").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("sign", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    part = F.coalesce("parts", F.lit(1))
    a = a.join(hot, "sign", "left").withColumn("part", F.pmod(F.xxhash64("id"), part).cast("int")).drop("parts")
    return a, b.join(hot, "sign", "left").withColumn("part", F.explode(F.sequence(F.lit(0), part - 1))).drop("parts")


def candidates(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(left_id, left_tokens, right_id, right_tokens, sign): pairs that share a signature that both may use."""
    often = left.select("tokens").union(right.select("tokens")).select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    a, b = (_signed(x.select("id", F.array_distinct("tokens").alias("tokens")), often, at_least) for x in (left, right))
    a, b = _dealt(a, b)
    a, b = (x.select("sign", "part", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "tokens", "size", "last")]) for side, x in (("left", a), ("right", b)))
    k = _needed(F.col("left_size"), F.col("right_size"), at_least)
    long_enough = (F.col("left_size") >= at_least * F.col("right_size") - 1e-9) & (F.col("right_size") >= at_least * F.col("left_size") - 1e-9)
    in_reach = (F.col("left_last") < F.col("left_size") - k + 2) & (F.col("right_last") < F.col("right_size") - k + 2)
    single = ~F.contains("sign", F.lit(" "))
    found = a.join(b, ["sign", "part"]).where(long_enough & F.when(k <= 1, single).otherwise(~single & in_reach))
    return found.select("left_id", "left_tokens", "right_id", "right_tokens", "sign")


def similar_sets(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(id, tokens) of both sides -> (left_id, right_id, similarity) of all pairs with a Jaccard similarity of at least the bound.

    Exact, by an equi-join. A pair at the bound shares a number of tokens that follows from the sizes of both sets. Where
    one is enough, every shared token makes a candidate, and every candidate is a pair. Where two or more are needed,
    candidates share a pair of tokens among the first of each set, rarest first, as far as that number allows; so words
    that stand everywhere make candidates only of sets that share two of them. A pair that shares several signatures is
    taken at the first of its common tokens alone, so nothing is made distinct afterwards. Tokens hold no spaces; empty
    sets are similar to nothing; ids are unique on each side.
    """
    pair, sizes = F.contains("sign", F.lit(" ")), F.size("left_tokens") + F.size("right_tokens")

    def judged(both: Column) -> Column:
        first = F.when(pair, F.concat_ws(" ", F.slice(both, 1, 2))).otherwise(F.get(both, F.lit(0)))
        return F.when(F.col("sign") == first, F.size(both) / (sizes - F.size(both)))

    # an array of one binds the common tokens, so they are made once a candidate
    similarity = F.get(F.transform(F.array(F.array_intersect("left_tokens", "right_tokens")), judged), F.lit(0))
    found = candidates(left, right, at_least).select("left_id", "right_id", similarity.alias("similarity"))
    return found.where(F.col("similarity") >= at_least - 1e-12)


def _numbered(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with numbers for tokens, in order, the rarest first, and the sets' sizes; stored, as they are read often."""
    every = left.select("tokens").union(right.select("tokens")).select(F.explode("tokens").alias("token"))
    often = every.groupBy("token").agg(F.count("*").alias("n")).orderBy("n", "token")
    known = materialised(often.select("token", F.monotonically_increasing_id().alias("number")), "tokens")

    def coded(name: str, sets: DataFrame) -> DataFrame:
        numbers = sets.select("id", F.explode("tokens").alias("token")).join(known, "token").groupBy("id").agg(F.array_sort(F.collect_list("number")).alias("tokens"))
        return materialised(sets.drop("tokens").join(numbers, "id").withColumn("size", F.size("tokens")), name)

    with ThreadPoolExecutor(2) as pool:
        return tuple(pool.map(coded, ("left-sets", "right-sets"), (left, right)))


def _least_needed(at_least: float) -> Column:
    """How many tokens a set shares with any partner at least."""
    return _needed(F.col("size"), F.ceil(F.col("size") * at_least - 1e-9).cast("int"), at_least)


def _longer(rows: DataFrame, level: int, at_least: float) -> DataFrame:
    """Each signature with one more of the set's later tokens, as far back as the first common tokens of a pair may stand."""
    reach = F.col("size") - F.greatest(F.lit(level), _least_needed(at_least)) + level
    later = F.slice("tokens", F.col("last") + 2, F.greatest(F.lit(0), reach - F.col("last") - 1))
    grown = F.transform(later, lambda t, i: F.struct(F.array_append("sign", t).alias("sign"), (F.col("last") + 1 + i).alias("last")))
    return rows.withColumn("_grown", F.explode(grown)).withColumns({"sign": F.col("_grown.sign"), "last": F.col("_grown.last")}).drop("_grown")


def _met(a: DataFrame, b: DataFrame, keys: list[str], level: int, at_least: float, only: bool) -> DataFrame:
    """Pairs of a signature that is their first common tokens (and, with only, all of them), with similarities."""
    one, two = (x.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("id", "tokens", "size", "last")], *more) for side, x, more in (("left", a, [] if only else ["marks"]), ("right", b, ["first"] if only else ["places"])))
    k, sizes = _needed(F.col("left_size"), F.col("right_size"), at_least), F.col("left_size") + F.col("right_size")
    long_enough = (F.col("left_size") >= at_least * F.col("right_size") - 1e-9) & (F.col("right_size") >= at_least * F.col("left_size") - 1e-9)
    # from a signature's last token on, both sets have as many tokens as are needed
    in_reach = (F.col("left_last") < F.col("left_size") - k + level) & (F.col("right_last") < F.col("right_size") - k + level)
    found = one.join(two, keys).where(long_enough & ((k <= level) if only else in_reach))
    first = lambda c: (c == F.col("sign")) if only else (F.slice(c, 1, level) == F.col("sign"))
    judged = lambda c: F.when(first(c), F.size(c) / (sizes - F.size(c)))
    return found.withColumn("similarity", F.get(F.transform(F.array(F.array_intersect("left_tokens", "right_tokens")), judged), F.lit(0))).where(F.col("similarity") >= at_least - 1e-12)


def best_partners(left: DataFrame, right: DataFrame, at_least: float, most: int, score: Callable[[Column, Column], Column]) -> DataFrame:
    """left (id, tokens, marks) and right (id, tokens, places), places an array of (mark, first) -> of each left set and mark
    the `most` right sets of this mark by score, then by first: (left_id, mark, right_id, first, score).

    score(similarity, mark) never falls with the similarity and is null where a pair does not count; pairs count from
    at_least on. Exact, without making all pairs. A pair meets at its first common token, rarest first. Where more than
    MANY right sets have a token, the signature grows: pairs with more common tokens meet at their first two, and so on.
    Pairs that have no more in common than such a signature are alike for all right sets of one size, so of these only the
    first ones of each size and mark are asked. Signatures of DEPTH tokens are dealt out, whatever their number.
    Ids are unique and sets distinct on each side; tokens of a set are distinct.
    """
    a, b = (x.withColumns({"sign": F.array().cast("array<long>"), "last": F.lit(-1)}) for x in _numbered(left, right))
    found = []
    for level in range(1, DEPTH + 1):
        a, b = (_longer(x, level, at_least) for x in (a, b))
        if level == DEPTH:
            found.append(_met(*_dealt(a, b), ["sign", "part"], level, at_least, False))
            break
        hot = materialised(b.groupBy("sign").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("sign"), "hot-signs")
        if hot.isEmpty():
            found.append(_met(a, b, ["sign"], level, at_least, False))
            break
        found.append(_met(*(x.join(hot, "sign", "left_anti") for x in (a, b)), ["sign"], level, at_least, False))
        a, b = (x.join(hot, "sign", "left_semi") for x in (a, b))
        # no more in common than the signature: of the right sets of one size the first ones do
        one, two = (x.where(_least_needed(at_least) <= level) for x in (a, b))
        first = top_per_group(two.select("sign", "size", "last", "id", "tokens", F.explode("places").alias("p")).select("*", "p.mark", "p.first"), ["sign", "size", "mark"], most, F.col("first"))
        found.append(_met(one.withColumn("mark", F.explode("marks")), first, ["sign", "mark"], level, at_least, True))
    common = F.filter("places", lambda p: F.array_contains("marks", p["mark"]))
    pairs = [x if "first" in x.columns else x.withColumn("_place", F.explode(common)).select("*", "_place.mark", "_place.first") for x in found]
    scored = union_all([x.select("left_id", "mark", "right_id", "first", score(F.col("similarity"), F.col("mark")).alias("score")) for x in pairs]).where("score IS NOT NULL")
    return top_per_group(scored, ["left_id", "mark"], most, F.desc("score"), F.col("first")).drop("rank")
