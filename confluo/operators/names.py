"""Names in texts by joins: a dictionary of any size, longest match first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary(aliases: DataFrame) -> DataFrame:
    """(alias, name) -> (gram, words, first, name) in upper case. An alias starts and ends with a letter, digit or underscore;
    what stands around these is cut off, and an alias without any is none. Of two names of an alias the first stays."""
    gram = F.regexp_extract(F.upper("alias"), r"\w(?:.*\w)?", 0)
    rows = aliases.select(gram.alias("gram"), F.upper("name").alias("name")).where(F.col("gram") != "")
    rows = rows.groupBy("gram").agg(F.min("name").alias("name"))
    words = F.regexp_extract_all("gram", F.lit(r"\w+"), F.lit(0))
    return rows.select("gram", F.size(words).alias("words"), F.get(words, F.lit(0)).alias("first"), "name")


def names_in(texts: DataFrame, aliases: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, names): the names that each text mentions as whole words, sorted; texts without any are left out.

    Texts are cut to words; only those with which some alias starts go on, with as many words as such an alias has, and
    meet the dictionary by equality. Of a text's matches the first wins, at one place the longest, and none overlap, as
    if one pattern of all aliases were searched from left to right. ids are unique. The text between words counts: an
    alias with one space does not match two. The dictionary is joined, never collected, so it may have any size.
    """
    known = dictionary(aliases)
    most = known.agg(F.max("words")).first()[0]
    if most is None:
        return texts.sparkSession.createDataFrame([], texts.select(F.col(id_col).alias("id"), F.array(F.lit("")).alias("names")).schema)
    starts = known.groupBy("first").agg(F.collect_set("words").alias("lengths"))  # of one word: a few lengths
    pieces = texts.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.upper(text), F.lit(r"\w+|\W+"), F.lit(0)).alias("pieces"))
    each = pieces.select("id", F.posexplode(F.transform("pieces", lambda _, i: F.slice("pieces", i + 1, 2 * most - 1))).alias("at", "near"))
    begun = each.withColumn("first", F.get("near", F.lit(0))).where(F.col("first").rlike(r"^\w")).join(starts, "first").select("id", "at", "near", F.explode("lengths").alias("words"))
    grams = begun.where(F.size("near") >= 2 * F.col("words") - 1).select("id", "at", "words", F.array_join(F.slice("near", F.lit(1), 2 * F.col("words") - 1), "").alias("gram"))
    met = grams.join(known.select("gram", "name"), "gram")
    ordered = F.array_sort(F.collect_list(F.struct("at", (-F.col("words")).alias("less"), "name")))
    none = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("names"))
    taken = lambda x, m: F.when(m["at"] >= x["free"], F.struct((m["at"] - 2 * m["less"] - 1).alias("free"), F.when(F.array_contains(x["names"], m["name"]), x["names"]).otherwise(F.array_append(x["names"], m["name"])).alias("names"))).otherwise(x)
    found = met.groupBy("id").agg(ordered.alias("matches")).select("id", F.reduce("matches", none, taken)["names"].alias("names"))
    return found.select("id", F.array_sort("names").alias("names"))
