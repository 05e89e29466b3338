"""Spelling variants: frequent words that differ by one inserted, deleted or replaced code point, from blocked Gram matrices.

Words are counted by Spark. A word is then a vector of letter counts: the alphabet is every code point that words may
hold. One edit changes one count by one (insertion, deletion) or two counts by one (replacement), so the squared
distance of two near words is 1 or 2, and their lengths differ by at most one. Words lie in blocks of one length and one
number of letters from each of CLASSES fixed classes of the alphabet; near words lie in the same block or in an adjacent
one, where one class has a letter more or less, or one has a letter more and another a letter less. A block with over
CHUNK words is cut into chunks by a hash. A task meets two chunks: the NumPy product of their count matrices gives all
squared distances, |a|^2 + |b|^2 - 2ab; pairs at 1 or 2 are kept and their edit is verified on the code points. Only near
pairs leave a task.

Forms and roots are Spark joins: a word's form is its most frequent near word, if that is FORM times as frequent; roots
follow forms by pointer doubling, so n links take log2(n) joins. Frequencies grow along a chain, so it ends.

Memory of a task: a batch of pairs of chunks. A chunk goes to as many tasks as its block's neighbours have chunks. Nothing
passes the driver but whether a root still moves.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string in the planted deletions;
repeated rows count again; ties of frequency go to the smallest word in code-point order; a word of any length is a
word; an empty table gives an empty table; other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import drop_stored, stored

LEAST_LETTERS, LEAST_N, FORM = 6, 5, 5
CHUNK, CHUNK_LETTERS, CLASSES = 2048, 400_000, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = [*LOWER, *(chr(c) for c in range(0xC0, 0x100))]


def runs(text: Column, least: int = LEAST_LETTERS) -> Column:
    """Maximal runs of letters with at least so many, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))


def planted(doc_id: Column, run: Column, every: int = 199) -> Column:
    """The run, less one of its code points where a hash of it and its document's id is divisible by `every`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, every: int = 199) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    each = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))  # one letter may go: shorter runs give no words
    words = each.select(planted(F.col("doc_id"), F.col("run"), every).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_N))


def _in_class(word: Column, number: int) -> Column:
    """How many of the word's letters are in a class of the alphabet, every CLASSES-th letter."""
    return F.length(word) - F.length(F.translate(word, "".join(LETTERS[number::CLASSES]), ""))


def _steps() -> list[tuple[int, ...]]:
    """To a block itself and to those of its neighbours that come after it: what one edit may change in the classes."""
    unit = [tuple(int(i == k) for i in range(CLASSES)) for k in range(CLASSES)]
    minus = lambda x, y: tuple(p - q for p, q in zip(x, y))
    none = (0,) * CLASSES
    return [none, *unit, *[minus(x, y) for x, y in permutations(unit, 2) if minus(x, y) > none]]


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix padded with zeros, lengths)."""
    lengths = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(lengths.max(initial=0)) + 1), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out, lengths


def _counts(points: np.ndarray) -> np.ndarray:
    exact = np.float32 if points.shape[1] < 2000 else np.float64  # sums of squares stay whole numbers
    number = np.full(0x100, len(LETTERS), np.int64)
    number[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    width = len(LETTERS) + 1
    flat = (np.arange(len(points))[:, None] * width + number[points]).ravel()
    return np.bincount(flat, minlength=len(points) * width).reshape(-1, width)[:, :-1].astype(exact)


def one_edit(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether rows of padded code points differ by exactly one inserted, deleted or replaced code point."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    swap = (n_a > n_b)[:, None]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    n = np.minimum(n_a, n_b)
    at = np.arange(width)
    same = short == long
    replaced = (~same).sum(axis=1) == 1
    # one more letter: equal up to some place, and from there on one place later
    before = np.where(same, width, at).min(axis=1)
    later = short[:, :-1] == long[:, 1:]
    inserted = (later | (at[:-1] < before[:, None]) | (at[:-1] >= n[:, None])).all(axis=1)
    return np.where(n_a == n_b, replaced, (abs(n_a - n_b) == 1) & inserted)


def near_words(a: list[str], b: list[str], rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of near words (i of a, j of b)."""
    points_a, n_a = _code_points(a)
    points_b, n_b = _code_points(b)
    counts_a, counts_b = _counts(points_a), _counts(points_b)
    norm_a, norm_b = (counts_a**2).sum(axis=1), (counts_b**2).sum(axis=1)
    left, right = [], []
    for x in range(0, len(a), rows):
        distance = norm_a[x : x + rows, None] + norm_b[None] - 2 * (counts_a[x : x + rows] @ counts_b.T)
        i, j = np.nonzero((distance > 0.5) & (distance < 2.5))
        i += x
        for y in range(0, len(i), most := max(1, 2_000_000 // points_a.shape[1])):
            p, q = i[y : y + most], j[y : y + most]
            good = one_edit(points_a[p], points_b[q], n_a[p], n_b[q])
            left.append(p[good])
            right.append(q[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, other, other_n): all near pairs, in both directions."""
    blocked = words.select("word", "n", F.array(*[_in_class(F.col("word"), k) for k in range(CLASSES)]).alias("block"))
    fit = F.greatest(F.lit(1.0), F.least(F.lit(CHUNK), F.lit(CHUNK_LETTERS) / F.first(F.length("word"))))
    sizes = stored(blocked.groupBy("block").agg(F.ceil(F.count("*") / fit).cast("int").alias("chunks")), "spelling-sizes")
    # a chunk is one row, of CHUNK words or so
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    chunks = blocked.join(sizes, "block").groupBy("block", chunk.alias("i")).agg(F.collect_list(F.struct("word", "n")).alias("held"))
    chunks = stored(chunks.select("block", "i", F.transform("held", lambda h: h["word"]).alias("words"), F.transform("held", lambda h: h["n"]).alias("ns")), "spelling-chunks")
    moved = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _steps()])
    other = F.transform(moved, lambda s: F.zip_with(s, F.col("block"), lambda x, y: x + y))
    pairs = sizes.select("block", "chunks", F.explode(other).alias("block_b")).join(sizes.select(F.col("block").alias("block_b"), F.col("chunks").alias("chunks_b")), "block_b")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tasks = pairs.withColumn("i", F.explode(every("chunks"))).withColumn("j", F.explode(every("chunks_b"))).drop("chunks", "chunks_b")
    tasks = tasks.where((F.col("block") != F.col("block_b")) | (F.col("i") <= F.col("j")))  # within a block two chunks meet once
    of = lambda side, block, i: chunks.select(F.col("block").alias(block), F.col("i").alias(i), F.col("words").alias(f"words_{side}"), F.col("ns").alias(f"ns_{side}"))
    met = tasks.join(of("a", "block", "i"), ["block", "i"]).join(of("b", "block_b", "j"), ["block_b", "j"])
    same = (F.col("block") == F.col("block_b")) & (F.col("i") == F.col("j"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                alone, a, n_a, b, n_b = (batch.column(k)[row].as_py() for k in range(5))
                i, j = near_words(a, b)
                if len(i):
                    i, j = i.tolist(), j.tolist()
                    word, other, other_n = [a[x] for x in i], [b[y] for y in j], [n_b[y] for y in j]
                    if not alone:
                        word, other, other_n = word + other, other + word, other_n + [n_a[x] for x in i]
                    yield pa.record_batch([pa.array(word, pa.string()), pa.array(other, pa.string()), pa.array(other_n, pa.int64())], names=["word", "other", "other_n"])

    return met.select(same.alias("alone"), "words_a", "ns_a", "words_b", "ns_b").mapInArrow(run, "word string, other string, other_n long")


def variants(docs: DataFrame, every: int = 199) -> DataFrame:
    """(doc_id, text) -> (word, form, root, n, n_near, form_n)."""
    words = stored(word_counts(docs, every), "spelling-words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("most"))
    found = words.join(near, "word", "left").withColumn("_form", -F.col("most")["less"] >= FORM * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_form"), F.col("most")["other"]).alias("form"), F.when(F.col("_form"), -F.col("most")["less"]).alias("form_n"))
    found = stored(found, "spelling-forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(found: DataFrame) -> DataFrame:
    """(word, form) -> (word, root) of the words that have a form: the last word on the way along forms."""
    links = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_stored(links)
        links = moved
        if links.where("moved").isEmpty():
            return links.drop("moved")
