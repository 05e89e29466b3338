"""Language identification by averaged hashed subword embeddings.

A text is lower-cased, every run of characters that are not letters becomes one boundary, and its subwords of 2 to 4
units (with the boundary at either end) are hashed into buckets. The embeddings of a text's subwords are averaged over
the whole text and a linear softmax reads the language off. Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample of whole documents: about `per_language` of each language, and about
`most_documents` in all, whichever is less, each language thinned alike. Executors turn the documents into counts of
buckets, pairs of numbers; documents are taken, of each language alike, while their pairs are at most `most_pairs` (2^25,
or 256 MB on the driver), one of fewer than LEAST_PAIRS counting as so many. A tenth of the sample is
kept apart: on it a temperature calibrates the probabilities and a rejection threshold is set, below which `accepted`
is false.

Defined cases: a null text, or one without any letter, is `und` with score 0 and not accepted; texts of any length are
read whole, in training too; rows whose language is null are not learned from but predicted like all; where there is
nothing to learn from, every text is `und`; of languages with equal probability the first by name is given; repeated
rows are predicted alike, and stand in the sample once; an empty table gives an empty table; columns of the
input named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import drop_stored, stored, without

UNKNOWN = "und"
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)
LEAST_PAIRS = 1024
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which UTF-16 units are letters; halves of pairs count as letters."""
    if not _letters:
        _letters.append(np.array([0xD800 <= c < 0xE000 or chr(c).isalpha() for c in range(1 << 16)]))
    return _letters[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every subword of the texts one after the other, and how many each text has."""
    raw = [np.frombuffer(t.lower().encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    gap = np.zeros(1, np.uint16)
    units = np.concatenate([gap, *[x for r in raw for x in (r, gap)]])
    owner = np.repeat(np.arange(len(texts) + 1), [1, *[len(r) + 1 for r in raw]])
    units = np.where(_letter_table()[units], units, 0).astype(np.uint32)
    kept = (units != 0) | np.concatenate([[True], units[:-1] != 0])  # of a run of boundaries the first
    units, owner = units[kept], owner[kept]
    found, owners = [], []
    value = units.astype(np.uint32)
    inside = np.ones(len(units), bool)
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            # value[i] covers units i to i+n-1; only its two ends may be boundaries
            inside = inside[: len(units) - n + 1]
            if n > 2:
                inside = inside & (units[n - 2 : -1] != 0)
            value = value[: len(units) - n + 1] * np.uint32(0x01000193) + units[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                good = np.flatnonzero(inside & ((units[: len(value)] != 0) | (units[n - 1 :] != 0)))
                mixed = value[good]
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                found.append((mixed >> np.uint32(15)).astype(np.int32))
                # the boundary before a text belongs to the text before it, so a subword's text is that of its second unit
                owners.append(owner[good + 1] - 1)
    ids, own = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return ids[order], np.bincount(own, minlength=len(texts))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: list[str]) -> np.ndarray:
        ids, counts = subwords(texts)
        return _softmax((_means(self.table, ids, counts) + self.bias) / self.temperature)


def _means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean table row over each text's subwords, 1 << 16 subwords at a time."""
    out = np.zeros((len(counts), table.shape[1]))
    stops = np.cumsum(counts)
    for a in range(0, len(ids), 1 << 16):
        part = ids[a : a + (1 << 16)]
        texts = np.searchsorted(stops, np.arange(a, a + len(part)), side="right")
        cut = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        out[texts[cut]] += np.add.reduceat(table[part], cut, axis=0)
    return out / np.maximum(counts, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's subwords in order, and how often each occurs."""
    return np.unique(subwords([text])[0], return_counts=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], langs: list[str], dims: int = 16, epochs: int = 6, batch: int = 32, rate: float = 4.0, seed: int = 1) -> Model:
    """Stochastic gradient descent on embeddings and softmax over documents' bucket counts, then calibration on every
    tenth document."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    y = np.searchsorted(names, langs)
    sizes = np.array([len(ids) for ids, _ in features])
    # a document's mean is the sum of its buckets' embeddings times their shares
    shares = [(counts / max(1, counts.sum())).astype(np.float32) for _, counts in features]
    rng = np.random.default_rng(seed)
    held = np.arange(len(features)) % 10 == 9 if len(features) >= 50 else np.zeros(len(features), bool)
    embed = (rng.random((BUCKETS, dims), np.float32) - 0.5) / dims
    weights = np.zeros((dims, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    learn = np.flatnonzero(~held & (sizes > 0))

    def joined(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([features[i][0] for i in part]), np.concatenate([shares[i] for i in part]), np.cumsum(sizes[part]) - sizes[part]

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            if not len(part):
                continue
            own, share, cuts = joined(part)
            mean = np.add.reduceat(embed[own] * share[:, None], cuts, axis=0)
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(part)), y[part]] -= 1
            error = (error / len(part)).astype(np.float32)
            back = error @ weights.T
            weights -= step * (mean.T @ error).astype(np.float32)
            bias -= step * 0.1 * error.sum(axis=0)
            slots, where = np.unique(own, return_inverse=True)
            pull = back[np.repeat(np.arange(len(part)), sizes[part])] * share[:, None]
            grad = np.stack([np.bincount(where, weights=pull[:, d], minlength=len(slots)) for d in range(dims)], axis=1)
            embed[slots] -= (step * len(part) * 4 * grad).astype(np.float32)
    model = Model(names, embed @ weights, bias.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(held & (sizes > 0))
    if len(check):
        own, share, cuts = joined(check)
        logits = np.add.reduceat(model.table[own] * share[:, None], cuts, axis=0) + model.bias
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
        model.temperature = float(min(losses, key=losses.get))
        best = _softmax(logits / model.temperature)
        right = best.argmax(axis=1) == y[check]
        if right.any():  # 99 of 100 right answers are accepted
            model.reject_below = float(min(0.5, np.quantile(best.max(axis=1)[right], 0.01)))
    return model


def training_sample(docs: DataFrame, per_language: int, most_documents: int, most_pairs: int = 1 << 25, seed: int = 3) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Bucket counts and languages of whole documents, drawn by a hash of id and text."""
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / F.lit(float(1 << 53))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # stored, so that Spark knows its size before it plans the join and need not shuffle texts for it
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("_n")), "langid-counts")
    share = min(float(per_language), most_documents / max(1, counts.count()))
    chosen = known.join(counts, "lang").withColumn("_draw", draw).where(F.col("_draw") < F.lit(share) / F.col("_n"))
    chosen = chosen.groupBy("lang", "_draw", "_n").agg(F.first("text").alias("text"))  # repeated rows once

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket_counts(t) for t in batch.column(3).to_pylist()]
            packed = [pa.array([x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            pairs = pa.array([max(LEAST_PAIRS, len(x[0])) for x in found], pa.int64())
            yield pa.record_batch([*batch.columns[:3], pairs, *packed], names=["lang", "_draw", "_place", "pairs", "ids", "counts"])

    place = F.col("_draw") * F.col("_n")  # among the documents of its language
    schema = "lang string, _draw double, _place double, pairs long, ids binary, counts binary"
    found = stored(chosen.select("lang", "_draw", place.alias("_place"), "text").mapInArrow(count, schema), "langid-sample")
    by_place = Window.orderBy("_place", "_draw", "lang").rowsBetween(Window.unboundedPreceding, 0)
    fits = found.select("_place", "_draw", "lang", "pairs").withColumn("so_far", F.sum("pairs").over(by_place)).where(F.col("so_far") <= most_pairs).select("_place", "_draw", "lang")
    rows = found.join(fits, ["_place", "_draw", "lang"], "left_semi").select("lang", "_draw", "ids", "counts").collect()
    drop_stored(found)
    rows.sort(key=lambda r: (r["_draw"], r["lang"], bytes(r["ids"])))
    return [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, learn_from: Column, per_language: int = 600, most_documents: int = 6000, most_pairs: int = 1 << 25) -> Model:
    """Learn from the rows of (doc_id, text, lang) for which learn_from holds."""
    return train(*training_sample(docs.where(learn_from), per_language, most_documents, most_pairs))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the calibrated probability) and accepted."""
    from pyspark.sql import types as T

    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    @F.pandas_udf(result)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            texts = [t or "" for t in texts]
            for chunk in _chunks(texts, 1_000_000):
                probability = model.scores(chunk) if model.languages else np.zeros((len(chunk), 1))
                best = probability.argmax(axis=1)
                for t, k, p in zip(chunk, best, probability.max(axis=1)):
                    if model.languages and any(c.isalpha() for c in t):
                        out.append((model.languages[k], float(p), bool(p >= model.reject_below)))
                    else:
                        out.append((UNKNOWN, 0.0, False))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    found = without(docs, "lang_pred", "score", "accepted").withColumn("_lang", of(F.col(f"`{text}`")))
    return found.select(*[c for c in found.columns if c != "_lang"], "_lang.*")


def _chunks(texts: list[str], chars: int) -> Iterable[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
