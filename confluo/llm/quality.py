"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features (shares of character classes, word length, distinct and repeated
words, repeated lines, its end) and those of the lines before and after it feed a two-state linear chain, trained in
numpy by gradient ascent on the exact likelihood. Documents carry the labels, so each line of a training document gets
its document's label, and the chain's own transitions smooth over lines that look otherwise. A document's quality is
the mean of its lines' forward-backward marginals, weighted by their lengths, turned into the probability of label 1
by a logistic curve fitted on the training documents.

Training reads a bounded sample of labelled rows, in the order of a hash of their id: at most `most_documents`, and
only as many as hold `most_lines` lines together (one at least). Each of them is read whole. Executors turn lines into
features, so a line of any length reaches the driver as a few numbers. Scoring reads every line of every text.

Defined cases: a null or empty text is one empty line and gets a score like any other; texts and lines of any length
are read whole; a document with several label rows counts with the smallest; null labels are not learned from; with no labels at all, or labels of one kind only,
every score is the share of label 1 (0.5 if there are none); a score equal to THRESHOLD counts as good; an empty table
gives an empty table; repeated rows score alike; columns of the input named like those added are replaced.
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

THRESHOLD = 0.3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "mark": b"!?", "symbol": b"#$%&*+/<=>@\\^_`{|}~[]()\"", "space": b" \t\r\x0b\x0c"}
FEATURES = [*_CLASSES, "wide", "length", "words", "word_length", "distinct", "again", "same_line", "empty", "ends", "bare_ends"]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1), np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        table[list(members), i] = 1
    table[128:, len(_CLASSES)] = 1
    return table


_TABLE = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, bytes of each line, lines of each text)."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw + b"\n", np.uint8)
    lines_of = np.array([t.count("\n") + 1 for t in texts])
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    n, size = len(stop), stop - start
    doc = np.repeat(np.arange(len(texts)), lines_of)
    shares = np.empty((n, _TABLE.shape[1]), np.float64)
    for i in range(_TABLE.shape[1]):
        total = np.concatenate([[0], np.cumsum(_TABLE[data, i], dtype=np.int64)])
        shares[:, i] = total[stop] - total[start]
    # words: runs between white space
    blank = (_TABLE[data, 5] == 1) | (data == 10)
    before = np.concatenate([[True], blank[:-1]])
    first = np.flatnonzero(~blank & before)
    last = np.flatnonzero(blank & ~before)
    line = np.searchsorted(stop, first)
    words = np.bincount(line, minlength=n)
    with np.errstate(over="ignore"):
        mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        place = np.arange(len(data), dtype=np.uint64)
        head = np.repeat(first, last - first)
        inside = np.flatnonzero(~blank)
        value = mixed[inside] + (place[inside] - head.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        hashed = np.add.reduceat(value, np.concatenate([[0], np.cumsum(last - first)[:-1]])) if len(first) else np.zeros(0, np.uint64)
    again = np.bincount(line[1:], weights=(hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1]), minlength=n) if len(first) > 1 else np.zeros(n)
    keys = np.sort((line.astype(np.uint64) << np.uint64(36)) | (hashed >> np.uint64(28)))
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[new] >> np.uint64(36)).astype(np.int64), minlength=n)
    with np.errstate(over="ignore"):
        of_line = np.zeros(n, np.uint64)
        np.add.at(of_line, line, hashed * (np.arange(len(hashed), dtype=np.uint64) - np.repeat(np.cumsum(words) - words, words).astype(np.uint64) + np.uint64(1)))
    pairs = (doc.astype(np.uint64) << np.uint64(36)) | (of_line >> np.uint64(28))
    _, where, count = np.unique(pairs, return_inverse=True, return_counts=True)
    end = data[np.maximum(stop - 1, 0)]
    out = np.column_stack([
        shares / np.maximum(size, 1)[:, None],
        np.log1p(size) / 8, np.log1p(words) / 6,
        np.minimum(size / np.maximum(words, 1), 40) / 10,
        np.where(words > 0, distinct / np.maximum(words, 1), 1.0),
        again / np.maximum(words, 1),
        (count[where] > 1) & (size > 0),
        size == 0,
        (size > 0) & np.isin(end, list(b".!?\"')")),
        (size > 0) & (_TABLE[end, 4] == 1),
    ])
    return out, size, lines_of


def with_neighbours(x: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its document (0 if there are none), and 1."""
    start = np.cumsum(lines_of) - lines_of
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[start] = 0
    after[start + lines_of - 1] = 0
    return np.column_stack([x, before, after, np.ones(len(x))])


def forward_backward(emission: np.ndarray, transition: np.ndarray, lines_of: np.ndarray, weigh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of each line and, given weights of the documents, the weighted sum of their expected transitions.

    With two labels a message is one number, the log odds of label 1 against 0. Documents advance together, longest
    first, their lines laid out step by step, so that step t is a slice of those with more than t lines.
    """
    order = np.argsort(-lines_of, kind="stable")
    sizes, start = lines_of[order], (np.cumsum(lines_of) - lines_of)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents with more than t lines
    edge = np.concatenate([[0], np.cumsum(live)])
    at = np.empty(len(emission), np.int64)  # the line at each place of the layout
    for t in range(steps):
        at[edge[t] : edge[t + 1]] = start[: live[t]] + t
    odds = (emission[:, 1] - emission[:, 0])[at]
    ahead, back = odds.copy(), np.zeros(len(odds))
    for t in range(1, steps):
        before = ahead[edge[t - 1] : edge[t - 1] + live[t]]
        ahead[edge[t] : edge[t + 1]] += np.logaddexp(transition[0, 1], transition[1, 1] + before) - np.logaddexp(transition[0, 0], transition[1, 0] + before)
    for t in range(steps - 1, 0, -1):
        after = odds[edge[t] : edge[t + 1]] + back[edge[t] : edge[t + 1]]
        back[edge[t - 1] : edge[t - 1] + live[t]] = np.logaddexp(transition[1, 0], transition[1, 1] + after) - np.logaddexp(transition[0, 0], transition[0, 1] + after)
    one = 1 / (1 + np.exp(-(ahead + back)))
    marginal = np.empty((len(odds), 2))
    marginal[at, 1], marginal[at, 0] = one, 1 - one
    if weigh is None:
        return marginal, None
    forward, behind = np.empty(len(odds)), np.empty(len(odds))
    forward[at], behind[at] = ahead, odds + back
    doc = np.repeat(np.arange(len(lines_of)), lines_of)
    inner = np.flatnonzero(np.concatenate([[False], doc[1:] == doc[:-1]]))
    joint = np.zeros((len(inner), 2, 2)) + transition
    joint[:, 1, :] += forward[inner - 1, None]
    joint[:, :, 1] += behind[inner, None]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return marginal, (joint * (weigh[doc[inner]] / joint.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray  # features x 2
    transition: np.ndarray
    slope: float
    offset: float
    prior: float | None = None  # where nothing could be learned

    def raw(self, texts: list[str]) -> np.ndarray:
        x, size, lines_of = line_features(texts)
        marginal = forward_backward(with_neighbours(x, lines_of) @ self.weights, self.transition, lines_of)[0][:, 1]
        return _weighted(marginal, size, lines_of)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-(self.slope * _logit(self.raw(texts)) + self.offset)))


def _weighted(marginal: np.ndarray, size: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(lines_of)), lines_of)
    weight = size + 1.0
    return np.bincount(doc, weights=marginal * weight, minlength=len(lines_of)) / np.bincount(doc, weights=weight, minlength=len(lines_of))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 120, rate: float = 0.1, penalty: float = 1e-4) -> Model:
    """features: of each document its lines' features and their sizes."""
    labels = np.asarray(labels, int)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros((0, 2)), np.zeros((2, 2)), 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    lines_of = np.array([len(size) for _, size in features])
    size = np.concatenate([size for _, size in features])
    x = with_neighbours(np.concatenate([raw for raw, _ in features]), lines_of)
    doc = np.repeat(np.arange(len(features)), lines_of)
    y = labels[doc]
    # both kinds of documents weigh alike, and each document alike
    weigh = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / np.sqrt(lines_of)
    weigh /= weigh.sum()
    weights, transition = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    truth = np.eye(2)[y]
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transition), np.zeros_like(transition)]
    inner = np.flatnonzero(np.concatenate([[False], doc[1:] == doc[:-1]]))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), weigh[doc[inner]])
    for step in range(1, steps + 1):
        marginal, expected = forward_backward(x @ weights, transition, lines_of, weigh)
        grads = [x.T @ ((truth - marginal) * weigh[doc][:, None]) - penalty * weights, (seen - expected) - penalty * transition]
        for k, (value, grad) in enumerate(zip((weights, transition), grads)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * grad**2
            value += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    model = Model(weights, transition, 1.0, 0.0)
    z = _logit(_weighted(forward_backward(x @ weights, transition, lines_of)[0][:, 1], size, lines_of))
    for _ in range(50):  # Newton steps of the logistic curve, with a light pull towards slope 1
        p = 1 / (1 + np.exp(-(model.slope * z + model.offset)))
        g = np.array([((labels - p) * z).sum() - (model.slope - 1), (labels - p).sum() - 0.01 * model.offset])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        model.slope, model.offset = float(model.slope + move[0]), float(model.offset + move[1])
    return model


def training_sample(docs: DataFrame, labels: DataFrame, learn_from: Column, most_documents: int, most_lines: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Line features and labels of whole documents."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    draw = F.xxhash64("doc_id", F.lit(11))
    chosen = marked.where(learn_from).withColumn("draw", draw).orderBy("draw", "doc_id").limit(most_documents)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most most_documents rows of three numbers

    def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features([t or ""]) for t in batch.column(3).to_pylist()]
            packed = [pa.array([x[k].astype("<f4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            lines = pa.array([int(x[2][0]) for x in found], pa.int64())
            yield pa.record_batch([*batch.columns[:3], lines, *packed], names=["draw", "doc_id", "quality", "lines", "features", "sizes"])

    schema = "draw long, doc_id long, quality long, lines long, features binary, sizes binary"
    found = rows.select("draw", F.col("doc_id").cast("long"), F.col("quality").cast("long"), "text").mapInArrow(featurise, schema)
    found = stored(found, "quality-features")
    # documents in order of their draw, while their lines fit
    by_draw = Window.orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("draw", "doc_id").agg(F.sum("lines").alias("lines"))
    fits = sizes.withColumn("before", F.coalesce(F.sum("lines").over(by_draw), F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("lines") <= most_lines))
    got = found.join(fits.select("draw", "doc_id"), ["draw", "doc_id"], "left_semi").collect()
    drop_stored(found)
    got.sort(key=lambda r: (r["draw"], r["doc_id"], bytes(r["features"])))
    features = [(np.frombuffer(r["features"], "<f4").reshape(r["lines"], len(FEATURES)).astype(np.float64), np.frombuffer(r["sizes"], "<f4")) for r in got]
    return features, np.array([int(r["quality"] > 0) for r in got])


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, most_documents: int = 6000, most_lines: int = 200_000) -> Model:
    """Learn from the labelled documents for which learn_from, a condition on doc_id, holds."""
    return train(*training_sample(docs, labels, learn_from, most_documents, most_lines))


def scorer(model: Model):
    """The model's score as a function of a text column."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out, part, chars = [], [], 0
            for t in texts:
                part.append(t or "")
                chars += len(part[-1])
                if chars >= 1_000_000:
                    out.append(model.scores(part))
                    part, chars = [], 0
            if part:
                out.append(model.scores(part))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1, and predicted (1 from THRESHOLD on)."""
    out = without(docs, "score", "predicted").withColumn("score", scorer(model)(F.col(f"`{text}`")))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs less those that the model rejects; their columns stay as they are."""
    return docs.where(scorer(model)(F.col(f"`{text}`")) >= THRESHOLD)
