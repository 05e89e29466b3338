"""The learned models' predictions, and the whole pipeline, against plain versions without numpy tricks."""

import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import langid, pii, quality, queries
from confluo.llm.common import table

from test_near_copies import _kept
from test_operators import SF, _targets, odd, docs  # noqa: F401


def _subwords(text):
    units = [0]
    raw = text.lower().encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        u = raw[i] | raw[i + 1] << 8
        u = u if 0xD800 <= u < 0xE000 or chr(u).isalpha() else 0
        if u or units[-1]:
            units.append(u)
    if units[-1]:
        units.append(0)
    found = Counter()
    for i in range(len(units)):
        for n in (2, 3, 4):
            gram = units[i : i + n]
            if len(gram) < n or 0 in gram[1:-1] or gram[0] == gram[-1] == 0:
                continue
            v = gram[0]
            for k, u in enumerate(gram[1:], 2):
                v = (v * 0x01000193 + u + k) % (1 << 32)
            found[((v ^ v >> 15) * 0x85EBCA6B % (1 << 32)) >> 15] += 1
    return found


def test_language_scores_equal_a_plain_version(spark, docs, odd):  # noqa: F811
    model = langid.fit(docs, F.lit(True), per_language=40)
    for frame in (docs.select("doc_id", "text"), odd.where("doc_id <> 7 OR doc_id IS NULL").select("doc_id", "text")):
        for r in langid.predict(frame, model).collect():
            counts = _subwords(r.text or "")
            if not any(c.isalpha() for c in r.text or ""):
                assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
                continue
            total = sum(counts.values())
            logits = [(sum(n * float(model.table[b][k]) for b, n in counts.items()) / total + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
            top = max(logits)
            share = 1 / sum(math.exp(x - top) for x in logits)
            assert abs(r.score - share) < 1e-4 and (r.lang_pred == model.languages[logits.index(top)] or share < 0.51)


def test_training_reads_whole_documents(spark):
    """A text of one line of 5 MB is learned from to its end; languages are thinned alike."""
    long = "aaa bbb " * 600_000 + "zzz qqq"
    rows = [(i, "zzz qqq", "x") for i in range(60)] + [(100 + i, "kkk lll", "y") for i in range(6)] + [(999, long, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    features, langs = langid.training_sample(frame, 1000, 1000)
    assert Counter(langs) == {"x": 60, "y": 7}
    ids, counts = next(f for f in features if f[1].sum() > 1_000_000)
    want = _subwords(long)
    assert dict(zip(ids.tolist(), counts.tolist())) == dict(want)
    _, langs = langid.training_sample(frame, 1000, 30)
    thinned = Counter(langs)
    assert thinned["y"] == 7 and 5 <= thinned["x"] <= 26  # 15 of each at most
    _, langs = langid.training_sample(frame, 1000, 1000, 20 * langid.LEAST_PAIRS)
    assert len(langs) == 20 and Counter(langs)["y"] >= 5  # bounded by pairs, the short language is kept
    _, langs = langid.training_sample(frame.union(frame), 1000, 1000)
    assert Counter(langs) == {"x": 60, "y": 7}  # repeated rows once
    marks = spark.createDataFrame([(999, 1), (1, 0)], "doc_id long, quality int")
    features, labels = quality.training_sample(frame, marks, F.lit(True), 100, 100)
    assert sorted(float(size.sum()) for _, size in features) == [7.0, float(len(long))] and sorted(labels) == [0, 1]


def _line(raw):
    classes = [bytes(v) for v in quality._CLASSES.values()]
    size, words = len(raw), raw.translate(bytes.maketrans(b"\t\r\x0b\x0c", b"    ")).split(b" ")
    words = [w for w in words if w]
    share = lambda members: sum(b in members for b in raw) / max(size, 1)
    out = [*[share(c) for c in classes], sum(b >= 128 for b in raw) / max(size, 1), math.log1p(size) / 8, math.log1p(len(words)) / 6, min(size / max(len(words), 1), 40) / 10]
    out += [len(set(words)) / len(words) if words else 1.0, sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1), words, size == 0]
    return out + [size > 0 and raw[-1:] in (b".", b"!", b"?", b'"', b"'", b")"), size > 0 and raw[-1] in classes[4]], size


def _quality(model, text):
    lines, sizes = zip(*[_line(x) for x in (text or "").encode().split(b"\n")])
    times = Counter(tuple(x[12]) for x in lines)
    rows = [[float(v) if i != 12 else float(times[tuple(x[12])] > 1 and n > 0) for i, v in enumerate(x)] for x, n in zip(lines, sizes)]
    none = [0.0] * len(rows[0])
    emit = []
    for i, x in enumerate(rows):
        whole = [*x, *(rows[i - 1] if i else none), *(rows[i + 1] if i + 1 < len(rows) else none), 1.0]
        emit.append([sum(a * b for a, b in zip(whole, model.weights[:, y])) for y in (0, 1)])
    both = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, back = [emit[0]], [[0.0, 0.0]]
    for e in emit[1:]:
        ahead.append([e[y] + both(ahead[-1][0] + model.transition[0][y], ahead[-1][1] + model.transition[1][y]) for y in (0, 1)])
    for e in reversed(emit[1:]):
        back.append([both(model.transition[y][0] + e[0] + back[-1][0], model.transition[y][1] + e[1] + back[-1][1]) for y in (0, 1)])
    good, total = 0.0, 0.0
    for a, b, n in zip(ahead, reversed(back), sizes):
        odds = a[1] + b[1] - a[0] - b[0]
        good += (n + 1) / (1 + math.exp(-max(-700.0, odds)))
        total += n + 1
    p = min(max(good / total, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.slope * math.log(p / (1 - p)) + model.offset)))


@pytest.fixture(scope="module")
def judge(spark, docs):  # noqa: F811
    return quality.fit(docs, table(spark, SF, "labels"), F.lit(True))


def test_quality_scores_equal_a_plain_version(spark, docs, odd, judge):  # noqa: F811
    lines = spark.createDataFrame([(1, "one\n" * 2000), (2, "\n\n"), (3, "Same same same.\nx\nSame  same same.\n#"), (4, "w" * 100_000)], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), lines):
        for r in quality.score(frame, judge).collect():
            want = _quality(judge, r.text)
            assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_whole_pipeline_equals_a_plain_version(spark, docs, judge):  # noqa: F811
    """Who stays, what is redacted, how much of each source is taken and what is packed."""
    from tokenizers import Tokenizer
    from zlib import crc32

    good = {r.doc_id: r.text for r in docs.collect() if _quality(judge, r.text) >= 0.3}
    kept = docs.where(F.col("doc_id").isin(sorted(_kept(good))))
    clean = {r.doc_id: r for r in pii.redact(kept).collect()}
    size = {i: len((r.text or "").translate({c: " " for c in range(9, 14)}).split(" ")) - (r.text or "").translate({c: " " for c in range(9, 14)}).split(" ").count("") for i, r in clean.items()}
    tokens = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array([*tokens.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for i, r in clean.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    taken, of_source, total = Counter(), Counter(), Counter()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        taken[r.doc_id] += r.length
    for i, n in taken.items():
        copies, rest = divmod(n, len(ids[i]))
        assert rest == 0 and 1 <= copies <= 3
        of_source[clean[i].source] += copies * size[i]
    for i, n in size.items():
        total[clean[i].source] += n
    for s, target in _targets(total).items():
        assert abs(of_source[s] - target) <= max(0.05 * target, min(size[i] for i in size if clean[i].source == s and size[i]))
