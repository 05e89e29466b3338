"""Spelling variants, BPE and the alignment of tokenizers against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import alignment, bpe, queries, spelling
from confluo.llm.common import table

from test_operators import SF, docs, odd  # noqa: F401

ALPHABET = ["a", "b", "e", " ", "  ", "\n", "\t", "'s", "'", "'re", "'ll ", "é", "ß", "😀", "<|endoftext|>", "1", "23", "!", "..", "the", "ing", " the", " ", "　", "中文", "́", "X", "don't", "\x00", "aaaa", "\r\n", "</s>", "<0x41>", "   ", "ǅ", "²", " "]


def _random_texts(n, extra=()):
    rng = random.Random(3)
    letters = [*ALPHABET, *extra]
    return ["", " ", "  ", "a" * 3000, "ab " * 50, "<|endoftext|>", "<|endoftext|>  a"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# --- spelling variants -----------------------------------------------------------------------------------------------


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(rows, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    alike = defaultdict(set)
    for w in n:
        for i in range(len(w) + 1):
            alike[i, w[:i], w[i + 1 :]].add(w)  # replaced
            alike[-1, w[:i] + w[i + 1 :], ""].add(w)
        alike[-1, w, ""].add(w)
    near = defaultdict(set)
    for group in alike.values():
        for w in group:
            near[w] |= {v for v in group if v != w and _near(v, w)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("chunk", [2048, 3])
def test_variants_equal_plain_version(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    chain = [("lettersa", 5), ("letters", 25), ("letterz", 5), ("letter", 130), ("lettre", 6), ("better", 900), ("betterÿ", 5), ("÷×÷×÷×", 5), ("abcabcabc" * 300, 5), ("abcabcabc" * 300 + "b", 30)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "s", "É"]) for _ in range(200))) for i in range(40)]
    rows += [(101 + i, " ".join([w] * k).upper() if i % 2 else "1".join([w] * k)) for i, (w, k) in enumerate(chain)] + [(None, "Nameless " * 7), (None, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))  # no deletion hits the chain
    want = _variants(rows, 11)
    assert _found(spelling.variants(frame, every=11)) == want
    assert any(v[0] and want[v[0]][0] for v in want.values()) and any(v[3] > 1 for v in want.values())


def test_variants_query_and_edges(spark, docs, odd):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    assert _found(queries.op11_spelling_variants(spark, "/root/testdata/sf0.01")) == _variants(rows)
    assert _found(spelling.variants(odd)) == _variants([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling.variants(docs.limit(0)).count() == 0


# --- BPE -------------------------------------------------------------------------------------------------------------


def _library(special=True):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    found.encode_special_tokens = not special
    return found


@pytest.mark.parametrize("special", [True, False])
def test_bpe_equals_library(special, monkeypatch):
    vocab = bpe.ByteBPE(queries.tokenizer_path("byte_bpe_50k.json"))
    library = _library(special)
    texts = _random_texts(6000)
    ids, counts, parts = vocab.encode_checked(texts, special)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [p.decode() for p in parts] == texts
    plain = [i for i in range(vocab.size) if i not in vocab.special.values()]
    assert vocab.encode_words(vocab.bytes, vocab.begins[plain], vocab.lengths[plain])[0].tolist() == plain  # each token is its own encoding


def test_bpe_survives_colliding_hashes_and_a_small_memory(monkeypatch):
    texts = _random_texts(400)
    library = [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]
    vocab = bpe.ByteBPE(queries.tokenizer_path("byte_bpe_50k.json"), most_words=50)
    found = [vocab.encode_checked(texts[i : i + 10])[:2] for i in range(0, len(texts), 10)]
    assert [x.tolist() for ids, n in found for x in np.split(ids, np.cumsum(n)[:-1])] == library
    vocab = bpe.ByteBPE(queries.tokenizer_path("byte_bpe_50k.json"))
    hashes = bpe.Words._hashes
    monkeypatch.setattr(bpe.Words, "_hashes", staticmethod(lambda *a: hashes(*a) % np.uint64(64)))
    ids, n, _ = vocab.encode_checked(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library


def test_bpe_query_and_edges(spark, docs, odd):  # noqa: F811
    library = _library()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = docs.collect()
    ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    want = Counter((r.doc_id, len(i), sha(np.array(i, "<u4").tobytes()), sha(library.decode(i, skip_special_tokens=False).encode())) for r, i in zip(rows, ids))
    assert Counter(map(tuple, queries.op12_bpe_codec(spark, SF).collect())) == want
    found = bpe.encode(odd.withColumn("ids", F.lit("clash")), queries.tokenizer_path("byte_bpe_50k.json"))
    assert found.columns == [c for c in odd.columns if c != "text"] + ["n_tokens", "ids", "decoded"]
    assert sorted(r.decoded for r in found.collect()) == sorted(r.text or "" for r in odd.collect())
    assert bpe.encode(docs.limit(0), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


# --- alignment -------------------------------------------------------------------------------------------------------


def _aligned(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, from the libraries' tokens."""
    from sentencepiece import SentencePieceProcessor

    first, second = _library(special=False), SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    spelled = bpe.vocabulary(queries.tokenizer_path("byte_bpe_50k.json"))
    found, held = [], Counter()
    for text in texts:
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        bytes_a = [spelled.decode_bytes(np.array([i])).tobytes() for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        groups = []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
            by_end_a, by_end_b = dict(zip(ends_a.tolist(), a)), dict(zip(ends_b.tolist(), b))
            group = ([], [])
            for end in sorted(by_end_a.keys() | by_end_b.keys()):
                for side, ids in zip(group, (by_end_a, by_end_b)):
                    side += [ids[end]] if end in ids else []
                if end in by_end_a and end in by_end_b:
                    groups.append(group)
                    group = ([], [])
        found.append(groups)
        held.update({(x, y) for p, q in groups for x in p for y in q})
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for groups in found:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), text))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_plain_version(spark, monkeypatch, small):
    if small:  # many blocks, lanes and slices
        for name, value in {"BLOCK": 20, "FAN": 2, "SHARDS": 5, "SLICE": 50}.items():
            monkeypatch.setattr(alignment, name, value)
    texts = [*_random_texts(400 if small else 1500, ["▁"]), None, "▁", "中文" * 100, *["the same text"] * 5]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    got = {r.doc_id: (*[r[c] for c in alignment.ADDED], r.groups) for r in alignment.align(frame, *paths).collect()}
    assert [got[i] for i in range(len(texts))] == _aligned(texts)


def test_large_groups_are_expanded_over_distinct_ids(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 1000)
    a, b = alignment._tokenizers(queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))
    made = alignment.Aligned(["x"], a, b)
    rng = np.random.default_rng(1)
    made.a, made.b = rng.integers(0, 300, 5000), rng.integers(0, 200, 4000)
    made.first_a, made.first_b, made.doc, made.links = np.array([0, 5000]), np.array([0, 4000]), np.array([0]), np.array([5000 * 4000])
    doc, pair, links = made.pairs()
    times_a, times_b = np.bincount(made.a), np.bincount(made.b)
    assert len(np.unique(pair)) == len(pair) == (times_a > 0).sum() * (times_b > 0).sum() and not doc.any()
    assert (links == times_a[pair >> 20] * times_b[pair & 0xFFFFF]).all()


def test_minimal_hash_numbers_every_key_once():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        made = alignment.MinimalHash.build(keys)
        assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
        assert n < 1000 or len(made.bits) < 6 * len(keys)


def test_alignment_query_and_edges(spark, docs, odd):  # noqa: F811
    rows = docs.collect()
    want = Counter((r.doc_id, *f[:6], hashlib.sha256(f[6].encode()).hexdigest() if f[6] else "") for r, f in zip(rows, _aligned([r.text for r in rows])))
    assert Counter(map(tuple, queries.op13_tokenizer_alignment(spark, SF).collect())) == want
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    held = odd.collect()
    found = alignment.align(odd, *paths)
    assert found.columns == [c for c in odd.columns if c != "text"] + [*alignment.ADDED, "groups"]
    assert Counter((r.doc_id, r.n_a, r.count_sum, r.groups) for r in found.collect()) == Counter((r.doc_id, f[0], f[5], f[6]) for r, f in zip(held, _aligned([r.text for r in held])))
    assert alignment.align(docs.limit(0), *paths).count() == 0
