"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import chat, langid, merkle, mixing, packing, pii, quality, queries, simhash, suffix_dedup, topk
from confluo.llm.common import stored, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and a column named like the operators' own."""
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, " \n\t ", "en", "a", 3, "x"), (4, "same text here again", "en", None, 1, None), (4, "same text here again", "en", None, 1, None),
        (5, "same text here again", "de", "b", 1, "x"), (None, "no id a@b.com", "en", "b", 1, "x"), (7, "long words " * 20_000, "en", "b", 1, "x"), (8, "é😀 ß", "fr", "", 1, "x"),
    ]
    names = ", ".join(f"{c} string" for c in ("score",))
    return spark.createDataFrame(rows, f"{DOCS}, {names}").withColumns({c: F.col("score") for c in ("size", "spans", "fingerprint", "predicted", "component", "tree", "copies", "lang_pred")})


# --- personal data ---------------------------------------------------------------------------------------------------


def _luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def _base(text):
    text, out, counts = text or "", [], []
    digits = lambda h: re.sub("[^0-9]", "", h)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(v) <= 255 for v in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 13 <= len(digits(h)) <= 19 and _luhn(digits(h))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(digits(h)) <= 15),
    )
    for kind, pattern, good in kinds:
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m.group())]
        counts.append(len(found))
        out += found
    return counts, hashlib.sha256(",".join(out).encode()).hexdigest()


def test_pii_base_equals_plain_search(spark, docs, odd, monkeypatch):
    rng = random.Random(5)
    alphabet = ["0123456789. -", "ab@.-_+%9", "+1 (23) 4-5.é", "😀a@b.c ", "4111111111111111 12.3.4.255", "\n \x0b"]
    texts = ["".join(rng.choice(rng.choice(alphabet)) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3." + "0" * 60 + "4", "+1 (743) 555-3824 ", "1 " * 5000, "1." * 5000, "a" * 3000 + "@", "4111 1111 1111 1111", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for data in (frame, docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        monkeypatch.setattr(queries, "table", lambda *_, data=data: data)
        want = sorted((str(r.doc_id), *_base(r.text)[0], _base(r.text)[1]) for r in data.collect())
        got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op1_pii_spans(spark, SF).collect())
        assert got == want


def test_pii_added_kinds_and_redaction(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE89 3704 0044 0532 0130 01; born 1980-02-03 ssn 123-45-6789, part 123-45-6788 of stock. " + "." * 60 + " 1980-02-03 card 4111.1111.1111.1111 at 00:1A:2b:3c:4d:5e"
    df = spark.createDataFrame([(1, text), (2, None), (3, "clean words only")], "doc_id long, text string")
    kinds = [s.kind for s in pii.find(df).where("doc_id = 1").first().spans]
    assert kinds == ["iban", "iban", "ssn", "mac", "birth", "dotcard"]  # the second number's context ends at the first
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[2] is None and out[3] == "clean words only" and out[1].startswith("IBAN [IBAN], [IBAN], DE89 3704") and "1980-02-03 card [DOTCARD] at [MAC]" in out[1]
    over = spark.createDataFrame([("+1 234.56.78.9012",)], "text string")
    assert pii.redact(over).first().text.count("[") == 1


def test_pii_needs_no_digit_and_stops_at_the_number(spark):
    rows = ["device aa:bb:cc:dd:ee:ff is here", "AT61 1904 3002 3457 3201 PAID", "AT611904300234573201 PAID", "AT61 1904 3002 3457 3201 paid", "xAT611904300234573201", "ZZ61 1904 3002 3457 3201"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = [r.l for r in pii.find(df).orderBy("doc_id").select(pii.listed(F.col("spans")).alias("l")).collect()]
    assert found == ["mac:7:24", "iban:0:24", "iban:0:20", "iban:0:24", "", ""]
    rng = random.Random(9)  # no kind is found in a text without what all texts must hold
    free = ["".join(rng.choice("abcdefABCDEF+-./ ()_%") for _ in range(300)) for _ in range(200)]
    needs = F.expr("false")
    for _, pattern, *_ in pii.KINDS.values():
        needs = needs | F.col("text").rlike(pattern)
    assert spark.createDataFrame([(t,) for t in free], "text string").where(needs).isEmpty()


# --- top-k -----------------------------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 8))
    vectors[500:700] = vectors[3]  # many equal vectors, so ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2100, [None] * 8), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (2400, [1.0, 2.0]), (None, [1.0] * 8), (5, [0.5] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(frame, F.col("id") % 100 == 0, shards=5, least_rows=100, block_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and len(v) == 8]
    for i, v in [x for x in q if x[0] % 100 == 0]:
        want = sorted(((-int(v @ w), j) for j, w in q if j != i))[:10]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert 2400 not in got  # no other vector has its length
    assert topk.top_k(frame.limit(0), F.col("id") % 100 == 0).count() == 0


def test_topk_of_clusters_asks_few_shards(spark, monkeypatch):
    """Far clusters: a query goes to its own cells only. Columns of the operator's own names ride along unread."""
    sent = []
    groups = topk._search_groups
    monkeypatch.setattr(topk, "_search_groups", lambda data, queries, k: sent.append(queries.count()) or groups(data, queries, k))
    rng = np.random.default_rng(8)
    middles = 40 * np.eye(12)
    vectors = np.concatenate([m + rng.normal(size=(200, 12)) for m in middles])
    rows = [(i, [float(x) for x in v], "x", 7, 7, 7) for i, v in enumerate(rng.permutation(vectors))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, dim int, cell int, score int")
    got = {}
    for r in topk.top_k(frame, F.col("id") % 100 == 0, shards=16, least_rows=50, block_rows=3).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    q = np.floor(1024 * np.array([r[1] for r in rows])).astype(int)
    for i in range(0, len(rows), 100):
        scores = q @ q[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:10]
        assert sorted(got[i], key=lambda x: (-x[1], x[0])) == [(j, -s) for s, j in want]
    assert sent[0] == 24 and sent[1] < 0.5 * 24 * 16


def test_topk_of_sums_beyond_doubles(spark):
    rows = [(0, [2.0**29 + 1 / 1024, 1 / 1024])] + [(i, [2.0**12, j / 1024]) for i, j in ((1, 5), (2, 9), (3, 9), (4, -3))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(frame, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(i, (2**39 + 1) * 2**22 + j) for i, j in ((2, 9), (3, 9), (1, 5), (4, -3))]


# --- learned models --------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    sf = SF.replace("0.001", "0.01")
    found = queries.op3_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98 and found.where("score < 0 or score > 1").isEmpty()


def test_language_edge_cases(spark, docs, odd):
    model = langid.fit(docs, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and (7, "und") not in got and (8, "und") not in got
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.where("lang is null"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_subword_means_do_not_depend_on_the_batch():
    texts = ["", "Hello, world!", "ça va?", "1234", "a", "x y", "hello"]
    together, counts = langid.subwords(texts)
    stops = np.cumsum(counts)
    for i, t in enumerate(texts):
        alone, _ = langid.subwords([t])
        assert sorted(alone) == sorted(together[stops[i] - counts[i] : stops[i]])
    assert counts[0] == counts[3] == 0 and counts[1] > 10


def test_quality_of_held_out_texts(spark, odd):
    sf = SF.replace("0.001", "0.01")
    found = queries.op9_line_crf_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels, F.lit(True), most_documents=300)
    assert quality.score(odd, model).where("score between 0 and 1 and predicted in (0, 1)").count() == odd.count()
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 4])
    emission, transition = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, expected = quality.forward_backward(emission, transition, lines, np.ones(3))
    start, total = 0, np.zeros((2, 2))
    for n in lines:
        e = emission[start : start + n]
        paths = np.array(np.meshgrid(*[[0, 1]] * n)).reshape(n, -1).T
        weight = np.exp([e[range(n), p].sum() + sum(transition[a, b] for a, b in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        assert np.allclose(got[start : start + n, 1], (paths * weight[:, None]).sum(axis=0))
        for p, w in zip(paths, weight):
            for a, b in zip(p, p[1:]):
                total[a, b] += w
        start += n
    assert np.allclose(expected, total)


# --- suffix dedup ----------------------------------------------------------------------------------------------------


def _removed(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for x in range(len(raw) - length + 1):
            if raw[x : x + length] in seen:
                gone[x : x + length] = True
            seen.add(raw[x : x + length])
        out[i] = gone
    return out


def _passages(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3)]
    texts = {}
    for i in range(120):
        a = rng.randint(0, 200)
        noise = lambda: "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 30)))
        texts[i] = noise() + rng.choice(base)[a : a + rng.randint(30, 250)] + noise()
    return texts | {200: "a" * 700, 201: "ab" * 300, 202: None, 203: "", 204: "abc" * 200, 205: "a" * 700, 206: texts[0]}


@pytest.mark.parametrize("length,k", [(100, 24), (12, 4), (30, 8)])
def test_suffix_dedup_equals_brute_force(spark, length, k):
    texts = _passages()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = _removed(texts, length)
    for r in suffix_dedup.deduplicate(frame, length, k).collect():
        gone = np.zeros(r.n_bytes, bool)
        for s in r.spans:
            gone[s.start : s.stop] = True
        assert (gone == want[r.doc_id]).all() and r.n_removed == gone.sum() and r.kept == bytes(np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)[~gone])


@pytest.mark.parametrize("hot,hottest,size", [(1, 1, 1_500_000), (1, 10_000, 300), (5, 30, 300), (40, 50, 1)])
def test_anchors_shared_by_tasks_equal_brute_force(spark, monkeypatch, hot, hottest, size):
    """A passage in every document, its anchors parted or dealt to many tasks, and transforms of few entries."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOTTEST", hottest)
    monkeypatch.setattr(suffix_dedup, "TRANSFORM_BYTES", size)
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = _passages(9) | {1000 + i: "".join(rng.choice("xyz") for _ in range(i % 40)) + line + str(i) for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = _removed(texts, 100)
    for r in suffix_dedup.deduplicate(frame).collect():
        gone = np.zeros(r.n_bytes, bool)
        for s in r.spans:
            gone[s.start : s.stop] = True
        assert (gone == want[r.doc_id]).all()


def test_suffix_dedup_of_long_texts(spark):
    """Texts of over 4 MB are searched in parts; one repeats a stretch across a part's edge, another itself."""
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 123, 4_300_000).astype(np.uint8).tobytes().decode()
    texts = {1: raw, 2: raw[4_194_000:4_194_900], 3: "z" * 50 + raw[100:400] * 2}
    got = {r.doc_id: (r.n_removed, [tuple(s) for s in r.spans]) for r in suffix_dedup.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: (0, []), 2: (900, [(0, 900)]), 3: (600, [(50, 650)])}


def test_suffix_dedup_edge_cases(spark, odd):
    got = suffix_dedup.deduplicate(odd)
    assert got.count() == odd.count() and got.where("doc_id = 1").first().kept == b""
    assert suffix_dedup.deduplicate(odd.limit(0)).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(queries.tokenizer_path())
    for frame in (docs.select("doc_id", "text"), odd.where("doc_id is not null and doc_id <> 4").select("doc_id", "text")):
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        pieces = packing.pack(frame, queries.tokenizer_path()).toPandas()
        assert set(pieces.doc_id) == set(texts)
        for doc, g in pieces.sort_values("start").groupby("doc_id"):
            ids = np.array([*reference.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert b"".join(g.ids) == ids and (g.doc_tokens == len(ids) // 4).all() and list(g.start) == [0, *np.cumsum(g.length)[:-1]]
        for _, g in pieces.sort_values("offset").groupby("sequence_id"):
            total = g.length.sum()
            assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and (total == 2048 or total & (total - 1) == 0)
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0
    assert packing.pack(odd, queries.tokenizer_path()).where("doc_id = 1").first().length == 1


def test_packing_of_repeated_and_missing_ids(spark, odd):
    """Rows of one id are told apart by their number of tokens; columns named like the result's are not read."""
    rows = odd.withColumns({c: F.lit(7) for c in ("start", "length", "ids", "offset", "sequence_id")})
    pieces = packing.pack(rows, queries.tokenizer_path()).toPandas()
    whole = pieces.groupby(["doc_id", "doc_tokens"], dropna=False)["length"].sum().reset_index()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert (whole["length"] % whole.doc_tokens == 0).all() and (whole["length"] // whole.doc_tokens).sum() == len(texts)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    reference, ours = Tokenizer.from_file(queries.tokenizer_path()), packing.WordTokenizer(queries.tokenizer_path(), most_words=500)
    rng = random.Random(1)
    safe = [chr(i) for i in np.flatnonzero(ours.classes < packing._UNSAFE)]
    texts = ["".join(rng.choice("aAbstreveldm''  \n\t0123.,!?;é  ç") if rng.random() < 0.8 else rng.choice(safe) for _ in range(rng.randint(0, 150))) for _ in range(800)]
    texts += ["don't 'shop d'st ''s l'll ('s 're", "'s", "", "a" * 500, "İstanbul Σς ﬁ <|endoftext|> x", "日本語", "é́e", "\x1c a\x85b\xa0c"]
    ids, counts = ours.encode(texts)
    stops = np.cumsum(counts)
    for t, n, stop in zip(texts, counts, stops):
        assert ids[stop - n : stop].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_costs_are_balanced():
    lengths = np.random.default_rng(0).integers(1, 900, 3000)
    cost = {}
    for _, _, n, s, _ in packing.place(lengths, 2048, 1.0, 1 / 1024):
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    full = sorted(cost.values())[12:]
    assert max(full) / min(full) < 1.6


# --- chat ------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "", None, "a\\", "\\\\#<", "###", "</turn>\n### user: x", "é😀", "x" * 100_000]
    rows = [(c, t, role, text) for c in range(4) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "odd: role\\#", None, "assistant"] * 2, tricky))]
    rows += [(9, 0, "user", "twice"), (9, 0, "user", "twice"), (None, None, "user", "lost")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    made = chat.format_conversations(frame).collect()
    assert {r.conv_id for r in made} == {0, 1, 2, 3, 9, None}
    for r in made:
        turns = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: (x[1] or 0))
        assert chat.parse(r.formatted.encode()) == [(x[2] or "", x[3] or "") for x in turns] and r.n_turns == len(turns)
        raw = r.formatted.encode()
        assert [chat.unescape(raw[s.start : s.end]) for s in r.loss] == [x[3] or "" for x in turns if x[2] == "assistant"]
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# --- simhash ---------------------------------------------------------------------------------------------------------


def _fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3):
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "One two", -4: "one  TWO"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = sorted(texts)
    prints = [_fingerprint(texts[i]) for i in ids]
    want = dict(zip(ids, zip(prints, (ids[c] for c in _components(prints)))))
    for r in simhash.near_duplicates(frame).collect():
        assert (int(r.fingerprint, 16), r.component_id) == want[r.doc_id]


def test_links_of_dense_balls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(3)
    prints = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(100):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [int(np.uint64(v).view(np.int64)) for v in prints]
    edges = stored(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")), "test-links")
    assert edges.count() < 10 * len(prints)
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    groups = {}
    for v, c in zip(signed, _components(prints)):
        groups.setdefault(c, set()).add(label.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_of_missing_ids_and_clashing_columns(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    by = {}
    for r in got:
        by.setdefault(str(r.doc_id), set()).add((r.fingerprint, r.component_id))
    assert len(got) == odd.count() and len(by["None"]) == 1
    assert {r.component_id for r in got if (r.text if "text" in r.asDict() else None) is None and r.doc_id in (1, 2, 3)} == {1} and by["4"] == by["5"] and next(iter(by["4"]))[1] == 4
    alone = spark.createDataFrame([(None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(alone).collect()} == {None}


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "7", "8", "None"] and kept.columns == odd.columns
    assert simhash.keep_one(odd.limit(0)).count() == 0


# --- fingerprints ----------------------------------------------------------------------------------------------------


def _tree(text):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [[[h(x)[:32] for x in re.findall(merkle.PIECE, p)] for p in s.split("\n")] for s in (text or "").split("\n\n")]
    paragraphs = [[h("".join(p)) for p in s] for s in leaves]
    sections = [h("".join(s)) for s in paragraphs]
    return leaves, paragraphs, sections, h("".join(sections))


def _compared(a, b):
    """Likeness and differing paragraphs, walked in a plain way."""
    (la, pa_, sa, ra), (lb, pb, sb, rb) = _tree(a), _tree(b)
    shared, own, other, differing = 0, set(), set(), []
    at = lambda x, i, none: x[i] if i < len(x) else none
    for i in range(max(len(sa), len(sb))):
        if at(sa, i, None) == at(sb, i, None):
            shared += sum(map(len, la[i]))
            continue
        for j in range(max(len(at(pa_, i, [])), len(at(pb, i, [])))):
            x, y = at(at(pa_, i, []), j, None), at(at(pb, i, []), j, None)
            if x == y:
                shared += len(la[i][j])
            else:
                differing.append((i, j))
                own |= set(la[i][j]) if x else set()
                other |= set(lb[i][j]) if y else set()
    total = 2 * shared + len(own) + len(other)
    return (2 * (shared + len(own & other)) / total if total else 1.0), differing, ra, rb


def test_merkle_equality_and_edits(spark, odd):
    text = "One. Two is longer than that!\nthree\n\nfour five six seven eight\nnine\n\n\nten"
    pairs = [("a\nb\n\nc\nd", "a\nB\n\nc\nd\ne"), ("x", "x"), (None, ""), ("", "y"), (text, "zero\n\n" + text), (text, text.replace("six", "6")), (text, "other. words\n\nonly"), ("\n" * 3000, "\n" * 3001), ("a" * 50_000, "a" * 49_999)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.select("i", merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b")).withColumn("c", merkle.compare(F.col("a"), F.col("b")))
    got = df.select("i", merkle.likeness(F.col("c")).alias("like"), merkle.locate(F.col("a"), F.col("b")).alias("at"), merkle.root(F.col("a")).alias("ra"), merkle.root(F.col("b")).alias("rb")).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        like, differing, ra, rb = _compared(a, b)
        assert (abs(r.like - like) < 1e-12, [tuple(x) for x in r["at"]], r.ra, r.rb) == (True, differing, ra, rb)
        assert (r.ra == r.rb) == ((a or "") == (b or ""))
    assert got[4].like > 0.9 and [tuple(x) for x in got[5]["at"]] == [(1, 0)] and got[6].like < 0.2
    rows = [r for r in merkle.compare_with_edits(odd).collect() if r.doc_id is not None]
    by = {r.doc_id: r for r in rows}
    assert by[4].fingerprint == by[5].fingerprint and by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in rows)
    assert merkle.compare_with_edits(odd.limit(0)).count() == 0


def test_next_text_of_repeated_and_missing_keys(spark):
    rows = [(None, "n2"), (None, "n1"), (3, "b"), (3, "a"), (3, "a"), (9, None)]
    got = [(r.doc_id, r.text, r.next_text) for r in merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_bucket=2).collect()]
    assert sorted(got, key=str) == sorted([(None, "n1", "n2"), (None, "n2", "a"), (3, "a", "a"), (3, "a", "b"), (3, "b", None), (9, None, "n1")], key=str)


def test_next_text_over_many_ranges(spark):
    n = 500
    frame = spark.createDataFrame([(i * i, f"t{i}") for i in range(n)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in merkle.with_next(frame, rows_per_bucket=20).collect()}
    assert got == {i * i: f"t{(i + 1) % n}" for i in range(n)}


# --- mixing ----------------------------------------------------------------------------------------------------------


def _targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[k] for k in full)
        share = sum(weight[k] for k in names if k not in full)
        target = {k: cap * sizes[k] if k in full else rest * weight[k] / share for k in names}
        above = {k for k in names if k not in full and target[k] > cap * sizes[k]}
        if not above:
            return target
        full |= above


def test_mixing_meets_targets(spark, docs, odd):
    rows = [(i, f"s{i % 7}" if i % 7 else None, (i * 37) % 400 + 1) for i in range(3000)] + [(5000 + i, "small", 3) for i in range(5)] + [(6000, "none", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, words long")
    mixed = mixing.mix(frame, size=F.col("words"))
    got = {r.source: r for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("most"), F.first("source_size").alias("size")).collect()}
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = _targets(sizes)
    for s, r in got.items():
        assert r.size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.most <= 3 and abs(r.taken - r.target) <= max(0.01 * r.target, 3)
    again = mixing.mix(frame.repartition(5), size=F.col("words"))
    assert mixed.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).isEmpty()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(odd).where("taken <= 3 * size").count() == odd.count()


def _rates(sizes, prior, target, cap=3.0):
    """The tilt by bisection."""
    tilted = lambda lam: np.where(prior > 0, np.minimum(cap, prior * np.exp(np.minimum(700, lam * sizes))), 0.0)
    low, high = -40.0, 40.0
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (low, lam) if (sizes * tilted(lam)).sum() > target else (lam, high)
    return tilted(high)


@pytest.mark.parametrize("with_prior", [False, True])
def test_mixing_rates_equal_a_plain_solver(spark, with_prior):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 5 == 0 else f"s{i % 5}", int(rng.lognormal(4, 1.3)) + (i % 9 > 0), float(rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]))) for i in range(400)]
    rows += [(1000 + i, "rare", 10 * i, 1.0) for i in range(4)] + [(2000, "barred", 50, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, words long, copies double")
    prior = F.when(F.col("doc_id") >= 0, F.col("copies")) if with_prior else None
    got = mixing.mix(frame, size=F.col("words"), prior=prior).toPandas()
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets = _targets(sizes)
    for s in sizes:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        want = own.doc_id.map({r[0]: max(0.0, r[3] or 0.0) if with_prior else 1.0 for r in rows}).to_numpy()
        n = own["size"].to_numpy().astype(float)
        rates = _rates(n, want, targets[s])
        assert np.allclose(own.rate, rates, atol=1e-5), (s, targets[s], np.c_[n, want, own.rate, rates][~np.isclose(own.rate, rates, atol=1e-5)])
        assert own.copies.between(0, 3).all() and (own.copies[want == 0] == 0).all()
        reach = 3 * n[want > 0].sum()
        assert abs(own.taken.sum() - min(targets[s], reach)) <= max(0.01 * targets[s], n[n > 0].min(initial=1e9) if (want > 0).any() else 0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_of_documents_meets_every_target(spark, sf):
    found = mixing.mix(table(spark, SF.replace("sf0.001", sf), "documents")).toPandas()
    for _, own in found.groupby("source", dropna=False):
        nearest = max(0.01 * own.target.iloc[0], own["size"][own["size"] > 0].min())
        assert abs(own.taken.sum() - own.target.iloc[0]) <= nearest and (own.taken <= 3 * own["size"]).all()


def test_mixing_of_one_hot_size(spark):
    """All documents of a source in one group: the further copies go by hash alone."""
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"), F.lit(7).alias("words"))
    got = {r.source: r for r in mixing.mix(frame, size=F.col("words")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    assert all(abs(r.taken - r.target) <= 3.5 and r.most - r.least == 1 for r in got.values() if r.target < 21000 - 1)


def test_digest_of_ids(spark, docs):
    row = queries.op5_cost_balanced_packing(spark, SF).orderBy("doc_id", "start").first()
    whole = packing.pack(docs, queries.tokenizer_path()).orderBy("doc_id", "start").first()
    assert row.ids_crc32 == zlib.crc32(whole.ids)
