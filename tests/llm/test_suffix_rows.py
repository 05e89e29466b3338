"""Suffix dedup of rows that share an id, or have none, against brute force row by row."""

import random

import numpy as np
from pyspark.sql import functions as F

from confluo.llm import suffix_dedup


def test_rows_of_one_id_equal_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = text(120), text(200)
    rows = [
        (None, passage + text(600)), (None, text(500) + passage + text(50)), (None, text(300)),
        (1, other), (2, other), (2, text(250) + passage), (2, passage + text(150)), (3, text(40) + other[:150]), (4, text(220)), (4, None),
    ]
    rows.append((5, rows[5][1][:200] + text(30)))  # repeats what stands beside a whole copy
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = frame.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), "text").alias("h")).collect()
    seen, want = set(), []
    for i, t, _ in sorted(hashed, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[2])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for x in range(len(raw) - 99):
            if raw[x : x + 100] in seen:
                gone[x : x + 100] = True
            seen.add(raw[x : x + 100])
        want.append((str(i), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in suffix_dedup.deduplicate(frame).collect()) == sorted(want)


def test_texts_of_two_ids_may_share_a_hash(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [text(150) for _ in range(5)]
    rows = [(i, text(rng.randrange(80)) + (passages[i % 5] if i % 3 else "") + text(200)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, bytes(r.kept), r.n_removed) for r in suffix_dedup.deduplicate(frame).collect())
    monkeypatch.setattr(suffix_dedup, "row_hash", lambda *c: F.pmod(F.xxhash64(*c), F.lit(2)))
    assert sorted((r.doc_id, bytes(r.kept), r.n_removed) for r in suffix_dedup.deduplicate(frame).collect()) == want
    assert sum(x[2] for x in want) > 5000
