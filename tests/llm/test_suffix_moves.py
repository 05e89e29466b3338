"""Suffix dedup moves only the texts that lose something, or may."""

import random

from confluo.llm import suffix_dedup
from confluo.llm.common import sieved


def test_only_texts_with_repeats_move(spark, monkeypatch):
    """Before, every text was shuffled three times."""
    rng = random.Random(7)
    page = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    passage = page()
    texts = {i: page() for i in range(200)}
    texts |= {i: f"{texts[i]} {passage} {i}" for i in range(0, 200, 40)}  # five share a passage
    texts |= {500 + i: texts[i] for i in range(1, 6)}  # five are copies
    moved = []

    def seen(rows, keys, *columns, name):
        out = sieved(rows, keys, *columns, name=name)
        if "text" in rows.columns:
            moved.append(out.where(name).count())
        return out

    monkeypatch.setattr(suffix_dedup, "sieved", seen)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(frame).collect()}
    assert {i for i, r in got.items() if r.n_removed} == {40, 80, 120, 160, *range(501, 506)} and len(got) == 205
    assert all(bytes(got[i].kept).decode() == texts[i] for i in texts if not got[i].n_removed)
    # copies; texts with a repeated anchor; texts that lose something (a few pass by chance)
    assert len(moved) == 3 and moved[0] <= 6 and moved[1] <= 11 and moved[2] <= 10
