"""The similarity join against all pairs."""

import random

import pytest
from confluo.operators import similarity
from pyspark.sql import functions as F


def _pairs(left, right, bound):
    jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    return {(i, j) for i, a in left for j, b in right if jaccard(set(a), set(b)) >= bound - 1e-12}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id int, tokens array<string>")


@pytest.mark.parametrize("bound,hot", [(0.2, 512), (0.2, 3), (0.35, 512), (0.5, 3), (0.8, 512), (1.0, 512)])
def test_equals_all_pairs(spark, monkeypatch, bound, hot):
    monkeypatch.setattr(similarity, "HOT", hot)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    rows = lambda n: [(i, rng.choices(words, weights=[30 - k for k in range(30)], k=rng.randint(0, 12))) for i in range(n)]
    left, right = rows(120), rows(90)
    got = [(r.left_id, r.right_id) for r in similarity.similar_sets(_frame(spark, left), _frame(spark, right), bound).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(left, right, bound)


def test_common_words_do_not_pair_everything(spark):
    """Five words, two of them from five common ones: candidates stay within a small multiple of the pairs there are."""
    rng = random.Random(1)
    common, rare = [f"c{i}" for i in range(5)], [f"r{i}" for i in range(2000)]
    for n in (250, 500):
        rows = [(i, rng.sample(common, 2) + rng.sample(rare, 3)) for i in range(n)]
        frame = _frame(spark, rows)
        made = similarity.candidates(frame, frame, 0.2).count()
        true = len(_pairs(rows, rows, 0.2))
        assert similarity.similar_sets(frame, frame, 0.2).count() == true and made <= 10 * true
    # where four tokens are needed, sharing the two common ones is not enough to meet
    rows = [(i, ["c0", "c1"] + [f"x{i}y{k}" for k in range(8)]) for i in range(300)]
    assert similarity.candidates(_frame(spark, rows), _frame(spark, rows), 0.25).where(F.col("left_id") != F.col("right_id")).count() == 0
