"""The best partners of token sets against all pairs, and how many rows are made on the way."""

import random

import pytest
from confluo.operators import similarity
from confluo.plans import scores
from pyspark.sql import functions as F


def _sides(spark, left, right):
    a = spark.createDataFrame(left, "id int, tokens array<string>, marks array<string>")
    b = spark.createDataFrame([(i, t, [(m, i + k) for k, m in enumerate(ms)]) for i, t, ms in right], "id int, tokens array<string>, places array<struct<mark:string,first:int>>")
    return a, b


def _score(similarity, mark):
    value = F.round(F.least(F.lit(1.0), similarity + F.when(mark == "", 0.0).otherwise(0.15)), 4)
    return F.when(value >= 0.35, value)


@pytest.mark.parametrize("bound,many,depth", [(0.2, 64, 4), (0.2, 3, 4), (0.2, 2, 2), (0.1, 1, 4), (0.35, 2, 4)])
def test_equals_all_pairs(spark, monkeypatch, bound, many, depth):
    monkeypatch.setattr(similarity, "MANY", many)
    monkeypatch.setattr(similarity, "DEPTH", depth)
    monkeypatch.setattr(similarity, "HOT", 4)
    rng = random.Random(11)
    words, weights = [f"w{i}" for i in range(30)], [(30 - k) ** 2 for k in range(30)]

    def sets(n):
        found = {frozenset(rng.choices(words, weights=weights, k=rng.randint(1, 9))) for _ in range(n)}
        return [(7 * i % 1009, sorted(t), ["", *rng.sample(["=x", "=y", "=z"], rng.randint(0, 2))]) for i, t in enumerate(sorted(found, key=sorted))]

    left, right = sets(110), sets(90)
    wanted = set()
    for i, t, marks in left:
        for mark in marks:
            listed = []
            for j, u, others in right:
                s = len(set(t) & set(u)) / len(set(t) | set(u))
                value = round(min(1.0, s + (0.15 if mark else 0.0)), 4)
                if mark in others and s >= bound - 1e-12 and value >= 0.35:
                    listed.append((-value, j + others.index(mark), j))
            wanted |= {(i, mark, j, first, -value) for value, first, j in sorted(listed)[:3]}
    got = [tuple(r) for r in similarity.best_partners(*_sides(spark, left, right), bound, 3, _score).select("left_id", "mark", "right_id", "first", "score").collect()]
    # two first places may be equal, as they are made by counting on
    assert len(got) == len(wanted) and {(a, m, f, s) for a, m, _, f, s in got} == {(a, m, f, s) for a, m, _, f, s in wanted}


def test_common_words_make_no_pairs(spark, monkeypatch):
    """Two words that all questions share: rows grow with the questions, not with their pairs."""
    made, met = [], similarity._met
    monkeypatch.setattr(similarity, "MANY", 8)
    monkeypatch.setattr(similarity, "_met", lambda *args: [f := met(*args), made.append(f.count())][0])
    totals = []
    for n in (200, 400):
        made.clear()
        rows = [(i, "large ring x" + "".join(chr(97 + int(c)) for c in str(i)), ["A"]) for i in range(n)]
        cases = spark.createDataFrame(rows, "case_id int, question string, countries array<string>")
        found = scores.match_markets(cases, cases.withColumnRenamed("case_id", "market_id")).collect()
        # all share two of four words, which the country raises to 0.65: the case itself, then the smallest ids
        assert len(found) == 3 * n and {r.market_id for r in found if r["rank"] > 1} <= {0, 1, 2}
        totals.append(sum(made))
    assert totals[0] <= 20 * 200 and totals[1] <= 2.1 * totals[0]
