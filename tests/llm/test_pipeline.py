"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from confluo.llm import mixing, pii
from confluo.llm.common import stored, table

from test_near_copies import _kept
from test_operators import SF, _base, odd  # noqa: F401

LABELS = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, LABELS, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], LABELS), f"test-{name}"))
    return out


def test_quality_keeps_good_and_drops_bad(spark, stages):
    marked = stages[0].join(table(spark, LABELS, "labels"), "doc_id").join(stages[1].select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").fillna(0, ["kept"])
    kept = {r.quality: r.k for r in marked.groupBy("quality").agg(F.avg("kept").alias("k")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.05 and stages[1].columns == stages[0].columns


def test_one_document_of_each_component(stages):
    """The stage links by five-word shingles and a similarity of 0.8, not by op7's fingerprints."""
    firsts = _kept({r.doc_id: r.text for r in stages[1].collect()})
    assert {r.doc_id for r in stages[2].collect()} == firsts and stages[2].count() == len(firsts)


def test_no_personal_data_is_left(stages):
    assert all(_base(r.text)[0] == [0, 0, 0, 0] and r.n_chars == len(r.text) for r in stages[3].collect())
    clean = stages[2].where(F.size(pii.spans(F.col("text"))) == 0)
    assert clean.select("doc_id", "text").exceptAll(stages[3].select("doc_id", "text")).isEmpty()


def test_mix_takes_copies(stages):
    want = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies}
    assert {r.doc_id: r.n for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_all_copies_are_packed(stages):
    got = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg((F.sum("length") / F.first("doc_tokens")).cast("int").alias("n")).collect()}
    assert got == {r.doc_id: r.n for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}


def test_edge_cases(spark, odd):  # noqa: F811
    docs, empty = odd, odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stored(stage(spark, docs, LABELS), f"odd-{name}"), stored(stage(spark, empty, LABELS), f"empty-{name}")
        assert empty.count() == 0
        if name != "packing":
            assert docs.columns == odd.columns
