import os

import pytest

import corpus_pipeline
from lakekin.llm.queries import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, edge_docs):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == edge_docs.columns and docs.schema.simpleString() == edge_docs.schema.simpleString(), name
    assert {"doc_id", "n_tokens", "ids"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, "").columns)


def test_stages_on_no_rows(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_run_against_single_steps(spark):
    """Each stage against the brute force of its own operator's tests."""
    import test_exact_dedup
    import test_host_rules
    import test_lsh_forest

    docs = table(spark, FOLDER, "documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    good = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    ids = {r["doc_id"] for r in good.collect()}
    fails = {i for i, t, _ in rows if (m := test_host_rules.brute(t))[0] < 50 or 100 * m[5] > 50 * m[0]}
    assert not ids & fails and len(ids) > len(rows) / 2
    rows = [r for r in rows if r[0] in ids]
    unique = corpus_pipeline.exact_copies(spark, good, FOLDER)
    ids = {r["doc_id"] for r in unique.collect()}
    assert ids == {i for i, _, _, kept, _ in test_exact_dedup.brute(rows) if kept}
    rows = [r for r in rows if r[0] in ids]
    single = corpus_pipeline.near_copies(spark, unique, FOLDER)
    want = test_lsh_forest.brute(rows)
    assert {r["doc_id"] for r in single.collect()} == {i for i in want if want[i] == i}
    mixed = corpus_pipeline.source_mix(spark, single, FOLDER)
    assert corpus_pipeline.token_ids(spark, mixed, FOLDER).count() == mixed.count() > 0
