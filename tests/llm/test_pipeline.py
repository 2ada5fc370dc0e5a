"""The pipeline's stages, each on its own input."""

import pytest

from kilngraph.llm import decontam
from tests.llm import brute


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def test_order_and_columns(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = list(stages)
    assert len(names) == 5
    for name in names[:-1]:
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns


def test_near_dedup_keeps_one_of_each_group(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.selectExpr("doc_id + 5000 doc_id", "concat(text, ' tail') text", "lang", "source", "n_chars").select(docs.columns)).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = {r["doc_id"] for r in stages["SimHash near-dedup"](spark, docs, sf).collect()}
    links = [(i, j) for i in range(len(rows)) for j in range(i) if brute.jaccard(rows[i][1], rows[j][1]) >= 0.8]
    roots = brute.components(len(rows), links)
    assert kept == {min(rows[k][0] for k, r in enumerate(roots) if r == g) for g in set(roots)}


def test_decontamination_drops_documents(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontam.contamination(docs, bench).where("contaminated").collect()}
    kept = {r["doc_id"] for r in stages["benchmark decontamination"](spark, docs, sf).collect()}
    assert bad and kept == {r["doc_id"] for r in docs.collect()} - bad


def test_run(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
