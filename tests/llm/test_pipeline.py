"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline
from quern.llm import neardup, secrets
from tests.llm.test_neighbours import brute_classes
from tests.llm.test_tokens import check_packing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    identified = stages["language id"](spark, docs, sf_dir)
    assert identified.columns == docs.columns and identified.count() == docs.count()  # all of these are prose
    unique = stages["near duplicates"](spark, identified, sf_dir)
    classes = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert unique.columns == docs.columns
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(classes.values()))
    redacted = stages["secrets"](spark, unique, sf_dir)
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in redacted.collect():
        assert r.text == secrets.redact_text(before[r.doc_id]) and r.n_chars == len(r.text)
        assert not secrets.base_spans(r.text)
    packed = stages["packing"](spark, redacted, sf_dir)
    check_packing(redacted, packed.collect(), 2048)


def test_run_equals_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).selectExpr("sum(length)").first()[0] > 0


def test_odd_documents(spark, docs, sf_dir):
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
    assert now.count() > 0


def test_words_of_shingles():
    assert neardup.shingles("A b, c!", 5) == ["a b c"]
