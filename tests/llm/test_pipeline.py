"""The corpus pipeline: each stage on messy rows, and the whole against brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality
from tests.llm.test_operators import brute_base, brute_components, messy


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_messy_rows(spark, small, name, stage):
    found = stage(spark, messy(spark), small)
    if name != "mixing":
        assert found.columns == corpus_pipeline.COLUMNS
    found.collect()
    assert stage(spark, messy(spark, empty=True), small).collect() == []


def test_pipeline_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = quality.graded(docs, quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))).where("kept")
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    least, _ = brute_components(texts, corpus_pipeline.NEAR_PERCENT)
    texts = {i: t for i, t in texts.items() if least[i] == i}
    items = [r["text"].encode().lower().split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def leaked(text):
        w = text.encode().lower().split()
        grams = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        return any(len({p for j in range(len(q) - 4) if tuple(q[j : j + 5]) in grams for p in range(j, j + 5)}) >= 0.6 * len(q) for q in items)

    texts = {i: t for i, t in texts.items() if not leaked(t)}
    found = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in found} <= set(texts)
    words = {i: len(t.split()) for i, t in texts.items()}
    assert abs(sum(words[r["doc_id"]] for r in found) - sum(words.values())) < 0.1 * sum(words.values())
    assert not any(b.startswith(("assign", "access")) for r in found for b in brute_base(r["text"]))
    assert all(len(r["text"]) == len(texts[r["doc_id"]]) for r in found)
    places = [(r["mix_shard"], r["mix_order"], r["mix_copy"]) for r in found]
    assert len(places) == len(set(zip([r["doc_id"] for r in found], [p[2] for p in places], strict=True)))


def test_clean_documents_stay(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1")
    docs = spark.read.parquet(f"{small}/documents.parquet").join(labels, "doc_id", "left_semi")
    kept = corpus_pipeline.quality_stage(spark, docs, small)
    assert kept.count() >= 0.97 * docs.count()
    assert kept.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").isEmpty()
