"""The pipeline's stages, each against its own input."""

import corpus_pipeline
from tillstream.llm import decontaminate, jaccard_join, quality

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "sharding":
            assert out.dtypes == docs.dtypes
        if name == "quality classifier":
            scores = quality.quality_report(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
        if name == "n-gram Jaccard join":
            found = jaccard_join.join_report(docs)
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in found.where("doc_id = component_id").collect()}
        if name == "benchmark decontamination":
            bad = decontaminate.contamination_report(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in bad.collect()}
        docs = out
    got = docs.collect()
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect()))
    assert len({(r.shard, r.slot) for r in got}) == len(got)
