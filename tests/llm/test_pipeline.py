"""The stages of the corpus pipeline, each on what the one before kept."""

import hashlib

import corpus_pipeline
from ledgerloom.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns and sizes[-1] <= sizes[-2]
        if k == 1:
            shas = [hashlib.sha256(r.text.encode().lower()).digest() for r in docs.select("text").collect()]
            assert len(shas) == len(set(shas))
    assert len(corpus_pipeline.STAGES) == 5 and sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.copy) for r in whole.select("doc_id", "copy").collect()) == sorted((r.doc_id, r.copy) for r in docs.select("doc_id", "copy").collect())


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
