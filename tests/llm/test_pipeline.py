import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert ids is None or now <= ids
        ids = now
    assert docs.filter("ids_sha256 is null").count() == 0 and ids


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}{k}")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op")))
def test_queries_run_over_the_small_tables(spark, name):
    found = __spark_entry__.queries()[name](spark, SF)
    assert found.count() >= 50
