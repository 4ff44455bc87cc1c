"""The pipeline's stages, each against what its operator says of the stage's own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", reason="taken away together with the llm folders")


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(3).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    blank = docs.limit(2).selectExpr("doc_id + 200000 AS doc_id", "CASE WHEN doc_id % 2 = 0 THEN '1 2 3' END AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(blank)
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        kept.append(docs.select("doc_id").distinct().count())
        if k < 4:
            assert docs.columns == before.columns, name
    copies = {r.doc_id for r in extra.collect()}
    ids = {r.doc_id for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    assert not ids & copies and not any(i >= 200000 for i in ids)
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 100
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
