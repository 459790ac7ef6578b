"""The pipeline on small tables, stage by stage."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_text_operators import toxic_docs  # noqa: E402


def test_stages(spark, tmp_path):
    d, labels = toxic_docs(spark, 200)
    long = " ".join(f"plain{k}" for k in range(80))
    more = spark.createDataFrame([(1001, long), (1002, long + " x"), (1003, long), (1004, "token = 'abcdefabcdefabcdef12' here"), (1005, None), (1006, "")], "doc_id long, text string")
    d = d.unionByName(more).selectExpr("doc_id", "text", "'en' lang", "concat('s', doc_id % 3) source", "cast(length(text) as long) n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels.selectExpr("doc_id", "1 quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == d.columns
    ids = lambda n: [r.doc_id for r in seen[n]]
    assert all(i % 4 for i in ids("toxicity") if i < 200) and len(ids("toxicity")) == 156
    assert [i for i in ids("near-duplicates") if i in (1001, 1002, 1003)] == [1001] and {1005, 1006} <= set(ids("near-duplicates"))
    assert "abcdefabcdef" not in next(r.text for r in seen["secrets"] if r.doc_id == 1004)
    assert len(seen["bpe"]) == len(seen["mixing"]) and set(ids("mixing")) <= set(ids("secrets"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["bpe"])


def test_stages_on_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
