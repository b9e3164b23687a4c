import __spark_entry__ as entry
import corpus_pipeline
from gaugeflow.llm import pii

SF = "/root/testdata/sf0.01"


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, last = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}, None
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        path = str(tmp_path / name)
        result.write.parquet(path)
        result = spark.read.parquet(path)
        now = {r.doc_id for r in result.select("doc_id").collect()}
        assert now <= ids and len(now) == result.count()
        if name in ("quality", "near_duplicates", "decontamination"):
            assert 0.5 * len(ids) < len(now) < len(ids)
            assert result.columns == columns
        if name == "pii":
            assert now == ids and result.columns == columns
            before = {x[2:] for r in docs.collect() for x in pii.entities(r.text)}
            after = {x[2:] for r in result.collect() for x in pii.entities(r.text)}
            assert before and not before & after
        docs, ids, last = result, now, name
    assert last == "mix" and docs.where("taken > 0").count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
