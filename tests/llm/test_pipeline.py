import corpus_pipeline
from parlance.llm import quality


def test_stages(spark, sf_dir, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs, before = documents, documents.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        n = out.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns, name
        if k < 3:
            assert 0 < n <= before, name
        if k == 0:
            kept = {r["doc_id"] for r in out.collect()}
            assert all(i in kept for i, q in labels.items() if q == 1)
        docs, before = out, n
    assert docs.where("n_tokens <> size(ids)").count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_read_written_tables(spark, sf_dir, documents, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.where("doc_id % 2 = 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    out = corpus_pipeline.run(spark, sf_dir)
    folder = spark.sparkContext.getCheckpointDir().split(":", 1)[-1]
    assert all(folder in f for files in [*read[1:], out.inputFiles()] for f in files)
    assert len(read) == 3 and read[0] == documents.inputFiles() and sorted(out.collect()) == sorted(documents.where("doc_id % 2 = 0").collect())


def test_no_documents(spark, documents, sf_dir):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0 and quality.THRESHOLD == 0.3
