import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == n
    assert 0 < corpus_pipeline.run(spark, sf_dir).count() < n
