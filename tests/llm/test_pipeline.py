"""The pipeline's stages, one after the other, over the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline


def test_each_stage_works_on_what_the_last_kept(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, total = docs.columns, docs.count()
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{name}"
        before = docs.count()
        stage(spark, docs, folder).write.parquet(path)
        result = spark.read.parquet(path)
        if place < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == columns
            assert 0.7 * before < result.count() <= before
            assert result.exceptAll(docs).count() == 0
        else:
            assert result.count() == before and result.where(F.col("n_tokens") > 0).count() > 0.9 * before
        docs = result
    run = corpus_pipeline.run(spark, folder)
    assert docs.count() < total
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))
