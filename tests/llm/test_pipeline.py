"""The pipeline against its stages by hand."""

from __future__ import annotations

import corpus_pipeline as C


def test_each_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf))
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns, name
        n = docs.count()
        assert 0 < n <= before, name
        before = n
    kept = {r[0] for r in docs.select("doc_id").collect()}
    out = C.run(spark, sf)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == kept
