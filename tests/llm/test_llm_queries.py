"""The registered queries of the subpackage and the pipeline, over whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, same

from marginalia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLES:
        assert same(df, connect(sf), queries.ORACLES[name]) > 0
    else:
        ids = df.select("doc_id").distinct().count()
        assert ids == spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count()


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert packed == kept
