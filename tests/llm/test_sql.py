"""Corpus queries with SQL against DuckDB, and that all of them and the pipeline run."""

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, sf):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.sql(queries.ORACLES[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in places)) for r in result.fetchall())


def test_pipeline(spark, sf, awkward):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count() > 0
