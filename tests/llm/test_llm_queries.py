"""Registered queries of these operators against their SQL, and the pipeline's stages."""

import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from kindred.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("KINDRED_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    expected = connection.sql(SQL[name])
    found = QUERIES[name](spark, FOLDER).select(*expected.columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected.fetchall(), key=str)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER).cache()
        assert 0 < docs.count() <= before
        before = docs.count()
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert {"doc_id", "pieces"} <= set(docs.columns)
