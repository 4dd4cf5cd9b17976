"""Registered queries over the smallest tables: whole results, and SQL where there is some."""

import os

import duckdb
import pytest

from netbehave.llm import lm, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels".split()
OTHERS = {"op11_host_trust": ("pages", "page_id"), "op13_orchard_codes": ("embeddings", "vec_id")}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(OTHERS) - {"op12_filter_audit"}))
def test_every_document_is_answered(spark, name, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 10)
    ids = {row["doc_id"] for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
    result = queries.QUERIES[name](spark, SF_DIR)
    rows = result.collect()
    assert {row["doc_id"] for row in rows} == ids
    if name != "op10_section_tokens":
        assert len(rows) == len(ids)


@pytest.mark.parametrize("name", OTHERS)
def test_every_page_and_vector_is_answered(spark, name):
    table, key = OTHERS[name]
    ids = sorted(row[key] for row in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
    assert sorted(row[key] for row in queries.QUERIES[name](spark, SF_DIR).collect()) == ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS FROM read_parquet('{SF_DIR}/{table}.parquet')")
    expected = duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(item[0] for item in expected.description)
    want = sorted(map(tuple, expected.df()[columns].values.tolist()))
    result = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(result.columns) == columns
    assert sorted(map(tuple, result.select(columns).collect())) == want
