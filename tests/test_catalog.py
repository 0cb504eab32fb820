"""Registered queries agree with their SQL at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from passagelake.catalog.oracles import ORACLES
from passagelake.catalog.queries import QUERIES
from scripts.check_oracles import TABLES, rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize(
    "name",
    [
        "tokenize_documents", "sentence_split", "upload_checks", "dedup_documents",
        "chunk_documents", "term_frequency", "fuzzy_expand", "bm25_scoped", "hybrid_search",
        "mmr_spread", "answer_sources", "history_messages",
    ],
)
def test_query_agrees_with_sql(spark, db, name):
    ours, theirs = queries()[name](spark, DATA).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0 and rows(ours) == rows(theirs)


def test_entry(spark):
    answers = entry(spark)
    assert answers.columns == ["query_id", "mode", "answer", "cited", "n_sources"]
    assert answers.count() == 40
