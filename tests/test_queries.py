"""Every query of the library against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import pytest

from tessera.plans import registry
from tests.oracle import compare, duck

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf_dir, db):
    assert compare(QUERIES[name](spark, sf_dir), db, SQL[name]) is None


def test_text_queries_on_whole_texts(spark, sf_dir):
    """What SQL cannot express, against plain Python on the same rows."""
    from tessera.functions import udfs
    from tests.test_operators import plain_excerpt

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["excerpt"] for r in QUERIES["text_excerpts"](spark, sf_dir).collect()} == {i: plain_excerpt(t, 4200) for i, t in texts.items()}
    assert {r["doc_id"]: r["demands"] for r in QUERIES["text_permission_demands"](spark, sf_dir).collect()} == {i: "\n".join(udfs.demands_of(t)) for i, t in texts.items()}
    spoken = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    plain = QUERIES["conv_markdown_plain"](spark, sf_dir).collect()
    assert plain and all(r["plain"] == udfs.plain_of(spoken[r["conversation_id"], r["sequence"]]) for r in plain)
    batches = QUERIES["conv_dialogue_batches"](spark, sf_dir).collect()
    assert batches and all((r["parts"], r["refused"]) == ([udfs.plain_of(spoken[r["conversation_id"], r["sequence"]])], None) for r in batches)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
