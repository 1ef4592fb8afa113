"""The SQL twins against brute force, and every twin's columns against its query's."""

import duckdb
import pandas as pd
import pytest
from fixtures import corpus

import brute
from conftest import SF
from topicloom.llm import LLM_ORACLES, LLM_QUERIES, oracles


def test_sql_equals_brute_force():
    rows = corpus()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841 (read by name)
    near = {r[0]: r[1:] for r in duckdb.sql(oracles.NEAR_DUPLICATES).fetchall()}
    assert near == brute.near_duplicates(rows)
    cut = {r[0]: r[1:] for r in duckdb.sql(oracles.REPEATS).fetchall()}
    assert cut == {d: (n, gone, brute.sha(kept)) for d, (n, gone, kept) in brute.without_repeats(rows).items()}


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = con.sql(LLM_ORACLES[name]).df(), LLM_QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    key = got.columns[0]
    want, got = (f[sorted(f.columns)].sort_values(key).reset_index(drop=True) for f in (want, got))
    for column in want.columns:
        assert (got[column].fillna("-").values == want[column].fillna("-").values).all(), column
