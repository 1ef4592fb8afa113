"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from conftest import SF
from topicloom.catalog import ORACLES, QUERIES

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF)
    got = ordered(result.toPandas())
    if name not in ORACLES:
        assert len(got) > 0
        return
    relation = duck.sql(ORACLES[name])
    want = ordered(relation.df())
    assert dict(zip(relation.columns, map(str, relation.types))) == {c: TYPES[t] for c, t in result.dtypes}
    assert len(got) == len(want)
    for column in want.columns:
        assert (got[column].values == want[column].values).all(), column


@pytest.mark.parametrize("name", ["phi", "reset_new_rows", "blend_batch", "blend_late_batch", "model_consistency", "topic_top_words_decayed"])
def test_word_rows_are_counted_before_ids(spark, monkeypatch, name):
    """No token is joined with the vocabulary where only counts of words are wanted."""
    from topicloom.operators import tokens

    def refused(*_):
        raise AssertionError("tokens encoded one by one")

    monkeypatch.setattr(tokens, "encode_docs", refused)
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["push_totals", "push_deltas"])
def test_both_sweeps_are_drawn_in_one_pass(spark, name):
    """What is added up is a saved table: the texts are not read again for each use."""
    assert not any("documents.parquet" in path for path in QUERIES[name](spark, SF).inputFiles())
