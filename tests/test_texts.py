"""Texts as rows of term numbers against the same work on token rows."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from topicloom.catalog import QUERIES
from topicloom.functions.sampling import keyed_uniform
from topicloom.functions.uniforms import keyed_uniforms
from topicloom.operators import gibbs, shards, texts as X, tokens as T
from topicloom.operators.counts import topic_vectors
from topicloom.operators.vocab import build_vocab_sorted
from topicloom.params import TopicParams
from topicloom.plans import online
from topicloom.storage import materialize

PARAMS = TopicParams(num_topics=3, segment_tokens=4)
ROWS = [(1, "b a  a c b a"), (2, None), (3, ""), (None, "c d"), (7, "a b c d e f g h i"), (7, "b a"), (-5, "z z")]


def odd_docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string")


def sorted_rows(df):
    return sorted((tuple(map(str, row)) for row in df.collect()))


def test_uniforms_of_arrays_equal_the_column(spark):
    ids, pos = [0, None, 12, -7, 2**62], np.array([0, 9, 10, 131071, 131072])
    table = spark.createDataFrame([(d, int(p)) for d in ids for p in pos], "doc_id bigint, pos int")
    want = {(r[0], r[1]): r[2] for r in table.select("doc_id", "pos", keyed_uniform(42, F.col("doc_id"), F.col("pos"), 3)).collect()}
    got = keyed_uniforms(42, ids, np.repeat(np.arange(len(ids)), len(pos)), np.tile(pos, len(ids)), 3)
    assert got.tolist() == [want[d, int(p)] for d in ids for p in pos]


def test_packed_texts_equal_packed_tokens(spark):
    docs = odd_docs(spark)
    tokens, coded = T.token_table(docs), materialize(X.coded_texts(docs), "coded")
    freqs = materialize(X.coded_frequency(coded), "freqs")
    assert sorted_rows(freqs) == sorted_rows(T.term_frequency(tokens))
    vocab = build_vocab_sorted(freqs).where("term <> 'c'")
    want = shards.pack_segments(gibbs.init_topics_uniform(T.encode_docs(tokens, vocab), PARAMS), PARAMS, 2)
    got = X.pack_texts(coded, vocab, PARAMS, 2)
    assert sorted_rows(got) == sorted_rows(want.select(got.columns))
    assert sorted_rows(shards.document_counts(got, 3)) == sorted_rows(topic_vectors(shards.unpack_tokens(want), "doc_id", 3))


def test_texts_are_counted_without_a_row_per_token(spark):
    docs = odd_docs(spark)
    tokens = gibbs.init_topics_uniform(T.token_table(docs), PARAMS, 1)
    for key in ("term", "doc_id"):
        got = X.sampled_counts(docs, PARAMS, range(1, 2), key)
        assert sorted_rows(got) == sorted_rows(topic_vectors(tokens, key, 3))
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    counted = materialize(X.counted_texts(docs, PARAMS), "counted")
    assert X.document_number(counted) == (4, True)
    assert sorted_rows(X.term_vectors(counted, 3)) == sorted_rows(topic_vectors(gibbs.init_topics_uniform(tokens, PARAMS), "term", 3))


@pytest.mark.parametrize("forget", [False, True])
def test_online_steps_over_texts_equal_those_over_tokens(spark, monkeypatch, forget):
    """Null and repeated documents, also across parts, terms known and new, an empty batch."""
    monkeypatch.setattr(X, "PART_TOKENS", 9)
    one = odd_docs(spark)
    two = spark.createDataFrame([(d, " ".join("abcdexyz"[(d * 5 + i * i) % 8] for i in range(12))) for d in (3, 4, 4, 9, 7)], one.schema)
    batches = [one.limit(0), one, one.limit(0), two.unionByName(one)]
    want = online.fit_online([T.token_table(b) for b in batches], PARAMS, forget)
    got = online.fit_online_texts(batches, PARAMS, forget)
    assert sorted_rows(got.rows) == sorted_rows(want.rows)
    assert (got.alpha, got.iteration) == (want.alpha, want.iteration)
    assert got.iteration == 2


def test_online_query_makes_no_row_per_token(spark, monkeypatch):
    monkeypatch.setattr(T, "token_table", None)
    assert QUERIES["fit_online"](spark, SF).count() > 0
