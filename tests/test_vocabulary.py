"""Bounded vocabulary: the scripted cases of the blueprint and random invariants."""

import random

from pyspark.sql import functions as F

from topicloom.operators import tokens as T
from topicloom.operators import vocab as Vb
from topicloom.operators.ranking import global_rank
from topicloom.storage import materialize


def freqs(spark, terms):
    """Frequencies that fall in the order of ``terms``."""
    return spark.createDataFrame([(t, len(terms) - i) for i, t in enumerate(terms)], "term string, freq bigint")


def ids(df, terms):
    found = {r["term"]: r["wid"] for r in df.collect()}
    return [found[t] for t in terms]


def add(spark, vocab, terms, t, capacity):
    step = Vb.vocab_add(vocab, freqs(spark, terms), t, capacity)
    return materialize(step.vocab, "v"), ids(step.issued, terms)


def pin(spark, vocab, terms, step):
    return materialize(Vb.vocab_use_counts(vocab, spark.createDataFrame([(t, step) for t in terms], "term string, step int")), "p")


def test_one_term_at_a_time(spark):
    vocab = Vb.empty_vocab(spark)
    got = []
    assert ids(T.lookup_term_ids(freqs(spark, ["ash"]).select("term"), vocab), ["ash"]) == [-1]
    for term, t in (("ash", 0), ("birch", 1), ("cedar", 1), ("ash", 1)):
        vocab, wid = add(spark, vocab, [term], t, 2)
        got += wid
    assert got == [0, 1, 0, -1]


def test_batches_of_terms(spark):
    first = ["t1", "t2", "t3", "t4", "t5"]
    vocab = Vb.empty_vocab(spark)
    assert sum(ids(T.lookup_term_ids(freqs(spark, first).select("term"), vocab), first)) == -5
    vocab, wid = add(spark, vocab, first, 0, 8)
    assert wid == [0, 1, 2, 3, 4] and sum(wid) == 10
    vocab = pin(spark, vocab, first, 1)
    second = ["u1", "u4", "u2", "u3"]
    vocab, wid = add(spark, vocab, second, 1, 8)
    assert wid == [5, 6, 7, -1]
    vocab = pin(spark, pin(spark, vocab, second, 1), second, -1)
    third = ["v1", "v2", "v3", "v4", "v5"]
    vocab = pin(spark, vocab, third, -1)
    assert vocab.agg(F.min("use_count")).first()[0] == 0
    vocab, wid = add(spark, vocab, third, 2, 8)
    assert wid == [5, 7, 6, -1, -1]
    assert {r["term"] for r in vocab.collect()} == set(first) | set(third[:3])


def test_each_candidate_is_used_once(spark):
    vocab, _ = add(spark, Vb.empty_vocab(spark), list("abcdefgh"), 0, 8)
    vocab = pin(spark, vocab, list("abcd"), 1)
    vocab, wid = add(spark, vocab, ["p", "q"], 5, 8)
    assert wid == [4, 5]


def test_batch_update_invariants(spark):
    rng = random.Random(3)
    vocab, size, capacity = Vb.empty_vocab(spark), 0, 12
    for t in range(5):
        terms = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        step = Vb.vocab_update_batch(vocab, freqs(spark, terms), t, capacity, size)
        before = {r["term"] for r in vocab.collect()}
        vocab, size = materialize(step.vocab, "v"), step.size
        rows = vocab.collect()
        assert len(rows) == size <= capacity
        assert sorted(r["wid"] for r in rows) == list(range(size))
        assert before & set(terms) <= {r["term"] for r in rows}
        assert all(r["use_count"] == 0 for r in rows)
        got = {r["term"]: r["wid"] for r in step.term_ids.collect()}
        assert set(got) == set(terms)
        held = {r["term"]: r["wid"] for r in rows}
        assert all(held[t] == w for t, w in got.items() if w >= 0)


def test_global_rank_over_many_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x")).repartition(7)
    ranked, n = global_rank(df, [F.asc("x")], "r", start=0)
    assert n == 5000
    assert ranked.where("r <> x").count() == 0
    empty, n = global_rank(df.where("x < 0"), [F.asc("x")], "r")
    assert n == 0 and empty.count() == 0
