"""Counts exchanged as arrays."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from topicloom.catalog import registry
from topicloom.operators import exchange, gibbs, shards
from topicloom.operators import tokens as T
from topicloom.params import TopicParams
from topicloom.plans import batch
from topicloom.storage import Workspace

PARAMS = TopicParams(num_topics=3, alpha=0.5, beta=0.1, tokens_per_shard=300, block_tokens=16, duration=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("top", [0, 1, 254, 255, 256, 1 << 40])
def test_counts_of_any_size_come_back(top):
    counts = np.array([[0, top, 3], [255, 254, 256]], dtype=np.int64)
    assert (exchange.counts_from_bytes(exchange.counts_to_bytes(counts), 3) == counts).all()
    assert exchange.counts_from_bytes(exchange.counts_to_bytes(counts[:0]), 3).shape == (0, 3)


@pytest.mark.parametrize("below", [1, 256, 257, 65_536, 65_537])
def test_numbers_come_back(below):
    numbers = np.array([0, below - 1, below // 2])
    assert (exchange.from_bytes(exchange.to_bytes(numbers, below), 3) == numbers).all()


@pytest.mark.parametrize("segment_tokens", [65_536, 8])
def test_a_sweep_writes_a_row_per_shard_and_class(spark, planted, monkeypatch, segment_tokens):
    """Not one per segment, nor one per shard and word; words of a single shard are not sent at all."""
    alone = planted.union(spark.createDataFrame([(100 + i, f"only{i} here{i} a") for i in range(50)], "doc_id bigint, text string"))
    written, save = {}, Workspace.save_bucketed

    def counted(self, df, label, *args, **rest):
        table = save(self, df, label, *args, **rest)
        sent = table.where("wid IS NOT NULL").select("*")
        written[label] = (table.count(), [len(r[0]) for r in sent.select("counts").collect()] if label.startswith("sweep") else None)
        return table

    monkeypatch.setattr(Workspace, "save_bucketed", counted)
    params = replace(PARAMS, segment_tokens=segment_tokens)
    model = batch.fit_distributed(alone, params, sweeps=2)
    number = shards.shard_count(model.tokens.count(), params)
    buckets = batch._bucket_number(spark, number)
    assert {"sweep0", "sweep1", "sweep2"} <= set(written)
    for label in ("sweep1", "sweep2"):
        rows, sizes = written[label]
        assert rows <= number * (1 + buckets)
        long = 0 if segment_tokens == 65_536 else 60
        assert sum(sizes) - 8 * len(sizes) <= number * (16 + long) * 3  # 16 letters in every shard, a byte a cell
    assert rows_of(model.rows) == rows_of(shards.packed_counts(model.tokens.groupBy("doc_id").agg(
        F.collect_list("wid").alias("wid"), F.collect_list("topic").alias("topic")), 3))


@pytest.mark.parametrize("changes", [{}, {"segment_tokens": 8}, {"sampler": "mh"}, {"tokens_per_shard": 10_000}])
def test_draws_are_those_of_the_sweep_over_rows(spark, planted, changes):
    """The same topics as the kernel that pulls a row per word, with the others' segments as of the exchange."""
    params = replace(PARAMS, **changes)
    model = batch.fit_distributed(planted, params, sweeps=2)
    number = shards.shard_count(model.tokens.count(), params)
    started = gibbs.init_topics_uniform(T.encode_docs(T.token_table(planted), model.vocab), params)
    work = Workspace(spark)
    packed = work.save(shards.pack_segments(started, params, number), "packed")
    for sweep in (1, 2):
        rows = work.save(shards.packed_counts(packed, 3), "rows")
        smooth = [sum(r["n"][z] for r in rows.collect()) + model.vocab_size * params.beta for z in range(3)]
        based = shards.refresh_base(packed, params) if packed.where("seg > 0").count() else packed
        packed = work.save(shards.sweep_shards(based, rows, smooth, params, fill=params.beta, first=sweep), "swept")
    assert rows_of(model.tokens) == rows_of(shards.unpack_tokens(packed).select(*model.tokens.columns))


def test_numbered_texts_go_once_they_are_packed(spark, monkeypatch):
    dropped, drop = [], Workspace.drop
    monkeypatch.setattr(Workspace, "drop", lambda self, table: (dropped.append(table.columns), drop(self, table))[1])
    registry.packed_docs(spark, SF)
    assert ["part", "doc_id", "codes", "terms", "freqs"] in dropped
