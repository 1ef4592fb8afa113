"""Invariants of the samplers and of the streaming trainer."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators import counts as C
from topicloom.operators import gibbs, quality, shards
from topicloom.operators import tokens as T
from topicloom.params import TopicParams
from topicloom.plans import batch, online
from topicloom.sources import documents as D
from topicloom.storage import Workspace, list_names, materialize, shared_root
from topicloom.streaming.trainer import StreamTrainer

PARAMS = TopicParams(num_topics=2, alpha=0.5, beta=0.1, tokens_per_shard=500, block_tokens=16, duration=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def doc_purity(model):
    """Mean share of a document's largest topic."""
    counts = C.topic_vectors(model.tokens, "doc_id", 2)
    return counts.agg(F.avg(F.greatest(F.col("n")[0], F.col("n")[1]) / (F.col("n")[0] + F.col("n")[1]))).first()[0]


def test_sweeps_keep_tokens_and_counts(spark, planted):
    model = batch.fit_distributed(planted, PARAMS, sweeps=3)
    total = T.token_table(planted).count()
    assert sum(model.totals) == total == model.tokens.count()
    assert model.tokens.where("topic < 0 OR topic > 1").count() == 0
    assert rows_of(C.topic_vectors(model.tokens, "wid", 2)) == rows_of(model.rows)
    text = T.decode_docs(model.tokens, model.vocab).select("doc_id", "pos", "term")
    assert rows_of(text) == rows_of(T.token_table(planted))


def test_planted_topics_are_found(spark, planted):
    start = batch.fit_distributed(planted, PARAMS, sweeps=0)
    end = batch.fit_distributed(planted, PARAMS, sweeps=25)
    assert doc_purity(start) < 0.7 and doc_purity(end) > 0.95

    def loglik(model):
        docs, words = C.topic_vectors(model.tokens, "doc_id", 2), C.topic_vectors(model.tokens, "wid", 2)
        pairs = quality.pair_likelihood(
            model.tokens, quality.theta(docs, 0.5, 2, "document"), quality.phi(words, 0.1, 2), 2
        )
        return quality.mean_log(pairs).first()[0]

    assert loglik(end) > loglik(start)


def test_result_does_not_depend_on_partitioning(spark, planted):
    first = rows_of(batch.fit_distributed(planted, PARAMS, sweeps=2).tokens)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = rows_of(batch.fit_distributed(planted.repartition(7), PARAMS, sweeps=2).tokens)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again
    other = rows_of(batch.fit_distributed(planted, replace(PARAMS, seed=7), sweeps=2).tokens)
    assert first != other


def test_long_documents_are_cut_and_whole(spark, planted):
    cut = replace(PARAMS, segment_tokens=8)
    model = batch.fit_distributed(planted, cut, sweeps=20)
    assert rows_of(model.tokens.select("doc_id", "pos")) == rows_of(T.token_table(planted).select("doc_id", "pos"))
    assert doc_purity(model) > 0.9
    packed = shards.pack_segments(model.tokens, cut, 2)
    based = shards.refresh_base(packed, cut)
    whole = {r["doc_id"]: r["n"] for r in C.topic_vectors(model.tokens, "doc_id", 2).collect()}
    for row in based.collect():
        own = [row["topic"].count(t) for t in (0, 1)]
        assert [x + y for x, y in zip(own, row["base"])] == whole[row["doc_id"]]


@pytest.mark.parametrize("segment_tokens", [65_536, 8])
def test_counts_are_exchanged_every_sweep_unless_asked(spark, planted, monkeypatch, segment_tokens):
    params, calls, sweep_shards = replace(PARAMS, segment_tokens=segment_tokens), [], shards.sweep_shards

    def counted(*args, sweeps=1, **rest):
        calls.append(sweeps)
        return sweep_shards(*args, sweeps=sweeps, **rest)

    monkeypatch.setattr(shards, "sweep_shards", counted)
    every = rows_of(batch.fit_distributed(planted, params, sweeps=3).tokens)
    assert calls == [1, 1, 1]
    assert every == rows_of(batch.fit_distributed(planted, replace(params, sweeps_per_sync=1), sweeps=3).tokens)
    calls.clear()
    assert every != rows_of(batch.fit_distributed(planted, replace(params, sweeps_per_sync=2), sweeps=3).tokens)
    assert calls == [2, 1]


def test_a_sweep_moves_word_rows_only(spark, planted, monkeypatch):
    """From the second sweep on: no exchange of pairs or segments, just of the model's rows, to the pairs and to the shards."""
    plans, sweep_shards = [], shards.sweep_shards

    def seen(*args, **rest):
        swept = sweep_shards(*args, **rest)
        plans.append(swept._jdf.queryExecution().executedPlan().toString())
        return swept

    monkeypatch.setattr(shards, "sweep_shards", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = batch.fit_distributed(planted, PARAMS, sweeps=2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line.split("Exchange ")[1].split(",")[0] for line in plans[1].splitlines() if "Exchange " in line]
    assert [m.split("#")[0] for m in moved] == ["hashpartitioning(shard", "hashpartitioning(wid"], plans[1]
    assert plans[1].count("Bucketed: true") == 3
    assert not any(t.name.startswith("topicloom_") for t in spark.catalog.listTables())
    assert rows_of(C.topic_vectors(model.tokens, "wid", 2)) == rows_of(model.rows)


def test_a_word_of_every_shard_is_split(spark, planted, monkeypatch):
    """Salted pairs give the shards the same rows, and no (word, salt) has more pairs than allowed."""
    tokens = T.token_table(planted).withColumn("wid", F.ascii("term").cast("bigint")).drop("term")
    packed = materialize(shards.pack_segments(gibbs.init_topics_uniform(tokens, PARAMS), PARAMS, 40), "packed")
    pairs, rows = materialize(shards.shard_words(packed), "pairs"), materialize(shards.packed_counts(packed, 2), "rows")
    monkeypatch.setattr(shards, "PAIR_ROWS", 4)
    salted, hot = shards.salted_words(pairs)
    assert hot.count() == 16
    spread = salted.groupBy("wid", "salt").count().agg(F.max("count"), F.count("*")).first()
    assert spread[0] < 10 and spread[1] > 40
    assert rows_of(shards.pull_shard_rows(salted, rows, hot)) == rows_of(shards.pull_shard_rows(pairs, rows))
    plain, none = shards.salted_words(pairs.where("shard < 3"))
    assert none is None and rows_of(shards.pull_shard_rows(plain, rows)) == rows_of(shards.pull_shard_rows(pairs.where("shard < 3"), rows))


def test_segments_see_each_other_between_inner_sweeps(spark, planted, monkeypatch):
    work, k = Workspace(spark), 2
    tokens = work.save(T.token_table(planted).withColumn("wid", F.ascii("term").cast("bigint")).drop("term"), "tokens")
    prior = work.save(tokens.select("wid").distinct().withColumn("n", F.array(F.lit(0.1), F.lit(0.1))), "prior")
    infer = lambda params: batch.infer_batch(tokens, prior, [1.6, 1.6], params, 3, work)
    cut, given, refresh = replace(PARAMS, segment_tokens=8, batch_iterations=4, kept_samples=2), [], shards.refresh_base

    def seen(packed, params):
        given.append({(r.doc_id, r.seg): r.topic for r in packed.collect()})
        return refresh(packed, params)

    monkeypatch.setattr(shards, "refresh_base", seen)
    got = {(r.doc_id, r.seg): r for r in infer(cut).collect()}
    assert len(given) == 4 and len({str(sorted(g.items())) for g in given}) == 4
    assert all(r.samples == [given[3][at], r.topic] for at, r in got.items())
    drawn = shards.sample_tokens(infer(cut), 4)
    assert {r.sweep: r["count"] for r in drawn.groupBy("sweep").count().collect()} == {s: tokens.count() for s in (3, 4)}
    assert all(len(topic) == len(r.pos) and set(topic) <= set(range(k)) for r in got.values() for topic in r.samples)


def test_sequential_sampler_is_a_block_of_one(spark, planted):
    model = batch.fit_distributed(planted, replace(PARAMS, block_tokens=1), sweeps=15)
    assert doc_purity(model) > 0.9


def test_synchronous_sweep_keeps_tokens(spark, planted):
    tokens = T.token_table(planted).withColumn("wid", F.xxhash64("term")).drop("term")
    start = materialize(gibbs.init_topics_uniform(tokens, PARAMS), "start")
    swept = gibbs.gibbs_sweep_sync(start, PARAMS, 1)
    assert rows_of(swept.select("doc_id", "pos", "wid")) == rows_of(start.select("doc_id", "pos", "wid"))
    assert rows_of(swept) == rows_of(gibbs.gibbs_sweep_sync(start, PARAMS, 1))


def test_sweeps_in_shards_draw_the_same_topics(spark, planted, monkeypatch):
    """And they send one vector per shard and word in place of one per token and join."""
    tokens = T.token_table(planted).withColumn("wid", F.ascii("term").cast("bigint")).drop("term")
    params = replace(PARAMS, tokens_per_shard=700)
    start = materialize(gibbs.init_topics_uniform(tokens, params), "start")
    assert rows_of(gibbs.sync_in_shards(start, params, 1)) == rows_of(gibbs.gibbs_sweep_sync(start, params, 1))
    packed = gibbs._packed(start, params)
    assert 8 * shards.shard_words(packed).count() < tokens.count()
    cut = replace(params, segment_tokens=8)
    assert rows_of(gibbs.sync_in_shards(start, cut, 1)) == rows_of(gibbs.gibbs_sweep_sync(start, params, 1))
    batches = [T.token_table(planted.where(f"doc_id % 2 = {i}")) for i in (0, 1)]
    narrow = online.fit_online(batches, params)
    monkeypatch.setattr(V, "UNROLL", 1)
    wide = online.fit_online(batches, params)
    assert rows_of(narrow.rows) == rows_of(wide.rows) and narrow.alpha == wide.alpha
    assert gibbs.gibbs_sweep_sync(start, params, 1).count() == tokens.count()


def test_online_model_grows_and_forgets(spark, planted):
    one, two = planted.where("doc_id % 2 = 0"), planted.where("doc_id % 2 = 1")
    kept = online.fit_online([T.token_table(one), T.token_table(two)], PARAMS)
    gone = online.fit_online([T.token_table(one), T.token_table(two)], PARAMS, forget_absent=True)
    assert kept.rows.count() == 16 and gone.rows.count() == 8 and kept.iteration == 2
    total = T.token_table(planted).count()
    assert sum(kept.alpha) == pytest.approx(total + 2 * PARAMS.alpha)
    assert sum(C.totals_list(kept.rows, 2)) == pytest.approx(total + 16 * 2 * PARAMS.beta)


def test_assign_works_on_a_stream(spark, planted, folder):
    model = online.fit_online([T.token_table(planted)], PARAMS)
    planted.repartition(2).write.parquet(f"{folder}/in")
    stream = D.stream_docs(spark, f"{folder}/in", planted.schema)
    assert stream.isStreaming
    scored = online.assign(T.token_table(stream), model, PARAMS)
    query = (
        scored.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batchwise = online.assign(T.token_table(planted), model, PARAMS)
    out = spark.read.parquet(f"{folder}/out").select(*batchwise.columns)
    assert rows_of(out) == rows_of(batchwise)


def test_heldout_likelihood_with_unseen_terms(spark, planted):
    model = batch.fit_distributed(planted, PARAMS, sweeps=10)
    test = spark.createDataFrame([(0, "aa bb cc new"), (1, "pp qq rr")], "doc_id bigint, text string")
    row = batch.heldout_loglik(test, model).first()
    assert row["tokens"] == 7 and row["loglik"] < 0


def test_reports_every_few_sweeps(spark, planted):
    _, reports = batch.fit_batch(planted, PARAMS, sweeps=4, report_every=2)
    assert [r["sweep"] for r in reports] == [2, 4]
    assert len(reports[0]["top_words"]) == 20


STREAM = replace(PARAMS, vocab_capacity=12, batch_iterations=3, kept_samples=2, top_words=3)


def state_of(trainer):
    state = trainer.store.latest()
    return (
        rows_of(state.vocab), [(w, [round(x, 9) for x in n], b) for w, n, b in rows_of(state.rows)],
        state.vocab_size, [round(x, 9) for x in state.totals],
    )


def test_stream_equals_batches_and_repeats_change_nothing(spark, planted, folder):
    cut = D.micro_batches(planted, 20)
    for b in range(3):
        cut.where(f"batch_id = {b}").drop("batch_id").coalesce(1).write.parquet(f"{folder}/in/part{b}")
    existing = list_names(spark, shared_root(spark))
    by_hand = StreamTrainer(spark, f"{folder}/hand", STREAM)
    for b in range(3):
        by_hand.process(spark.read.parquet(f"{folder}/in/part{b}"), b)
    state = state_of(by_hand)
    assert state[2] == 12 and len({w for _, w, _, _ in state[0]}) == 12
    check = by_hand.consistency().first()
    assert check["row_sum"] == pytest.approx(check["total_sum"]) and check["late_rows"] == 0

    assert list_names(spark, shared_root(spark)) == existing
    by_hand.process(spark.read.parquet(f"{folder}/in/part2"), 2)
    assert state_of(by_hand) == state

    streamed = StreamTrainer(spark, f"{folder}/stream", STREAM)
    schema = "doc_id bigint, text string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    streamed.start(stream).awaitTermination()
    assert state_of(streamed) == state
    assert streamed.reports().select("batch_id").distinct().count() == 3


def test_empty_batch_moves_state_on(spark, planted, folder):
    trainer = StreamTrainer(spark, folder, STREAM)
    trainer.process(planted, 0)
    before = state_of(trainer)
    trainer.process(planted.limit(0), 1)
    assert trainer.store.latest().version == 1 and state_of(trainer) == before


def test_totals_follow_rows_on_an_unaligned_clock(spark, planted, folder):
    cut = D.micro_batches(planted, 15)
    trainer = StreamTrainer(spark, folder, replace(STREAM, duration=60_000), batch_time=lambda b: b * 90_000)
    for b in range(4):
        trainer.process(cut.where(f"batch_id = {b}").drop("batch_id"), b)
    check = trainer.consistency().first()
    assert check["row_sum"] == pytest.approx(check["total_sum"])


def test_expired_batches_are_not_run_again(spark, planted, folder):
    trainer = StreamTrainer(spark, folder, replace(STREAM, batch_iterations=1), keep_versions=1)
    cut = D.micro_batches(planted, 15)
    for b in range(4):
        if b != 1:
            trainer.process(cut.where(f"batch_id = {b}").drop("batch_id"), b)
    state, words = state_of(trainer), rows_of(trainer.reports())
    trainer.process(planted, 0)
    assert state_of(trainer) == state and rows_of(trainer.reports()) == words
    with pytest.raises(RuntimeError, match="expired"):
        trainer.process(planted, 1)


def test_equal_batches_draw_differently_and_leave_details(spark, planted, folder):
    trainer = StreamTrainer(spark, folder, replace(STREAM, vocab_capacity=100), details=True)
    for b in range(2):
        trainer.process(planted, b)
    topics = [rows_of(trainer.assigned().where(f"batch_id = {b}").select("doc_id", "pos", "topic")) for b in range(2)]
    assert topics[0] != topics[1]
    assert sorted((r.batch_id, r.prior) for r in trainer.logliks().collect()) == [(0, False), (0, True), (1, False), (1, True)]
    sizes = {r.doc_id: r.n for r in T.token_table(planted).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(sum(r.n) == pytest.approx(sizes[r.doc_id]) for r in trainer.profiles().collect())


def test_keyed_sweeps_equal_synchronous_ones(spark, planted):
    params = replace(PARAMS, tokens_per_shard=300)
    model = batch.fit_distributed(planted, params, sweeps=1, keyed=True)
    start = gibbs.init_topics_uniform(T.encode_docs(T.token_table(planted), model.vocab), params)
    assert rows_of(model.tokens) == rows_of(gibbs.gibbs_sweep_sync(start, params, 1).select(*model.tokens.columns))


def test_shard_kernel_equals_brute_force():
    """Several sweeps of one exchange, a token at a time, under the kernel's own random numbers."""
    params = replace(PARAMS, num_topics=3, block_tokens=1)
    docs, topics = [[5, 9, 5, 7], [9, 9, 5], [7, 5, 9, 7, 7]], [[0, 1, 2, 1], [2, 2, 0], [1, 0, 0, 2, 1]]
    rows = {5: [4.0, 2.0, 3.0], 7: [3.0, 3.0, 2.0], 9: [2.0, 4.0, 5.0]}  # other shards' tokens among them
    totals = [sum(n[z] for n in rows.values()) + 0.3 for z in range(3)]
    segments = pa.table({
        "shard": pa.array([4] * 3, pa.int32()), "doc_id": [0, 1, 2], "seg": pa.array([0] * 3, pa.int32()), "pos": [list(range(len(d))) for d in docs],
        "wid": docs, "topic": pa.array(topics, pa.list_(pa.int32())), "base": pa.array([None] * 3, pa.list_(pa.float64()))})
    table = pa.table({"shard": [4] * 3, "wid": list(rows), "n": list(rows.values())})
    got = shards._shard_kernel(params, totals, 0.1, False, 3, 1, 2)((pa.scalar(4),), segments, table)["topic"].to_pylist()

    want, words, t = [list(z) for z in topics], {w: [x + 0.1 for x in n] for w, n in rows.items()}, list(totals)
    for sweep in (2, 3, 4):
        rng = np.random.Generator(np.random.Philox(key=[params.seed, (4 << 20) + sweep]))
        for d, doc in enumerate(docs):
            for i, w in enumerate(doc):
                old = want[d][i]
                words[w][old] -= 1
                t[old] -= 1
                rest = want[d][:i] + want[d][i + 1 :]
                weight = [(rest.count(z) + params.alpha) * words[w][z] / t[z] for z in range(3)]
                mark = rng.random() * sum(weight)
                new = next(z for z in range(3) if z == 2 or sum(weight[: z + 1]) > mark)
                words[w][new] += 1
                t[new] += 1
                want[d][i] = new
    assert got == want and got != topics


@pytest.mark.parametrize("name", ["stream_train", "trainers_by_name"])
def test_no_token_is_lost_to_the_capacity(spark, folder, monkeypatch, name):
    """More terms than the default dictionary holds: the stream queries still equal their SQL."""
    import duckdb

    from topicloom.catalog import ORACLES, QUERIES, training

    rows = [(d, " ".join(f"w{(d * 5 + i) % 61}" for i in range(9))) for d in range(24)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(training, "PARAMS", replace(training.PARAMS, vocab_capacity=20))
    got = rows_of(QUERIES[name](spark, folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLES[name]).fetchall(), key=str)
