"""Batch training: vocabulary, uniform start, sweeps, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import counts as C
from topicloom.operators import exchange, gibbs, quality, ranking, shards, texts as X, tokens as T, vocab as Vb
from topicloom.params import TopicParams
from topicloom.storage import Workspace

BUCKET_SHARDS = 32  # shards a task reads in a row; each is a few hundred kilobytes


@dataclass
class FittedTopics:
    """A fitted model: vocabulary (term, wid), rows (wid, n), totals (K numbers),
    and the final assignment (doc_id, pos, wid, topic)."""

    params: TopicParams
    vocab: DataFrame
    rows: DataFrame
    totals: list[float]
    tokens: DataFrame
    vocab_size: int

    def cells(self) -> DataFrame:
        """(term, topic, cnt), zero counts included."""
        named = self.rows.join(self.vocab.select("wid", "term"), "wid")
        return C.vector_cells(named, "term")

    def top_words(self, t: int = 10) -> DataFrame:
        return ranking.top_words(self.cells(), t)


def fit_distributed(
    docs: DataFrame, params: TopicParams, segment=T.whitespace_terms, sweeps: int | None = None,
    shard_number: int | None = None, on_report: Callable[[int, FittedTopics], None] | None = None,
    report_every: int = 10, keyed: bool = False,
) -> FittedTopics:
    """Approximate distributed Gibbs sampling.

    Per exchange every shard pulls the rows of its words, sweeps its documents in
    order against its own copy, ``sweeps_per_sync`` times over, and the new counts
    are summed by class of words. What never changes, the segments' words and positions and
    which words several shards have, is saved once, bucketed by the keys it is met on, so
    a sweep moves those words' counts only and writes nothing but topics and counts. A model handed to ``on_report`` is
    valid during the call. ``keyed`` makes every sweep a synchronous one with
    uniforms keyed by token, which SQL can repeat.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    k = params.num_topics
    sweeps = params.iterations if sweeps is None else sweeps

    coded = work.save(X.coded_texts(docs, segment), "texts")
    freqs = work.save(X.coded_frequency(coded), "freqs")
    vocab = Vb.build_vocab_sorted(freqs)
    vocab_size, token_number = freqs.agg(F.count(F.lit(1)), F.coalesce(F.sum("freq"), F.lit(0))).first()
    number = shard_number or shards.shard_count(token_number, params)
    packed = X.pack_texts(coded, vocab, params, number, work.save)
    work.drop(coded)
    layout = ShardLayout(packed, params, work, number, vocab_size)

    def model(tokens: DataFrame, rows: DataFrame) -> FittedTopics:
        return FittedTopics(params, vocab, rows, totals, shards.unpack_tokens(tokens), vocab_size)

    with _partitions(spark, layout.buckets):
        swept, sweep = layout.start(), 0
        totals = layout.totals(swept)
        while sweep < sweeps:
            rounds = min(1 if keyed else params.sweeps_per_sync, sweeps - sweep)
            if on_report:
                rounds = min(rounds, report_every - sweep % report_every)
            old, sweep = swept, sweep + rounds
            swept = layout.save_swept(layout.swept(old, totals, vocab_size, rounds, sweep - rounds + 1, keyed), f"sweep{sweep}")
            totals = layout.totals(swept)
            work.drop(old)
            if on_report and sweep % report_every == 0:
                packed = layout.packed(swept)
                rows = work.save(shards.packed_counts(packed, k), f"rows{sweep}")
                on_report(sweep, model(packed, rows))
                work.drop(rows)
        tokens = work.save(layout.packed(swept).drop("base"), "tokens")  # outlives the session's catalog
        rows = work.save(shards.packed_counts(tokens, k), "rows")
    layout.close(swept)
    return model(tokens, rows)


@contextmanager
def _partitions(spark: SparkSession, number: int) -> Iterator[None]:
    """As many shuffle partitions as there are buckets, so that buckets are read where they lie."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(number))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class ShardLayout:
    """The parts of a sharded corpus that sweeps do not change, bucketed once.

    The shards' rows and a sweep's result lie in buckets by shard, the words that several
    shards have in buckets by class: the joins and the cogroups of a sweep find them in place.
    """

    def __init__(self, packed: DataFrame, params: TopicParams, work: Workspace, number: int, vocab_size: int) -> None:
        self.params, self.work = params, work
        self.buckets = _bucket_number(work.spark, number)
        twins = packed.withColumn("twin", F.lit(None).cast("bigint"))
        if packed.where("seg > 0").limit(1).count() > 0:
            twins = packed.join(work.save(exchange.twin_ids(packed, vocab_size), "twins"), "doc_id", "left")
        rows = twins.select("shard", "doc_id", "seg", "pos", "wid", "topic", "twin")
        with _partitions(work.spark, self.buckets):
            self.table = work.save_bucketed(exchange.shard_layout(rows, params, self.buckets), "layout", ["shard"], self.buckets, placed=True)
            self.classes = work.save_bucketed(exchange.shared_words(self.table), "classes", ["wid"], self.buckets, placed=True)
        work.drop(packed)
        self.shards = self.table.where("wid IS NULL")

    def start(self) -> DataFrame:
        """The saved result of no sweep."""
        empty = self.classes.select("shard", "wid", "at", F.lit(None).cast("binary").alias("counts"))
        run, schema = exchange.shard_kernel(self.params, [], 0.0, 0, 0, False)
        held = self.shards.select("shard", "sizes", "word", "twin", "topic")
        return self.save_swept(held.groupBy("shard").cogroup(empty.groupBy("shard")).applyInArrow(run, schema), "sweep0")

    def held(self, swept: DataFrame, *columns: str) -> DataFrame:
        """The shards' rows with their topics after a sweep."""
        topics = swept.where("wid IS NULL").select("shard", "topic")
        return self.shards.select("shard", *columns).join(topics.hint("merge"), "shard")

    def packed(self, swept: DataFrame) -> DataFrame:
        """Whole packed rows."""
        return exchange.unpack_shards(self.held(swept, "docs", "segs", "sizes", "pos", "word", "wids"))

    def swept(self, last: DataFrame, totals: list[float], vocab_size: int, sweeps: int, first: int, keyed: bool) -> DataFrame:
        """Topics, their totals and the shared words' counts after so many sweeps from one exchange."""
        smooth = [value + vocab_size * self.params.beta for value in totals]
        sums = exchange.summed_counts(self.classes, last, self.params.num_topics)
        return shards.sweep_shards(
            self.held(last, "sizes", "word", "twin", *(["docs", "pos"] if keyed else [])), sums, smooth, self.params,
            fill=float(self.params.beta), sweeps=sweeps, first=first, keyed=keyed, kernel=exchange.shard_kernel)

    def totals(self, swept: DataFrame) -> list[float]:
        return C.totals_list(swept.where("wid IS NULL"), self.params.num_topics)

    def save_swept(self, swept: DataFrame, label: str) -> DataFrame:
        return self.work.save_bucketed(swept, label, ["shard"], self.buckets, placed=True)

    def close(self, swept: DataFrame) -> None:
        for table in (self.table, self.classes, swept):
            self.work.drop(table)


def _bucket_number(spark: SparkSession, number: int) -> int:
    """Buckets for so many shards: enough to even them out over the cores, and never more than ``BUCKET_SHARDS`` in one on average."""
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(min(number, wanted), -(-number // BUCKET_SHARDS))


def fit_batch(
    docs: DataFrame, params: TopicParams, test: DataFrame | None = None, sweeps: int | None = None,
    report_every: int = 10, segment=T.whitespace_terms,
) -> tuple[FittedTopics, list[dict]]:
    """Batch training with a report every ``report_every`` sweeps: top words,
    topic totals and, given test documents, their held-out log-likelihood."""
    reports: list[dict] = []

    def report(sweep: int, model: FittedTopics) -> None:
        entry = {"sweep": sweep, "top_words": model.top_words(10).collect(), "totals": list(model.totals)}
        if test is not None:
            entry["loglik"] = heldout_loglik(test, model, segment=segment).first()["loglik"]
        reports.append(entry)

    model = fit_distributed(docs, params, segment, sweeps, on_report=report, report_every=report_every)
    return model, reports


def heldout_samples(test: DataFrame, model: FittedTopics, samples: int = 2, segment=T.whitespace_terms) -> DataFrame:
    """Assignments of the test tokens in the last ``samples`` of 2 x ``samples`` sweeps.

    Unseen terms are added to the vocabulary; counts start from the model's own.
    """
    params, k = model.params.reseeded(-1), model.params.num_topics
    work = Workspace(test.sparkSession)
    raw = T.token_table(test, segment)
    freqs = work.save(T.term_frequency(raw), "test-freqs")
    vocab = work.save(Vb.extend_vocab(model.vocab, freqs), "test-vocab")
    size = vocab.count()
    token_number = freqs.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    encoded = gibbs.init_topics_uniform(T.encode_docs(raw, vocab, freqs), params)
    packed = work.save(
        shards.pack_segments(encoded, params, shards.shard_count(token_number, params)), "test-start"
    )
    several = packed.where("seg > 0").limit(1).count() > 0
    # Only the rows of the test words take part; the totals are those of the whole model.
    own = model.rows.select("wid", "n").join(
        vocab.join(freqs.select("term"), "term", "left_semi").select("wid"), "wid", "left_semi"
    )
    own = work.save(own, "test-model")
    kept = []
    for sweep in range(1, 2 * samples + 1):
        counts = work.save(shards.packed_counts(packed, k), f"test-counts{sweep}")
        rows = work.save(C.merge_online_model(own, counts, "wid", k), f"test-rows{sweep}")
        smooth = [m + c + size * params.beta for m, c in zip(model.totals, C.totals_list(counts, k))]
        source = shards.refresh_base(packed, params) if several else packed
        swept = shards.sweep_shards(source, rows, smooth, params, fill=float(params.beta), first=sweep)
        packed = work.save(swept, f"test-sweep{sweep}")
        if sweep > samples:
            kept.append(shards.unpack_tokens(packed).withColumn("sweep", F.lit(sweep)))
    merged = kept[0]
    for table in kept[1:]:
        merged = merged.unionByName(table)
    return merged


def heldout_loglik(test: DataFrame, model: FittedTopics, samples: int = 2, segment=T.whitespace_terms) -> DataFrame:
    drawn = heldout_samples(test, model, samples, segment)
    return quality.loglik_heldout(drawn, model.params.alpha, model.params.beta, model.params.num_topics)


def infer_batch(
    tokens: DataFrame, prior_rows: DataFrame, prior_totals: list[float], params: TopicParams,
    shard_number: int, work: Workspace, stream: int = 0,
) -> DataFrame:
    """Inner loop of the streaming trainer: uniform start, ``batch_iterations``
    sweeps per shard against one prior snapshot; packed rows with the last
    ``kept_samples`` sweeps as samples.

    ``prior_rows`` already hold beta; every shard adds its own counts. ``stream``
    tells batches apart, so equal documents in two batches draw differently.
    """
    params = params.reseeded(stream)
    started = gibbs.init_topics_uniform(tokens, params)
    packed = work.save(shards.pack_segments(started, params, shard_number), "packed")
    return infer_packed(packed, prior_rows, prior_totals, params, work)


def infer_packed(
    packed: DataFrame, prior_rows: DataFrame, prior_totals: list[float], params: TopicParams, work: Workspace, pairs: DataFrame | None = None,
) -> DataFrame:
    """The sweeps of :func:`infer_batch` over saved packed rows; ``params`` are the reseeded ones, ``pairs`` the saved ``shard_words``."""
    if packed.where("seg > 0").limit(1).count() > 0:
        return _infer_segments(packed, prior_rows, prior_totals, params, work)
    swept = shards.sweep_shards(
        packed, prior_rows, prior_totals, params, own_counts=True,
        sweeps=params.batch_iterations, kept=params.kept_samples, pairs=pairs,
    )
    return work.save(swept, "samples")


def _infer_segments(packed: DataFrame, prior_rows: DataFrame, prior_totals: list[float], params: TopicParams, work: Workspace) -> DataFrame:
    """The same sweeps one at a time: before each, segments of a document learn each other's counts."""
    kept = min(params.kept_samples, params.batch_iterations)
    pairs = work.save(shards.shard_words(packed), "pairs")
    if kept > 1:
        packed = work.save(packed.withColumn("samples", F.array().cast("array<array<int>>")), "start")
    for sweep in range(1, params.batch_iterations + 1):
        swept = shards.sweep_shards(
            shards.refresh_base(packed, params), prior_rows, prior_totals, params, own_counts=True, first=sweep, pairs=pairs
        )
        if kept > 1 and sweep > params.batch_iterations - kept:
            swept = swept.withColumn("samples", F.concat("samples", F.array("topic")))
        old, packed = packed, work.save(swept, f"samples{sweep}")
        work.drop(old)
    return packed
