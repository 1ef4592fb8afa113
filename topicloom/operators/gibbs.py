"""Topic draws over token tables, as joins and column expressions.

Tokens are rows (doc_id, pos, <key>, topic), where the key is ``wid`` or ``term``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import sampling as S
from topicloom.functions import vectors as V
from topicloom.operators import shards
from topicloom.operators.counts import topic_vectors, totals_list
from topicloom.operators.skew import hot_keys, keyed_join
from topicloom.params import TopicParams
from topicloom.storage import materialize


def token_uniform(params: TopicParams, sweep: int):
    return S.keyed_uniform(params.seed, F.col("doc_id"), F.col("pos"), sweep)


def init_topics_uniform(tokens: DataFrame, params: TopicParams, sweep: int = 0) -> DataFrame:
    """A uniform topic per token, keyed by (seed, doc_id, pos, sweep)."""
    topic = F.floor(token_uniform(params, sweep) * params.num_topics).cast("int")
    return tokens.withColumn("topic", topic)


def hot_in(tokens: DataFrame, key: str) -> DataFrame | None:
    """Hot keys of a token table, counted here."""
    return hot_keys(tokens.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), key, "_rows")


def init_topics_prior(
    tokens: DataFrame, model: DataFrame, alpha: list[float], totals: list[float], params: TopicParams,
    key: str = "term", sweep: int = 0, hot: DataFrame | None = None,
) -> DataFrame:
    """Draw from alpha_k * n_wk / n_k of a model (key, n).

    ``alpha`` and ``totals`` are the model's K-vectors. A term the model lacks
    uses beta for its row and totals + beta below. Also valid for a streaming
    ``tokens`` (a stream-static join); pass no ``hot`` there.
    """
    beta = float(params.beta)
    rows = model.select(key, F.col("n").alias("_row"))
    joined = keyed_join(tokens, rows, key, "left", hot, ("doc_id", "pos"))
    unknown = F.col("_row").isNull()
    weight = lambda i: (
        V.at(alpha, i) * F.coalesce(V.at(F.col("_row"), i), F.lit(beta))
        / (V.at(totals, i) + F.when(unknown, beta).otherwise(0.0))
    )
    return S.draw_topics(joined, weight, token_uniform(params, sweep), params.num_topics).drop("_row")


def assign_topics(
    tokens: DataFrame, model: DataFrame, alpha: list[float], params: TopicParams, key: str = "term",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Score documents against a model that stays as it is."""
    totals = totals_list(model, params.num_topics)
    return init_topics_prior(tokens, model, alpha, totals, params, key, hot=hot)


def with_counts(
    tokens: DataFrame, k: int, key: str, hot_words: DataFrame | None = None, hot_docs: DataFrame | None = None
) -> DataFrame:
    """Tokens with the count vectors of their word and document, ``_word`` and ``_doc``.

    ``tokens`` should be a saved table: it is read once per count and once for
    the joins."""
    words = topic_vectors(tokens, key, k).withColumnRenamed("n", "_word")
    docs = topic_vectors(tokens, "doc_id", k).withColumnRenamed("n", "_doc")
    joined = keyed_join(tokens, words, key, "inner", hot_words, ("doc_id", "pos"))
    return keyed_join(joined, docs, "doc_id", "inner", hot_docs, (key, "pos"))


def token_totals(tokens: DataFrame, k: int) -> list[float]:
    """Tokens per topic, K numbers."""
    counts = {r["topic"]: r["cnt"] for r in tokens.groupBy("topic").agg(F.count(F.lit(1)).alias("cnt")).collect()}
    return [float(counts.get(i, 0)) for i in range(k)]


def gibbs_sweep_sync(
    tokens: DataFrame, params: TopicParams, sweep: int, key: str = "wid", vocab_size: int | None = None,
) -> DataFrame:
    """One synchronous sweep with symmetric priors: all tokens against frozen counts.

    Up to ``V.UNROLL`` topics tokens meet the short vectors in joins, and the draw is
    compiled; beyond that see :func:`sync_in_shards`. The topics are the same.
    """
    k = params.num_topics
    if k > V.UNROLL:
        return sync_in_shards(tokens, params, sweep, key, vocab_size)
    size = tokens.select(key).distinct().count() if vocab_size is None else vocab_size
    counted = with_counts(tokens, k, key, hot_in(tokens, key), hot_in(tokens, "doc_id"))
    weight = S.symmetric_weight(
        F.col("_doc"), F.col("_word"), token_totals(tokens, k), params.alpha, params.beta, size, F.col("topic")
    )
    drawn = S.draw_topics(counted, weight, token_uniform(params, sweep), k)
    return drawn.select("doc_id", "pos", key, "topic")


def sync_in_shards(
    tokens: DataFrame, params: TopicParams, sweep: int, key: str = "wid", vocab_size: int | None = None,
) -> DataFrame:
    """The same sweep over tokens packed by document, which meet their words' rows a shard at a time.

    A vector travels once per shard and word, not once per token. ``key`` is a column of ids.
    """
    packed = _packed(tokens.withColumnRenamed(key, "wid"), params)
    return sync_packed(packed, params, sweep, vocab_size).withColumnRenamed("wid", key)


def sync_packed(packed: DataFrame, params: TopicParams, sweep: int, vocab_size: int | None = None) -> DataFrame:
    """(doc_id, pos, wid, topic) after the same sweep over saved packed rows."""
    words = materialize(shards.packed_counts(packed, params.num_topics), "words")
    size = words.count() if vocab_size is None else vocab_size
    smooth = [value + size * float(params.beta) for value in totals_list(words, params.num_topics)]
    swept = shards.sweep_shards(
        with_base(packed, params), words, smooth, params, fill=float(params.beta), first=sweep, keyed=True)
    return shards.unpack_tokens(swept).select("doc_id", "pos", "wid", "topic")


def gibbs_sweep_blended(
    tokens: DataFrame, model: DataFrame, alpha: list[float], prior_totals: list[float], params: TopicParams,
    sweep: int, key: str = "term",
) -> DataFrame:
    """One synchronous sweep with a model's vectors as priors.

    ``model`` covers every term of ``tokens`` (see ``overlay_unknown_prior``);
    its rows travel with the word counts, so tokens meet both in one join. For many topics
    see :func:`blended_in_shards`.
    """
    k = params.num_topics
    prior = model.select(key, F.col("n").alias("_prior"))
    words = topic_vectors(tokens, key, k).withColumnRenamed("n", "_word").join(prior, key)
    docs = topic_vectors(tokens, "doc_id", k).withColumnRenamed("n", "_doc")
    counted = keyed_join(tokens, words, key, "inner", hot_in(tokens, key), ("doc_id", "pos"))
    counted = keyed_join(counted, docs, "doc_id", "inner", hot_in(tokens, "doc_id"), (key, "pos"))
    weight = S.blended_weight(
        F.col("_doc"), F.col("_word"), token_totals(tokens, k), alpha, F.col("_prior"), prior_totals, F.col("topic")
    )
    drawn = S.draw_topics(counted, weight, token_uniform(params, sweep), k)
    return drawn.select("doc_id", "pos", key, "topic")


def blended_in_shards(
    tokens: DataFrame, model: DataFrame, alpha: list[float], prior_totals: list[float], params: TopicParams, sweep: int,
) -> DataFrame:
    """The same sweep over tokens with ``wid``, as packed rows; no vector travels per token.

    The rows of ``model`` (wid, n) and the counts are added up before they go to the shards.
    """
    k = params.num_topics
    packed = _packed(tokens, params)
    counts = materialize(shards.packed_counts(packed, k), "words")
    both = model.select("wid", "n").join(counts.select("wid"), "wid", "left_semi").unionByName(counts)
    words = both.groupBy("wid").agg(V.sum_cells(F.col("n"), k).alias("n"))
    totals = [x + y for x, y in zip(totals_list(counts, k), prior_totals)]
    return shards.sweep_shards(with_base(packed, params), words, totals, params, first=sweep, keyed=True, alpha=alpha)


def _packed(tokens: DataFrame, params: TopicParams) -> DataFrame:
    number = shards.shard_count(tokens.count(), params)
    return materialize(shards.pack_segments(tokens, params, number), "packed")


def with_base(packed: DataFrame, params: TopicParams) -> DataFrame:
    """Segments of long documents learn the counts of the others."""
    several = packed.where("seg > 0").limit(1).count() > 0
    return shards.refresh_base(packed, params) if several else packed
