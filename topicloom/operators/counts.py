"""Topic counts: building, merging and moving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import vectors as V


def topic_counts(tokens: DataFrame, key: str) -> DataFrame:
    """(key, topic, cnt): term-topic counts for a term key, document-topic for doc_id."""
    return tokens.groupBy(key, "topic").agg(F.count(F.lit(1)).alias("cnt"))


def topic_vectors(tokens: DataFrame, key: str, k: int, weight: Column | None = None) -> DataFrame:
    """(key, n): the same counts as a zero-filled vector."""
    return V.count_vectors(tokens, [key], k, weight)


def vector_cells(rows: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Vector rows in long form (key, topic, cnt), zeros included."""
    return rows.select(key, F.posexplode(value).alias("topic", "cnt"))


def sparse_cells(rows: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Long form without the zero cells; negative deltas stay."""
    return vector_cells(rows, key, value).where(F.col("cnt") != 0)


def topic_totals(cells: DataFrame) -> DataFrame:
    """(topic, cnt) column sums of long-form counts."""
    return cells.groupBy("topic").agg(F.sum("cnt").alias("cnt"))


def totals_vector(rows: DataFrame, k: int, value: str = "n") -> DataFrame:
    """One row: the column sums of vector rows. K numbers."""
    return rows.agg(V.sum_cells(F.col(value), k).alias("n"))


def totals_list(rows: DataFrame, k: int, value: str = "n") -> list[float]:
    """The same K numbers on the driver; zeros for no rows."""
    return [cell or 0.0 for cell in totals_vector(rows, k, value).first()[0]]


def batch_stats(tokens: DataFrame, docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per batch: documents, tokens, distinct terms and terms not in ``vocab``.

    Tokens are first reduced to one row per (batch, term), so the distinct
    counts are plain sums of small groups.
    """
    terms = tokens.groupBy("batch_id", "term").agg(F.count(F.lit(1)).alias("cnt"))
    flagged = terms.join(vocab.select("term", F.lit(1).alias("_known")), "term", "left")
    per_terms = flagged.groupBy("batch_id").agg(
        F.sum("cnt").alias("tokens"),
        F.count(F.lit(1)).alias("terms"),
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("new_terms"),
    )
    per_docs = docs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("docs"))
    zero = F.lit(0).cast("bigint")
    return per_docs.join(per_terms, "batch_id", "left").select(
        "batch_id", "docs", *[F.coalesce(c, zero).alias(c) for c in ("tokens", "terms", "new_terms")]
    )


def last_sweeps(samples: DataFrame, sweeps: int, kept: int) -> DataFrame:
    """Samples of the newest ``kept`` of sweeps 0..sweeps-1."""
    return samples.where(F.col("sweep") >= sweeps - kept)


def average_samples(samples: DataFrame, key: str, sweeps: int, kept: int) -> DataFrame:
    """Mean (key, topic) count over the kept sweeps, divided by how many there are."""
    used = min(sweeps, kept)
    counted = last_sweeps(samples, sweeps, kept).groupBy(key, "topic").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.withColumn("cnt", F.col("cnt") / F.lit(float(used)))


def sweep_delta(before: DataFrame, after: DataFrame, key: str, cnt: str | None = None) -> DataFrame:
    """(key, topic, delta) between two assignments of the same tokens; zeros drop out.

    Each side is summed before the shuffle, as one +1/-1 aggregation. Rows stand for
    one token, or for as many as their column ``cnt`` says.
    """
    many = F.lit(1) if cnt is None else F.col(cnt)
    signed = after.select(key, "topic", many.alias("delta")).unionByName(
        before.select(key, "topic", (-many).alias("delta"))
    )
    return signed.groupBy(key, "topic").agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)


def push_deltas(state: DataFrame, deltas: DataFrame, keys: list[str], value: str = "cnt", delta: str = "delta") -> DataFrame:
    """Next version of a count table: old counts plus deltas, one aggregation."""
    moved = deltas.select(*keys, F.col(delta).alias(value))
    return state.select(*keys, value).unionByName(moved).groupBy(*keys).agg(F.sum(value).alias(value))


def pull_rows(state: DataFrame, wanted: DataFrame, key: str, k: int) -> DataFrame:
    """Model rows of the wanted keys; keys without a row get a zero vector.

    Only the distinct keys travel, so a hot term is one row here.
    """
    keys = wanted.select(key).distinct()
    return keys.join(state.select(key, "n"), key, "left").withColumn("n", F.coalesce("n", V.filled(0.0, k)))


def add_prior_counts(batch: DataFrame, prior: DataFrame, key: str, k: int) -> DataFrame:
    """Batch vectors plus the prior vectors of the same keys."""
    old = prior.select(key, F.col("n").alias("_prior"))
    return batch.join(old, key, "left").select(
        key, V.add(F.col("n"), F.coalesce("_prior", V.filled(0.0, k)), k).alias("n")
    )


def overlay_unknown_prior(model: DataFrame, terms: DataFrame, key: str, beta: float, k: int) -> DataFrame:
    """Model rows plus a [beta, ...] row for every term the model lacks."""
    fresh = terms.select(key).distinct().join(model.select(key), key, "left_anti")
    return model.select(key, "n").unionByName(fresh.withColumn("n", V.filled(beta, k)))


def get_update_times(wanted: DataFrame, stamps: DataFrame, model_batch: Column) -> DataFrame:
    """(wid, last_batch or -1, model_batch) for the wanted ids."""
    missing = F.lit(-1).cast("bigint")
    return (
        wanted.select("wid").distinct()
        .join(stamps.select("wid", "last_batch"), "wid", "left")
        .withColumn("last_batch", F.coalesce("last_batch", missing))
        .withColumn("model_batch", F.coalesce(model_batch, missing))
    )


def merge_online_model(model: DataFrame, counts: DataFrame, key: str, k: int, forget_absent: bool = False) -> DataFrame:
    """Prior rows plus this batch's counts.

    ``forget_absent`` keeps only the terms of this batch, as the reference does.
    """
    both = model.select(key, "n", F.lit(0).alias("_seen")).unionByName(
        counts.select(key, "n", F.lit(1).alias("_seen"))
    )
    merged = both.groupBy(key).agg(V.sum_cells(F.col("n"), k).alias("n"), F.max("_seen").alias("_seen"))
    if forget_absent:
        merged = merged.where("_seen = 1")
    return merged.drop("_seen")


def model_memory(vocab: DataFrame, k: int, distinct_lengths: bool = False) -> DataFrame:
    """Estimated bytes of a model: V * K * 8 plus the bytes of the terms.

    ``distinct_lengths`` sums each byte length once, as the reference does.
    No rows at all gives -1.
    """
    size = F.octet_length("term").cast("bigint")
    per_length = vocab.groupBy(size.alias("len")).agg(F.count(F.lit(1)).alias("terms"))
    text = F.sum("len") if distinct_lengths else F.sum(F.col("len") * F.col("terms"))
    return per_length.agg(F.coalesce(F.sum("terms") * F.lit(8 * k) + text, F.lit(-1)).cast("bigint").alias("bytes"))
