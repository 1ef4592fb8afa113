"""The time-decayed model: rows ``nwt(wid, n, last_batch)``.

A row is stored as of the batch that last touched it and brought to a later
time on read, so a batch writes nothing for words it does not contain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.params import TopicParams


def elapsed(last_batch: Column, t: int | Column, duration: int) -> Column:
    """Whole batches since ``last_batch``; 1 when there was none, 0 when late."""
    now = t if isinstance(t, Column) else F.lit(t)
    gap = F.greatest(now - last_batch, F.lit(0))
    return F.when(last_batch < 0, F.lit(1)).otherwise(F.floor(gap / F.lit(duration)))


def decay_factor(last_batch: Column, t: int | Column, rate: float, duration: int) -> Column:
    return F.pow(F.lit(1.0 - rate), elapsed(last_batch, t, duration).cast("double"))


def decay_rows(rows: DataFrame, t: int | Column, params: TopicParams) -> DataFrame:
    """Rows brought to time t; ``last_batch`` keeps the stored stamp."""
    factor = decay_factor(F.col("last_batch"), t, params.rate, params.duration)
    return rows.withColumn("_f", factor).withColumn(
        "n", V.scale(F.col("n"), F.col("_f"), params.num_topics)
    ).drop("_f")


def seed_rows(rows: DataFrame, params: TopicParams) -> DataFrame:
    """beta added to every cell of the rows."""
    return rows.withColumn("n", V.elementwise(lambda x: x + float(params.beta), params.num_topics, F.col("n")))


def seed_totals(totals: DataFrame, rows: DataFrame, params: TopicParams) -> DataFrame:
    """rows * beta added to every topic total."""
    mass = rows.agg(F.count(F.lit(1)) * F.lit(float(params.beta))).scalar()
    return totals.withColumn("n", V.elementwise(lambda x: x + mass, params.num_topics, F.col("n")))


def reset_new_rows(rows: DataFrame, issued: DataFrame, t: int, params: TopicParams) -> DataFrame:
    """Rows of newly issued ids become [beta, ...] as of t, whatever they held."""
    kept = rows.select("wid", "n", "last_batch").join(issued.select("wid"), "wid", "left_anti")
    fresh = issued.select(
        "wid", V.filled(params.beta, params.num_topics).alias("n"), F.lit(t).cast("bigint").alias("last_batch")
    )
    return kept.unionByName(fresh)


def reset_change(rows: DataFrame, issued: DataFrame, t: int, params: TopicParams) -> DataFrame:
    """One row: what ``reset_new_rows`` adds to the topic totals at time t."""
    k = params.num_topics
    old = decay_rows(rows.select("wid", "n", "last_batch"), t, params).select("wid", F.col("n").alias("_old"))
    change = issued.select("wid").join(old, "wid", "left").select(
        V.elementwise(
            lambda x: F.lit(float(params.beta)) - x, k, F.coalesce("_old", V.filled(0.0, k))
        ).alias("n")
    )
    zero = F.lit(0.0)
    return change.agg(F.array(*[F.coalesce(F.sum(F.get("n", F.lit(i))), zero) for i in range(k)]).alias("n"))


def blend_batch(rows: DataFrame, counts: DataFrame, t: int, params: TopicParams) -> DataFrame:
    """Next version of the rows after a batch with mean counts (wid, n) at time t.

    Touched rows are decayed to t, get rate * count and are stamped; a word
    without a row starts at [beta, ...]; all other rows pass through unread.
    """
    k = params.num_topics
    c = counts.select("wid", F.col("n").alias("_c"))
    joined = rows.select("wid", "n", "last_batch").join(c, "wid", "full_outer")
    factor = F.coalesce(decay_factor(F.col("last_batch"), t, params.rate, params.duration), F.lit(1.0))
    blended = V.elementwise(
        lambda x, y: x * F.col("_f") + y * F.lit(float(params.rate)), k,
        F.coalesce("n", V.filled(params.beta, k)), F.col("_c"),
    )
    now = F.lit(t).cast("bigint")
    return joined.withColumn("_f", factor).select(
        "wid",
        F.when(F.col("_c").isNull(), F.col("n")).otherwise(blended).alias("n"),
        F.when(F.col("_c").isNull(), F.col("last_batch")).otherwise(F.coalesce(F.greatest("last_batch", now), now)).alias("last_batch"),
    )


def stamp_batch_time(rows: DataFrame, touched: DataFrame, t: int) -> DataFrame:
    """last_batch = t for the touched ids (they are added if absent)."""
    mark = touched.select("wid").distinct().withColumn("_t", F.lit(t).cast("bigint"))
    return rows.select("wid", "last_batch").join(mark, "wid", "full_outer").select(
        "wid", F.coalesce("_t", "last_batch").alias("last_batch")
    )


def decay_totals(totals: list[float], batches: int, rate: float) -> list[float]:
    """All rows decay by the same factor, so the totals do too."""
    return [value * (1.0 - rate) ** batches for value in totals]


def model_consistency(rows: DataFrame, totals: DataFrame, t: int | Column, params: TopicParams) -> DataFrame:
    """One row: sum of the decayed rows, sum of the totals, rows stamped after t."""
    k = params.num_topics
    now = t if isinstance(t, Column) else F.lit(t)
    summed = decay_rows(rows, t, params).agg(
        F.sum(V.total(F.col("n"), k)).alias("row_sum"),
        F.sum(F.when(F.col("last_batch") > now, 1).otherwise(0)).cast("bigint").alias("late_rows"),
    )
    whole = totals.select(V.total(F.col("n"), k)).scalar()
    return summed.withColumn("total_sum", whole)


def backfill_rows(tokens: DataFrame, key: str, batch: str, t: int, params: TopicParams) -> DataFrame:
    """The rows at time t after all batches in ``batch`` were blended in turn.

    Closed form of ``blend_batch`` repeated: beta from the word's first batch on
    and rate per token, each decayed by its age. One aggregation replaces one
    join per batch when a history is loaded.
    """
    k = params.num_topics
    weight = F.pow(F.lit(1.0 - params.rate), F.floor((F.lit(t) - F.col(batch)) / F.lit(params.duration)).cast("double"))
    summed = tokens.withColumn("_w", weight * F.lit(float(params.rate))).groupBy(key).agg(
        V.count_topics(F.col("topic"), k, F.col("_w")).alias("n"), F.min(batch).alias("_first")
    )
    start = F.lit(float(params.beta)) * F.pow(
        F.lit(1.0 - params.rate), F.floor((F.lit(t) - F.col("_first")) / F.lit(params.duration)).cast("double")
    )
    return summed.withColumn("_s", start).select(key, V.elementwise(lambda x: x + F.col("_s"), k, F.col("n")).alias("n"))
