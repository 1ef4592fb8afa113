"""Keyed randomness, topic weights and the categorical draw, as columns.

A draw is a pure function of (seed, document, position, sweep), so a retried
task or another partitioning gives the same topics. A weight is a function from
a topic index to a column; vectors may be columns or K numbers from the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import vectors as V


def keyed_uniform(seed: int, *key: Column | int) -> Column:
    """Uniform in [0, 1): the first 32 bits of an md5 over the key."""
    parts = [F.lit(str(seed))] + [
        (part if isinstance(part, Column) else F.lit(part)).cast("string") for part in key
    ]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


Weight = Callable[[int | Column], Column]
Vector = Column | list[float]


def _less_own(count: Column, topic: Column | None, i: int | Column) -> Column:
    """The count without the token itself, whose topic is ``topic``."""
    return count if topic is None else count - F.when(topic == i, 1.0).otherwise(0.0)


def prior_weight(alpha: Vector, word: Vector, totals: Vector) -> Weight:
    """alpha_k * word_k / total_k: no counts yet."""
    return lambda i: V.at(alpha, i) * V.at(word, i) / V.at(totals, i)


def blended_weight(
    doc: Vector, word: Vector, totals: Vector, alpha: Vector, prior: Vector, prior_totals: Vector,
    topic: Column | None = None,
) -> Weight:
    """(doc + alpha)(word + prior)/(total + prior total) with a model's vectors."""
    return lambda i: (
        (_less_own(V.at(doc, i), topic, i) + V.at(alpha, i))
        * (_less_own(V.at(word, i), topic, i) + V.at(prior, i))
        / (_less_own(V.at(totals, i), topic, i) + V.at(prior_totals, i))
    )


def symmetric_weight(
    doc: Vector, word: Vector, totals: Vector, alpha: float, beta: float, vocab_size: int,
    topic: Column | None = None,
) -> Weight:
    """(doc + alpha)(word + beta)/(total + V beta), in floating point throughout."""
    mass = float(vocab_size) * float(beta)
    return lambda i: (
        (_less_own(V.at(doc, i), topic, i) + float(alpha))
        * (_less_own(V.at(word, i), topic, i) + float(beta))
        / (_less_own(V.at(totals, i), topic, i) + mass)
    )


def smoothed_weight(doc: Vector, word: Vector, totals: Vector, topic: Column | None = None) -> Weight:
    """doc * word / total where the priors are already inside."""
    return lambda i: (
        _less_own(V.at(doc, i), topic, i) * _less_own(V.at(word, i), topic, i)
        / _less_own(V.at(totals, i), topic, i)
    )


def draw_topics(df: DataFrame, weight: Weight, u: Column, k: int, name: str = "topic") -> DataFrame:
    """Categorical draw per row: the first topic whose running weight exceeds
    ``u`` times the total, else the last one.

    Weights, running sums and the comparison are separate projections, so each
    is computed once per row inside compiled code.
    """
    kept = [c for c in df.columns if c != name]
    if k > V.UNROLL:
        return _draw_wide(df, weight, u, k, name, kept)
    weights = [f"_w{i}" for i in range(k)]
    sums = [f"_c{i}" for i in range(k)]
    running, grown = [], None
    for column in weights:
        grown = F.col(column) if grown is None else grown + F.col(column)
        running.append(grown)
    below = F.lit(0)
    for column in sums[:-1]:
        below = below + F.when(F.col(column) <= F.col("_mark"), 1).otherwise(0)
    return (
        df.select(*kept, u.alias("_u"), *[weight(i).alias(c) for i, c in enumerate(weights)])
        .select(*kept, "_u", *[total.alias(c) for total, c in zip(running, sums)])
        .select(*kept, *sums, (F.col("_u") * F.col(sums[-1])).alias("_mark"))
        .select(*kept, below.cast("int").alias(name))
    )


def _draw_wide(df: DataFrame, weight: Weight, u: Column, k: int, name: str, kept: list[str]) -> DataFrame:
    """The same draw for many topics, with a plan that does not grow with k."""
    whole = F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + x)
    step = lambda acc, x: F.struct(
        (acc["s"] + x).alias("s"),
        (acc["i"] + F.when(acc["s"] + x <= F.col("_mark"), 1).otherwise(0)).alias("i"),
    )
    walked = F.aggregate("_w", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), step)
    return (
        df.select(*kept, u.alias("_u"), V.from_cells(weight, k).alias("_w"))
        .withColumn("_mark", F.col("_u") * whole)
        .select(*kept, F.least(walked["i"], F.lit(k - 1)).cast("int").alias(name))
    )
