"""Length-K vectors in ``array<double>`` columns.

Up to ``UNROLL`` topics every cell is its own expression, so the arithmetic is
compiled by whole-stage codegen; beyond that the same result comes from
higher-order functions, whose plan does not grow with K.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL = 32


def at(v: Column | list[float], i: int | Column) -> Column:
    """Cell ``i`` of a vector column, or of K numbers known on the driver."""
    if isinstance(v, list):
        return F.lit(float(v[i])) if isinstance(i, int) else F.get(literal(v), i)
    return F.get(v, F.lit(i) if isinstance(i, int) else i)


def from_cells(cell: Callable[[int | Column], Column], k: int) -> Column:
    """``[cell(0), ..., cell(k - 1)]``."""
    if k <= UNROLL:
        return F.array(*[cell(i) for i in range(k)])
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), cell)


def literal(values: list[float]) -> Column:
    """A constant vector; for K-vectors that are known on the driver."""
    return F.array(*[F.lit(float(value)) for value in values])


def filled(value: float | Column, k: int) -> Column:
    return F.array_repeat(value if isinstance(value, Column) else F.lit(float(value)), k)


def elementwise(fn: Callable[..., Column], k: int, *vectors: Column | list[float]) -> Column:
    """``[fn(v1[i], v2[i], ...) for i in range(k)]``."""
    return from_cells(lambda i: fn(*[at(v, i) for v in vectors]), k)


def add(a: Column, b: Column, k: int) -> Column:
    return elementwise(lambda x, y: x + y, k, a, b)


def scale(a: Column, factor: Column | float, k: int) -> Column:
    return elementwise(lambda x: x * factor, k, a)


def total(v: Column, k: int) -> Column:
    """Sum of the cells, added in ascending topic order."""
    if k <= UNROLL:
        return reduce(lambda x, y: x + y, [at(v, i) for i in range(k)])
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column, k: int) -> Column:
    """Inner product, added in ascending topic order."""
    if k <= UNROLL:
        return reduce(lambda x, y: x + y, [at(a, i) * at(b, i) for i in range(k)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sum_cells(v: Column, k: int) -> Column:
    """Aggregate: cell-wise sum over the rows of a group (partial-aggregated)."""
    return F.array(*[F.sum(at(v, i)) for i in range(k)])


def count_topics(topic: Column, k: int, weight: Column | None = None) -> Column:
    """Aggregate: rows of a group per topic, as a zero-filled vector."""
    one = F.lit(1.0) if weight is None else weight.cast("double")
    return F.array(*[F.sum(F.when(topic == i, one).otherwise(0.0)) for i in range(k)])


def count_vectors(df: DataFrame, keys: list[str], k: int, weight: Column | None = None, name: str = "n") -> DataFrame:
    """(keys, name): rows (or their weights) of a group per value of ``topic``, zero-filled.

    Up to ``UNROLL`` topics in one aggregation of K sums; beyond that counted by
    (keys, topic), which costs the same for any K, and one vector is filled per group.
    """
    if k <= UNROLL:
        return df.groupBy(*keys).agg(count_topics(F.col("topic"), k, weight).alias(name))
    one = F.lit(1.0) if weight is None else weight.cast("double")
    cells = df.groupBy(*keys, "topic").agg(F.sum(one).alias("_cell"))
    found = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("topic", "_cell"))).alias("_cells"))
    return found.select(*keys, from_cells(lambda i: F.coalesce(F.col("_cells")[i], F.lit(0.0)), k).alias(name))
