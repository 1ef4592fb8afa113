"""Equi-joins that hold up when one key owns a large part of the rows.

Natural text has a few terms in almost every position, so a plain shuffle join
of tokens on the term sends them all to one task. A key is *hot* when it owns
more rows than one task should get: ``MIN_ROWS``, or 1/``SHARE`` of the rows where
that is more. There cannot be more than ``SHARE`` such keys, so the hot list is
safe to broadcast by arithmetic. Hot keys are cut into as many salts as needed
for every (key, salt) to hold at most that many rows, whatever the size of the
table, and the matching right rows are repeated per salt: at most 2 x ``SHARE``
extra rows in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1 << 17
MIN_ROWS = 1_000_000
BROADCAST_ROWS = 10_000
HASH_BYTES = 64 << 20


def hot_keys(
    counts: DataFrame, key: str, count: str, share: int = SHARE, min_rows: int = MIN_ROWS
) -> DataFrame | None:
    """``(key, _salts)`` of the hot keys, or None when there are none.

    ``counts`` has one row per key with its row count; best a saved table, since
    two numbers are taken from it here. ``min_rows`` is what a single task copes
    with anyway.
    """
    whole, most = counts.agg(F.sum(count), F.max(count)).first()
    target = max(min_rows, -(-(whole or 0) // share))
    if most is None or most < target:
        return None
    return counts.where(F.col(count) >= target).select(key, F.ceil(F.col(count) / F.lit(target)).cast("int").alias("_salts"))


def keyed_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner",
    hot: DataFrame | None = None, spread: tuple[str, ...] = (),
) -> DataFrame:
    """Join on ``key``; rows of hot keys are spread by the ``spread`` columns.

    ``right`` holds one row per key and is the side that is hashed: left sides
    are exploded tokens, whose size the optimizer takes for that of the unsplit
    text, so it must not pick the side to build or broadcast from. Works for
    inner, left, left_semi and left_anti joins, since each left row meets
    exactly one copy of its right row.
    """
    if hot is None:
        return left.join(_hashed(right), key, how)
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts")
    copies = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(_hashed(copies), [key, "_salt"], how).drop("_salt")


def _hashed(right: DataFrame) -> DataFrame:
    """``right`` hinted as the hashed side while a partition's share of it fits easily in memory."""
    spark = right.sparkSession
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return right.hint("shuffle_hash") if size <= partitions * HASH_BYTES else right


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows
