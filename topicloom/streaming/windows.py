"""Event time: tumbling, sliding and session windows, with a bound on lateness.

Every function takes a table or a stream. On a stream ``delay`` sets the
watermark: the latest event time seen so far less ``delay``. A window whose end
the watermark has passed is closed, and rows that come for it later are late and
dropped; a table has no late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def marked(events: DataFrame, time: str, delay: str | None) -> DataFrame:
    """``events`` with a timestamp in ``time`` and, on a stream, its watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay) if delay is not None and events.isStreaming else timed


def window_counts(
    events: DataFrame, time: str, length: str, slide: str | None = None, delay: str | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """``(start, stop, *keys, events)`` per window of ``length``, a new one every ``slide``."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = marked(events, time, delay).groupBy(window.alias("_window"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("stop"), *keys, "events")


def session_counts(events: DataFrame, time: str, gap: str | Column, key: str, delay: str | None = None) -> DataFrame:
    """``(key, start, stop, events)`` per session: events of a key less than ``gap`` apart; ``stop`` is a gap after the last."""
    counted = marked(events, time, delay).groupBy(F.session_window(time, gap).alias("_session"), key).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(key, F.col("_session.start").alias("start"), F.col("_session.end").alias("stop"), "events")


def newest(updates: DataFrame, keys: list[str], batch: str = "batch_id") -> DataFrame:
    """The last row per key of an update stream's batches."""
    rest = [c for c in updates.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max(F.struct(batch, *[c for c in rest if c != batch])).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest if c != batch])


def late_rows(query: StreamingQuery) -> int:
    """Rows (of partial sums, where the engine sums before it looks) that a query has dropped as late so far."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
