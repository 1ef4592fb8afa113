"""Streams paced by documents, and event time: sliding and session windows, watermarks, late data."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.decayed import BAT
from topicloom.catalog.registry import (
    batch_rows, BATCHES, CHUNK, ENCODED, K, ORACLES, PARAMS, cells_sql, chunk_of, docs, query, table, talks, wide, with_sql,
)
from topicloom.catalog.relational import doc_rows
from topicloom.catalog import sampling  # noqa: F401  registers the SQL of assign_topics
from topicloom.operators import counts as C
from topicloom.operators import decay, gibbs
from topicloom.operators import tokens as T
from topicloom.sources import numbered as N
from topicloom.sources import sinks
from topicloom.storage import Workspace, materialize
from topicloom.streaming import windows as W


def micros(*names: str):
    return [F.unix_micros(n).alias(n) for n in names]


@query("stream_docs_by_number", f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {CHUNK} AS batch_id FROM documents")
def stream_docs_by_number(spark, sf):
    """The documents as a stream whose batches hold exactly so many documents each."""
    work = Workspace(spark)
    path, out = work.new_path("numbered"), work.new_path("out")
    N.append_numbered(docs(spark, sf), path)
    stream = N.stream_numbered(spark, path, chunk_of(spark, sf), work.new_path("position"))
    N.drain(sinks.write_stream(stream, sinks.table_writer(out), work.new_path("checkpoint"), "0 seconds").start())
    return spark.read.parquet(out).select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("assign_topics_stream", ORACLES["assign_topics"])
def assign_topics_stream(spark, sf):
    """Conversations scored as they arrive, against the documents' model: a stream-static join."""
    work = Workspace(spark)
    model = work.save(doc_rows(spark, sf), "model")
    alpha = [1.0 + x for x in C.totals_list(model, K)]
    path, out = work.new_path("numbered"), work.new_path("out")
    number = N.append_numbered(talks(spark, sf), path)
    stream = N.stream_numbered(spark, path, -(-max(number, 1) // BATCHES), work.new_path("position"))
    scored = gibbs.assign_topics(T.token_table(stream), model, alpha, PARAMS)
    write = sinks.table_writer(out)
    counted = lambda batch, batch_id: write(C.topic_counts(batch, "doc_id"), batch_id)  # noqa: E731  a document lies in one batch
    N.drain(sinks.write_stream(scored, counted, work.new_path("checkpoint"), "0 seconds").start())
    return spark.read.parquet(out).select("doc_id", "topic", "cnt")


@query(
    "sliding_batches",
    "SELECT epoch_us(start) AS start, epoch_us(start + INTERVAL 7 DAY) AS stop, CAST(sum(n) AS BIGINT) AS events, count(*) AS docs FROM ("
    " SELECT date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS start, user_id, CAST(count(*) AS BIGINT) AS n"
    " FROM events, range(7) r(i) GROUP BY 1, 2) GROUP BY start",
)
def sliding_batches(spark, sf):
    """A week's events as a batch, a new batch every day; a user is a document."""
    per_user = W.window_counts(table(spark, sf, "events").select("ts", "user_id"), "ts", "7 days", "1 day", keys=("user_id",))
    weeks = per_user.groupBy("start", "stop").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("docs"))
    return weeks.select(*micros("start", "stop"), "events", "docs")


@query(
    "session_docs",
    "SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS stop, count(*) AS events FROM ("
    " SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM ("
    "  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens"
    "  FROM events)) GROUP BY user_id, session",
)
def session_docs(spark, sf):
    """A user's events without a pause of six hours as a document."""
    found = W.session_counts(table(spark, sf, "events").select("ts", "user_id"), "ts", "6 hours", "user_id")
    return found.select("user_id", *micros("start", "stop"), "events")


LATE_EVERY, ARRIVALS = 7, 8
#: Every seventh event arrives a quarter of the table later than it should.
ARRIVED = (
    f"a AS (SELECT ts, event_id + CASE WHEN event_id % {LATE_EVERY} = 0 THEN n // 4 ELSE 0 END AS arrival, event_id FROM events, (SELECT count(*) AS n FROM events))",
    f"b AS (SELECT ts, (row_number() OVER (ORDER BY arrival * 2 + (event_id % {LATE_EVERY} = 0)::INT) - 1) // ((SELECT count(*) + {ARRIVALS - 1} FROM events) // {ARRIVALS}) AS b FROM a)",
    "top AS (SELECT b, max(epoch_ms(ts)) AS high FROM b GROUP BY b)",
    # Rows are held against the watermark the batch before ran with: the latest time two batches back, less a day.
    "mark AS (SELECT x.b, coalesce(max(y.high), 0) - CASE WHEN max(y.high) IS NULL THEN 0 ELSE 86400000 END AS mark FROM top x LEFT JOIN top y ON y.b < x.b - 1 GROUP BY x.b)",
)


@query(
    "stream_windows_late",
    with_sql(*ARRIVED)
    + "SELECT epoch_us(date_trunc('day', ts)) AS start, CAST(sum((epoch_ms(date_trunc('day', ts)) + 86400000 > mark)::INT) AS BIGINT) AS on_time,"
    " CAST(sum((epoch_ms(date_trunc('day', ts)) + 86400000 <= mark)::INT) AS BIGINT) AS late FROM b JOIN mark USING (b) GROUP BY 1",
)
def stream_windows_late(spark, sf):
    """Events of a day counted on a stream with a watermark; what came after its day was closed is late."""
    events = table(spark, sf, "events").select("event_id", "ts")
    number = events.count()
    is_late = F.col("event_id") % LATE_EVERY == 0
    arrival = (F.col("event_id") + F.when(is_late, number // 4).otherwise(0)) * 2 + is_late.cast("int")
    work = Workspace(spark)
    path, out = work.new_path("arrived"), work.new_path("counts")
    arrived = events.select(F.col("ts").cast("timestamp").alias("ts"), arrival.alias("arrival"))
    N.append_numbered(arrived, path, order="arrival")
    chunk = (number + ARRIVALS - 1) // ARRIVALS
    stream = N.stream_numbered(spark, path, chunk, work.new_path("position"), "ts timestamp")
    counted = W.window_counts(stream, "ts", "1 day", delay="1 day")
    writer = sinks.write_stream(counted, sinks.table_writer(out), work.new_path("checkpoint"), "0 seconds").outputMode("update")
    N.drain(writer.start())
    seen = W.newest(spark.read.parquet(out), ["start", "stop"])
    whole = W.window_counts(arrived, "ts", "1 day").withColumnRenamed("events", "whole")
    on_time = F.coalesce("events", F.lit(0))
    return whole.join(seen, ["start", "stop"], "left").select(
        *micros("start"), on_time.alias("on_time"), (F.col("whole") - on_time).alias("late"))


#: Batch times as they come in: the third is late and decays nothing, the model's clock stays at two.
TIMES = (0, 2, 1, 3)
CLOCK = tuple(max(TIMES[: i + 1]) for i in range(BATCHES))


@query(
    "blend_late_batch",
    with_sql(
        *ENCODED, BAT, "late AS (SELECT *, CASE b " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(CLOCK)) + " END AS t FROM bat)",
        "closed AS (SELECT wid, "
        + ", ".join(
            f"pow(CAST({1 - PARAMS.rate} AS DOUBLE), CAST({CLOCK[-1]} - min(t) AS DOUBLE)) + sum(CASE WHEN topic = {i} THEN CAST({PARAMS.rate} AS DOUBLE)"
            f" * pow(CAST({1 - PARAMS.rate} AS DOUBLE), CAST({CLOCK[-1]} - t AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END) AS n{i}" for i in range(K)
        )
        + ", CAST(max(t) AS BIGINT) AS last_batch FROM late GROUP BY wid)",
    )
    + f"SELECT CAST(wid AS BIGINT) AS wid, {cells_sql('round(n{i}, 6) AS n{i}')}, last_batch FROM closed",
)
def blend_late_batch(spark, sf):
    """Batches blended in order of arrival, one of them late."""
    _, parts = batch_rows(spark, sf)
    work, rows = Workspace(spark), spark.createDataFrame([], "wid bigint, n array<double>, last_batch bigint")
    for b in range(BATCHES):
        counts = parts.where(F.col("b") == b).select("wid", "n")
        rows = work.save(decay.blend_batch(rows, counts, max(TIMES[: b + 1]), PARAMS), f"rows{b}")
    return wide(decay.decay_rows(rows, CLOCK[-1], PARAMS), "wid", "last_batch")
