"""The time-decayed model."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.registry import (
    BATCHES, CHUNK, ENCODED, ITEM_TOKENS, K, PARAMS, batch_rows, cells_sql, chunk_of, item_tokens, query, sums_sql,
    table, term_rows, unpivot_sql, uniform_sql, wide, with_sql,
)
from topicloom.functions import vectors as V
from topicloom.operators import counts as C
from topicloom.operators import decay, gibbs, ranking
from topicloom.storage import Workspace, materialize

BAT = f"bat AS (SELECT *, doc_id // {CHUNK} AS b FROM enc)"
ROWS = f"rw AS (SELECT wid, {sums_sql()}, CAST(max(b) AS BIGINT) AS last_batch FROM bat GROUP BY wid)"
KEEP = 1 - PARAMS.rate


def power(gap: str) -> str:
    return f"pow(CAST({KEEP} AS DOUBLE), CAST({gap} AS DOUBLE))"


def stored_rows(spark, sf):
    """All counts of a word, stamped with its last batch."""
    batch = F.floor(F.col("doc_id") / chunk_of(spark, sf)).cast("bigint")
    return term_rows(spark, sf, last_batch=F.max(batch))


@query("decay_rows", with_sql(*ENCODED, BAT, ROWS)
       + f"SELECT CAST(wid AS BIGINT) AS wid, {cells_sql(f'round(n{{i}} * {power(f'{BATCHES} - last_batch')}, 6) AS n{{i}}')} FROM rw")
def decay_rows(spark, sf):
    return wide(decay.decay_rows(stored_rows(spark, sf)[1], BATCHES, PARAMS), "wid")


REUSED = "reuse AS (SELECT wid FROM voc WHERE term IN (SELECT term FROM item))"


def _reused(spark, sf, vocab):
    """Ids whose term also occurs in the benchmark stand for reissued ids."""
    return vocab.join(item_tokens(spark, sf).select("term").distinct(), "term", "left_semi").select("wid")


@query(
    "reset_new_rows",
    with_sql(*ENCODED, ITEM_TOKENS, BAT, ROWS, REUSED)
    + f"SELECT CAST(wid AS BIGINT) AS wid, {cells_sql('n{i}')}, last_batch FROM rw WHERE wid NOT IN (SELECT wid FROM reuse)"
    f" UNION ALL SELECT CAST(wid AS BIGINT), {cells_sql('CAST(1 AS DOUBLE)')}, CAST({BATCHES} AS BIGINT) FROM reuse",
)
def reset_new_rows(spark, sf):
    vocab, rows = stored_rows(spark, sf)
    return wide(decay.reset_new_rows(rows, _reused(spark, sf, vocab), BATCHES, PARAMS), "wid", "last_batch")


@query(
    "reset_change",
    with_sql(*ENCODED, ITEM_TOKENS, BAT, ROWS, REUSED)
    + f"SELECT {cells_sql(f'round(sum(1 - n{{i}} * {power(f'{BATCHES} - last_batch')}), 6) AS n{{i}}')}"
    " FROM rw WHERE wid IN (SELECT wid FROM reuse)",
)
def reset_change(spark, sf):
    """What resetting the rows does to the topic totals."""
    vocab, rows = stored_rows(spark, sf)
    return wide(decay.reset_change(rows, _reused(spark, sf, vocab), BATCHES, PARAMS))


@query("seed_rows", with_sql(*ENCODED, BAT, ROWS) + f"SELECT CAST(wid AS BIGINT) AS wid, {cells_sql('n{i} + 1 AS n{i}')} FROM rw")
def seed_rows(spark, sf):
    return wide(decay.seed_rows(stored_rows(spark, sf)[1], PARAMS), "wid")


@query("seed_totals", with_sql(*ENCODED, BAT, ROWS) + f"SELECT {cells_sql('sum(n{i}) + count(*) AS n{i}')} FROM rw")
def seed_totals(spark, sf):
    rows = stored_rows(spark, sf)[1]
    return wide(decay.seed_totals(C.totals_vector(rows, K), rows, PARAMS))


# Closed form of the recurrence at time T, for a word first seen in batch b0:
# beta * keep^(T - b0) + sum over batches of rate * count * keep^(T - b).
LAST = BATCHES - 1
CLOSED = (
    "closed AS (SELECT wid, max(b) AS last_batch, min(b) AS b0, "
    + ", ".join(
        f"{power(f'{LAST} - min(b)')} + sum(CASE WHEN topic = {i} THEN CAST({PARAMS.rate} AS DOUBLE) * {power(f'{LAST} - b')}"
        f" ELSE CAST(0 AS DOUBLE) END) AS n{i}"
        for i in range(K)
    )
    + " FROM bat GROUP BY wid)"
)


def replayed(spark, sf):
    """(vocabulary, rows, totals) after blending the batches one by one."""
    work = Workspace(spark)
    vocab, parts = batch_rows(spark, sf)
    rows = spark.createDataFrame([], "wid bigint, n array<double>, last_batch bigint")
    totals = [0.0] * K
    for b in range(BATCHES):
        counts = parts.where(F.col("b") == b).select("wid", "n")
        fresh = counts.join(rows.select("wid"), "wid", "left_anti").count()
        added = C.totals_list(counts, K)
        totals = [t + PARAMS.beta * fresh + PARAMS.rate * c for t, c in zip(decay.decay_totals(totals, 1, PARAMS.rate), added)]
        rows = work.save(decay.blend_batch(rows, counts, b, PARAMS), f"rows{b}")
    return vocab, rows, totals


@query("blend_batch", with_sql(*ENCODED, BAT, CLOSED)
       + f"SELECT CAST(wid AS BIGINT) AS wid, {cells_sql('round(n{i}, 6) AS n{i}')} FROM closed")
def blend_batch(spark, sf):
    return wide(decay.decay_rows(replayed(spark, sf)[1], LAST, PARAMS), "wid")


@query("stamp_batch_time", with_sql(*ENCODED, BAT, ITEM_TOKENS, REUSED)
       + f"SELECT CAST(wid AS BIGINT) AS wid, CAST(CASE WHEN wid IN (SELECT wid FROM reuse) THEN {BATCHES} ELSE max(b) END AS BIGINT)"
       " AS last_batch FROM bat GROUP BY wid")
def stamp_batch_time(spark, sf):
    vocab, rows = stored_rows(spark, sf)
    return decay.stamp_batch_time(rows, _reused(spark, sf, vocab), BATCHES)


@query(
    "model_consistency",
    with_sql(*ENCODED, BAT, CLOSED, f"s AS (SELECT sum({cells_sql('n{i}', ' + ')}) AS x FROM closed)")
    + "SELECT round(x, 4) AS row_sum, CAST(0 AS BIGINT) AS late_rows, round(x, 4) AS total_sum FROM s",
)
def model_consistency(spark, sf):
    """Rows and running totals, kept apart, agree with the closed form."""
    _, rows, totals = replayed(spark, sf)
    whole = spark.createDataFrame([(totals,)], "n array<double>")
    checked = decay.model_consistency(rows, whole, LAST, PARAMS)
    return checked.select(F.round("row_sum", 4).alias("row_sum"), "late_rows", F.round("total_sum", 4).alias("total_sum"))


@query(
    "topic_top_words_decayed",
    with_sql(
        *ENCODED, BAT, CLOSED, f"cell AS ({unpivot_sql('closed', 'wid')})",
        "ranked AS (SELECT topic, term, round(cnt, 6) AS cnt, row_number() OVER (PARTITION BY topic ORDER BY round(cnt, 6) DESC, term) AS rank"
        " FROM cell JOIN voc USING (wid))",
    )
    + "SELECT topic, CAST(rank AS INTEGER) AS rank, term, cnt FROM ranked WHERE rank <= 20",
)
def topic_top_words_decayed(spark, sf):
    vocab, rows, _ = replayed(spark, sf)
    fresh = decay.decay_rows(rows, LAST, PARAMS).join(vocab.select("wid", "term"), "wid")
    cells = C.vector_cells(fresh, "term").withColumn("cnt", F.round("cnt", 6))
    return ranking.top_words(cells, 20).select("topic", "rank", "term", "cnt")


@query(
    "decayed_backfill",
    with_sql(
        "bat AS (SELECT event_type AS term, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS b,"
        f" CAST(floor({uniform_sql(0)} * {K}) AS INTEGER) AS topic FROM (SELECT *, user_id AS doc_id, event_id AS pos FROM events))",
        "hi AS (SELECT max(b) AS t FROM bat)",
    )
    + "SELECT term, "
    + ", ".join(
        f"round(pow(CAST({KEEP} AS DOUBLE), CAST(max(t) - min(b) AS DOUBLE)) + sum(CASE WHEN topic = {i} THEN CAST({PARAMS.rate} AS DOUBLE)"
        f" * pow(CAST({KEEP} AS DOUBLE), CAST(t - b AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END), 6) AS n{i}"
        for i in range(K)
    )
    + " FROM bat CROSS JOIN hi GROUP BY term",
)
def decayed_backfill(spark, sf):
    """Thirty daily batches of events in one aggregation."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("term"),
        F.to_date("ts").alias("day"),
    )
    first, last = events.agg(F.min("day"), F.max("day")).first()
    tokens = gibbs.init_topics_uniform(events, PARAMS).withColumn("b", F.date_diff("day", F.lit(first)).cast("bigint"))
    return wide(decay.backfill_rows(tokens, "term", "b", (last - first).days, PARAMS), "term")
