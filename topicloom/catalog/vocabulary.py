"""The bounded, ageing vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.registry import (
    DOC_TOKENS, ITEM_TOKENS, TALK_TOKENS, doc_tokens, freq_sql, item_tokens, query, talk_tokens, with_sql,
)
from topicloom.operators import tokens as T, vocab as Vb
from topicloom.operators.ranking import with_global_rank
from topicloom.storage import materialize

# A vocabulary of the conversations: last_seen is the latest turn of a term,
# terms that also occur in the benchmark are pinned.
SEED = (
    DOC_TOKENS, TALK_TOKENS, ITEM_TOKENS, freq_sql("freq", "tok"), freq_sql("ifreq", "item"),
    "seed AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS wid, last_seen,"
    " CAST(CASE WHEN term IN (SELECT term FROM ifreq) THEN 1 ELSE 0 END AS BIGINT) AS use_count"
    " FROM (SELECT term, CAST(max(doc_id % 4294967296) AS BIGINT) AS last_seen FROM talk GROUP BY term))",
)
NEW = (
    "fresh AS (SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) AS rn FROM freq"
    " WHERE term NOT IN (SELECT term FROM seed))"
)


def seed(spark, sf):
    last = talk_tokens(spark, sf).groupBy("term").agg(F.max(F.col("doc_id") % 4294967296).cast("bigint").alias("last_seen"))
    pinned = item_tokens(spark, sf).select("term").distinct().withColumn("pin", F.lit(1))
    rows = with_global_rank(last, [F.asc("term")], "wid", start=0).join(pinned, "term", "left")
    return materialize(
        rows.select("term", "wid", "last_seen", F.coalesce("pin", F.lit(0)).cast("bigint").alias("use_count")), "seed"
    )


def fresh(spark, sf, vocab):
    return T.unknown_terms(T.term_frequency(doc_tokens(spark, sf)), vocab)


@query(
    "vocab_add",
    with_sql(*SEED, NEW)
    + "SELECT term, CAST(CASE WHEN rn <= 1000 THEN (SELECT count(*) FROM seed) + rn - 1 ELSE -1 END AS BIGINT) AS wid FROM fresh",
)
def vocab_add(spark, sf):
    """1000 free places, nothing old enough to evict."""
    state = seed(spark, sf)
    size = state.count()
    return Vb.vocab_add(state, fresh(spark, sf, state), 0, size + 1000, size).issued.select("term", "wid")


@query(
    "vocab_replace",
    with_sql(
        *SEED, NEW,
        "cand AS (SELECT term, wid, row_number() OVER (ORDER BY last_seen, term) AS crn FROM seed WHERE last_seen < 100 AND use_count = 0)",
        "swap AS (SELECT f.term, c.term AS gone, c.wid FROM fresh f JOIN cand c ON c.crn = f.rn)",
    )
    + "SELECT term, wid, last_seen, use_count FROM seed WHERE term NOT IN (SELECT gone FROM swap)"
    " UNION ALL SELECT term, wid, CAST(100 AS BIGINT), CAST(0 AS BIGINT) FROM swap",
)
def vocab_replace(spark, sf):
    """A full vocabulary: every new term takes the id of an old one."""
    state = seed(spark, sf)
    size = state.count()
    return Vb.vocab_add(state, fresh(spark, sf, state), 100, size, size).vocab


@query(
    "vocab_touch",
    with_sql(*SEED)
    + "SELECT term, wid, CASE WHEN term IN (SELECT term FROM freq) THEN greatest(last_seen, CAST(2 AS BIGINT)) ELSE last_seen END"
    " AS last_seen, use_count FROM seed",
)
def vocab_touch(spark, sf):
    return Vb.vocab_touch(seed(spark, sf), doc_tokens(spark, sf), 2)


@query(
    "vocab_use_counts",
    with_sql(*SEED)
    + "SELECT term, wid, last_seen, CAST(use_count + CASE WHEN term IN (SELECT term FROM freq) THEN 1 ELSE 0 END"
    " - CASE WHEN term IN (SELECT term FROM ifreq) THEN 1 ELSE 0 END AS BIGINT) AS use_count FROM seed",
)
def vocab_use_counts(spark, sf):
    """Pin the terms of the documents, release those of the benchmark."""
    plus = doc_tokens(spark, sf).select("term").distinct().withColumn("step", F.lit(1))
    minus = item_tokens(spark, sf).select("term").distinct().withColumn("step", F.lit(-1))
    return Vb.vocab_use_counts(seed(spark, sf), plus.unionByName(minus))


@query(
    "lru_candidates",
    with_sql(*SEED)
    + "SELECT row_number() OVER (ORDER BY last_seen, term) AS crn, term, wid, last_seen FROM seed"
    " WHERE last_seen < 100 AND use_count = 0 ORDER BY crn LIMIT 1000",
)
def lru_candidates(spark, sf):
    return Vb.lru_candidates(seed(spark, sf), 100, 1000).select("crn", "term", "wid", "last_seen")


@query("vocab_size", with_sql(*SEED) + "SELECT count(*) AS size FROM seed")
def vocab_size(spark, sf):
    return seed(spark, sf).agg(F.count(F.lit(1)).alias("size"))


@query("load_vocab", with_sql(*SEED) + "SELECT wid, term FROM seed")
def load_vocab(spark, sf):
    return seed(spark, sf).select("wid", "term")


def _chain_sql(batches: list[tuple[str, int]], capacity: str) -> str:
    """The batch rule as CTEs, one group per (frequency table, time)."""
    parts, state = ["v0 AS (SELECT CAST('' AS VARCHAR) AS term, CAST(0 AS BIGINT) AS wid, CAST(0 AS BIGINT) AS last_seen WHERE false)"], "v0"
    for i, (freq, t) in enumerate(batches, 1):
        parts += [
            f"room{i} AS (SELECT greatest({capacity} - count(*), 0) AS free, count(*) AS size FROM {state})",
            f"new{i} AS (SELECT term, row_number() OVER (ORDER BY freq DESC, term) AS rn FROM {freq}"
            f" WHERE term NOT IN (SELECT term FROM {state}))",
            f"cand{i} AS (SELECT term, wid, row_number() OVER (ORDER BY last_seen, term) AS crn FROM {state}"
            f" WHERE last_seen < {t} AND term NOT IN (SELECT term FROM {freq}))",
            f"put{i} AS (SELECT n.term, c.term AS gone, CASE WHEN n.rn <= r.free THEN r.size + n.rn - 1"
            f" ELSE coalesce(c.wid, -1) END AS wid FROM new{i} n CROSS JOIN room{i} r LEFT JOIN cand{i} c ON c.crn = n.rn - r.free)",
            f"v{i} AS (SELECT term, wid, CASE WHEN term IN (SELECT term FROM {freq}) THEN greatest(last_seen, {t}) ELSE last_seen END AS last_seen"
            f" FROM {state} WHERE term NOT IN (SELECT gone FROM put{i} WHERE gone IS NOT NULL)"
            f" UNION ALL SELECT term, wid, {t} FROM put{i} WHERE wid >= 0)",
        ]
        state = f"v{i}"
    return ",\n".join(parts)


@query(
    "vocab_update_batch",
    with_sql(
        DOC_TOKENS, TALK_TOKENS, ITEM_TOKENS, freq_sql("freq", "tok"), freq_sql("tfreq", "talk"), freq_sql("ifreq", "item"),
        _chain_sql([("tfreq", 0), ("freq", 1), ("ifreq", 2)], "(SELECT count(*) + 1000 FROM tfreq)"),
    )
    + "SELECT term, CAST(wid AS BIGINT) AS wid, CAST(last_seen AS BIGINT) AS last_seen, CAST(0 AS BIGINT) AS use_count FROM v3",
)
def vocab_update_batch(spark, sf):
    """Conversations, documents and benchmark as three batches of a vocabulary
    with 1000 places more than the conversations need."""
    state, size, capacity = Vb.empty_vocab(spark), 0, None
    for t, tokens in enumerate((talk_tokens(spark, sf), doc_tokens(spark, sf), item_tokens(spark, sf))):
        freqs = materialize(T.term_frequency(tokens), "freqs")
        capacity = capacity or freqs.count() + 1000
        step = Vb.vocab_update_batch(state, freqs, t, capacity, size)
        state, size = materialize(step.vocab, "vocab"), step.size
    return state


@query("vocab_reset", with_sql(DOC_TOKENS)
       + "SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS before, CAST(0 AS BIGINT) AS terms FROM tok")
def vocab_reset(spark, sf):
    """A trainer that has seen the documents' terms forgets them all."""
    from topicloom.storage import Workspace
    from topicloom.streaming.state import StateStore

    docs = doc_tokens(spark, sf).groupBy("doc_id").count().agg(F.count(F.lit(1)).alias("docs"))
    store = StateStore(spark, Workspace(spark).new_path("state"), 1)
    freqs = materialize(T.term_frequency(doc_tokens(spark, sf)), "freqs")
    step = Vb.vocab_add(Vb.empty_vocab(spark), freqs, 0, freqs.count(), 0)
    nothing = store.empty()
    store.commit(store.write_changes(nothing, 0, step.vocab, nothing.rows, 0, step.size, [0.0]))
    before = store.latest().vocab.where("wid >= 0").count()
    store.reset()
    return docs.withColumn("before", F.lit(before).cast("bigint")).withColumn("terms", F.lit(store.latest().vocab.count()).cast("bigint"))
