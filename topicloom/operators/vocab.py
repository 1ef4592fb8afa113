"""Term dictionaries: the sorted one of a fixed corpus, and the bounded ageing one.

Ageing state: ``vocab(term, wid, last_seen, use_count)`` with ids 0..size-1.
Every step is DataFrame in, DataFrame out; ranks come from a distributed sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.ranking import global_rank, with_global_rank
from topicloom.storage import materialize

SCHEMA = "term string, wid bigint, last_seen bigint, use_count bigint"


def empty_vocab(spark: SparkSession) -> DataFrame:
    """A vocabulary with no terms; also what a reset leaves behind."""
    return spark.createDataFrame([], SCHEMA)


def build_vocab_sorted(freqs: DataFrame) -> DataFrame:
    """(term, freq, wid): distinct terms in sort order with dense ids from 0."""
    return with_global_rank(freqs.select("term", "freq"), [F.asc("term")], "wid", start=0)


def extend_vocab(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """``vocab`` plus its missing terms, which take ids V, V+1, ... in term order."""
    unseen = terms.select("term").distinct().join(vocab.select("term"), "term", "left_anti")
    ranked = with_global_rank(unseen, [F.asc("term")], "wid", start=0)
    size = vocab.agg(F.count(F.lit(1))).scalar()
    added = ranked.select("term", (F.col("wid") + size).alias("wid"))
    return vocab.select("term", "wid").unionByName(added)


def vocab_difference(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    return terms.select("term").subtract(vocab.select("term"))


def vocab_union(*term_tables: DataFrame) -> DataFrame:
    """Distinct terms over all inputs."""
    merged = term_tables[0].select("term")
    for table in term_tables[1:]:
        merged = merged.unionByName(table.select("term"))
    return merged.distinct()


def unknown_by_freq(freqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Unknown terms, most frequent first, ties by term."""
    fresh = freqs.join(vocab.select("term"), "term", "left_anti")
    return fresh.orderBy(F.desc("freq"), F.asc("term"))


def vocab_touch(vocab: DataFrame, terms: DataFrame, t: int) -> DataFrame:
    """last_seen = max(last_seen, t) for the given terms."""
    seen = terms.select("term").distinct().withColumn("_t", F.lit(t).cast("bigint"))
    return vocab.join(seen, "term", "left").select(
        "term", "wid", F.greatest("last_seen", "_t").alias("last_seen"), "use_count"
    )


def vocab_use_counts(vocab: DataFrame, pins: DataFrame) -> DataFrame:
    """Apply pins, rows (term, step) with +1 or -1. Terms outside the vocabulary
    are ignored, so releasing them never leaves a negative count behind."""
    moved = pins.groupBy("term").agg(F.sum("step").alias("_step"))
    return vocab.join(moved, "term", "left").select(
        "term", "wid", "last_seen",
        (F.col("use_count") + F.coalesce("_step", F.lit(0))).cast("bigint").alias("use_count"),
    )


def lru_order() -> list:
    return [F.asc("last_seen"), F.asc("term")]


def lru_boundary(idle: DataFrame, n: int) -> int | None:
    """Least ``last_seen`` up to which ``idle`` has ``n`` terms; None if it has fewer.

    From a histogram, one row per batch time still in the vocabulary, combined
    before the shuffle and read on the driver a partition at a time.
    """
    reached = 0
    for seen, terms in idle.groupBy("last_seen").agg(F.count(F.lit(1)).alias("terms")).orderBy("last_seen").toLocalIterator():
        reached += terms
        if reached >= n:
            return seen
    return None


def lru_candidates(vocab: DataFrame, t: int, n: int) -> DataFrame:
    """The ``n`` longest unseen, unpinned terms: (crn, term, wid, last_seen).

    Only terms up to the boundary are sorted: at most ``n`` and those that share
    the boundary's ``last_seen``.
    """
    idle = vocab.where((F.col("last_seen") < t) & (F.col("use_count") == 0)).select("term", "wid", "last_seen")
    boundary = lru_boundary(idle, n)
    if boundary is not None:
        idle = idle.where(F.col("last_seen") <= boundary)
    return with_global_rank(idle, lru_order(), "crn").where(F.col("crn") <= n)


@dataclass
class VocabStep:
    """State after an addition, and what each offered term got.

    ``issued(term, freq, wid)`` has wid -1 for terms that found no place;
    ``evicted(term, wid)`` are the rows that left; ``size`` is the new size.
    """

    vocab: DataFrame
    issued: DataFrame
    evicted: DataFrame
    size: int


def vocab_add(vocab: DataFrame, freqs: DataFrame, t: int, capacity: int | None, size: int | None = None) -> VocabStep:
    """Admit terms (term, freq), none of them known, by falling frequency.

    Free ids go first; then each term takes over the id of the next least
    recently seen unpinned term; the rest get -1. Without a capacity every term gets a free id.
    """
    size = vocab.count() if size is None else size
    ranked, offered = global_rank(freqs.select("term", "freq"), [F.desc("freq"), F.asc("term")], "rn")
    free = offered if capacity is None else max(capacity - size, 0)
    minus_one = F.lit(-1).cast("bigint")
    if offered > free:
        freed = lru_candidates(vocab, t, offered - free).select(
            (F.col("crn") + free).alias("rn"), F.col("term").alias("_out"), F.col("wid").alias("_freed")
        )
        placed = ranked.join(freed, "rn", "left").select(
            "term", "freq", "_out",
            F.when(F.col("rn") <= free, F.col("rn") + (size - 1))
            .otherwise(F.coalesce("_freed", minus_one)).alias("wid"),
        )
    else:
        placed = ranked.select(
            "term", "freq", F.lit(None).cast("string").alias("_out"), (F.col("rn") + (size - 1)).alias("wid")
        )
    placed = materialize(placed, "issued")
    evicted = placed.where(F.col("_out").isNotNull()).select(F.col("_out").alias("term"), "wid")
    entered = placed.where("wid >= 0").select(
        "term", "wid", F.lit(t).cast("bigint").alias("last_seen"), F.lit(0).cast("bigint").alias("use_count")
    )
    stayed = vocab.join(evicted.select("term"), "term", "left_anti") if offered > free else vocab
    return VocabStep(
        stayed.unionByName(entered), placed.select("term", "freq", "wid"), evicted, size + min(offered, free)
    )


@dataclass
class VocabBatch:
    """Outcome of one batch: next state, ids of all its terms, new ids, evictions.

    ``changed`` holds the state's rows of the batch's own ids, all that differ
    from the state before it: an evicted term's id is one of them.
    """

    vocab: DataFrame
    term_ids: DataFrame
    issued: DataFrame
    evicted: DataFrame
    size: int
    changed: DataFrame


def vocab_update_batch(
    vocab: DataFrame, freqs: DataFrame, t: int, capacity: int | None, size: int | None = None
) -> VocabBatch:
    """One batch of the ageing vocabulary.

    Known terms are touched and pinned before new ones are admitted, so a term
    of this batch is never evicted by it. Pins last for the batch only.
    """
    size = vocab.count() if size is None else size
    state = vocab.select("term", "wid", "last_seen", "use_count")
    held = state.select("term", F.col("wid").alias("_wid"), F.col("last_seen").alias("_seen"), F.col("use_count").alias("_uses"))
    looked = materialize(freqs.join(held, "term", "left"), "lookup")
    known = looked.where(F.col("_wid").isNotNull())
    touched = vocab_touch(state, known, t)
    pinned = vocab_use_counts(touched, known.select("term", F.lit(1).alias("step")))
    step = vocab_add(pinned, looked.where(F.col("_wid").isNull()), t, capacity, size)
    released = vocab_use_counts(step.vocab, known.select("term", F.lit(-1).alias("step")))
    term_ids = known.select("term", "freq", F.col("_wid").alias("wid")).unionByName(step.issued)
    issued, now = step.issued.where("wid >= 0"), F.lit(t).cast("bigint")
    seen = known.select("term", F.col("_wid").alias("wid"), F.greatest("_seen", now).alias("last_seen"), F.col("_uses").alias("use_count"))
    changed = seen.unionByName(issued.select("term", "wid", now.alias("last_seen"), F.lit(0).cast("bigint").alias("use_count")))
    return VocabBatch(released, term_ids, issued, step.evicted, step.size, changed)
