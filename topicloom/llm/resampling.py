"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words are lower-cased; word unigrams and bigrams are hashed to ``BUCKETS``
buckets. The raw model counts every document. The target model counts the texts
of at most ``SAMPLE`` labelled rows of good quality, those with the least hash of
their id (the one bounded sample here, a parameter). A document's importance is
the log ratio of the two models over its n-grams; a document is drawn by adding
Gumbel noise keyed by its id and taking the ``k`` greatest sums, which samples k
documents without replacement in proportion to their importance.

Counts are summed per task before the shuffle, so the models, two vectors of
``BUCKETS`` numbers, are the only thing the driver sees. The k greatest come from
a range-partitioned running count, not from one task. Defined results: null or
wordless text has importance 0; ties in the drawing order go to the lesser id;
with no good labelled row every ratio is 0 and the draw is uniform; repeated
rows are drawn separately; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import running_total
from topicloom.llm.hashing import gram_hashes, lower_ascii, word_hashes
from topicloom.storage import materialize, spread

BUCKETS = 1 << 16
SAMPLE = 20_000
KEEP = 0.9
SEED = 77


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every word unigram and bigram."""
    words = word_hashes(lower_ascii((text or "").encode()))
    return (np.concatenate([words, gram_hashes(words, 2)]) >> np.uint64(48)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of all and of target texts of this task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, chosen in zip(batch.column("text"), batch.column("chosen").to_pylist(), strict=True):
            own = np.bincount(buckets(text.as_py()), minlength=BUCKETS)
            raw += own
            if chosen:
                target += own
    some = np.flatnonzero(raw)
    yield pa.record_batch({"bucket": pa.array(some), "raw": pa.array(raw[some]), "target": pa.array(target[some])})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of target to raw per bucket; zero without any target text."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _weights(ratios: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(b), float(ratios[b].sum())) for b in (buckets(t.as_py()) for t in batch.column("text"))]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "version": batch.column("version"),
                "n_grams": pa.array([n for n, _ in found], pa.int64()), "log_weight": pa.array([w for _, w in found], pa.float64()),
            })

    return weigh


def targets(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Ids of the bounded sample of labelled rows of good quality."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)


def resampled(docs: DataFrame, labels: DataFrame, keep: float = KEEP, k: int | None = None) -> DataFrame:
    """``doc_id, n_grams, log_weight, drawn_at, kept`` per row; ``k`` or a share ``keep`` of all rows is kept."""
    source = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    chosen = F.broadcast(targets(labels).withColumn("chosen", F.lit(True)))  # at most SAMPLE ids
    marked = source.join(chosen, "doc_id", "left").select("text", "chosen")
    counted = marked.mapInArrow(_counts, "bucket bigint, raw bigint, target bigint")
    model = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in model:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    weighed = source.withColumn("version", F.xxhash64("text")).mapInArrow(
        _weights(log_ratios(raw, target)), "doc_id bigint, version bigint, n_grams bigint, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "version"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = F.col("log_weight") - F.log(-F.log(uniform))
    rows = weighed.withColumn("drawn_at", drawn).withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    ranked = running_total(rows.withColumn("last", -F.col("drawn_at")), "all", ["last", "doc_id", "version"], "one", "place")
    ranked = materialize(ranked, "ranked")
    wanted = k if k is not None else math.ceil(keep * ranked.count())
    return ranked.select("doc_id", "n_grams", "log_weight", "drawn_at", (F.col("place") < wanted).alias("kept"))
