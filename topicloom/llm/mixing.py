"""Mixing sources to target weights, in fixed-length blocks of words.

Every source's documents, in order of ``doc_id``, are one row of words, cut into
blocks of ``BLOCK`` words. The mix takes whole blocks:

1. Sources get weights 1, 2, 3, repeating in code-point order (null last), and
   targets: their share of all words, stopped at ``MOST`` times the source with
   the excess shared again by weight.
2. A source's target is a number of slots. Slots are dealt to output shards: each
   stratum of shards has its exact part of every source, and within it a shard's
   source counts are a multinomial draw given what the stratum has left.
3. Slot number q of a source takes block ``permutation_e(q mod blocks)``, e being
   ``q div blocks``: a keyed Feistel permutation per source and round, computed
   where it is needed. No block is thus taken twice before all are taken once.
4. Blocks and documents meet by (source, block). The last slot of a source takes
   only the words still due.

Shards are made independently from their number; only one row per source
(sizes, targets: the recipe of the mix) is on the driver. Word positions come
from a range-partitioned running total, so a source with a third of all rows is
spread. Defined results: null text has size 0 and takes 0; repeated rows are
documents of their own; a null ``doc_id`` comes first in its source. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.columns import bundle, hash_of, others, unbundled
from topicloom.llm.graph import running_total
from topicloom.llm.hashing import mix
from topicloom.storage import materialize

BLOCK = 64
MOST = 3
SHARD = 4096
STRATUM = 64 * SHARD
SEED = 20240
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 4


def shares(sizes: list[int], most: int = MOST) -> list[float]:
    """Target words per source, sources given in order."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    left = float(sum(sizes))
    while True:
        open_weight = sum(w for i, w in enumerate(weights) if i not in fixed)
        targets = {i: left * w / open_weight for i, w in enumerate(weights) if i not in fixed}
        over = [i for i, t in targets.items() if t > most * sizes[i]]
        if not over:
            return [fixed.get(i, targets.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: float(most * sizes[i]) for i in over}
        left = float(sum(sizes)) - sum(fixed.values())


def _round_keys(source: int, epoch: int) -> np.ndarray:
    start = ((SEED << 32) + source) * 0x9E3779B97F4A7C15 + epoch * 64
    return mix(np.array([(start + k) % 2**64 for k in range(ROUNDS)], np.uint64))


def permuted(index: np.ndarray, size: int, source: int, epoch: int, back: bool = False) -> np.ndarray:
    """``index`` under (or back from) the keyed permutation of ``range(size)``."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(source, epoch)
    value = index.astype(np.uint64)
    todo = np.arange(len(value))
    while len(todo):
        left, right = value[todo] >> half, value[todo] & low
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left + key) & low), left
            else:
                left, right = right, left ^ (mix(right + key) & low)
        value[todo] = left << half | right
        todo = todo[value[todo] >= size]  # walk on until inside the range
    return value.astype(np.int64)


def recipe(sizes: list[int]) -> list[dict]:
    """Per source: blocks, slots, and how many words its last slot takes."""
    plan = []
    for source, (size, target) in enumerate(zip(sizes, shares(sizes), strict=True)):
        due = min(round(target), MOST * size)
        blocks = -(-size // BLOCK)
        missing = blocks * BLOCK - size
        short = [e * blocks + int(permuted(np.array([blocks - 1]), blocks, source, e, back=True)[0]) for e in range(MOST if blocks else 0)]
        words = lambda slots: slots * BLOCK - missing * sum(q < slots for q in short)  # noqa: B023, E731
        slots = -(-due // BLOCK)
        while words(slots) < due:
            slots += 1
        plan.append({"size": size, "target": target, "blocks": blocks, "slots": slots, "spare": words(slots) - due})
    return plan


def _slots(plan: list[dict]):
    """Slots of whole strata: shard, place in it, source, block and words taken from it."""
    totals = np.array([p["slots"] for p in plan], np.int64)
    strata = max(1, -(-int(totals.sum()) // STRATUM))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number in (int(n) for frame in frames for n in frame["id"]):
            before = np.array([int(t) * number // strata for t in totals])
            left = np.array([int(t) * (number + 1) // strata for t in totals]) - before
            shards = max(1, -(-int(left.sum()) // SHARD))
            rng = np.random.Generator(np.random.Philox(key=[SEED, number]))
            for k in range(shards):
                take = int(left.sum()) // (shards - k)
                counts = rng.multivariate_hypergeometric(left, take, method="marginals")
                source = np.repeat(np.arange(len(plan)), counts)
                ordinal = np.concatenate([np.arange(b, b + c) for b, c in zip(before, counts, strict=True)])
                before, left = before + counts, left - counts
                block, words, copy = np.zeros(take, np.int64), np.zeros(take, np.int64), np.zeros(take, np.int64)
                for s in np.flatnonzero(counts):
                    p, own = plan[s], np.flatnonzero(source == s)
                    copy[own] = epoch = ordinal[own] // p["blocks"]
                    for e in np.unique(epoch):
                        at = own[epoch == e]
                        block[at] = permuted(ordinal[at] % p["blocks"], p["blocks"], int(s), int(e))
                    words[own] = np.minimum(BLOCK, p["size"] - block[own] * BLOCK) - p["spare"] * (ordinal[own] == p["slots"] - 1)
                order = rng.permutation(take)
                yield pd.DataFrame({
                    "shard": f"{number:08d}-{k:02d}", "slot": np.arange(take), "source_at": source[order].astype(np.int32),
                    "block": block[order], "words": words[order], "copy": copy[order],
                })

    return strata, draw


def row_version(docs: DataFrame) -> Column:
    """A hash of all columns: rows with the same id and version are the same."""
    return hash_of(docs)


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, version, size)`` per row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), row_version(docs).alias("version"), size.alias("size"))


def mixture(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with place and target, and the spans of the mix.

    Documents: ``doc_id, source, version, size, source_at, source_size, target,
    begin`` (words of the source before it). Spans: ``shard, slot, source_at,
    block, copy, doc_id, version, begin, from_word, to_word``; words of one slot are
    in order of ``begin``, and ``copy`` counts how often the block came before.
    """
    spark: SparkSession = docs.sparkSession
    rows = materialize(sized(docs), "sizes")
    sources = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    plan = recipe([sources[s] for s in names])
    known = spark.createDataFrame(
        [(s, i, p["size"], float(p["target"])) for i, (s, p) in enumerate(zip(names, plan, strict=True))],
        "named string, source_at int, source_size bigint, target double")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    placed = materialize(running_total(placed, "source_at", ["doc_id", "size", "version"], "size", "begin"), "placed")
    last = (F.col("begin") + F.col("size") - 1) / BLOCK
    held = placed.where("size > 0").select(
        "source_at", "doc_id", "version", "begin", "size",
        F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor(last))).alias("block"))
    strata, draw = _slots(plan)
    slots = spark.range(strata if plan else 0, numPartitions=min(max(strata, 1), 10_000)).mapInPandas(
        draw, "shard string, slot bigint, source_at int, block bigint, words bigint, copy bigint")
    first = F.greatest(F.col("block") * BLOCK - F.col("begin"), F.lit(0))
    behind = F.least(F.col("block") * BLOCK + F.col("words") - F.col("begin"), F.col("size"))
    spans = (
        held.join(slots.hint("merge"), ["source_at", "block"])  # the planner sees only the strata's numbers and would broadcast the slots
        .withColumn("from_word", first).withColumn("to_word", behind).where("to_word > from_word")
        .select("shard", "slot", "source_at", "block", "copy", "doc_id", "version", "begin", "from_word", "to_word")
    )
    return placed, spans


def taken(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row."""
    placed, spans = mixture(docs)
    words = spans.groupBy("source_at", "begin").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    words = words.withColumn("some", F.lit(True))
    joined = placed.withColumn("some", F.col("size") > 0).join(words, ["source_at", "begin", "some"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut down to the words of their spans; whole ones stay as they are."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            words = text.as_py().encode().split()
            part = [w for s in sorted(spans, key=lambda s: s["from_word"]) for w in words[s["from_word"] : s["to_word"]]]
            texts.append(text.as_py() if len(part) == len(words) else b" ".join(part).decode())
        rest = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "spans")}
        yield pa.record_batch(rest | {"text": pa.array(texts, pa.string())})


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row, with all columns of ``docs``, for each copy of a document's taken words.

    A copy holds each of the document's words at most once, in their order.
    """
    _, spans = mixture(docs)
    parts = spans.groupBy("doc_id", "version", "begin", "copy").agg(F.collect_list(F.struct("from_word", "to_word")).alias("spans"))
    rest = others(docs, "doc_id", "text")
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row_version(docs).alias("version"), bundle(rest).alias("rest"))
    held = held.dropDuplicates(["doc_id", "version"])  # equal rows: each has its own parts
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "spans")
    joined = held.join(parts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("rest", held.schema["rest"].dataType), T.StructField("text", T.StringType())])
    texts = joined.select("doc_id", "rest", "text", "spans").mapInArrow(_rendered, kinds)
    own = unbundled(rest)
    return texts.select(*[own.get(c, F.col(c.lower()).alias(c)) for c in docs.columns])
