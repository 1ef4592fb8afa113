"""Phrases whose words meet more often than chance: counts as sorted streams, merged in lockstep.

Texts (A-Z in lower case) are cut at ``.,;:!?`` and line breaks into pieces, pieces
at spaces and tabs into words. Everything is counted per language (null: ``und``):
n all words, f(phrase) all its occurrences inside pieces, overlaps included.
Candidates have 2 to ``LONGEST`` words and a = f >= ``LEAST``. A candidate's
score is the least floor(1000 a n / (l r)) over its cuts into a first part (l = f)
and a rest (r = f). A candidate inside a longer one of equal count is dropped. The job:

1. *Counting*, a pass over the texts per phrase length. A phrase can be frequent
   only if its first and its last words (all but one) are, so a task counts only places where
   both pass a filter of the frequent phrases of the length before: a bit table
   of ``FILTER_BITS``. What it lets through by mistake is counted and then falls
   below ``LEAST``; the filter decides what is shuffled, never a count. A task
   sorts the keys of a slice and sends each once; Spark combines them.
2. *Streams*: all frequent phrases, with the empty phrase (count n) at the head of
   its language, in prefix order (by words) and in suffix order (by words from the
   last). Both are range partitioned; a partition is given the shorter phrases its
   first one begins with, at most ``LONGEST`` rows.
3. *Lockstep*: walking down the prefix stream, the counts of all first parts of a
   phrase are those passed on the way to it; the same walk down the suffix stream gives the
   counts of all rests. No table is looked up. A phrase as frequent as the one
   a word shorter on its way shows that one to be dropped; longer ones have their
   shortenings between, so steps of one word suffice.
4. Both walks meet in a merge join; ranks come from a range sort with offsets.

Words of a language are told apart as text, longer phrases by 64 bits for all
words but the last and 64 bits for the last. Long texts are cut into slices that
repeat as many words as a phrase reaches back.

Defined results: null text is empty, null ``lang`` is ``und``, repeated rows count
each time, ``doc_id`` and extra columns are not read, empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import running_total
from topicloom.llm.hashing import mix, span_hashes
from topicloom.storage import Workspace, spread

LONGEST = 5
LEAST = 100
TOP = 2000
FILTER_BITS = 1 << 26
SLICE = 2 << 20
HELD = 1 << 21

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def segments(data: bytes, overlap: int) -> Iterator[bytes]:
    """``data`` in parts of about ``SLICE`` bytes; each repeats the last ``overlap`` words of the one before."""
    start, size = 0, SLICE
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in b" \n":
            end += 1
        part = data[start:end]
        if end == len(data):
            yield part
            return
        pieces = part.rsplit(None, overlap) if overlap else [part]
        if overlap and len(pieces) <= overlap:  # a few huge words: look further
            size *= 2
            continue
        yield part
        start, size = start + len(pieces[0]) if overlap else end, SLICE


class Words:
    """The words of several parts of texts: hashes (with the language in them), pieces and places."""

    def __init__(self, parts: list[bytes], langs: list[str]) -> None:
        self.data = b"\n".join(parts)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = (raw != 32) & (raw != 10)
        turns = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        self.piece = np.cumsum(raw == 10)[self.starts] if len(raw) else np.zeros(0, np.int64)
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        self.names = sorted(set(langs))
        code = {name: k for k, name in enumerate(self.names)}
        self.lang = np.array([code[name] for name in langs], np.int64)[np.searchsorted(offsets, self.starts, "right") - 1]
        salts = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in self.names]
        self.ids = mix(span_hashes(raw, self.starts, self.ends) ^ np.array(salts, np.uint64)[self.lang])

    def longer(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Ids of phrases of ``size`` words from those of ``size - 1``."""
        return mix(ids[: max(len(self.ids) - size + 1, 0)] * _STEP + self.ids[size - 1 :])


def joined_id(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(head * _STEP + word)


def _parts(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[Words]:
    for batch in batches:
        parts, langs, size = [], [], 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part in segments((text.as_py() or "").encode().translate(_FOLD), overlap):
                parts.append(part)
                langs.append(lang)
                size += len(part)
                if size >= SLICE:
                    yield Words(parts, langs)
                    parts, langs, size = [], [], 0
        if parts:
            yield Words(parts, langs)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, key, n)`` per slice; a null word stands for all words."""
    for words in _parts(batches, 0):
        keys, first, counts = np.unique(words.ids, return_index=True, return_counts=True)
        spans = zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)
        texts = [words.data[a:b].decode() for a, b in spans]
        totals = np.bincount(words.lang, minlength=len(words.names))
        yield pa.record_batch({
            "lang": pa.array([words.names[k] for k in words.lang[first].tolist()] + words.names, pa.string()),
            "word": pa.array([*texts, *[None] * len(words.names)], pa.string()),
            "key": pa.array(np.concatenate([keys.view(np.int64), np.zeros(len(words.names), np.int64)])),
            "n": pa.array(np.concatenate([counts, totals]).astype(np.int64)),
        })


def _passes(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slots = (ids >> np.uint64(6)) & np.uint64(len(table) - 1)
    return ((table[slots] >> (ids & np.uint64(63))) & np.uint64(1)).astype(bool)


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows ``(id, head, word, count)`` with the counts of equal rows added up."""
    ids, head, word, count = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(ids, kind="stable")
    ids, head, word, count = ids[order], head[order], word[order], count[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (head[1:] != head[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return ids[first], head[first], word[first], np.add.reduceat(count, first) if len(first) else count


def _count_phrases(size: int, table: Broadcast):
    """``(head, word, n)`` of phrases of ``size`` words whose shorter ones pass the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, rows = table.value, [], 0
        for words in _parts(batches, size - 1):
            ids = words.ids
            for longer in range(2, size):
                ids = words.longer(ids, longer)
            good = _passes(bits, ids)
            whole = words.piece[: max(len(words.ids) - size + 1, 0)] == words.piece[size - 1 :]
            at = np.flatnonzero(whole & good[:-1] & good[1:]) if len(good) > 1 else np.zeros(0, np.int64)
            head, word = ids[at], words.ids[at + size - 1]
            held.append(_summed([(joined_id(head, word), head, word, np.ones(len(at), np.int64))]))
            rows += len(held[-1][0])
            if rows > HELD:
                held = [_summed(held)]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield _sent(held[0])
                    held, rows = [], 0
        if held:
            yield _sent(_summed(held))

    return count


def _sent(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    _, head, word, count = rows
    return pa.record_batch({"head": pa.array(head.view(np.int64)), "word": pa.array(word.view(np.int64)), "n": pa.array(count)})


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        head, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("head", "word"))
        yield batch.append_column("key", pa.array(joined_id(head, word).view(np.int64)))


def _filter(keys: DataFrame) -> Broadcast:
    """The bit table of ``key``: at most ``FILTER_BITS / 64`` numbers reach the driver."""
    slot = F.shiftright("key", 6).bitwiseAND(FILTER_BITS // 64 - 1)
    bit = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    rows = keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``(lang, words, a)``: phrases of up to ``longest`` words that occur ``least`` times; no words: all words of ``lang``."""
    work = Workspace(docs.sparkSession)
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    source = spread(source, "text")
    counts = source.mapInArrow(_count_words, "lang string, word string, key bigint, n bigint")
    counts = counts.groupBy("lang", "word", "key").agg(F.sum("n").alias("a")).where((F.col("a") >= least) | F.col("word").isNull())
    counts = work.save(counts, "words")
    vocabulary = counts.where("word is not null")
    streams = counts.select("lang", F.when(F.col("word").isNull(), F.lit([]).cast("array<string>")).otherwise(F.array("word")).alias("words"), "a").where("a > 0")
    shorter = vocabulary.select("key", "lang", F.array("word").alias("words"))
    last = vocabulary.select(F.col("key").alias("word"), F.col("word").alias("last"))
    for size in range(2, longest + 1):
        if shorter.isEmpty():
            break
        found = source.mapInArrow(_count_phrases(size, _filter(shorter)), "head bigint, word bigint, n bigint")
        found = found.groupBy("head", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        found = found.mapInArrow(_keyed, "head bigint, word bigint, a bigint, key bigint")
        named = found.join(shorter.withColumnRenamed("key", "head"), "head").join(last, "word")
        shorter = work.save(named.select("key", "lang", F.concat("words", F.array("last")).alias("words"), "a"), f"phrases{size}")
        streams = streams.union(shorter.select("lang", "words", "a"))
        shorter = shorter.drop("a")
    return streams


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Down a sorted stream: for phrases of two words or more, n, the counts of their first 1, 2, ... words, and whether the longest of these is as frequent."""
    part, passed = None, []
    for batch in batches:
        out: dict[str, list] = {"lang": [], "words": [], "a": [], "n": [], "parts": [], "same": []}
        for at, lang, words, a, seed in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "words", "a", "seed")), strict=True):
            if at != part:
                part, passed = at, []
            del passed[len(words) :]
            if not seed and len(words) > 1:
                for name, value in zip(out, (lang, words, a, passed[0], passed[1:], passed[-1] == a), strict=True):
                    out[name].append(value)
            passed.append(a)
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
        yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def in_order(streams: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Walks down ``streams (lang, words, a)`` in the order of ``words``."""
    ranged = streams.repartitionByRange("lang", "words").withColumn("part", F.spark_partition_id())
    ranged = work.save(ranged, name)
    first = ranged.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("first"))
    ways = F.transform(F.sequence(F.lit(0), F.size("first.words") - 1), lambda k: F.slice("first.words", 1, k))
    ways = F.when(F.size("first.words") > 0, ways)  # nothing lies before the empty phrase
    wanted = first.select(F.col("part").alias("to"), F.col("first.lang").alias("lang"), F.explode(ways).alias("words"))
    # at most LONGEST rows per partition of the stream
    seeds = ranged.join(F.broadcast(wanted), ["lang", "words"]).where("part <> to").select("lang", "words", "a", F.col("to").alias("part"), F.lit(True).alias("seed"))
    whole = ranged.select("lang", "words", "a", "part", F.lit(False).alias("seed")).union(seeds)
    placed = whole.repartition("part").sortWithinPartitions("part", "lang", "words")
    return placed.mapInArrow(_walk, "lang string, words array<string>, a bigint, n bigint, parts array<bigint>, same boolean")


def _best(a: Column, n: Column, size: Column) -> Column:
    """The lowest-scoring cut as ``(score, k, l, r)``."""
    wide = lambda c: c.cast("decimal(38,0)")

    def cut(k: Column) -> Column:
        l, r = F.get("firsts", k - 1), F.get("rests", size - k - 1)
        return F.struct(F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(5,0)"), wide(l) * wide(r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases, best first."""
    work = Workspace(docs.sparkSession)
    streams = work.save(frequent_phrases(docs, least, longest), "streams")
    firsts = work.save(in_order(streams, work, "prefix").withColumnRenamed("parts", "firsts"), "firsts")
    turned = streams.select("lang", F.reverse("words").alias("words"), "a")
    rests = in_order(turned, work, "suffix").withColumn("words", F.reverse("words")).withColumnRenamed("parts", "rests")
    rests = work.save(rests, "rests")
    size = F.size("words")
    inside = firsts.where("same").select("lang", F.slice("words", F.lit(1), size - 1).alias("words")).union(
        rests.where("same").select("lang", F.slice("words", F.lit(2), size - 1).alias("words")))
    left = firsts.join(rests.select("lang", "words", "rests"), ["lang", "words"]).join(inside.distinct(), ["lang", "words"], "left_anti")
    best = _best(F.col("a"), F.col("n"), size)
    scored = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", best.alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", (-F.col("best.score")).alias("_score"), (-F.col("a")).alias("_a"), F.lit(1).alias("_one"))
    ranked = running_total(scored, "lang", ["_score", "_a", "phrase"], "_one", "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
