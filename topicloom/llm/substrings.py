"""Removal of passages that an earlier document already holds, by seed and extend.

A window is ``WINDOW`` consecutive words. A word is removed if a window covering
it also starts in a document with a smaller ``doc_id``; windows are judged on
the input. The job:

1. *Outlines*, one pass over the texts: word count, a 128-bit digest of the word
   sequence, and the winnowed anchors: of every ``WINDOW - ANCHOR + 1`` runs of
   ``ANCHOR`` words the one with the least hash. Two documents with a window in
   common have chosen the same anchor in it.
2. *Copies*: of documents with one word sequence only the first goes on. The
   others lose every word if they have a window at all, so a group of copies
   costs one member.
3. *Seeds*: anchors joined across documents; those of one word sequence only drop
   out. Two values per anchor are combined before the shuffle.
4. *Extension*: each document extends its seeds left and right to all windows
   that hold them, and windows meet by a 96-bit key with the least document that
   has the same extension. A seed in very many documents is compared with that
   one document, never in pairs.
5. Overlapping repeats are merged to maximal spans and cut out.

Rows are told apart by ``doc_id`` and a hash of the text. Null text has no words.
A row with a null ``doc_id`` is kept whole and serves nobody as original; rows
with the same ``doc_id`` do not remove each other's words. Extra columns are
carried through by :func:`without_repeats`, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.columns import bundle, others, unbundled
from topicloom.llm.hashing import covered, gram_hashes, window_minima, word_hashes
from topicloom.storage import Workspace, spread

WINDOW = 13
ANCHOR = 5


def anchors(words: np.ndarray) -> np.ndarray:
    """Start places of the winnowed anchors; every tied minimum is one."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64)
    grams = gram_hashes(words, ANCHOR)
    size = WINDOW - ANCHOR + 1
    low = window_minima(grams, size)
    edge = np.zeros(size - 1, np.uint64)
    reach = ~window_minima(~np.concatenate([edge, low, edge]), size)  # greatest minimum of the windows over a place
    return np.flatnonzero(reach == grams)


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, chosen = [], [], []
        for text in batch.column("text"):
            data = (text.as_py() or "").encode()
            words = word_hashes(data)
            counts.append(len(words))
            digests.append(hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest())
            chosen.append(np.unique(gram_hashes(words, ANCHOR)[anchors(words)]).view(np.int64))
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "version": batch.column("version"),
            "n_words": pa.array(counts, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "form": pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
            "anchors": pa.array(chosen, pa.list_(pa.int64())),
        })


def extensions(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Start places of the windows that hold an anchor among ``seeds``."""
    places = anchors(words)
    hits = places[np.isin(gram_hashes(words, ANCHOR)[places], seeds)]
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.maximum(hits - (WINDOW - ANCHOR), 0), 1)
    np.add.at(marks, hits + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[: max(len(words) - WINDOW + 1, 0)] > 0)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that hold a seed of their document: a key of 96 bits and the place."""
    for batch in batches:
        for row, doc_id, text, seeds in zip(*(batch.column(c) for c in ("row", "doc_id", "text", "seeds")), strict=True):
            data = (text.as_py() or "").encode()
            words = word_hashes(data)
            starts = extensions(words, seeds.values.to_numpy().view(np.uint64))
            one, two = (gram_hashes(w, WINDOW, lane)[starts] for lane, w in enumerate((words, word_hashes(data, 1))))
            yield pa.record_batch({
                "key1": pa.array(one.view(np.int64)), "key2": pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                "row": pa.array(np.full(len(starts), row.as_py())), "doc_id": pa.array(np.full(len(starts), doc_id.as_py())),
                "place": pa.array(starts.astype(np.int32)),
            })


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, kept = [], [], []
        layout = batch.column("layout")[0].as_py() if len(batch) else False
        for text, whole, places in zip(*(batch.column(c) for c in ("text", "whole", "places")), strict=True):
            words = (text.as_py() or "").encode().split()
            drop = np.zeros(len(words), bool)
            if whole.as_py():
                drop[:] = True
            elif places.is_valid:
                drop = covered(places.values.to_numpy().astype(np.int64), WINDOW, len(words))
            counts.append(len(words))
            gone.append(int(drop.sum()))
            if layout and not drop.any():
                kept.append(text.as_py())
            else:
                kept.append(b" ".join(w for w, d in zip(words, drop.tolist(), strict=True) if not d).decode())
        rest = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "whole", "places", "layout")}
        yield pa.record_batch(rest | {
            "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string()),
        })


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Later copies ``(doc_id, version)`` and removed windows ``(doc_id, version, place)``.

    ``docs`` has ``doc_id``, ``text`` and ``version``, a hash of the text.
    """
    work = Workspace(docs.sparkSession)
    source = docs.where("doc_id is not null")
    outline = spread(source, "version").mapInArrow(
        _outlines, "doc_id bigint, version bigint, n_words bigint, digest binary, form bigint, anchors array<bigint>")
    outline = work.save(outline.withColumn("row", F.monotonically_increasing_id()), "outlines")
    long = outline.where(F.col("n_words") >= WINDOW)
    first = long.groupBy("digest").agg(F.min("doc_id").alias("first"))
    later = long.select("row", "doc_id", "version", "digest").join(first, "digest").where("doc_id > first")
    later = work.save(later.select("row", "doc_id", "version"), "copies")
    forms = outline.select(F.explode("anchors").alias("anchor"), "form")
    common = forms.groupBy("anchor").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low < high").select("anchor")
    seeds = outline.select(F.explode("anchors").alias("anchor"), "row").join(common, "anchor")
    own = seeds.groupBy("row").agg(F.collect_list("anchor").alias("seeds")).join(later.select("row"), "row", "left_anti")
    named = own.join(outline.select("row", "doc_id", "version"), "row").groupBy("doc_id", "version")
    own = work.save(named.agg(F.min("row").alias("row"), F.first("seeds").alias("seeds")), "seeds")
    release(work, outline)
    windows = source.join(own, ["doc_id", "version"]).mapInArrow(_windows, "key1 bigint, key2 int, row bigint, doc_id bigint, place int")
    windows = work.save(windows, "windows")
    release(work)
    low = windows.groupBy("key1", "key2").agg(F.min("doc_id").alias("low"))
    found = windows.join(low, ["key1", "key2"]).where("doc_id > low").groupBy("row").agg(F.collect_list("place").alias("places"))
    found = work.save(found.join(own.select("row", "doc_id", "version"), "row").select("doc_id", "version", "places"), "places")
    release(work, windows, own)
    return later.select("doc_id", "version").distinct(), found


def release(work: Workspace, *tables: DataFrame) -> None:
    """Delete tables no longer read, and let Spark's cleaner find the shuffle files of finished jobs."""
    for table in tables:
        work.drop(table)
    work.spark.sparkContext._jvm.System.gc()


def _cut_rows(docs: DataFrame, keep_layout: bool, rest: list[str]) -> DataFrame:
    """``(doc_id, rest, n_words, n_removed, kept_text)``, the columns ``rest`` in a bundle."""
    held = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("version"), bundle(rest).alias("rest"))
    later, found = repeated_windows(held.select("doc_id", "text", "version"))
    plan = found.withColumn("whole", F.lit(False)).unionByName(
        later.select("doc_id", "version", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("whole"))
    )
    joined = held.join(plan, ["doc_id", "version"], "left").select("doc_id", "rest", "text", "whole", "places", F.lit(keep_layout).alias("layout"))
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("rest", held.schema["rest"].dataType)])
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())):
        kinds = kinds.add(name, kind)
    return joined.mapInArrow(_cut, kinds)


def without_repeats(docs: DataFrame, keep_layout: bool = False) -> DataFrame:
    """``docs`` without its ``text``, plus ``n_words``, ``n_removed`` and ``kept_text``.

    ``kept_text`` has the kept words joined by one space; with ``keep_layout``
    texts that lose no word stay as they are, white space included. Columns of
    ``docs`` with one of the three names give way to the results.
    """
    rest = others(docs, "doc_id", "text", "n_words", "n_removed", "kept_text")
    cut = _cut_rows(docs, keep_layout, rest)
    return cut.select("doc_id", *unbundled(rest).values(), "n_words", "n_removed", "kept_text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns, with the kept text in place of ``text``; rows that lost all their words go.

    ``n_chars``, where there is one, follows the text; other columns stay as they are.
    """
    rest = others(docs, "doc_id", "text")
    cut = _cut_rows(docs, True, rest).where("n_removed < n_words or n_removed = 0")
    own = unbundled(rest)
    own |= {c: F.length("kept_text").cast(docs.schema[c].dataType).alias(c) for c in rest if c.lower() == "n_chars"}
    own |= {c: (F.col("doc_id") if c.lower() == "doc_id" else F.col("kept_text")).alias(c) for c in docs.columns if c not in own}
    return cut.select(*[own[c] for c in docs.columns])
