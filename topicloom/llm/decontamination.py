"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Words are runs of digits, letters and all characters beyond ASCII, with A-Z in
lower case. A window is ``WINDOW`` consecutive words of a benchmark item; an item
of fewer words, but not none, is one window. A text is written as its words with
one space around each, so that a window is a byte string and occurs exactly where
that string does. The job:

1. Items are cut into overlapping pieces of bounded length, which reach the
   tasks in blocks of ``BLOCK_BYTES`` of normalised text. The benchmark is the
   stated query set: every block is one pass over all documents.
2. A block's windows fall into classes by length. Of every class the first ``m``
   bytes count, ``m`` being its least length, at most ``REACH``. The shift table holds,
   for the hash of a run of up to eight bytes, how far the window may move
   without missing a string; what no string holds moves it past that run.
3. Where the shift is zero, the bucket of that hash gives the strings that may
   start here; their first bytes are compared, then all of them.

Texts are searched in slices of about ``TEXT_BYTES``, by many cursors at once
that stand ``LANE`` bytes apart. Equal windows of several items are one string
with a list of items, so a sentence that most items share costs one comparison.

Defined results: null or wordless texts have no words and no hits; wordless items
have no windows; a null ``item_id`` marks words as hit but is no item; repeated
items and documents count as they stand; extra columns are ignored. An empty
benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.hashing import gram_hashes, word_hashes
from topicloom.storage import spread

WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 4096
TEXT_BYTES = 4 << 20
LANE = 2048
REACH = 64
PAIRS = 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACE, _END = 32, b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def written(words: list[bytes]) -> bytes:
    """The byte string searched: a space before, between and after the words, and an end mark no window holds."""
    return b" " + b" ".join(words) + b" " + _END if words else b""


class Strings:
    """The strings of one length class, with their shift table and suffix buckets.

    ``text`` holds them; string ``k`` lies at ``starts[k]:ends[k]``.
    """

    def __init__(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        self.reach = int(min((ends - starts).min(), REACH))
        self.block = min(8, self.reach // 2 + 1)
        self.keep = np.uint64(8 * (8 - self.block))
        runs = self.reach - self.block + 1
        bits = max(10, int(len(starts) * runs).bit_length() + 2)
        self.drop = np.uint64(64 - min(bits, 27))
        eights = self._eights(text)
        self.shift = np.full(1 << min(bits, 27), runs, np.uint8)
        for end in range(self.block, self.reach + 1):  # later runs, with smaller shifts, overwrite earlier ones
            self.shift[self._slots(eights, starts + end)] = self.reach - end
        slots = self._slots(eights, starts + self.reach)
        order = np.argsort(slots, kind="stable")
        self.slots, self.strings = slots[order], order
        self.starts, self.ends, self.text = starts, ends, text
        self.mask = np.uint64((1 << (8 * min(8, self.reach))) - 1)
        self.heads = eights[starts + 8] & self.mask

    @staticmethod
    def _eights(text: bytes) -> np.ndarray:
        """The eight bytes that end before place ``i`` of ``text``, as one number, at ``i``; from ``i`` on, at ``i + 8``."""
        held = b"\0" * 8 + text + b"\0" * (REACH + 8)
        return np.ndarray((len(held) - 7,), "<u8", held, 0, (1,))

    def _slots(self, eights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (((eights[ends] >> self.keep) * _FACTOR) >> self.drop).astype(np.int64)

    def found(self, text: bytes) -> list[tuple[int, int]]:
        """(place, string) of every occurrence in ``text``."""
        eights, at = self._eights(text), np.arange(0, len(text), LANE)
        stop, places, slots = np.minimum(at + LANE, len(text)), [], []
        while len(at):
            slot = self._slots(eights, at + self.reach)
            shift = self.shift[slot]
            here = shift == 0
            if here.any():
                places.append(at[here])
                slots.append(slot[here])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return self._confirmed(text, eights, np.concatenate(places), np.concatenate(slots)) if places else []

    def _confirmed(self, text: bytes, eights: np.ndarray, places: np.ndarray, slots: np.ndarray) -> list[tuple[int, int]]:
        low, high = (np.searchsorted(self.slots, slots, side) for side in ("left", "right"))
        total, first, hits = np.cumsum(high - low), 0, []
        while first < len(places):  # bounded numbers of (place, string) at once
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + PAIRS, "right")))
            sizes = (high - low)[first:last]
            place = np.repeat(places[first:last], sizes)
            inner = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            string = self.strings[np.repeat(low[first:last], sizes) + inner]
            same = (eights[place + 8] & self.mask) == self.heads[string]
            for p, s in zip(place[same].tolist(), string[same].tolist(), strict=True):
                start, end = int(self.starts[s]), int(self.ends[s])
                if text[p : p + end - start] == self.text[start:end]:
                    hits.append((p, s))
            first = last
        return hits


class Windows:
    """All distinct windows of a block of items ``(item_id, words)``."""

    def __init__(self, items: list[tuple[str | None, bytes]]) -> None:
        items = [item for item in items if item[1]]
        self.names = [name for name, _ in items]
        self.classes: list[tuple[Strings, np.ndarray]] = []  # with the numbers of their strings
        pieces = [text.split() for _, text in items]
        text = b"".join(map(written, pieces))
        sizes = np.array([len(p) for p in pieces], np.int64)
        if not len(sizes):
            return
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == _SPACE)
        base = np.cumsum(sizes + 1) - sizes - 1  # a piece's first space
        lanes = [word_hashes(text, lane) for lane in (0, 1)]  # one word per space, but for a piece's last space
        first = np.cumsum(sizes) - sizes
        found = []
        for size in sorted(set(np.minimum(sizes, WINDOW).tolist())):
            own = np.flatnonzero(np.minimum(sizes, WINDOW) == size)
            many = sizes[own] - size + 1
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            word, space = np.repeat(first[own], many) + inner, np.repeat(base[own], many) + inner
            one, two = (gram_hashes(words, size, lane)[word] for lane, words in enumerate(lanes))
            found += [(one, two, spaces[space], spaces[space + size] + 1, np.full(len(word), size), np.repeat(own, many))]
        one, two, starts, ends, count, item = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((two, one))
        one, two, starts, ends, count, item = (c[order] for c in (one, two, starts, ends, count, item))
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        for k in np.flatnonzero(~new).tolist():  # equal keys are not taken for equal strings
            new[k] = text[starts[k] : ends[k]] != text[starts[k - 1] : ends[k - 1]]
        self._items, self._first = item, np.append(np.flatnonzero(new), len(new))
        starts, ends, self._count = starts[new], ends[new], count[new]
        kinds = np.minimum(np.frexp((ends - starts).astype(float))[1], REACH.bit_length())
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            self.classes.append((Strings(text, starts[own], ends[own]), own))

    def occurrences(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(place of the first word's space, words, number) of every window in ``text``."""
        for strings, own in self.classes:
            for place, string in strings.found(text):
                yield place, int(self._count[own[string]]), int(own[string])

    def owners(self, number: int) -> list[str | None]:
        """Ids of the items with that window."""
        return [self.names[k] for k in self._items[self._first[number] : self._first[number + 1]].tolist()]


_built: dict[str, Windows] = {}


def _windows(name: str, block: Broadcast) -> Windows:
    """The block's tables, built once per worker; only the latest are kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Windows(block.value)
    return _built[name]


def searched(texts: list[str | None], windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: its number of words, the spans of words hit, and the items found."""
    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(text or "")
        if size >= TEXT_BYTES:
            yield from _slice(held, windows)
            held, size = [], 0
    yield from _slice(held, windows)


def _slice(held: list[list[bytes]], windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    text = b"".join(map(written, held))
    counts = [len(words) for words in held]
    spans, numbers = [[] for _ in held], [set() for _ in held]
    hits = list(windows.occurrences(text))
    if hits:
        places = np.array([h[0] for h in hits])
        sizes = np.array([len(w) + 1 if w else 0 for w in held], np.int64)
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == _SPACE)
        words, base = np.searchsorted(spaces, places), np.cumsum(sizes) - sizes
        marks = np.zeros(len(spaces) + 1, np.int64)
        np.add.at(marks, words, 1)
        np.add.at(marks, words + np.array([h[1] for h in hits]), -1)
        turns = np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0)
        filled = np.flatnonzero(sizes)
        whose = lambda at: filled[np.searchsorted(base[filled], at, "right") - 1]
        for start, end in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True):
            k = whose(start)
            spans[k].append((int(start - base[k]), int(end - base[k])))
        for k, (_, _, number) in zip(whose(words).tolist(), hits, strict=True):
            numbers[k].add(number)
    for count, span, own in zip(counts, spans, numbers, strict=True):
        yield count, span, sorted({name for number in own for name in windows.owners(number)} - {None})


_FOUND = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _search(block: Broadcast):
    name = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(name, block)
        for batch in batches:
            rows = list(searched(batch.column("text").to_pylist(), windows))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "version": batch.column("version"), "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "spans": pa.array([[{"start": a, "stop": b} for a, b in r[1]] for r in rows], _SPANS),
                "items": pa.array([r[2] for r in rows], pa.list_(pa.string())),
            })

    return search


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, pieces = [], []
        for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            for start in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), PIECE_WORDS):
                names.append(name)
                pieces.append(b" ".join(words[start : start + PIECE_WORDS + WINDOW - 1]))
        yield pa.record_batch({"item_id": pa.array(names, pa.string()), "words": pa.array(pieces, pa.binary())})


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """Pieces of items ``(item_id, words)`` in blocks of at most ``BLOCK_BYTES`` and one piece."""
    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    held, size = [], 0
    for row in source.mapInArrow(_pieces, "item_id string, words binary").distinct().toLocalIterator():
        held.append((row.item_id, bytes(row.words)))
        size += len(row.words)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks as disjoint spans."""
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            out: list[dict] = []
            for span in sorted(spans or [], key=lambda s: s["start"]):
                if out and span["start"] <= out[-1]["stop"]:
                    out[-1]["stop"] = max(out[-1]["stop"], span["stop"])
                else:
                    out.append(dict(span))
            merged.append(out)
        rest = {c: batch.column(c) for c in batch.schema.names if c != "spans"}
        yield pa.record_batch(rest | {"spans": pa.array(merged, _SPANS)}).select(["doc_id", "n_words", "spans", "items"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, n_words, spans, items)``, one row per document.

    ``spans`` are the disjoint runs of hit words, ``items`` the ids (as strings,
    sorted) of items with an occurring window.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    source = spread(source, "doc_id")
    kind = f"doc_id bigint, version bigint, {_FOUND}"
    passes = [source.mapInArrow(_search(context.broadcast(block)), kind) for block in blocks(benchmark)]
    if len(passes) < 2:
        return (passes or [source.mapInArrow(_search(context.broadcast([])), kind)])[0].drop("version")
    # rows with the same id and text have the same findings, so sets hold one entry per block at most
    found = reduce(DataFrame.union, passes).where("size(spans) > 0").groupBy("doc_id", "version").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "spans", "items")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version"))
    whole = passes[0].select("doc_id", "version", "n_words").join(found, same, "left")
    none = F.lit([]).cast("array<string>")
    whole = whole.select("doc_id", "n_words", "spans", F.coalesce("items", none).alias("items"))
    return whole.mapInArrow(_merge, f"doc_id bigint, {_FOUND}")
