"""Packing of documents into token sequences of bounded length, by swap-based local search.

A document is its ids and one end id. Longer ones are cut into pieces of
``LENGTH`` tokens, the first of which may be shorter. A full piece is a sequence
of its own. Short pieces are dealt by hash to groups of about ``GROUP``, each
packed in one task: a best-fit start on falling lengths, then a local search
that takes one of the ``EMPTIEST`` bins and moves its pieces, or exchanges one
for one, two for one or one for two, into any underfull bin. Every step raises
the sum of squared fills, so bins run empty; it ends when no step is left or the
group's bins are as few as its tokens allow.

The tokens are counted once: pieces are saved with a row id that also names
sequences, so a repeated task gives the same ids. Defined results: null or empty
text is the end id alone; every row is packed, repeated ones too; a null
``doc_id`` is carried through; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.tokens import byte_tokens
from topicloom.storage import materialize, spread

LENGTH = 1024
END = 2
GROUP = 8192
EMPTIEST = 16
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n % length or length
    return [(0, min(first, n))] + [(s, length) for s in range(first, n, length)]


def _pieces(folder: str | None, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(folder)
        end = np.array([END], "<u4")
        for batch in batches:
            rows, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = np.concatenate([tokens.ids(text.as_py() or ""), end]).tobytes()
                for number, (start, length) in enumerate(cuts(len(data) // 4)):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, number, start, length, zlib.crc32(part)))
                    if keep_ids:
                        ids.append(part)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.record_batch(arrays, names=names)

    return cut


class Bins:
    """Bins of one group, found by their gap and by the lengths they hold."""

    def __init__(self, capacity: int = LENGTH) -> None:
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.gaps: list[int] = []
        self.by_gap: dict[int, set[int]] = defaultdict(set)
        self.mask = 0  # bit g is set while a bin has gap g

    def _enter(self, b: int) -> None:
        self.by_gap[self.gaps[b]].add(b)
        self.mask |= 1 << self.gaps[b]

    def _leave(self, b: int) -> None:
        same = self.by_gap[self.gaps[b]]
        same.discard(b)
        if not same:
            self.mask &= ~(1 << self.gaps[b])

    def change(self, b: int, out: tuple[int, ...], into: tuple[int, ...], sizes: list[int]) -> None:
        self._leave(b)
        for i in out:
            self.bins[b].remove(i)
        self.bins[b].extend(into)
        self.gaps[b] += sum(sizes[i] for i in out) - sum(sizes[i] for i in into)
        if self.bins[b]:
            self._enter(b)

    def tightest(self, size: int, but: int = -1) -> int | None:
        """A bin with the least gap that takes ``size``."""
        left = self.mask >> size
        while left:
            gap = size + (left & -left).bit_length() - 1
            for b in self.by_gap[gap]:
                if b != but:
                    return b
            left &= left - 1
        return None

    def best_fit(self, sizes: list[int]) -> None:
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = self.tightest(sizes[i])
            if b is None:
                self.bins.append([])
                self.gaps.append(self.capacity)
                b = len(self.bins) - 1
                self.bins[b].append(i)
                self.gaps[b] -= sizes[i]
                self._enter(b)
            else:
                self.change(b, (), (i,), sizes)

    def improve(self, sizes: list[int]) -> None:
        """Take steps that raise the sum of squared fills until bins are fewest or the ``EMPTIEST`` have none left."""
        fewest = -(-sum(sizes) // self.capacity)
        used = sum(1 for b in self.bins if b)
        stuck: set[int] = set()
        while used > fewest:
            emptiest = islice((b for g in self._open_gaps(self.capacity) for b in sorted(self.by_gap[g])), EMPTIEST)
            low = next((b for b in emptiest if b not in stuck), None)
            if low is None:
                break
            step = self._step(low, sizes)
            if step is None:
                stuck.add(low)
                continue
            b, out, into = step
            self.change(low, out, into, sizes)
            self.change(b, into, out, sizes)
            used -= not self.bins[low]
            stuck.clear()

    def _open_gaps(self, most: int) -> list[int]:
        """Gaps of bins that are not full, greatest first."""
        return [g for g in range(min(most, self.capacity - 1), 0, -1) if self.mask >> g & 1]

    def _step(self, low: int, sizes: list[int]) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """(other bin, pieces that go there, pieces that come back): a move, or the exchange that fills the other bin most."""
        mine, gap_low = self.bins[low], self.gaps[low]
        for i in sorted(mine, key=lambda i: -sizes[i]):
            b = self.tightest(sizes[i], low)
            if b is not None and self.gaps[b] - sizes[i] < gap_low:
                return b, (i,), ()
        singles = [((i,), sizes[i]) for i in mine]
        doubles = [((i, j), sizes[i] + sizes[j]) for k, i in enumerate(mine) for j in mine[k + 1 :]]
        best, gain = None, 0
        for gap in self._open_gaps(gap_low):
            if gap <= gain:
                break
            for b in sorted(self.by_gap[gap]):
                if b == low:
                    continue
                items = self.bins[b]
                theirs = [((i,), sizes[i]) for i in items]
                pairs = [((i, j), sizes[i] + sizes[j]) for k, i in enumerate(items) for j in items[k + 1 :]]
                for ours, back in ((singles, theirs), (doubles, theirs), (singles, pairs)):
                    for out, give in ours:
                        for into, take in back:
                            if gain < give - take <= gap:
                                best, gain = (b, out, into), give - take
        return best


def pack(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers, none over ``capacity``."""
    held = Bins(capacity)
    held.best_fit(sizes)
    held.improve(sizes)
    return [b for b in held.bins if b]


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row").reset_index(drop=True)
    sizes = rows["length"].tolist()
    names, places = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    ids = rows["row"].to_numpy()
    for held in pack(sizes):
        at = 0
        for i in held:
            names[i], places[i] = ids[held[0]], at
            at += sizes[i]
    return pd.DataFrame({"row": ids, "sequence_id": names, "offset": places})


def packed(docs: DataFrame, folder: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; with their ``ids`` (little-endian unsigned 32-bit) on request."""
    source = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    cut = source.mapInArrow(_pieces(folder, keep_ids), PIECE + ", ids binary" * keep_ids)
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < LENGTH)
    groups = max(1, -(-short.count() // GROUP))
    dealt = short.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    placed = dealt.groupBy("group").applyInPandas(_pack_group, "row bigint, sequence_id bigint, offset bigint")
    both = pieces.join(placed, "row", "left")
    return both.select(
        *pieces.drop("row").columns, F.coalesce("sequence_id", "row").alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"))
