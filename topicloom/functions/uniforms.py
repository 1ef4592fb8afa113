"""``keyed_uniform`` for whole arrays in tasks: MD5 of short keys, all of a block in step."""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
from pyspark import cloudpickle

# Workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 8192  # keys hashed in step; the state stays in the cache
TABLED = 1 << 17  # positions whose part of a key is taken from a table
KEY_BYTES = 55  # a longer key takes more than one MD5 block
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _endings(tables: dict, start: int, sweep: int, number: int) -> np.ndarray:
    """Words of the key's part from byte ``start`` on, per position, with MD5's padding; kept in ``tables``."""
    if (start, sweep, number) in tables:
        return tables[start, sweep, number]
    rows = []
    for pos in range(number):
        end = b"%d:%d" % (pos, sweep)
        size = start + len(end)
        rows.append((b"\0" * start + end + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"))
    tables[start, sweep, number] = table = np.ascontiguousarray(np.frombuffer(b"".join(rows), dtype="<u4").reshape(-1, 16).T)
    return table


def _first_word(words: list[np.ndarray | None], size: int) -> np.ndarray:
    """First word of the MD5 state of one block per key; None are words of zeros."""
    a, b, c, d = (np.full(size, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(size, dtype=np.uint32), np.empty(size, dtype=np.uint32)
    for i in range(61):  # the last three steps do not reach the first word
        if i < 16:  # f = d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            at = 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        if words[at] is not None:
            f += words[at]
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        f >>= np.uint32(32 - turn)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    b += np.uint32(0x67452301)
    return b


def _one_by_one(beginnings: list[bytes], doc: np.ndarray, pos: np.ndarray, sweep: int) -> np.ndarray:
    keys = (b"%s%d:%d" % (beginnings[d], p, sweep) for d, p in zip(doc.tolist(), pos.tolist(), strict=True))
    return np.fromiter((int.from_bytes(hashlib.md5(key).digest()[:4], "big") for key in keys), dtype=np.float64, count=len(doc))


def keyed_uniforms(seed: int, doc_ids: list[int | None], doc: np.ndarray, pos: np.ndarray, sweep: int, tables: dict | None = None) -> np.ndarray:
    """Uniforms of tokens at ``pos`` of document number ``doc`` in ``doc_ids``: the doubles of ``keyed_uniform(seed, doc_id, pos, sweep)``.

    ``doc`` ascends. As there, a null id is left out of the key. ``tables`` carries work over to further calls.
    """
    tables = {} if tables is None else tables
    beginnings = [b"%d:" % seed if d is None else b"%d:%d:" % (seed, d) for d in doc_ids]
    out = np.empty(len(doc), dtype=np.float64)
    starts = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
    ends = len(b"%d:%d" % (TABLED, sweep))
    groups: dict[int, list[int]] = {}
    for number, beginning in enumerate(beginnings):
        if starts[number] < starts[number + 1]:
            groups.setdefault(len(beginning), []).append(number)
    for start, members in groups.items():
        if len(groups) == 1:
            at = np.arange(len(doc))
        else:
            at = np.concatenate([np.arange(starts[m], starts[m + 1]) for m in members])
        if start + ends > KEY_BYTES:
            out[at] = _one_by_one(beginnings, doc[at], pos[at], sweep)
            continue
        far = pos[at] >= TABLED
        if far.any():
            out[at[far]] = _one_by_one(beginnings, doc[at[far]], pos[at[far]], sweep)
            at = at[~far]
            if not len(at):
                continue
        table = _endings(tables, start, sweep, min(TABLED, 1 << int(pos[at].max()).bit_length()))
        rows = b"".join(beginnings[m].ljust(64, b"\0") for m in members)
        heads = np.ascontiguousarray(np.frombuffer(rows, dtype="<u4").reshape(-1, 16).T)
        rank = np.zeros(len(doc_ids), dtype=np.int64)
        rank[members] = np.arange(len(members))
        used = [(heads[j] if heads[j].any() else None, table[j] if table[j].any() else None) for j in range(16)]
        for first in range(0, len(at), BLOCK):
            part = at[first : first + BLOCK]
            d, p = rank[doc[part]], pos[part]
            words: list[np.ndarray | None] = []
            for head, end in used:
                word = None if head is None else head.take(d)
                if end is not None:
                    word = end.take(p) if word is None else word | end.take(p)
                words.append(word)
            out[part] = _first_word(words, len(part)).byteswap()
    out /= 4294967296.0
    return out
