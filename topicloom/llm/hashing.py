"""Words and hashes of whole texts, in NumPy, for use inside tasks.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Word
hashes are polynomial in the word's bytes, taken for all words at once from
prefix sums; n-gram hashes are polynomial in the word hashes. Both are finished
by an avalanche step. ``lane`` gives independent hashes, so two lanes make a
128-bit key.
"""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
_CHUNK = 1 << 22
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_GRAM = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (a xor-shift-multiply finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[1 - lane]))


_BYTES = (_byte_values(0), _byte_values(1))


def _power_table(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's base and of its inverse modulo 2^64."""
    if lane not in _powers or len(_powers[lane][0]) < size:
        size = max(size, 1 << 16)
        tables = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        _powers[lane] = (tables[0], tables[1])
    return _powers[lane]


def lower_ascii(data: bytes) -> bytes:
    """``data`` with A-Z lowered and every other byte as it is."""
    return data.translate(_LOWER)


def _chunks(data: bytes):
    """Cuts of bounded length that never part a word (a longer word makes a longer cut)."""
    start = 0
    while start < len(data):
        end = min(start + _CHUNK, len(data))
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def word_hashes(data: bytes, lane: int = 0) -> np.ndarray:
    """One hash per word of ``data``, in order."""
    found = []
    for part in _chunks(data):
        raw = np.frombuffer(part, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_IS_SPACE[raw]
        turns = np.diff(inside)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        power, inverse = _power_table(lane, len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[lane][raw] * power[: len(raw)], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """One hash per span of the bytes ``raw``: that of a word of the same bytes."""
    power, inverse = _power_table(lane, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[lane][raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def gram_hashes(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """One hash per run of ``size`` consecutive words; none if there are fewer words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count].copy()
    for step in range(1, size):
        total *= _GRAM[lane]
        total += words[step : step + count]
    return mix(total)


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values (of all of them if there are fewer)."""
    size = min(size, len(values))
    span, low = 1, values
    while span < size:
        step = min(span, size - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return low


def covered(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``length`` places lie in a run of ``size`` from one of ``starts``."""
    marks = np.zeros(length + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, length), -1)
    return np.cumsum(marks[:-1]) > 0
