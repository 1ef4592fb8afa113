"""Segmenters that need Python: Arrow UDFs, Arrow batches in and out.

They plug in where a column function does (``functions.text.Segmenter``). Use
the built-in ones where they suffice; these are for grammars and dictionaries the
engine has no expression for.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from topicloom.functions.text import Segmenter

# Workers need no copy of this package: the segmenter travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of letters, with single hyphens and apostrophes inside.
WORDS = r"\p{L}+(?:[-']\p{L}+)*"
DICTIONARY_WORDS = 1_000_000
TEXTS = 128  # whose terms are Python objects at a time; the rest of a batch is Arrow
TERMS = pa.list_(pa.string())


def python_segmenter(split: Callable[[str], list[str]]) -> Segmenter:
    """A segmenter from a function of one text; null text stays null."""

    def terms(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else split(text) for text in texts.to_pylist()], TERMS)

    @F.arrow_udf("array<string>")
    def segment(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([terms(texts.slice(at, TEXTS)) for at in range(0, max(len(texts), 1), TEXTS)])

    return segment


def pattern_segmenter(pattern: str = WORDS) -> Segmenter:
    """All matches of a pattern (``regex`` syntax) in order."""

    def split(text: str) -> list[str]:
        import regex  # compiled patterns are kept by the module

        return [match.group() for match in regex.finditer(pattern, text)]

    return python_segmenter(split)


def longest_matches(text: str, words: frozenset[str], longest: int) -> list[str]:
    """Cut runs of letters and digits left to right at the longest listed word, else after one character."""
    found = []
    for run in "".join(c if c.isalnum() else " " for c in text).split():
        start = 0
        while start < len(run):
            stop = next((start + n for n in range(min(longest, len(run) - start), 1, -1) if run[start : start + n] in words), start + 1)
            found.append(run[start:stop])
            start = stop
    return found


def dictionary_segmenter(words: Iterable[str]) -> Segmenter:
    """Forward maximum matching over a dictionary, for scripts without spaces.

    The dictionary goes to every task; more than ``DICTIONARY_WORDS`` are refused.
    """
    listed = frozenset(words)
    if len(listed) > DICTIONARY_WORDS:
        raise ValueError(f"a dictionary of {len(listed)} words is too large to send to every task")
    longest = max(map(len, listed), default=1)
    return python_segmenter(lambda text: longest_matches(text, listed, longest))
