"""Text columns. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A segmenter turns a text column into an array<string> column. Anything with
#: this shape plugs in: a built-in expression or a pandas UDF.
Segmenter = Callable[[Column], Column]


def whitespace_terms(text: Column) -> Column:
    """Split on whitespace; empty ends are dropped, case is kept."""
    return F.array_remove(F.split(text, r"\s+"), "")


def letter_terms(text: Column) -> Column:
    """Runs of letters, lower-cased: the default word segmenter."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def single_line(text: Column) -> Column:
    """Line breaks become spaces."""
    return F.translate(text, "\n\r", "  ")


def json_field(line: Column, name: str) -> Column:
    """One top-level key of a JSON line; other keys are not parsed into columns."""
    return F.get_json_object(single_line(line), f"$.{name}")


def json_terms(segment: Segmenter = letter_terms, field: str = "c") -> Segmenter:
    """A formatter for JSON lines: content field, then ``segment``."""
    return lambda line: segment(json_field(line, field))
