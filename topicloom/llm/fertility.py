"""Quality rules: text statistics and tokeniser fertility.

Base rules look at the words alone. The fertility rule measures how two public
vocabularies take a text. The one of pieces with byte fallback encodes its words:
word characters per token, share of byte-fallback tokens, and entropy of the
tokens in bits. The byte-level one encodes the text with its white space: the same
three as ``level_chars_per_token``, ``part_share`` (tokens that are no whole
characters; it has no byte fallback) and ``level_entropy``. Bands of these six are
drawn per language (per script where a row names no language) from all documents
that pass the base rules: the quartiles, widened by ``SPREAD`` interquartile ranges
and at least by ``LEAST``. A document outside a band is rejected. Quartiles are merged
from per-task summaries, so a language with most of the rows is no burden, and
only the bands, one row per language or script, are joined back.

Defined results: null text has no words and fails the base rules; a language of
whose documents none passes has no bands, and rejects by the base rules only;
rows are independent of each other, so repeated rows each get their result.
Extra columns are ignored by :func:`quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.hashing import covered, gram_hashes, word_hashes
from topicloom.llm.tokens import byte_tokens, piece_tokens
from topicloom.storage import materialize, spread

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
MEASURES = ("chars_per_token", "byte_share", "entropy", "level_chars_per_token", "part_share", "level_entropy")
SPREAD = 4.0
LEAST = dict(zip(MEASURES, (0.2, 0.05, 1.0) * 2, strict=True))
#: First code point of each script told apart, ascending.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
           (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
           (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = np.array([n for _, n in SCRIPTS])


def script_of(text: str) -> str:
    """Script of most letters' code points."""
    points = np.array([ord(c) for c in text if c.isalpha()], np.int64)
    if not len(points):
        return "none"
    names, counts = np.unique(_NAMES[np.searchsorted(_STARTS, points, "right") - 1], return_counts=True)
    return str(names[counts.argmax()])


def repeated_words(data: bytes) -> int:
    """Words covered by windows of ``REPEAT_WINDOW`` words that occur more than once in the text."""
    words = word_hashes(data)
    grams = gram_hashes(words, REPEAT_WINDOW)
    if not len(grams):
        return 0
    _, group, sizes = np.unique(grams, return_inverse=True, return_counts=True)
    return int(covered(np.flatnonzero(sizes[group] > 1), REPEAT_WINDOW, len(words)).sum())


def token_entropy(ids: np.ndarray) -> float:
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def fertility(ids: np.ndarray, fallback: np.ndarray, chars: int) -> tuple[float, float, float]:
    """Characters per token, share of tokens in ``fallback``, entropy."""
    return chars / len(ids), float(fallback[ids].mean()), token_entropy(ids)


def _measures(folder: str | None):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens = piece_tokens(folder), byte_tokens(folder)
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                text = text.as_py() or ""
                data = text.encode()
                words = data.split()
                lines = [line for line in data.split(b"\n") if line.strip()]
                chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
                symbols = len(data) - len(data.translate(None, SYMBOLS))
                repeats = repeated_words(data)
                failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
                figures = (None,) * len(MEASURES)
                if not failed:
                    figures = (*fertility(pieces.ids(words), pieces.is_byte, chars), *fertility(tokens.ids(text), tokens.is_part, chars))
                group = f"lang {lang}" if lang is not None else f"script {script_of(text)}"
                rows.append((len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed, group, *figures))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()] + [pa.float64()] * len(MEASURES)
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([batch.column("doc_id"), batch.column("version"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=NAMES)

    return measure


NAMES = ["doc_id", "version", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "band", *MEASURES]


def measured(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Base statistics and fertility figures per row (figures null where the base rules fail)."""
    schema = ("doc_id bigint, version bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
              " base_failed boolean, band string, " + ", ".join(f"{m} double" for m in MEASURES))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), lang.alias("lang")]
    source = spread(docs.select(*columns, row_version(docs).alias("version")), "doc_id")
    return source.mapInArrow(_measures(folder), schema)


def row_version(docs: DataFrame) -> Column:
    """A hash of what decides a row's verdict, its text and language."""
    return F.xxhash64("text", F.col("lang").cast("string")) if "lang" in docs.columns else F.xxhash64("text")


def bands(figures: DataFrame) -> DataFrame:
    """Lower and upper limits per band group."""
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 10000).alias(m) for m in MEASURES]
    limits = []
    for m in MEASURES:
        low, high = F.col(m)[0], F.col(m)[1]
        reach = F.greatest((high - low) * SPREAD, F.lit(LEAST[m]))
        limits += [(low - reach).alias(f"{m}_low"), (high + reach).alias(f"{m}_high")]
    return figures.where("not base_failed").groupBy("band").agg(*quartiles).select("band", *limits)


def quality(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` per row of ``docs (doc_id, text[, lang])``."""
    figures = materialize(measured(docs, folder), "figures")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    limits = bands(figures).withColumnRenamed("band", "_band")
    joined = figures.join(limits, F.col("band") == F.col("_band"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select(*NAMES[:8], "kept", *MEASURES)
