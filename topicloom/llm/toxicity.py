"""Toxicity with noisy-channel deobfuscation.

Written words are taken as noisy copies of clean ones: letters replaced by look-alike
signs, spaced out, or repeated. The steps:

1. A character trigram model of clean writing is counted over all documents:
   lower-cased letters inside words, all other characters a word end.
2. Words that can be noise (a look-alike sign next to a letter, a letter three
   times in a row, or single letters in a row) span a lattice: each sign is itself
   or a letter it looks like, a run of a letter may shrink, a spaced-out row may
   close up. The Viterbi path under the channel costs and the trigram model is the
   restored word. Other words have one path, themselves.
3. Features of restored words (the word and its prefixes of ``PREFIXES`` letters)
   are counted by label over at most ``SAMPLE`` labelled training rows, those with
   the least hash of their id. Features with a G statistic of at least ``GAIN`` in
   favour of label 1 and three such documents are kept, the ``FEATURES`` strongest.
4. A text's evidence is the sum of the log odds of its distinct restored words,
   each by its strongest feature; a logistic curve, fitted on the same training
   rows, maps it to a score between 0 and 1.

Only ids decide which rows train (``crc32(doc_id) mod 3 <> 1``); labels, language,
source and id never enter a score. Counts are summed per task before a shuffle; the driver
gets the trigram counts over a fixed alphabet, at most ``FEATURES`` features and
a histogram of bounded size. Defined results: null or empty text scores as a text
without evidence; repeated rows score alike; with no labelled row of either kind
every score is 0.5 x the share of label 1 (0 without labels), which no text
exceeds; a null ``doc_id`` is never held out and never trains. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.storage import materialize, spread

SAMPLE = 20_000
FEATURES = 20_000
GAIN = 22.0
PREFIXES = (4, 5, 6)
SEED = 91
THRESHOLD = 0.7
#: Letters that a sign can stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
SWAP, SIGN, SHRINK = -2.0, -12.0, -1.0  # log probabilities of a look-alike, of a sign meant as it is, of a repeated letter
#: The model's alphabet: 0 ends a word, then a-z, then Latin letters with marks.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 2  # and one place for every other letter
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_LETTER, _SIGN = r"[^\W\d_]", "[" + re.escape("".join(LOOKALIKES)) + "]"
_NOISY = re.compile(rf"{_LETTER}{_SIGN}+{_LETTER}|^{_SIGN}+{_LETTER}|{_LETTER}[0-9@$]+$|({_LETTER})\1\1")
_LONG_RUN = re.compile(rf"({_LETTER})\1\1")
_SINGLES = re.compile(r"[ \t]\S[ \t]\S(?:\s|$)")
HEAD = PREFIXES[0]  # no prefix is shorter, and a shorter feature is a whole word
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_RUN = re.compile(r"(\S)\1\1+")
STRETCH = 512
REMEMBERED = 200_000
_PUNCTUATION = ".,;:?\"'"
_EDGES = ".,;:!?\"'()[]{}<>«»„“”…-–—*#%&|~`^/\\"
_table = np.full(0x250, len(LETTERS) + 1, np.int64)
for _point in range(0x250):
    _char = chr(_point)
    _table[_point] = _CODE.get(_char.lower()[:1], len(LETTERS) + 1) if _char.isalpha() else 0


def codes(text: str) -> np.ndarray:
    """A text in the model's alphabet."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < len(_table), _table[np.minimum(points, len(_table) - 1)], len(LETTERS) + 1)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py()
            for start in range(0, len(text or ""), 1 << 20):  # slices overlap by two letters, so no trigram is lost or doubled
                own = codes(text[max(start - 2, 0) : start + (1 << 20)])
                lead = [0, 0] if start == 0 else []
                own = np.concatenate([lead, own]).astype(np.int64)
                if len(own) > 2:
                    total += np.bincount((own[:-2] * SIZE + own[1:-1]) * SIZE + own[2:], minlength=SIZE**3)
    some = np.flatnonzero(total)
    yield pa.record_batch({"cell": pa.array(some), "n": pa.array(total[some])})


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities ``[before, last, next]`` from the trigrams of all documents."""
    counted = docs.select("text").mapInArrow(_trigrams, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(SIZE**3)
    for row in counted.collect():  # at most SIZE ** 3 cells
        cells[row["cell"]] = row["n"]
    three = cells.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    base = (one + 1) / (one.sum() + SIZE)
    pairs = (two + 20 * base) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 20 * pairs[None]) / (three.sum(axis=2, keepdims=True) + 20))


class Restorer:
    """Restored words of a text; written words are restored once and remembered."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def decode(self, written: str, spaced: bool = False) -> str:
        """Viterbi over the lattice of a word or, with word breaks allowed, of a spaced-out row.

        The best state is fixed every ``STRETCH`` characters, which bounds the memory for very long words.
        """
        states = {(0, 0, ""): (0.0, None)}  # (code before, last code, last letter): log probability, linked letters
        runs = {at for run in _RUN.finditer(written) for at in range(run.start() + 1, run.end())}
        for at, char in enumerate(written):
            reached: dict = {}

            def enter(state, score, path, reached=reached):
                if state not in reached or score > reached[state][0]:
                    reached[state] = (score, path)

            for (before, last, seen), (score, path) in states.items():
                ways = [(before, last, score, path)]
                if spaced and last:
                    ways.append((last, 0, score + self.model[before, last, 0], (path, " ")))
                for letter, cost in options(char):
                    if letter is None:
                        enter((before, last, seen), score + cost, path)
                        continue
                    code = _CODE.get(letter, len(LETTERS) + 1)
                    for b, l, value, way in ways:
                        enter((l, code, letter), value + cost + self.model[b, l, code], (way, letter))
                    if letter == seen and at in runs:
                        enter((before, last, seen), score + cost + SHRINK, path)
            states = reached
            if at % STRETCH == STRETCH - 1:
                best = max(states, key=lambda s: (states[s][0], s))
                states = {best: states[best]}
        _, path = max(((score + self.model[s[0], s[1], 0], path) for s, (score, path) in states.items()), key=lambda e: e[0])
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def restored(self, written: str) -> tuple[str, ...]:
        """What a lower-cased written word can be: itself without signs at its edges, and its restored form."""
        found = self.known.get(written)
        if found is None:
            bare = written.strip(_EDGES)
            found = (bare,) if bare else ()
            if _NOISY.search(written) or (bare and _NOISY.search(bare)):
                found = tuple(dict.fromkeys([*found, *(w for w in (self.decode(written.strip(_PUNCTUATION).rstrip("!")),) if w)]))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[written] = found
        return found

    def written(self, text: str) -> set[str]:
        """Distinct lower-cased words of a text, and the words its spaced-out rows close up to."""
        text = text.lower()
        return set(text.split()) | self.closed_up(text)

    def closed_up(self, text: str) -> set[str]:
        """Words that spaced-out rows of a lower-cased text close up to."""
        found: set[str] = set()
        for row in _SPACED.finditer(text) if _SINGLES.search(text) else ():
            letters = "".join(c for c in row[0] if c.isalpha() or c in LOOKALIKES)
            if len(set(letters)) > 2:
                found.update(self.decode(letters, True).split())
        return found


def options(char: str) -> list[tuple[str | None, float]]:
    """Letters a character can stand for with their costs; None drops it."""
    if char.isalpha():
        return [(char, 0.0)]
    return [(letter, SWAP) for letter in LOOKALIKES.get(char, "")] + [(None, SIGN)]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def _counts(model: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = restorer.written(text.as_py() or "")
                for f in {f for w in words for r in restorer.restored(w) for f in features(r)}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pa.record_batch({
                "feature": pa.array(list(seen), pa.string()), "clean": pa.array([c[0] for c in seen.values()], pa.int64()),
                "toxic": pa.array([c[1] for c in seen.values()], pa.int64()),
            })

    return count


class Evidence:
    """Evidence of a text: log odds of the distinct strongest features of its restored words.

    A word of letters alone is its own restored form, and most start like no
    feature, so they are passed over before anything is looked up.
    """

    def __init__(self, model: np.ndarray, odds: dict[str, float]) -> None:
        self.restorer, self.odds = Restorer(model), odds
        self.known: dict[str, str | None] = {}
        self.heads = {f[:HEAD] for f in odds}

    def strongest(self, forms: tuple[str, ...]) -> str | None:
        names = [f for form in forms for f in features(form) if f in self.odds]
        return max(names, key=lambda f: (self.odds[f], f), default=None)

    def feature(self, written: str) -> str | None:
        found = self.known.get(written, "")
        if found == "":
            found = self.strongest(self.restorer.restored(written))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[written] = found
        return found

    def of(self, text: str) -> float:
        text = text.lower()
        runs, heads, found = _LONG_RUN.search(text) is not None, self.heads, set()
        for word in set(text.split()) | self.restorer.closed_up(text):
            bare = word if word.isalpha() else word.strip(_EDGES)
            if bare.isalpha() and word[0] not in LOOKALIKES and not (runs and _LONG_RUN.search(word)):
                if bare[:HEAD] in heads:
                    found.add(self.strongest((bare,)))
            else:
                found.add(self.feature(word))
        return sum(sorted(self.odds[f] for f in found if f))


def _scores(model: np.ndarray, odds: dict[str, float]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Evidence(model, odds)
        for batch in batches:
            found = [judge.of(t.as_py() or "") for t in batch.column("text")]
            rest = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.record_batch(rest | {"evidence": pa.array(found, pa.float64())})

    return score


def fitted_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over (evidence, clean, toxic) counts, by Newton steps with a weak prior."""
    x = np.array([b[0] for b in bins])
    n, y = np.array([b[1] + b[2] for b in bins], float), np.array([b[2] for b in bins], float)
    slope = offset = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = n * p * (1 - p)
        gradient = np.array([((y - n * p) * x).sum() - 0.01 * slope, (y - n * p).sum() - 0.01 * offset])
        curve = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(curve, gradient)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(slope), 0.0), float(offset)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def in_training(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` per row."""
    source = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    model = language_model(source)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    chosen = materialize(chosen, "labelled")
    texts = materialize(source.join(F.broadcast(chosen), "doc_id").repartition(F.xxhash64("doc_id", "text")), "training")  # at most ``sample`` ids
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    odds: dict[str, float] = {}
    curve = (0.0, math.log((toxic + 1e-9) / (clean + 1e-9)) if toxic and clean else -40.0)
    if clean and toxic:
        counts = texts.select("text", "toxic").mapInArrow(_counts(model), "feature string, clean bigint, toxic bigint")
        counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3")
        cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        both = F.col("clean") + F.col("toxic")
        share = toxic / (clean + toxic)
        gain = 2 * (cell(F.col("toxic"), both * share) + cell(F.col("clean"), both * (1 - share)))
        log_odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        strong = counts.select("feature", gain.alias("gain"), log_odds.alias("log_odds")).where((F.col("gain") >= GAIN) & (F.col("log_odds") > 1))
        odds = {r["feature"]: r["log_odds"] for r in strong.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()}
        train = texts.mapInArrow(_scores(model, odds), "doc_id bigint, toxic int, evidence double")
        bins = train.groupBy(F.least(F.round("evidence", 1), F.lit(1000.0)).alias("x")).agg(
            F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
        curve = fitted_curve([tuple(r) for r in bins.collect()])  # at most 10,001 bins
    found = source.mapInArrow(_scores(model, odds), "doc_id bigint, evidence double")
    score = 1 / (1 + F.exp(-(F.col("evidence") * curve[0] + curve[1])))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), "evidence").select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
