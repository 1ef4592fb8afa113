"""Phrases and their scores against counts of every place."""

import collections
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from topicloom.llm import collocations as C
from topicloom.llm import oracles

SCHEMA = "doc_id bigint, lang string, text string, rank string, words int"


def brute(docs, least, top, longest=5):
    totals, counts = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {k: a for k, a in counts.items() if a >= least}
    inside = set()
    for (lang, long), a in frequent.items():
        for k in range(2, len(long)):
            inside |= {(lang, long[i : i + k]) for i in range(len(long) - k + 1) if frequent[lang, long[i : i + k]] == a}
    found = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) > 1 and (lang, p) not in inside:
            cuts = [(1000 * a * totals[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(p).encode(), frequent[lang, p[:k]], frequent[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, totals[lang], -score) for lang, rows in found.items()
                  for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def corpus(seed, docs=150):
    rng = random.Random(seed)
    vocab = [f"{c}{v}" for c in "btkéЖ" for v in "aeiou"] + ["X", "new york", "New York City", "of the", "中 文"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    text = lambda: "".join(rng.choices(vocab, weights)[0] + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), text()) for _ in range(docs)]
    return rows + [("en", None), (None, ""), ("de", " .,;"), ("fr", "a b"), ("en", "same old song here now") ] + [("en", "same old song here now")] * 12


def frame(spark, docs):
    return spark.createDataFrame([(1, lang, text, "x", 1) for lang, text in docs], SCHEMA)


def rows(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, top", [(3, 10_000), (8, 7)])
def test_equals_brute_force(spark, least, top):
    docs = corpus(least)
    assert rows(C.collocations(frame(spark, docs), least, top)) == brute(docs, least, top)


def test_full_filters_and_small_slices_change_nothing(spark, monkeypatch):
    """A filter that lets everything through, many slices, and streams of many partitions."""
    docs = corpus(5, 60)
    for name, value in (("FILTER_BITS", 64), ("SLICE", 40), ("HELD", 10)):
        monkeypatch.setattr(C, name, value)
    assert rows(C.collocations(frame(spark, docs), 2, 10_000)) == brute(docs, 2, 10_000)


def test_segments_repeat_the_last_words(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 7)
    rng = random.Random(2)
    for overlap in range(5):
        for _ in range(50):
            data = "".join(rng.choice(["a ", "bb ", "\n", "c" * 20 + " ", " "]) for _ in range(30)).encode()
            parts = list(C.segments(data, overlap))
            want = collections.Counter(tuple(w[i : i + overlap + 1]) for p in data.split(b"\n") for w in [p.split()] for i in range(len(w) - overlap))
            got = collections.Counter(tuple(w[i : i + overlap + 1]) for q in parts for p in q.split(b"\n") for w in [p.split()] for i in range(len(w) - overlap))
            assert got == want


def test_walk_starts_anywhere(spark):
    """Partitions that begin inside a phrase know the counts of its shorter ones."""
    letters = "abc"
    grams = [()] + [(x,) for x in letters] + [(x, y) for x in letters for y in letters] + [(x, y, z) for x in letters for y in letters for z in letters]
    counts = {g: 1000 - 100 * len(g) - sum(map(ord, g)) % 7 for g in grams}
    streams = spark.createDataFrame([("en", list(g), a) for g, a in counts.items()], "lang string, words array<string>, a bigint")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = C.in_order(streams, C.Workspace(spark), "stream").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == 36
    assert all(r.n == counts[()] and r.parts == [counts[tuple(r.words[:k])] for k in range(1, len(r.words))] for r in got)


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, l, r = 9 * 10**11, 8 * 10**12, 10**12 + 3, 10**12 + 7
    row = spark.createDataFrame([(a, n, [l], [r])], "a bigint, n bigint, firsts array<bigint>, rests array<bigint>")
    best = row.select(C._best(F.col("a"), F.col("n"), F.lit(2)).alias("b")).first().b
    assert (best.score, best.k, best.l, best.r) == (1000 * a * n // (l * r), 1, l, r)


def test_sql_equals_brute_force():
    documents = pd.DataFrame([(i, *d) for i, d in enumerate(corpus(9))], columns=["doc_id", "lang", "text"])  # noqa: F841 (read by name)
    sql = oracles.COLLOCATIONS.replace(">= 100", ">= 3")
    assert sorted(duckdb.sql(sql).fetchall()) == brute(corpus(9), 3, 2000)


def test_empty_tables(spark):
    assert rows(C.collocations(frame(spark, []))) == []
    assert rows(C.collocations(frame(spark, [("en", None), (None, "a")]), 1)) == []


def test_ids_do_not_mix_languages():
    words = C.Words([b"a b", b"a b"], ["en", "de"])
    assert len(np.unique(words.ids)) == 4
