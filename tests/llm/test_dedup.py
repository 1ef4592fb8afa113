"""Near-duplicate documents and repeated passages against brute force."""

import random

import numpy as np
import pytest
from fixtures import corpus, long_text

import brute
from topicloom.llm import minhash
from topicloom.llm.graph import components
from topicloom.llm.minhash import near_duplicates
from topicloom.llm.substrings import without_repeats

SCHEMA = "doc_id bigint, text string, digest string, place int"


@pytest.fixture(scope="module")
def docs():
    rows = corpus()
    return [*rows, (len(rows), long_text()), (len(rows) + 1, long_text() + " tail")]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = "a b c d e f g h i j"
    rows = [(3, text), (3, text), (3, "other words that are in no further text"), (2, text), (7, "Other words that are in no further text"), (None, text), (None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 0, -1, True), (-1, 6, -1, True), (2, 6, 2, True), (3, 4, 2, False), (3, 6, 2, False), (3, 6, 2, False), (7, 4, 2, False)]


def test_repeats(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in without_repeats(frame(spark, docs)).collect()}
    assert got == brute.without_repeats(docs)


def test_repeats_with_layout_and_odd_ids(spark):
    text = " ".join(map(str, range(20)))
    rows = [(1, text + "\n end"), (1, text + "\n end"), (5, "x " + text), (None, text), (6, None)]
    got = without_repeats(frame(spark, rows), keep_layout=True)
    assert got.columns == ["doc_id", "digest", "place", "n_words", "n_removed", "kept_text"]
    rows = sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in got.collect())
    assert rows == [(0, 0, text), (1, 0, text + "\n end"), (1, 0, text + "\n end"), (5, 20, "x"), (6, 0, None)]


def test_empty_tables(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    assert without_repeats(frame(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3), (8, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(200, 260)} | {7: 7, 8: 7}


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 300, 9000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, size // 9, dtype=np.uint64)]))
        turned = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view(np.uint64))
        differ = len(np.setxor1d(a, b))
        assert turned <= differ and (differ > 100 or turned >= 0.9 * differ)


def test_pairs_of_copies_below_the_threshold_grow_with_the_group(spark, monkeypatch):
    """Each its own component, all alike: few pairs reach the full sets, and links between some of them are found."""
    rng, sent, confirmed = random.Random(5), [], minhash._confirmed
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(400)

    def copy():
        w = list(base)
        for at in range(rng.randrange(60), 400, 60):  # seven edits, 35 of 396 shingles
            w[at] = words(1)[0]
        return " ".join(w)

    def counted(pairs, sets):
        sent.append(pairs.count())
        return confirmed(pairs, sets)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    docs, total = [], {}
    for n in (80, 240):
        docs += [(d, copy()) for d in range(len(docs), n)]
        sent.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, docs)).collect()}
        total[n] = sum(sent)
        if n == 80:
            assert got == brute.near_duplicates(docs)
    assert total[240] <= 4.5 * total[80] + 240, total
