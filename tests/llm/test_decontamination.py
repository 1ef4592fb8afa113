"""Windows of benchmark items in documents, against a search of every place."""

import random
import re

import numpy as np
import pytest

from topicloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, items string, version bigint"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """doc -> (words, hit places, items)."""
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(len(w), D.WINDOW)
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    found = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in range(1, D.WINDOW + 1):
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(w[i : i + size])]
        found.append((doc, len(w), sorted(hit), sorted(str(n) for n in names if n is not None)))
    return sorted(found, key=str)


def got(spark, docs, items):
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n_words int")
    rows = D.contaminated(table, bench).collect()
    hits = lambda r: [k for s in r.spans for k in range(s.start, s.stop)]
    assert all(a.stop < b.start for r in rows for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, hits(r), r["items"]) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("ab1é中") for _ in range(rng.randint(1, 4))) for _ in range(12)] + ["x" * 300]
    joined = lambda ws: "".join(w.upper() * (rng.random() < 0.2) or w + rng.choice([" ", ", ", "\n", "—", " - "][:4]) for w in ws)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 40]))) for i in range(100, 125)]
    items += [(7, items[-1][1]), (7, "tail of its own words"), (None, text(12)), (8, None), (9, " .!? "), (10, "")]
    docs = []
    for d in range(60):
        part = rng.choice(items)[1] or ""
        w = part.split()
        cut = w[rng.randint(0, 2) : len(w) - rng.randint(0, 2)]
        docs.append((d, rng.choice(["", "zz! "]) + text(rng.randint(0, 6)).upper() + "; " + ", ".join(cut) + "\n" + text(rng.randint(0, 30))))
    docs += [(60, None), (61, ""), (62, "..."), (None, items[0][1]), (63, items[0][1]), (63, items[0][1]), (64, text(5000))]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert got(spark, docs, items) == brute(docs, items)


def test_many_blocks_pieces_and_cursors(spark, monkeypatch):
    docs, items = corpus(3)
    for name, value in (("BLOCK_BYTES", 200), ("PIECE_WORDS", 7)):
        monkeypatch.setattr(D, name, value)
    assert got(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("lane, pairs, size", [(1, 1, 1), (3, 2, 100), (50, 5, 1 << 20)])
def test_slices_lanes_and_pairs_do_not_matter(monkeypatch, lane, pairs, size):
    docs, items = corpus(4)
    for name, value in (("LANE", lane), ("PAIRS", pairs), ("TEXT_BYTES", size)):
        monkeypatch.setattr(D, name, value)
    windows = D.Windows([(None if i is None else str(i), b" ".join(D.words_of(t))) for i, t in items])
    rows = [(d, n, [k for a, b in spans for k in range(a, b)], own) for (d, _), (n, spans, own) in zip(docs, D.searched([t for _, t in docs], windows), strict=True)]
    assert sorted(rows, key=str) == brute(docs, items)


def test_strings_with_one_suffix_and_colliding_slots():
    rng = np.random.default_rng(1)
    strings = sorted({bytes(rng.integers(97, 99, 12).astype(np.uint8)) + b"same end" for _ in range(300)})
    text = b"".join(strings)
    starts = np.arange(len(strings)) * 20
    searched = D.Strings(text, starts, starts + 20)
    searched.shift[:] = 0  # as if every slot were taken
    body = b"".join(rng.permutation(np.array(strings, "S20")).tolist())
    found = searched.found(body)
    assert sorted(found) == sorted((m, k) for k, s in enumerate(strings) for m in range(len(body)) if body[m : m + 20] == s)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    assert got(spark, [(1, "a b"), (2, None)], []) == [(1, 2, [], []), (2, 0, [], [])]
