"""Mixing, resampling, toxicity and license scans."""

import collections
import random

import duckdb
import numpy as np
import pytest
from fixtures import corpus, long_text
from pyspark.sql import functions as F

import brute
from topicloom.llm import licenses, mixing, resampling, toxicity


def test_targets_are_water_filling():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) * rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        assert np.allclose(mixing.shares(sizes), brute.targets(sizes))


@pytest.mark.parametrize("size", [1, 2, 3, 64, 1000])
def test_permutations(size):
    index = np.arange(size)
    image = mixing.permuted(index, size, 3, 1)
    assert sorted(image.tolist()) == index.tolist()
    assert (mixing.permuted(image, size, 3, 1, back=True) == index).all()


def sources():
    names = ["b", "a", None, "é", "B", "empty"]
    rows = [(d, t, names[0] if d % 2 else names[d % 5], d * 1.5) for d, t in corpus()]
    return rows + [(500, None, "empty", 0.0), (501, long_text(3000), "a", 0.0), (None, "x y z", "a", 0.0), (502, "same row", "B", 0.0), (502, "same row", "B", 0.0)]


def test_mix(spark):
    rows = sources()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double")
    got = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(7)).collect()
    order = lambda rs: sorted(rs, key=lambda r: (r.doc_id is None, r.doc_id, r.taken))
    assert [tuple(r) for r in order(got)] == [tuple(r) for r in order(again)]
    total = collections.Counter()
    for _, text, source, _ in rows:
        total[source] += len(brute.words(text))
    names = sorted(s for s in total if s is not None) + [None]
    target = dict(zip(names, brute.targets([total[n] for n in names]), strict=True))
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    source = {d: s for d, _, s, _ in rows}
    took = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        took[s] += r.taken
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
        assert r.size == len(brute.words(dict((d, t) for d, t, _, _ in rows)[r.doc_id]))
    assert all(abs(took[n] - target[n]) <= 1 for n in names)
    texts = mixing.mixed(docs).collect()
    assert sum(len(brute.words(r.text)) for r in texts) == sum(took.values())
    by = {(d, s): brute.words(t) for d, t, s, _ in rows}
    for r in texts:
        rest = iter(by[r.doc_id, r.source])
        assert all(any(w == x for x in rest) for w in brute.words(r.text))  # a subsequence
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_resampling(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "house", "green", "water"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["zzz", "qqq", "$$$"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), "x") for i in range(200)] + [(300, None, "x"), (None, "", "x"), (301, long_text(2000), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, place string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 3)], "doc_id bigint, quality int, toxic int")
    got = resampling.resampled(docs, labels, k=120).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 120
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 4 == 0)
    raw, target = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for d, t, _ in rows:
        np.add.at(raw, resampling.buckets(t), 1)
        if d is not None and d < 200 and d % 3 == 0 and d % 4:
            np.add.at(target, resampling.buckets(t), 1)
    ratios = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    for r in got:
        assert abs(r.log_weight - ratios[resampling.buckets(dict((d, t) for d, t, _ in rows)[r.doc_id])].sum()) < 1e-6
    assert sorted(r.drawn_at for r in got if r.kept)[0] >= max(r.drawn_at for r in got if not r.kept)
    plain = resampling.resampled(docs, labels.limit(0), keep=0.5).collect()
    assert {r.log_weight for r in plain} == {0.0} and sum(r.kept for r in plain) == 102


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(8)
    plain = ["a", "the", "stone", "idea", "mason", "order", "castle", "paper", "lot", "dinner", "person", "radio", "period", "studio"]
    rude = ["moron", "idiot", "stupid"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for at, r in zip(rng.sample(range(40), 3), rude, strict=True):
                w[at] = r
        rows.append((i, " ".join(w), toxic))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, toxic_rows):
    rows, labels = toxic_rows
    noisy = [(1000, "the m0r0n and 1d1ot"), (1001, "a s t u p i d idea of m o r o n"), (1002, "stuuupid st0ne mooooron idiooot"), (1003, None), (1004, ""), (1005, "stone 10 45.6 paper"), (None, "moron idiot stupid")]
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in rows] + [(d, t, 1) for d, t in noisy], "doc_id bigint, text string, toxic int")
    table = spark.createDataFrame([(d, x, 1) for d, x in labels], "doc_id bigint, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.scored(docs, table).collect()}
    assert len(got) == len(rows) + len(noisy)
    for d, _, toxic in rows:
        assert got[d].predicted == int(toxic) and got[d].held_out == (not toxicity.in_training(d))
    assert [got[d].predicted for d in (1000, 1001, 1002, None)] == [1, 1, 1, 1]
    assert [got[d].predicted for d in (1003, 1004, 1005)] == [0, 0, 0]
    assert got[None].held_out is False
    bare = toxicity.scored(docs, table.limit(0)).collect()
    assert {r.predicted for r in bare} == {0} and len(bare) == len(got)


def test_licenses_inside_lines_and_wrapped(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    texts = [
        "Copyright (c) 2020 Foo. Released under the MIT License.",
        "some words of a page on one line " * 30 + apache + " and more words of the page" * 30,
        "/* A tool for things\n * Licensed under the Apache\n * License, Version 2.0.\n * It does this and that, as told below,\n * and much more than what fits here\n * in these few lines of a header.\n */",
        "about us " * 20 + mit + " and so on " * 20 + apache,
        apache + "\n\nfoo bar " + apache + " other words follow it here, " + apache,
        "Use of this is under the rules of the house and the license of the owner " * 20,
    ]
    got = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {r.doc_id: (r.n_notices, r.licenses) for r in got}
    assert found == {0: (1, "MIT"), 1: (1, "Apache-2.0"), 2: (1, "Apache-2.0"), 3: (2, "Apache-2.0,MIT"), 4: (3, "Apache-2.0"), 5: (0, "")}


def test_licenses_are_looked_for_only_in_texts_that_may_hold_one(spark):
    """Least parts of every template that still count pass, whatever stands between the words; other texts are not normalised."""
    texts = []
    for _, text in licenses.TEMPLATES:
        words = licenses.template_words(text)
        for cut in range(len(words)):
            for kept in (words[cut:], words[:cut]):
                texts += [" ".join(kept), "\u00e9--\n".join(kept).upper()]
    texts += ["", "LICENSE of the house, released to the public", "some words of a page " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    low = docs.select("doc_id", licenses.lowered(F.col("text")).alias("low"))
    gated = {r.doc_id: r.may for r in low.select("doc_id", licenses.may_hold(F.col("low")).alias("may")).collect()}
    units = F.filter(F.transform(licenses.unit_bigrams(licenses.normalised(F.col("low"))), lambda g: licenses.best_match(g)), lambda m: m.isNotNull())
    found = {r.doc_id: r.n for r in low.select("doc_id", F.size(units).alias("n")).collect()}
    held = [d for d, n in found.items() if n]
    assert len(held) > 2 * len(licenses.TEMPLATES) and all(gated[d] for d in held)
    assert not any(gated[d] for d in range(len(texts) - 3, len(texts)))
    plan = licenses.scanned(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.index("CASE WHEN") < plan.index("regexp_replace(")


def test_license_scan_equals_its_sql(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    wrapped = "Intro\n\n" + mit[:70] + "\n" + mit[70:160] + "\n" + mit[160:] + "\n\nrest"
    rows = [(d, t, 1) for d, t in corpus()] + [
        (500, "x\nLicensed under the apache LICENSE -- version 2.0!\ny"), (501, wrapped), (502, "Released under the MIT License."),
        (502, "Released under the MIT License."), (503, "This work is licensed under the GNU General Public License, version 9."), (504, long_text(9000))]
    rows = [(r[0], r[1], 1) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, units int")
    frame = licenses.scanned(docs)
    got = frame.toPandas()
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841 (read by name)
    want = con.sql(licenses.oracle_sql()).df()
    keys = list(want.columns)
    assert list(got.columns) == keys
    assert sorted(map(str, got.fillna("").values.tolist())) == sorted(map(str, want.fillna("").values.tolist()))
    best = {r.doc_id: r.best_license for r in got.itertuples()}
    assert [best[d] for d in (500, 501, 502, 503)] == ["Apache-2.0", "MIT", "MIT", "GPL-3.0"]
    assert "Python" not in frame._jdf.queryExecution().toString() and "Exchange" not in frame._jdf.queryExecution().toString()
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.scored(docs, labels).count() == 0
    assert resampling.resampled(docs, labels).count() == 0
    assert mixing.taken(docs).count() == 0 and mixing.mixed(docs).count() == 0
