"""Pipeline stages against brute-force versions of their decisions."""

import collections

import numpy as np
import public_tokenizers
import pytest
from fixtures import corpus
from tokenizers import Tokenizer

import brute
import corpus_pipeline as P
from topicloom.llm import LLM_ORACLES, LLM_QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents before the first and after each stage."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(d, t, "en", "ab"[d % 2], len(t or "")) for d, t in corpus()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs.collect()]
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    whole = P.run(spark, folder)
    assert whole.count() == len(found[-1]) and whole.columns == docs.columns
    return found


def test_stages(stages):
    start, good, single, cut, mix, packed = stages
    passed = {r.doc_id for r in start if not brute.base_rules(r.text)[5]}
    assert {r.doc_id for r in good} <= passed and len(good) > 0.9 * len(passed)
    near = brute.near_duplicates([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in single} == {d for d, (_, _, kept) in near.items() if kept}
    free = brute.without_repeats([(r.doc_id, r.text) for r in single])
    text = {r.doc_id: r.text for r in single}
    want = {d: text[d] if not gone else kept for d, (n, gone, kept) in free.items() if gone < n or not gone}
    assert {r.doc_id: r.text for r in cut} == want
    assert all(r.n_chars == len(r.text) for r in [*cut, *mix])
    size = collections.Counter()
    for r in cut:
        size[r.source] += len(brute.words(r.text))
    names = sorted(size)
    for name, target in zip(names, brute.targets([size[n] for n in names]), strict=True):
        assert abs(sum(len(brute.words(r.text)) for r in mix if r.source == name) - target) <= 1
    copies = collections.Counter(r.doc_id for r in mix)
    assert max(copies.values()) <= 3 and set(copies) <= set(want)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix)
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 2
    assert np.mean(list(fill.values())) > 700


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and set(LLM_ORACLES) <= set(LLM_QUERIES)
