"""Operators and stages on tables whose other columns have odd or clashing names."""

import pytest

import corpus_pipeline as P
from topicloom.llm import mixing, substrings

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_text", "_", "_id", "_row", "_version", "my col", "a.b", "tags"]
KINDS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, n_removed string, kept_text int, _ int, _id int, _row string,"
         " _version int, `my col` string, `a.b` int, tags map<string,array<int>>")


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"word{i} goes on" for i in range(20))
    rows = [(d, f"{passage} and text number {d} ends here with more words of its own kind", "en", "ab"[d % 2], 3, 10 * d, "x", d, 1, d, "r", 2, "m", d, {"k": [d]}) for d in range(12)]
    return spark.createDataFrame(rows, KINDS)


def kept(rows, *changed):
    return {r.doc_id: {c: r[c] for c in NAMES if c not in changed} for r in rows}


def test_columns_pass_the_stages(spark, docs):
    before = kept(docs.collect(), "text", "n_chars")
    for stage in (P.quality_rules, P.minhash_near_dedup, P.substring_dedup, P.source_mixing):
        found = stage(spark, docs, "")
        assert found.columns == NAMES
        rows = found.collect()
        assert rows and all(before[d] == rest for d, rest in kept(rows, "text", "n_chars").items()), stage.__name__


def test_results_take_their_names(docs):
    cut = substrings.without_repeats(docs)
    assert cut.columns == ["doc_id", *[c for c in NAMES[2:] if c not in ("n_words", "n_removed", "kept_text")], "n_words", "n_removed", "kept_text"]
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[0].n_removed == 0 and rows[1].n_removed >= 60 and rows[1]["a.b"] == 1 and rows[1].tags == {"k": [1]}


def test_rows_with_maps_are_mixed(docs):
    assert mixing.taken(docs).count() == 12
    assert {r.doc_id: r.tags["k"] for r in mixing.mixed(docs).collect()}.items() <= {d: [d] for d in range(12)}.items()
