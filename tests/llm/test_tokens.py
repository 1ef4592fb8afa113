"""Quality rules, packing and their tokenizers."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import corpus, long_text
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import brute
from topicloom.llm import packing
from topicloom.llm.fertility import quality, script_of, token_entropy
from topicloom.llm.tokens import byte_tokens, piece_tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z'1\n\t é中\U0001f600.<|>"), max_size=40) | st.text(max_size=40))
def test_byte_ids_equal_the_library(text):
    assert byte_tokens().ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_strings_and_pieces():
    text = "a <|endoftext|> b"
    assert byte_tokens().ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    tokens = byte_tokens()
    assert not tokens.is_part[tokens.ids("plain café")].any() and tokens.is_part[tokens.ids("䵖䵗")].mean() > 0.5
    assert token_entropy(np.array([1, 1, 2, 2])) == 1.0
    assert [script_of(t) for t in ("abc", "Жд", "12", "中文 a")] == ["latin", "cyrillic", "none", "han"]


def test_byte_fallback_of_pieces(spark):
    tokens = piece_tokens()
    ids = tokens.ids(["plain".encode(), "䵖䵗".encode()])
    assert 0 < tokens.is_byte[ids].mean() < 1
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a word of 䵖䵗 in\n\n a  text, \t and more " + " ".join(f"w{i}" for i in range(40)), " ".join("the river ran past the old house and out to sea".split()[i % 7] + str(i) for i in range(40))]
    rows = quality(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        want = [i for w in texts[r.doc_id].split() for i in model.encode(w)]
        assert r.byte_share == pytest.approx(sum(map(model.is_byte, want)) / len(want)) and r.chars_per_token == pytest.approx(r.word_chars / len(want))
        assert r.level_entropy == token_entropy(byte_tokens().ids(texts[r.doc_id])) and (r.byte_share > 0) == (r.doc_id == 0)


def test_quality_rejects_by_byte_fallback_alone(spark):
    plain = [" ".join(f"{w}{(i * 7 + j * j) % 50}" for j, w in enumerate("the house by a river was small and green with light water over paper walls so we went home again today".split())) for i in range(40)]
    fallen = " ".join(w + ("" if j % 7 else "\u314b") for j, w in enumerate(plain[0].split()))
    rows = [(i, t, "en") for i, t in enumerate(plain)] + [(100, fallen, "en")]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    odd = got.pop(100)
    assert not odd.kept and odd.byte_share > 0.05 and odd.part_share == 0 and all(r.kept for r in got.values())


def test_quality(spark):
    docs = [*corpus(), (900, long_text()), (901, "line\nline\n \nline " + "# $ " * 30)]
    rows = [(d, t, "en" if d % 3 else None, 1) for d, t in docs]
    got = quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int")).collect()
    figures = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got}
    assert figures == {d: brute.base_rules(t) for d, t in docs}
    assert not any(r.kept and r.base_failed for r in got)
    assert sum(r.kept for r in got) > 0.9 * sum(not r.base_failed for r in got)


def test_quality_rejects_outside_the_bands(spark):
    import random

    rng = random.Random(2)
    plain = [" ".join(rng.choice(["the", "house", "river", "small", "green", "water", "light", "paper"]) for _ in range(80)) for _ in range(60)]
    odd = ["".join(chr(rng.randrange(0x4D00, 0x4DB0)) for _ in range(5)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(plain)] + [(100, " ".join(odd), "en")]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not got.pop(100) and all(got.values())


def test_cuts():
    assert packing.cuts(1) == [(0, 1)]
    assert packing.cuts(1024) == [(0, 1024)]
    assert packing.cuts(2500) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.mark.parametrize("seed", range(4))
def test_bins_hold_all_and_are_few(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1024, 900).tolist() if seed else [600] * 30 + [424] * 20 + [300] * 10 + [124] * 10
    bins = packing.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= max(-(-sum(sizes) // 1024), sum(s > 512 for s in sizes)) * 1.03 + 1


def test_exchanges_empty_a_bin():
    held = packing.Bins(10)
    sizes = [6, 3, 5, 4, 2]
    for items in ([0, 1], [2, 3], [4]):
        held.bins.append(items)
        held.gaps.append(10 - sum(sizes[i] for i in items))
        held._enter(len(held.bins) - 1)
    held.improve(sizes)
    assert sum(1 for b in held.bins if b) == 2


def test_packed(spark):
    docs = [*corpus(), (900, long_text(5000)), (900, long_text(5000)), (None, "no id"), (901, None)]
    got = packing.packed(spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id bigint, text string, row int"), keep_ids=True).collect()
    ids = collections.Counter()
    for d, t in docs:
        ids[d] += len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1
    found = collections.Counter()
    for r in got:
        found[r.doc_id] += r.length
        assert r.length <= 1024 and (r.piece == 0 or r.length == 1024)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert found == ids
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    text = dict(docs)[900]
    whole = b"".join(r.ids for r in sorted((r for r in got if r.doc_id == 900), key=lambda r: r.piece)[::2])
    assert np.frombuffer(whole, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids + [2]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.packed(empty).count() == 0 and quality(empty).count() == 0
