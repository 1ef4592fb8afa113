"""The Metropolis-Hastings sampler: its stationary distribution, its proposals and its cost."""

import itertools
import math
import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from topicloom.operators import counts as C
from topicloom.operators import shards
from topicloom.params import TopicParams
from topicloom.plans import batch


def start_of(docs, topic, k, alpha, beta):
    """Arrays of a shard that holds everything: word, doc, counts with priors inside."""
    word, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    a, b = np.full((len(docs), k), alpha), np.full((word.max() + 1, k), beta)
    np.add.at(a, (doc, topic), 1.0)
    np.add.at(b, (word, topic), 1.0)
    return word, doc, a, b, b.sum(axis=0)


@pytest.mark.parametrize("steps", [1, 2, 3])
def test_stationary_distribution(steps):
    """Long runs visit every assignment of a small corpus as often as the collapsed posterior says."""
    docs, k, alpha, beta = [np.array([0, 0, 1]), np.array([1, 2])], 2, 0.7, 0.4
    posterior = {}
    for z in itertools.product(range(k), repeat=5):
        _, _, a, b, t = start_of(docs, np.array(z), k, alpha, beta)
        posterior[z] = math.exp(sum(map(math.lgamma, a.ravel())) + sum(map(math.lgamma, b.ravel())) - sum(map(math.lgamma, t)))
    whole = sum(posterior.values())
    topic, rng, seen = np.zeros(5, np.int64), np.random.default_rng(7), Counter()
    word, doc, a, b, t = start_of(docs, topic, k, alpha, beta)
    sweeps = 5_000
    for _ in range(sweeps):
        topic = shards._sweep_mh(word, doc, topic, a, None, np.full(k, alpha), b, t, rng, 1, steps, beta, 1)
        seen[tuple(topic.tolist())] += 1
    assert np.allclose(start_of(docs, topic, k, alpha, beta)[2], a) and np.allclose(start_of(docs, topic, k, alpha, beta)[3], b)
    assert sum(abs(seen[z] / sweeps - p / whole) for z, p in posterior.items()) / 2 < 0.06


@pytest.mark.parametrize("fill", [0.0, 0.5])
def test_word_proposal_draws_its_counts_without_the_token(fill):
    b = np.array([[3.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 6.0], [2.0, 2.0, 0.0, 0.0]]) + fill
    proposal, rng = shards._WordProposal(b, fill), np.random.default_rng(1)
    for w, own in ((0, 0), (0, 2), (1, 3), (2, 1)):
        word, held = np.full(40_000, w), np.full(40_000, own)
        drawn = proposal.draw(word, held, rng.random(40_000))
        rest = b[w] - (np.arange(4) == own)
        assert np.abs(np.bincount(drawn, minlength=4) / 40_000 - rest / rest.sum()).max() < 0.01
        assert np.allclose(proposal.chance(np.full(4, w), np.full(4, own), np.arange(4)), rest)


def cost(k):
    """Seconds per token of a sweep, the best of three."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2000, 200) for _ in range(300)]
    topic = rng.integers(0, k, 60_000)
    word, doc, a, b, t = start_of(docs, topic, k, 0.1, 0.01)
    best = math.inf
    for _ in range(3):
        begun = time.process_time()
        topic = shards._sweep_mh(word, doc, topic, a, None, np.full(k, 0.1), b, t, rng, 2048, 4, 0.01)
        best = min(best, time.process_time() - begun)
    return best / 60_000


def test_cost_hardly_grows_with_the_topics():
    assert cost(1000) < 2.5 * cost(100)


def test_planted_topics_are_found():
    """Documents over two disjoint sets of words, also when they are cut into segments that know each other's counts."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 8, 30) + 8 * (d % 2) for d in range(60)]
    topic = rng.integers(0, 2, 1800)
    word, doc, a, b, t = start_of(docs, topic, 2, 0.5, 0.1)
    for _ in range(80):
        topic = shards._sweep_mh(word, doc, topic, a, None, np.full(2, 0.5), b, t, rng, 16, 4, 0.1)
    counts = a - 0.5
    assert (counts.max(axis=1) / counts.sum(axis=1)).mean() > 0.95


def test_shards_use_it(spark, planted):
    params = TopicParams(num_topics=2, alpha=0.5, beta=0.1, tokens_per_shard=500, block_tokens=16, sampler="mh", segment_tokens=8)
    model = batch.fit_distributed(planted, params, sweeps=2)
    assert sum(model.totals) == model.tokens.count() == 1800
    assert sorted(map(str, C.topic_vectors(model.tokens, "wid", 2).collect())) == sorted(map(str, model.rows.collect()))
    plain = batch.fit_distributed(planted, replace(params, sampler="gibbs"), sweeps=2)
    assert model.tokens.exceptAll(plain.tokens).count() > 0


def test_unknown_sampler():
    with pytest.raises(ValueError, match="gibbs"):
        TopicParams(sampler="other")
