"""The trie against one built turn by turn."""

import collections
import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from topicloom.llm import oracles
from topicloom.llm import prefixtrie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, name string"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c - 100 * int(c / 100))
        convs[c] = own.get(base, [])[:h] + ts[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def corpus(seed, long=40):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["", "hi", "héé", "中文", None, "a b"]))
    rows = []
    for c in [0, 100, 300, 400, 500, *rng.sample(range(1, 500), 60), -7, -100, 12345]:
        rows += [(c, t if rng.random() < 0.95 else None, *turn()) for t in range(rng.choice([0, 1, 2, 3, 5, 8]) + 1)]
    same = [turn() for _ in range(long)]
    for c in range(600, 640):  # long conversations that part at several depths
        keep = rng.choice([1, 3, long // 2, long - 1, long])
        rows += [(c, t, *x) for t, x in enumerate(same[:keep] + [turn() for _ in range(rng.choice([0, 0, 1, 7]))])]
    rows += [(None, 1, "user", "x"), (601, 3, "user", "tie"), (601, 3, "user", "tie"), (602, None, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def got(spark, rows, chunk):
    nodes, ends = P.prefix_trie(*P.rebuilt(frame(spark, rows)), chunk)
    digests = {bytes(r.name): r.sha256 for r in P.end_digests(ends).collect()}
    empty = hashlib.sha256().hexdigest()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, digests.get(bytes(r.name), empty)) for r in nodes.collect())


@pytest.mark.parametrize("chunk", [2, 8, P.CHUNK])
def test_equals_brute_force(spark, chunk):
    rows = corpus(chunk)
    assert got(spark, rows, chunk) == brute(rows)


def test_query_form_and_short_strings(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS", 3)
    rows = corpus(3) + [(c, 0, "user", "same") for c in range(1000, 1050)]
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    found = P.conversation_trie(frame(spark, rows))
    assert tuple(found.columns) == columns
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_names_do_not_depend_on_chunks():
    turns = [bytes([k]) * 16 for k in range(37)]
    whole = P.prefix_names(turns, P.ROOT)
    assert len(set(whole)) == 37
    assert P.prefix_names(turns[:20], P.ROOT) == whole[:20]
    units = [P.block_name(turns[k : k + 8]) for k in range(0, 32, 8)]
    closes = P.prefix_names(units, P.ROOT)
    assert closes == [whole[k] for k in (7, 15, 23, 31)]
    assert P.prefix_names(turns[8:15], closes[0]) == whole[8:15]


def test_sql_equals_brute_force():
    rows = corpus(5, 12)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841 (read by name)
    found = [tuple(r) for r in duckdb.sql(oracles.PREFIX_TRIE).fetchall()]
    assert sorted(found) == brute(rows)


def test_turnless_and_empty(spark):
    only = [(7, 0, "user", "x")]
    assert got(spark, only, 4) == brute(only)
    assert got(spark, [], 4) == [] and got(spark, [(None, 1, "user", "x")], 4) == []
