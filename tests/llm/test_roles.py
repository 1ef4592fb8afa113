"""Role repair against a search over all repairs, and its handling of odd rows."""

import itertools
import random

import pytest

from topicloom.llm import roles as R

NAMES = [None, *R.ROLES]


def cheapest(given):
    """Least cost over every way to keep, relabel, merge and insert (at most two inserts before a turn)."""
    best = None
    fills = [()] + [(a,) for a in R.ROLES] + list(itertools.product(R.ROLES, repeat=2))

    def legal(out):
        seq = out[1:] if out and out[0] == "system" else out
        return bool(seq) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(seq))

    def prefix(out):
        return not out or out == ["system"] or legal(out)

    def walk(i, out, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(given):
            for fill in fills:
                if legal(out + list(fill)) and (best is None or cost + R.INSERT * len(fill) < best):
                    best = cost + R.INSERT * len(fill)
            return
        if out:
            walk(i + 1, out, cost + R.MERGE + R.RELABEL * (out[-1] != given[i]))
        for fill in fills:
            for role in R.ROLES:
                after = [*out, *fill, role]
                if all(prefix(after[:k]) for k in range(len(out), len(after) + 1)):
                    walk(i + 1, after, cost + R.INSERT * len(fill) + R.RELABEL * (role != given[i]))

    walk(0, [], 0)
    return best


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    picked = {c: [rng.choice([*R.ROLES, "tool"]) for _ in range(rng.randint(1, 4))] for c in range(40)}
    picked |= {c: [rng.choice([*R.ROLES, None]) for _ in range(rng.randint(20, 60))] for c in range(40, 44)}
    return picked


def frame(spark, cases):
    rows = [(c, t, r, f"t{t}", "x") for c, given in cases.items() for t, r in enumerate(given)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place string")


@pytest.mark.parametrize("chunk", [3, R.CHUNK])
def test_repairs_are_legal_and_cheapest(spark, cases, chunk):
    got = R.formatted(frame(spark, cases), chunk).orderBy("conv_id", "place", "part").collect()
    for conv, given in cases.items():
        rows = [r for r in got if r.conv_id == conv]
        out = [r.role for r in rows if r.action != "merge"]
        chat = out[1:] if out[0] == "system" else out
        assert chat and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(chat))
        cost = sum(r.cost for r in rows)
        if len(given) <= 4:
            assert cost == cheapest([g if g in R.ROLES else None for g in given]), given
        assert [r.place for r in rows if r.action != "insert"] == list(range(len(given)))
        text = "".join(r.piece for r in rows)
        assert text.count("<|end|>\n") == len(out) and text.endswith("\n<|end|>\n")
        assert [p.split("|>")[0] for p in text.split("<|")[1:]] == [x for r in out for x in (r, "end")]
        assert [w for w in text.replace("<", "\n").split("\n") if w.startswith("t")] == [f"t{t}" for t in range(len(given))]


def test_chunks_do_not_change_the_cost(spark, cases):
    costs = [sorted((r[0], r[1]) for r in R.formatted(frame(spark, cases), c).groupBy("conv_id").sum("cost").collect()) for c in (4, R.CHUNK)]
    assert costs[0] == costs[1]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "USER", ""), (1, 0, "USER", ""), (2, 5, "system", None)]
    got = R.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "place", "part").collect()
    assert [(r.conv_id, r.role, r.action) for r in got] == [
        (None, "user", "relabel"), (None, "assistant", "relabel"), (1, "user", "keep"), (1, "user", "merge"), (2, "user", "relabel")]
    assert R.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def every_repair(given):
    """(cost, choices) of every way to keep, merge, relabel and insert; choices as the docstring orders them."""
    order = {"user": 0, "assistant": 1, "system": 2}
    fills = [()] + [(a,) for a in R.ROLES] + list(itertools.product(R.ROLES, repeat=2))
    legal = lambda out: all(r == ("user", "assistant")[i % 2] for i, r in enumerate(out[1:] if out[:1] == ["system"] else out))

    def walk(i, out, cost, taken):
        if i == len(given):
            if out not in ([], ["system"]):
                yield cost, (*taken, (0,)), out
            if out == ["system"]:
                yield cost + R.INSERT, (*taken, (1,)), [*out, "user"]
            return
        if out:
            yield from walk(i + 1, out, cost + R.MERGE + R.RELABEL * (out[-1] != given[i]), [*taken, (0, 1, order[out[-1]])])
        for fill in fills:
            for role in R.ROLES:
                if legal([*out, *fill, role]):
                    step = (bool(fill), 0 if role == given[i] else 2, order[role])
                    yield from walk(i + 1, [*out, *fill, role], cost + R.INSERT * len(fill) + R.RELABEL * (role != given[i]), [*taken, step])

    return walk(0, [], 0, [])


@pytest.mark.parametrize("chunk", [1, 2, 4])
def test_ties_of_all_short_conversations(chunk):
    """The repair taken is the first of the cheapest, whole or from chunks."""
    for n in range(1, 5):
        for given in itertools.product([*R.ROLES, None], repeat=n):
            cost, taken, out = min(every_repair(given))
            matrices = [R.product([R._TABLES[r][0] for r in given[k : k + chunk]]) for k in range(0, n, chunk)]
            ends = R.product(matrices)[R.START] + (R._ENDING << R.BITS)
            last = int(ends.argmin())
            assert int(ends[last]) >> R.BITS == cost
            between = R.states_between(matrices, R.START, last)
            fixed = [f for k, a, b in zip(range(0, n, chunk), between, between[1:]) for f in R.repaired(list(given[k : k + chunk]), a, b)]
            got = [r for role, action, before in fixed for r in (*before, *([] if action == "merge" else [role]))] + ["user"] * (last == R.SYSTEM)
            steps = [(bool(before), ("keep", "merge", "relabel").index(action), ("user", "assistant", "system").index(role)) for role, action, before in fixed]
            assert (steps, got) == (list(taken[:-1]), out), given
