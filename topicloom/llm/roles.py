"""Chat formatting: minimum-cost repair of role sequences, then rendering.

Legal conversations are an optional system turn followed by user and assistant
turns in alternation, user first. Every turn is kept, relabelled or merged into
the turn before it, and empty turns may be inserted, at the costs below (a
merged turn of another role is relabelled too). The cheapest repair is found by
dynamic programming over the automaton's four states.

A turn is a 4 x 4 matrix of costs from state to state; matrices multiply in the
(min, +) sense. Beside its cost an entry carries the rank of its choices among
the matrix's entries, so that ties are settled in chunks as in the whole. A conversation of any length is therefore cut into chunks of
``CHUNK`` turns: chunks are summed up to one matrix each, chunks of chunks
likewise until each conversation is one, and the way back down fixes every
chunk's first and last state, so that chunks decode independently. A conversation
with a third of all rows is many tasks of bounded size. Turn numbers come from a
range-partitioned running count, not from one window.

Defined results: turns are read in order of ``turn`` (null first), ties by role
and text; roles are read in lower case; a null or unknown role can only be relabelled or merged; null text is
an empty turn; rows with null ``conv_id`` form one conversation; extra columns
are ignored. Of equally cheap repairs that is taken which, at the first turn where
they differ, has the earlier choice in the order keep, merge, relabel (each
without turns inserted before it first), then the earlier role in the order
user, assistant, system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import running_total
from topicloom.storage import materialize

CHUNK = 1024
START, USER, ASSISTANT, SYSTEM = range(4)
ROLES = ("user", "assistant", "system")
#: Which roles may follow each state, and the states a conversation may end in.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (USER, ASSISTANT)
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 40
BITS = 5  # of a rank; an entry is cost << BITS | rank


def _inserted(state: int, target: int) -> list[int]:
    """Fewest roles to insert after ``state`` so that ``target`` may come next."""
    paths = [(state, [])]
    for at, path in paths:
        if target in NEXT[at]:
            return path
        paths += [(n, [*path, n]) for n in NEXT[at] if n not in path]
    return []


def _choices(role: str | None) -> list[tuple[int, int, int, str, list[int]]]:
    """(from, to, cost, action, inserted roles) for a turn, by preference."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    found = []
    for state in range(4):
        if state != START:
            found.append((state, state, MERGE + RELABEL * (state != own), "merge", []))
        for target in (SYSTEM, USER, ASSISTANT):
            if target == SYSTEM and state != START:
                continue  # a system turn comes first or not at all
            path = _inserted(state, target)
            action = "keep" if target == own else "relabel"
            found.append((state, target, RELABEL * (target != own) + INSERT * len(path), action, path))
    return sorted(found, key=lambda c: (c[2], _rank(c)))


def _rank(choice: tuple) -> int:
    """Order of a choice among equally cheap ones."""
    _, target, _, action, path = choice
    return 4 * (3 * bool(path) + ("keep", "merge", "relabel").index(action)) + target


def _table(role: str | None) -> tuple[np.ndarray, dict]:
    entries, best = np.full((4, 4), FAR << BITS, np.int64), {}
    for choice in _choices(role):
        if (choice[0], choice[1]) not in best:
            entries[choice[0], choice[1]] = choice[2] << BITS | _rank(choice)
            best[choice[0], choice[1]] = choice
    return entries, best


_TABLES = {role: _table(role) for role in (*ROLES, None)}
_ENDING = np.array([0 if s in (START, *FINAL) else INSERT for s in range(4)])


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Least cost from state to state over all matrices, and the rank of each entry's choices."""
    costs, ranks = np.where(np.eye(4, dtype=bool), 0, FAR), np.zeros((4, 4), np.int64)
    low = (1 << BITS) - 1
    for m in matrices:
        whole = np.minimum(costs[:, :, None] + (m >> BITS)[None, :, :], FAR)
        keys = (whole << 2 * BITS) | (ranks << BITS)[:, :, None] | (m & low)[None, :, :]
        least = keys.min(axis=1)
        costs = least >> 2 * BITS
        ranks = np.unique(least & ((1 << 2 * BITS) - 1), return_inverse=True)[1].reshape(4, 4)
    return costs << BITS | ranks


def states_between(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """States before, between and after the matrices on the way taken from ``first`` to ``last``."""
    ahead = [np.where(np.arange(4) == last, 0, FAR)]
    for m in reversed(matrices):
        ahead.append(np.minimum(((m >> BITS) + ahead[-1][None, :]).min(axis=1), FAR))
    ahead.reverse()
    states = [first]
    for m, after in zip(matrices, ahead[1:], strict=True):
        states.append(int((m[states[-1]] + (after << BITS)).argmin()))
    return states


def repaired(roles: list[str | None], first: int, last: int) -> list[tuple[str, str, list[str]]]:
    """Per turn: its role in the repair, the action, and the roles inserted before it."""
    tables = [_TABLES[_known(r)] for r in roles]
    states = states_between([t[0] for t in tables], first, last)
    found = []
    for (_, best), before, after in zip(tables, states, states[1:], strict=False):
        _, target, _, action, path = best[before, after]
        found.append((ROLES[target - 1], action, [ROLES[p - 1] for p in path]))
    return found


def _flat(column: pa.Array) -> list[np.ndarray]:
    return [np.array(c, np.int64).reshape(-1, 4, 4) for c in column.to_pylist()]


def _sum_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals = [product([_TABLES[_known(r)][0] for r in roles]).ravel() for roles in batch.column("roles").to_pylist()]
        yield pa.record_batch({"conv": batch.column("conv"), "at": batch.column("at"), "costs": pa.array(totals, pa.list_(pa.int64()))})


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals = [product(list(m)).ravel() for m in _flat(batch.column("costs"))]
        yield pa.record_batch({"conv": batch.column("conv"), "at": batch.column("at"), "costs": pa.array(totals, pa.list_(pa.int64()))})


def _split(chunk: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last state of every child of a chunk of chunks."""
        for batch in batches:
            rows = []
            for conv, at, costs, first, last in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "costs", "first", "last")), strict=True):
                states = states_between(list(np.array(costs, np.int64).reshape(-1, 4, 4)), first, last)
                rows += [(conv, at * chunk + k, states[k], states[k + 1]) for k in range(len(states) - 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "at", "first", "last"])

    return split


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for roles, first, last in zip(*(batch.column(c).to_pylist() for c in ("roles", "first", "last")), strict=True):
            out.append([{"role": r, "action": a, "before": b} for r, a, b in repaired(roles, first, last)])
        kind = pa.list_(pa.struct([("role", pa.string()), ("action", pa.string()), ("before", pa.list_(pa.string()))]))
        yield pa.record_batch({"conv": batch.column("conv"), "at": batch.column("at"), "fixed": pa.array(out, kind)})


def _gathered(rows: DataFrame, item: str, alias: str, chunk: int) -> DataFrame:
    """Chunks of up to ``chunk`` items, in order of ``place``."""
    items = F.array_sort(F.collect_list(F.struct("place", item)))
    return rows.groupBy("conv", F.floor(F.col("place") / chunk).alias("at")).agg(items.alias("items")).select("conv", "at", F.col("items")[item].alias(alias))


def formatted(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired turns of ``turns (conv_id, turn, role, text)``, in pieces.

    ``conv_id, place, part, role, action, cost, piece``: ``place`` numbers the
    input turns of a conversation from 0, ``part`` the rows of one place
    (inserted turns before the turn itself). The pieces of a conversation in
    order of place and part are its rendered text.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("one"))
    rows = materialize(running_total(rows, "conv", ["turn", "role", "text"], "one", "place"), "turns")
    chunks = materialize(_gathered(rows, "role", "roles", chunk), "chunks")
    matrix = "conv string, at bigint, costs array<bigint>"
    levels = [materialize(chunks.mapInArrow(_sum_turns, matrix), "level")]
    parents = []
    while not levels[-1].where("at > 0").isEmpty():
        below = levels[-1].withColumnRenamed("at", "place")
        parents.append(_gathered(below, "costs", "costs", chunk).withColumn("costs", F.flatten("costs")))
        levels.append(materialize(parents[-1].mapInArrow(_sum_chunks, matrix), "level"))
    ends = F.array(*[F.col("costs")[s] + (int(_ENDING[s]) << BITS) for s in range(4)])  # from START, the first row of the matrix
    known = levels[-1].select("conv", "at", F.lit(START).alias("first"), (F.array_position(ends, F.array_min(ends)) - 1).cast("int").alias("last"), F.shiftright(F.array_min(ends), BITS).alias("total"))
    finals = materialize(known, "finals")
    known = finals.drop("total")
    for parent in reversed(parents):
        known = materialize(parent.join(known, ["conv", "at"]).mapInArrow(_split(chunk), "conv string, at bigint, first int, last int"), "states")
    fixed = chunks.join(known, ["conv", "at"]).mapInArrow(
        _decode, "conv string, at bigint, fixed array<struct<role string, action string, before array<string>>>")
    fixed = fixed.select("conv", "at", F.posexplode("fixed").alias("k", "fix")).select("conv", (F.col("at") * chunk + F.col("k")).alias("place"), "fix.*")
    fixed = fixed.withColumnRenamed("role", "new_role")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("turns"))
    final = finals.select("conv", "last").join(sizes, "conv").select(
        "conv", (F.col("turns") - 1).alias("place"), (F.col("last") == SYSTEM).alias("tail"), F.lit(True).alias("ends"))
    joined = rows.join(fixed.hint("merge"), ["conv", "place"]).join(final, ["conv", "place"], "left")
    close, opening = F.lit("<|end|>\n"), lambda role: F.concat(F.lit("<|"), role, F.lit("|>\n"))
    cost = F.when(F.col("action") == "keep", 0).when(F.col("action") == "relabel", RELABEL).otherwise(
        MERGE + F.when(F.col("new_role").eqNullSafe(F.col("role")), 0).otherwise(RELABEL))
    piece = lambda role, action, cost, text: F.struct(role.alias("role"), action.alias("action"), cost.cast("int").alias("cost"), text.alias("text"))
    ended = F.coalesce("ends", F.lit(False))
    own = piece(F.col("new_role"), F.col("action"), cost, F.col("text"))
    before = F.transform("before", lambda r: piece(r, F.lit("insert"), F.lit(INSERT), F.lit("")))
    tail = F.when(F.coalesce("tail", F.lit(False)), F.array(piece(F.lit("user"), F.lit("insert"), F.lit(INSERT), F.lit("")))).otherwise(
        F.slice(F.array(own), 1, 0))
    parts = joined.select(
        "conv_id", "place", ended.alias("ended"), F.posexplode(F.concat(before, F.array(own), tail)).alias("part", "p"),
        F.size(F.concat(before, F.array(own), tail)).alias("parts"))
    start = (F.col("place") == 0) & (F.col("part") == 0)
    head = F.when(F.col("p.action") == "merge", F.lit("\n")).otherwise(
        F.concat(F.when(start, F.lit("")).otherwise(close), opening(F.col("p.role"))))
    foot = F.when(F.col("ended") & (F.col("part") == F.col("parts") - 1), F.concat(F.lit("\n"), close)).otherwise(F.lit(""))
    lead = F.when(start | (F.col("p.action") == "merge"), F.lit("")).otherwise(F.lit("\n"))
    return parts.select("conv_id", "place", "part", "p.role", "p.action", "p.cost", F.concat(lead, head, F.col("p.text"), foot).alias("piece"))
