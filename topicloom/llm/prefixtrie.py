"""The trie of conversation prefixes, by van Emde Boas recursion.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that start with it. The sequences are cut at half depth, again and again:

1. *Names*. A block of 2^j turns is named by a digest of its halves' names, the
   prefix before a cut by a digest of the prefix before the block that ends there and that
   block. A conversation of up to ``CHUNK`` turns is named in one row; of a longer
   one the chunks are the turns of a shorter conversation, which is named first,
   by the same step, and gives every chunk the names at its ends.
2. *Nodes*: rows of equal names are counted, combined before the shuffle.
3. *Totals*, from blocks of one level of depth up to the whole: a block of depth 2^(j+1) is an
   upper trie and the lower forests that hang from the cut, all of whose totals
   are known by then. The sum of a forest is grafted onto the cut prefix it hangs
   from and onto that one's ancestors in the upper trie. All blocks of
   a depth go in one job; a round is one saved table, and there are as many as the
   greatest depth has binary digits. The ancestors of a cut prefix are read from the names of its
   least member, a chunk at a time.

Turns are numbered by a range-partitioned running count, so a conversation with
a third of all rows is many tasks. Ends are hashed from strings of at most
``IDS`` ids each, in order, in bounded memory.

Defined results: turns are read in order of ``turn`` (null first), ties by role
and text; null role or text is empty; rows with null ``conv_id`` belong to no
conversation and are left out; repeated rows are turns of their own; extra columns
are ignored; an empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import running_total
from topicloom.storage import Workspace

CHUNK = 256  # a power of two
IDS = 4096
SHARED = 6
GROUP = 100
ROOT = b""


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(len(p).to_bytes(1, "little") + p for p in parts), digest_size=16).digest()


def prefix_names(turns: list[bytes], root: bytes) -> list[bytes]:
    """Names of the first 1, 2, ... of ``turns`` after the prefix ``root``."""
    names = [root, *turns]
    size, blocks = 1, list(turns)
    while blocks:
        for k in range(0, len(blocks), 2):  # the block from place k * size ends at an odd multiple of its size
            names[(k + 1) * size] = blocks[k], k * size
        blocks = [_digest(b"b", blocks[k], blocks[k + 1]) for k in range(0, len(blocks) - 1, 2)]
        size *= 2
    for place in range(1, len(names)):
        block, before = names[place]
        names[place] = _digest(b"p", names[before], block)
    return names[1:]


def block_name(turns: list[bytes]) -> bytes:
    """Name of a whole number of turns that is a power of two."""
    while len(turns) > 1:
        turns = [_digest(b"b", turns[k], turns[k + 1]) for k in range(0, len(turns), 2)]
    return turns[0]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for turns, root, close in zip(*(batch.column(c).to_pylist() for c in ("turns", "root", "close")), strict=True):
            names = prefix_names(turns, ROOT if root is None else root)
            found.append(names if close is None else [*names[:-1], close])
        rest = {c: batch.column(c) for c in batch.schema.names if c not in ("turns", "root", "close")}
        yield pa.record_batch(rest | {"names": pa.array(found, pa.list_(pa.binary()))})


def _block_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [block_name(turns) for turns in batch.column("turns").to_pylist()]
        yield pa.record_batch({"conv": batch.column("conv"), "at": batch.column("at"), "turn": pa.array(names, pa.binary())})


def _gathered(rows: DataFrame, chunk: int, *columns: str) -> DataFrame:
    """Rows ``(conv, place, ...)`` as chunks ``(conv, at, ...)`` with arrays of the columns."""
    items = F.array_sort(F.collect_list(F.struct("place", *columns)))
    grouped = rows.groupBy("conv", F.floor(F.col("place") / chunk).alias("at")).agg(items.alias("items"))
    return grouped.select("conv", "at", *[F.col("items")[c].alias(f"{c}s") for c in columns])


def _rooted(chunks: DataFrame, chunk: int, work: Workspace) -> DataFrame:
    """``chunks (conv, at, turns)`` with the names of the prefixes before (``root``) and after (``close``) each.

    Both are null in conversations of one chunk, and ``close`` after an unfilled last chunk.
    """
    longer = chunks.where("at = 1").select("conv")
    if longer.isEmpty():
        return chunks.withColumn("root", F.lit(None).cast("binary")).withColumn("close", F.lit(None).cast("binary"))
    full = chunks.join(longer, "conv", "left_semi").where(F.size("turns") == chunk).select("conv", "at", "turns")
    units = full.mapInArrow(_block_names, "conv bigint, at bigint, turn binary").withColumnRenamed("at", "place")
    upper = work.save(_gathered(units, chunk, "turn"), "upper")
    named = _rooted(upper, chunk, work).mapInArrow(_named, "conv bigint, at bigint, names array<binary>")
    ends = named.select("conv", F.posexplode("names").alias("k", "close"), "at").select("conv", (F.col("at") * chunk + F.col("k")).alias("at"), "close")
    ends = work.save(ends, "ends")
    starts = ends.select("conv", (F.col("at") + 1).alias("at"), F.col("close").alias("root"))
    return chunks.join(starts, ["conv", "at"], "left").join(ends, ["conv", "at"], "left")


def rebuilt(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does: ``(conv)`` and ``(conv, place, turn, size)``.

    Conversation c takes the first h turns of c - c % ``group`` (all if it has
    fewer, none if there is no such conversation) and goes on with its own turns after its first h, where h =
    crc32(c) % ``shared``. ``turn`` names a turn's role and text, ``size`` counts
    the code points of its text.
    """
    work = Workspace(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("order"), role.alias("role"),
        text.alias("text"), F.lit(1).alias("one"))
    rows = running_total(rows, "conv", ["order", "role", "text"], "one", "place")
    rows = work.save(rows.select("conv", "place", _turn_name().alias("turn"), F.length("text").cast("bigint").alias("size")), "turns")
    convs = rows.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % shared)
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % group)
    heads = rows.where((F.col("conv") % group == 0) & (F.col("place") < shared - 1)).select(
        F.col("conv").alias("base"), F.col("place"), "turn", "size")
    had = heads.groupBy("base").agg(F.count("*").alias("had"))
    convs = work.save(convs.join(had, "base", "left").withColumn("taken", F.least("h", F.coalesce("had", F.lit(0)))), "conversations")
    first = convs.join(heads, "base").where("place < h").select("conv", "place", "turn", "size")
    own = rows.join(convs.select("conv", "h", "taken"), "conv").where("place >= h").select(
        "conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn", "size")
    return convs.select("conv"), work.save(first.union(own), "rebuilt")


def _turn_name() -> Column:
    role, text = F.col("role"), F.col("text")
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def prefix_trie(convs: DataFrame, turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of ``convs (conv)`` with ``turns (conv, place, turn, size)``.

    Nodes ``(name, parent, depth, conv_id, parent_conv_id, n_convs, n_children,
    n_leaves, saved)``: ``conv_id`` is the least member, ``saved`` the sum of
    (members - 1) x size over the subtree. Ends ``(name, conv)``: where each conversation ends.
    """
    work = Workspace(convs.sparkSession)
    chunks = work.save(_gathered(turns, chunk, "turn", "size"), "chunks")
    paths = work.save(_rooted(chunks, chunk, work).mapInArrow(_path, "conv bigint, at bigint, names array<binary>, parents array<binary>, sizes array<bigint>"), "paths")
    place = F.col("at") * chunk + F.col("k") + 1
    steps = paths.select("conv", "at", F.posexplode(F.arrays_zip("names", "parents", "sizes")).alias("k", "step")).select(
        "conv", place.alias("depth"), F.col("step.names").alias("name"), F.col("step.parents").alias("parent"), F.col("step.sizes").alias("size"))
    whole = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("size"), "conv_id", "n_convs")
    nodes = steps.groupBy("name", "parent", "depth", "size").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = work.save(nodes.unionByName(whole), "nodes")
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    known = nodes.join(children.withColumnRenamed("parent", "name"), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = work.save(known.join(above, "parent", "left"), "known")
    leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("size")
    totals = work.save(known.select("name", "parent", "depth", "parent_conv_id", leaf.alias("n_leaves"), saved.alias("saved")), "totals")
    deepest = totals.agg(F.max("depth")).first()[0] or 0
    for level in range((int(deepest) - 1).bit_length() if deepest > 1 else 0):
        totals = _graft(totals, paths, 1 << level, chunk, work)
    top = totals.where("depth <= 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")).where("n_leaves is not null")
    summed = totals.where("depth > 0").select("name", "n_leaves", "saved").union(top.select(F.lit(ROOT), "n_leaves", "saved"))
    lengths = turns.groupBy("conv").agg(F.count("*").alias("turns"))
    last = paths.join(lengths, "conv").where(F.col("at") == F.floor((F.col("turns") - 1) / chunk)).select(F.element_at("names", -1).alias("name"), "conv")
    ends = last.union(convs.join(lengths, "conv", "left_anti").select(F.lit(ROOT).alias("name"), "conv"))
    return known.drop("size").join(summed, "name"), ends


def _path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the prefixes in a chunk, and of those one turn shorter."""
    for batch in batches:
        roots = batch.column("root").to_pylist()
        for named in _named(iter([batch])):
            names = named.column("names").to_pylist()
            parents = [[ROOT if root is None else root, *own[:-1]] for root, own in zip(roots, names, strict=True)]
            yield pa.record_batch({
                "conv": batch.column("conv"), "at": batch.column("at"), "names": named.column("names"),
                "parents": pa.array(parents, pa.list_(pa.binary())), "sizes": batch.column("sizes"),
            })


def _graft(totals: DataFrame, paths: DataFrame, half: int, chunk: int, work: Workspace) -> DataFrame:
    """Totals within blocks of depth 2 x ``half`` from those within blocks of ``half``.

    Cuts lie at odd multiples m of ``half``; a cut prefix and its ancestors below depth
    m - ``half`` take the sum of the forest that starts one turn deeper.
    """
    cut = F.col("depth") - 1
    forests = totals.where(cut % (2 * half) == half).groupBy("parent", "parent_conv_id", cut.alias("m")).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    if half == 1:
        more = forests.select(F.col("parent").alias("name"), "n_leaves", "saved")
    else:
        low, high = F.col("m") - half, F.col("m")
        spans = forests.select("parent_conv_id", "m", "n_leaves", "saved", F.explode(F.sequence(F.floor(low / chunk), F.floor((high - 1) / chunk))).alias("at"))
        ways = spans.join(paths.select(F.col("conv").alias("parent_conv_id"), "at", "names"), ["parent_conv_id", "at"])
        start = F.greatest(low - F.col("at") * chunk, F.lit(0))
        stop = F.least(high - F.col("at") * chunk, F.lit(chunk))
        more = ways.select(F.explode(F.slice("names", (start + 1).cast("int"), (stop - start).cast("int"))).alias("name"), "n_leaves", "saved")
        more = more.groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    more = more.select("name", F.col("n_leaves").alias("more"), F.col("saved").alias("more_saved"))
    following = work.save(_added(totals, more), "totals")
    work.drop(totals)
    return following


def _added(totals: DataFrame, more: DataFrame) -> DataFrame:
    return totals.join(more, "name", "left").select(
        "name", "parent", "depth", "parent_conv_id", (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with one name as strings of at most ``IDS`` ids."""
    name, ids = None, []

    def run(held: list[int]) -> pa.RecordBatch:
        return pa.record_batch({"name": pa.array([name], pa.binary()), "first": pa.array([held[0]], pa.int64()), "ids": pa.array([",".join(map(str, held))], pa.string())})

    for batch in batches:
        for own, conv in zip(batch.column("name").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (own != name or len(ids) == IDS):
                yield run(ids)
                ids = []
            name = own
            ids.append(conv)
    if ids:
        yield run(ids)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's strings, joined by commas, without holding them."""
    name, state = None, None
    row = lambda: pa.record_batch({"name": pa.array([name], pa.binary()), "sha256": pa.array([state.hexdigest()], pa.string())})
    for batch in batches:
        for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own == name and state is not None:
                state.update(b",")
            else:
                if state is not None:
                    yield row()
                name, state = own, hashlib.sha256()
            state.update(ids.encode())
    if state is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """``(name, sha256)`` of the ids in ``ends (name, conv)``, in numerical order, joined by commas.

    SHA-256 runs through its input once from start to end, so the ids of one node meet in one
    task; they come as few long strings and are not held.
    """
    ordered = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    strings = ordered.mapInArrow(_strings, "name binary, first bigint, ids string")
    return strings.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name binary, sha256 string")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: a row per node, without the names."""
    nodes, ends = prefix_trie(*rebuilt(turns))
    digests = nodes.join(end_digests(ends), "name", "left")
    empty = hashlib.sha256().hexdigest()
    return digests.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.lit(empty)).alias("ends_sha256"))
