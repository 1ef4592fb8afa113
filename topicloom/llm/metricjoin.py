"""Near-duplicate vectors by an exact metric range join.

Two vectors with the same label are linked when their cosine is ``COSINE`` or
more. On unit vectors that is a Euclidean distance of at most ``RADIUS``, a
metric, so:

1. Equal vectors of a label are one class with a multiplicity.
2. Each label gets pivots among its own classes, one per ``CELL`` classes and at
   most ``PIVOTS``; a vector's *home* is the cell of its nearest pivot.
3. A vector is also replicated to a foreign cell unless the triangle inequality
   rules it out: a vector at home there lies beyond the plane between the two
   pivots, at least ``(d_foreign^2 - d_home^2) / (2 d_pivots)`` away, and within
   the foreign cell's reach of its pivot. Partners of a vector are thus all
   found in its home cell, and cells are joined independently.
4. A cell is cut into blocks of about ``BLOCK`` rows; home blocks meet all blocks
   of the cell in a task each, so a label or cell with a third of all rows is many
   tasks. A task sends back one count and one component edge per home row, never
   pairs.

Pivots steer only the work, not the result. On data without structure the planes
rule out little (every cell is replicated to nearly all others) and the join
costs as much as all pairs of a label in blocks, which any exact join may.

Defined results: a vector that is null, zero, or holds null or non-finite
components, or has no label, links with nothing; vectors of unequal length are
not compared; each row counts as one vector, also when it repeats a ``vec_id``
(whose rows are one node of the components); null ``vec_id``: linked and counted
like others but without a component of its own (null, kept). Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.graph import components
from topicloom.storage import materialize

COSINE = 0.93
RADIUS = (2 - 2 * COSINE) ** 0.5
CELL = 4096
PIVOTS = 64
BLOCK = 2048
SLICE = 16384
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Home cell, distance to its pivot and candidate foreign cells with the plane's distance ruled in."""
    columns = ["label", "dim", "cell", "at_home", "gap", "key", "copies", "vector"]
    if not len(rows) or not len(pivots):
        return pd.DataFrame(columns=columns)
    pivots = pivots.sort_values("cell")
    points, centres = _unit(_matrix(rows["vector"])), _unit(_matrix(pivots["vector"]))
    squares = np.maximum(2 - 2 * points @ centres.T, 0)
    home = squares.argmin(axis=1)
    nearest = squares[np.arange(len(points)), home]
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[home]
    planes = (squares - nearest[:, None]) / np.maximum(2 * apart, 1e-12)
    reached = planes <= RADIUS + SLACK
    reached[np.arange(len(points)), home] = True
    row, cell = np.nonzero(reached)
    out = rows.iloc[row].reset_index(drop=True)
    out["at_home"] = home[row] == cell
    out["gap"] = np.sqrt(squares[row, cell])
    out["cell"] = pivots["cell"].to_numpy()[cell]
    return out[columns]


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of this task's home rows: a count per row, and each row's least partner of its local component."""
    home, other = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(home) or not len(other):
        return pd.DataFrame({"key": [], "n": [], "root": []}).astype({"key": "int64", "n": "int64", "root": "int64"})
    left, right = _unit(_matrix(home["vector"])), _unit(_matrix(other["vector"]))
    at, to = np.nonzero(left @ right.T >= COSINE)
    counts = np.bincount(at, weights=other["copies"].to_numpy()[to], minlength=len(home))
    keys, positions = np.unique(np.concatenate([home["key"], other["key"]]), return_inverse=True)
    at, to = positions[: len(home)][at], positions[len(home) :][to]
    label = np.arange(len(keys))
    while True:  # least label of each local component, with pointers doubled
        before = label.copy()
        low = np.minimum(label[at], label[to])
        np.minimum.at(label, at, low)
        np.minimum.at(label, to, low)
        label = label[label]
        if (label == before).all():
            break
    mine = pd.DataFrame({"key": home["key"].to_numpy(), "n": counts.astype(np.int64), "root": keys[label[positions[: len(home)]]]})
    theirs = other["key"].to_numpy()
    theirs = pd.DataFrame({"key": theirs, "n": 0, "root": keys[label[positions[len(home) :]]]})
    return pd.concat([mine, theirs[theirs["key"] != theirs["root"]]])


def vector_links(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False))
    rows = materialize(rows.withColumn("usable", usable), "vectors")
    classes = rows.where("usable").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("node"))
    classes = materialize(
        classes.select("label", F.size("vector").alias("dim"), "vector", "copies", "node")
        .withColumn("key", F.monotonically_increasing_id()), "classes")

    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    sized = groups.select("label", "dim", F.ceil(F.col("size") / SLICE).cast("int").alias("slices"), F.least(F.ceil(F.col("size") / CELL), F.lit(PIVOTS)).alias("cells"))
    drawn = Window.partitionBy("label", "dim").orderBy(F.xxhash64("vector"), "key")
    pivots = (
        classes.select("label", "dim", "vector", "key", F.row_number().over(drawn).alias("cell")).where(F.col("cell") <= PIVOTS)
        .join(sized, ["label", "dim"]).where("cell <= cells")
        .select("label", "dim", "cell", "vector", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    )
    pivots = materialize(pivots, "pivots")
    dealt = classes.join(sized, ["label", "dim"]).withColumn("slice", F.pmod("key", "slices").cast("int"))
    kinds = "label string, dim int, cell int, at_home boolean, gap double, key bigint, copies bigint, vector array<double>"
    assigned = (
        dealt.select("label", "dim", "slice", "key", "copies", "vector").groupBy("label", "dim", "slice")
        .cogroup(pivots.groupBy("label", "dim", "slice")).applyInPandas(_assign, kinds)
    )
    assigned = materialize(assigned, "assigned")
    reach = assigned.groupBy("label", "dim", "cell").agg(
        F.max(F.when(F.col("at_home"), F.col("gap"))).alias("reach"),
        F.count(F.when(F.col("at_home"), 1)).alias("homes"), F.count("*").alias("all"))
    near = assigned.join(reach, ["label", "dim", "cell"]).where(F.col("gap") <= F.col("reach") + RADIUS + SLACK)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    near = near.withColumn("home_blocks", blocks("homes")).withColumn("all_blocks", blocks("all"))
    task = ["label", "dim", "cell", "hb", "ob"]
    home = near.where("at_home").select(
        "label", "dim", "cell", F.pmod(F.xxhash64("key"), "home_blocks").cast("int").alias("hb"),
        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("ob"), F.lit(0).alias("side"), "key", "copies", "vector")
    other = near.select(
        "label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("hb"),
        F.pmod(F.xxhash64("key"), "all_blocks").cast("int").alias("ob"), F.lit(1).alias("side"), "key", "copies", "vector")
    compared = home.union(other).groupBy(*task).applyInPandas(_compare, "key bigint, n bigint, root bigint")
    compared = materialize(compared, "compared")
    counts = compared.groupBy("key").agg(F.sum("n").alias("n"))
    nodes = classes.select("key", "node")
    edges = compared.where("key <> root").select("key", "root").distinct()
    edges = edges.join(nodes, "key").join(nodes.select(F.col("key").alias("root"), F.col("node").alias("b")), "root")
    used = rows.where("usable").join(classes.select("label", "vector", "key", "node"), ["label", "vector"]).select("vec_id", "key", "node")
    own = used.where("vec_id <> node")
    labels = components(edges.select(F.col("node").alias("a"), "b").union(own.select(F.col("vec_id").alias("a"), F.col("node").alias("b"))))
    counted = used.select("vec_id", "key").union(rows.where("not usable").select("vec_id", F.lit(None).cast("bigint").alias("key")))
    result = counted.join(counts, "key", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
