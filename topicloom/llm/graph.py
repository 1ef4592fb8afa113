"""Connected components and prefix sums as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.storage import Workspace, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``: the least node reachable.

    Large-star and small-star steps take turns until the edges are stars around
    their least nodes, a number of rounds that grows with the logarithm of the longest path. Every
    round is one saved table; minima are combined before the shuffle, so a node
    with very many neighbours is no burden. Null ends and loops are ignored.
    """
    work = Workspace(edges.sparkSession)
    one = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current = work.save(one.where("a is not null and b is not null and a <> b").distinct(), "edges")
    while not _is_star(current):
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        small = large.join(least, "hi").select(F.explode(pairs).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        following = work.save(small, "round")
        work.drop(current)
        current = following
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _is_star(edges: DataFrame) -> bool:
    """Whether every greater end has one lesser end, and that is no greater end itself."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def running_total(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over earlier rows of the same ``group``.

    A group may hold most of the rows: the rows are range partitioned by group
    and order (and, so that equal rows can part too, by a row number of no
    other meaning), saved, summed within each (partition, group), and offset by
    the sums of that group's earlier partitions. Only those sums, one per
    partition and group in it, meet in a window.
    """
    keys = [group, *order]
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "_tie")
        .withColumn("_part", F.spark_partition_id())
    )
    placed = materialize(placed, "ranged")
    sums = placed.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part", group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = local.join(
        offsets.withColumnRenamed(group, "_group").withColumnRenamed("_part", "_at"),
        F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")), "left",
    )
    total = (F.col("_before") + F.col("_offset")).cast("bigint")
    return joined.withColumn(name, total).drop("_tie", "_part", "_before", "_offset", "_group", "_at")
