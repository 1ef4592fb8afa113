"""Global ranks and top-N reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.storage import materialize


def global_rank(df: DataFrame, order: list[Column], name: str, start: int | Column = 1) -> tuple[DataFrame, int]:
    """Number all rows 'start, start+1, ...' in ``order`` without a one-task window.

    Rows are range-partitioned and sorted; every row notes its partition and its
    place there; the place is then shifted by the sizes of the partitions before.
    The sorted rows are written once in between, so both passes see the same
    boundaries even if an executor is lost. ``order`` should be unique per row.
    Returns the numbered rows and how many there are.
    """
    places = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    # One number per sort partition comes to the driver, and goes back as a list.
    sizes = places.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).orderBy("_part").collect()
    rows, before = [], 0
    for number, size in sizes:
        rows.append(f"({number}L, {before}L)")
        before += size
    listed = ", ".join(rows) or "(0L, 0L)"
    shifts = df.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t(_part, _shift)")
    first = start if isinstance(start, Column) else F.lit(start)
    ranked = (
        places.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, (F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_shift") + first).cast("bigint"))
        .drop("_place", "_part", "_shift")
    )
    return ranked, before


def with_global_rank(df: DataFrame, order: list[Column], name: str, start: int | Column = 1) -> DataFrame:
    return global_rank(df, order, name, start)[0]


def top_words(cells: DataFrame, t: int, word: str = "term", value: str = "cnt") -> DataFrame:
    """``t`` largest words per topic, ties by word. Catalyst prunes each input
    partition to ``t`` rows per topic (WindowGroupLimit) before the shuffle."""
    order = W.partitionBy("topic").orderBy(F.desc(value), F.asc(word))
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= t)


def label_words(cells: DataFrame, word: str = "term", value: str = "cnt", skip: int = 5, show: int = 10) -> DataFrame:
    """The words after the ``skip`` most common of each topic, counts cut to integers."""
    return top_words(cells, skip + show, word, value).where(F.col("rank") > skip).withColumn(
        value, F.col(value).cast("int")
    )


def doc_topic_profile(counts: DataFrame) -> DataFrame:
    """Per document ``"topic(cnt) topic(cnt)"``, largest count first, ties by topic.

    The list per document has at most K entries.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "topic", "cnt")))
    return counts.groupBy("doc_id").agg(ordered.alias("tops")).select(
        "doc_id",
        F.array_join(F.transform("tops", lambda x: F.format_string("%d(%d)", x["topic"], x["cnt"])), " ").alias("profile"),
    )
