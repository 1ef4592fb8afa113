"""Columns of the caller that operators carry through without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots, spaces and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(names: list[str]) -> list[Column]:
    return [named(c) for c in names]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores, so that no column of ``docs`` is called that."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(docs: DataFrame, *used: str) -> list[str]:
    return [c for c in docs.columns if c.lower() not in used]


def bundle(names: list[str]) -> Column:
    """The columns in one struct, by place."""
    return F.struct(F.lit(0).alias("none"), *[named(c).alias(f"c{i}") for i, c in enumerate(names)])


def unbundled(names: list[str], struct: str = "rest") -> dict[str, Column]:
    """The columns of a bundle under their names."""
    return {c: F.col(struct).getField(f"c{i}").alias(c) for i, c in enumerate(names)}


def hash_of(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns; maps, which have no order, by their text."""
    return F.xxhash64(*[F.to_json(F.struct(named(c))) if "map<" in kind else named(c) for c, kind in docs.dtypes])
