"""Registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def known_to_workers(spark: SparkSession) -> None:
    """Put this package on the path of Python workers that see the driver's folders (others get it with the job's files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB twin."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            known_to_workers(spark)
            return fn(spark, sf)

        LLM_QUERIES[name] = run
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
