"""A training corpus in five stages: quality, near copies, repeated passages, mixture, sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept;
its result is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import fertility, minhash, mixing, packing, substrings
from topicloom.llm.columns import all_of, free_name
from topicloom.llm.registry import known_to_workers
from topicloom.storage import Workspace

#: Tokenizers cannot be expressed in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    kept = fertility.quality(docs).where("kept")
    row, own, version = (free_name(docs, c) for c in ("_row", "_id", "_version"))
    kept = kept.select(F.col("doc_id").alias(own), F.col("version").alias(version))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(row) == F.col(version))
    return docs.withColumn(row, fertility.row_version(docs)).join(kept, same, "left_semi").drop(row)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies; rows without an id stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(all_of(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; documents left without a word go."""
    return substrings.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of the words taken from a document."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(all_of(docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of bounded length."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    known_to_workers(spark)
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
