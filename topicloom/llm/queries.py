"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import licenses, oracles
from topicloom.llm.collocations import collocations
from topicloom.llm.decontamination import contaminated
from topicloom.llm.fertility import quality
from topicloom.llm.metricjoin import vector_links
from topicloom.llm.minhash import near_duplicates
from topicloom.llm.mixing import taken
from topicloom.llm.packing import packed
from topicloom.llm.prefixtrie import conversation_trie
from topicloom.llm.registry import query, table
from topicloom.llm.resampling import resampled
from topicloom.llm.roles import formatted
from topicloom.llm.substrings import without_repeats
from topicloom.llm.toxicity import scored


@query("op1_license_scan", licenses.oracle_sql())
def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scanned(table(spark, sf, "documents"))


@query("op2_minhash_near_dedup", oracles.NEAR_DUPLICATES)
def op2_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query("op6_substring_dedup", oracles.REPEATS)
def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = without_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_metric_range_join", oracles.VECTOR_LINKS)
def op10_metric_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return vector_links(table(spark, sf, "embeddings"))


@query("op3_tokeniser_fertility")
def op3_tokeniser_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents")).drop("version")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


@query("op8_source_mixing")
def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return taken(table(spark, sf, "documents"))


@query("op4_chat_role_repair")
def op4_chat_role_repair(spark: SparkSession, sf: str) -> DataFrame:
    return formatted(table(spark, sf, "conversations"))


@query("op9_importance_resampling")
def op9_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampled(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_noisy_channel_toxicity")
def op7_noisy_channel_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_benchmark_decontamination", oracles.CONTAMINATED)
def op12_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op13_phrase_collocations", oracles.COLLOCATIONS)
def op13_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


@query("op11_conversation_prefix_trie", oracles.PREFIX_TRIE)
def op11_conversation_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie(table(spark, sf, "conversations"))
