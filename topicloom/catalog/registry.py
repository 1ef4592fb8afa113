"""The query registry, the inputs queries share, and the matching SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators import gibbs, shards
from topicloom.operators import texts as X
from topicloom.operators import tokens as T
from topicloom.operators.vocab import build_vocab_sorted
from topicloom.params import TopicParams
from topicloom.storage import Workspace, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = 10
BATCHES = 4
PARAMS = TopicParams(num_topics=K, duration=1)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Inputs -----------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def talks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as a second corpus."""
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 4294967296 + F.col("turn")).alias("doc_id"), "text"
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as a third corpus."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.token_table(docs(spark, sf))


def talk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.token_table(talks(spark, sf))


def item_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.token_table(items(spark, sf))


def drawn(tokens: DataFrame, sweep: int = 0) -> DataFrame:
    return gibbs.init_topics_uniform(tokens, PARAMS, sweep)


def doc_vocab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary with dense ids, saved frequencies) of the documents."""
    freqs = materialize(T.term_frequency(doc_tokens(spark, sf)), "freqs")
    return build_vocab_sorted(freqs), freqs


def encoded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, saved tokens (doc_id, pos, wid, topic)) of the documents."""
    vocab, freqs = doc_vocab(spark, sf)
    tokens = drawn(T.encode_docs(doc_tokens(spark, sf), vocab, freqs))
    return vocab, materialize(tokens, "encoded")


def packed_docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, saved packed rows) of the same documents and topics as ``encoded``."""
    work = Workspace(spark)
    coded = work.save(X.coded_texts(docs(spark, sf)), "texts")
    freqs = materialize(X.coded_frequency(coded), "freqs")
    vocab, tokens = build_vocab_sorted(freqs), freqs.agg(F.sum("freq")).first()[0] or 0
    packed = X.pack_texts(coded, vocab, PARAMS, shards.shard_count(tokens, PARAMS))
    work.drop(coded)
    return vocab, packed


def term_rows(spark: SparkSession, sf: str, **more: Column) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, saved rows (wid, n and ``more`` aggregates of ``doc_id``)) of the drawn documents.

    Counted by term in one pass and named by ids afterwards: a row per term meets the vocabulary, not one per token.
    """
    counted = drawn(doc_tokens(spark, sf)).groupBy("term").agg(
        V.count_topics(F.col("topic"), K).alias("n"), *[column.alias(name) for name, column in more.items()])
    rows = materialize(counted, "term-rows")
    vocab = build_vocab_sorted(rows.select("term", V.total(F.col("n"), K).cast("bigint").alias("freq")))
    return vocab, materialize(rows.join(vocab.select("term", "wid"), "term").select("wid", "n", *more), "rows")


def batch_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, saved rows (wid, b, n)): the same per batch number."""
    size = chunk_of(spark, sf)
    tokens = drawn(doc_tokens(spark, sf)).withColumn("b", F.floor(F.col("doc_id") / size).cast("bigint"))
    rows = materialize(V.count_vectors(tokens, ["term", "b"], K), "term-rows")
    freqs = rows.groupBy("term").agg(F.sum(V.total(F.col("n"), K)).cast("bigint").alias("freq"))
    vocab = build_vocab_sorted(freqs)
    return vocab, materialize(rows.join(vocab.select("term", "wid"), "term").select("wid", "b", "n"), "rows")


def chunk_of(spark: SparkSession, sf: str) -> int:
    """Chunk size that cuts the documents into ``BATCHES`` batches; 1 without documents."""
    last = table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    return 1 if last is None else max((last + BATCHES) // BATCHES, 1)


def batched(spark: SparkSession, sf: str) -> DataFrame:
    """Document tokens with topics and ``batch_id``."""
    size = chunk_of(spark, sf)
    return drawn(doc_tokens(spark, sf)).withColumn("batch_id", F.floor(F.col("doc_id") / size).cast("bigint"))


def wide(rows: DataFrame, *keys: str, value: str = "n", digits: int = 6) -> DataFrame:
    """Vector rows as rounded columns n0, n1, ..."""
    return rows.select(*keys, *[F.round(V.at(F.col(value), i), digits).alias(f"n{i}") for i in range(K)])


# SQL fragments ------------------------------------------------------------------


def tokens_sql(name: str, source: str, doc_id: str) -> str:
    return rf"""{name} AS (
  SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term
  FROM (SELECT {doc_id} AS doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM {source})
)"""


DOC_TOKENS = tokens_sql("tok", "documents", "doc_id")
TALK_TOKENS = tokens_sql("talk", "conversations", "conv_id * 4294967296 + turn")
ITEM_TOKENS = tokens_sql("item", "benchmark", "item_id")


def freq_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT term, count(*) AS freq FROM {source} GROUP BY term)"


def vocab_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT term, freq, row_number() OVER (ORDER BY term) - 1 AS wid FROM {source})"


def uniform_sql(sweep: int | str, alias: str = "") -> str:
    """The keyed uniform of a token row."""
    dot = f"{alias}." if alias else ""
    return (
        f"(CAST(('0x' || substr(md5(concat_ws(':', '{PARAMS.seed}', {dot}doc_id, {dot}pos, {sweep})), 1, 8)) AS BIGINT)"
        " / CAST(4294967296 AS DOUBLE))"
    )


def topic_sql(sweep: int | str = 0, alias: str = "") -> str:
    return f"CAST(floor({uniform_sql(sweep, alias)} * {K}) AS INTEGER)"


def drawn_sql(name: str, source: str, sweep: int | str = 0) -> str:
    return f"{name} AS (SELECT doc_id, pos, term, {topic_sql(sweep)} AS topic FROM {source})"


def sums_sql(topic: str = "topic", weight: str = "1.0") -> str:
    """K conditional sums n0, n1, ..."""
    return ", ".join(
        f"sum(CASE WHEN {topic} = {i} THEN CAST({weight} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS n{i}"
        for i in range(K)
    )


def cells_sql(pattern: str, sep: str = ", ") -> str:
    """``pattern`` with {i} filled for every topic."""
    return sep.join(pattern.replace("{i}", str(i)) for i in range(K))


def unpivot_sql(source: str, key: str, value: str = "cnt") -> str:
    """Wide rows back to (key, topic, value)."""
    return " UNION ALL ".join(
        f"SELECT {key}, CAST({i} AS INTEGER) AS topic, n{i} AS {value} FROM {source}" for i in range(K)
    )


def draw_sql(weights: list[str], u: str) -> str:
    """Index of the first running sum above u * total; sums taken in topic order."""
    sums = ["(" + " + ".join(weights[: i + 1]) + ")" for i in range(len(weights))]
    whole = sums[-1]
    below = " + ".join(f"CASE WHEN {s} <= {u} * {whole} THEN 1 ELSE 0 END" for s in sums[:-1])
    return f"CAST({below} AS INTEGER)"


def with_sql(*parts: str) -> str:
    """A WITH clause whose parts are computed once, however often they are used."""
    return "WITH " + ",\n".join(part.replace(" AS (", " AS MATERIALIZED (", 1) for part in parts) + "\n"


ENCODED = (
    DOC_TOKENS, freq_sql("freq", "tok"), vocab_sql("voc", "freq"), drawn_sql("dr", "tok"),
    "enc AS (SELECT doc_id, pos, wid, term, topic FROM dr JOIN voc USING (term))",
)
CHUNK = f"(SELECT (max(doc_id) + {BATCHES}) // {BATCHES} FROM documents)"


def batch_sql(source: str = "tok") -> str:
    """Drawn document tokens with batch_id, as CTE ``bat``."""
    return f"bat AS (SELECT doc_id, pos, term, {topic_sql()} AS topic, doc_id // {CHUNK} AS batch_id FROM {source})"
