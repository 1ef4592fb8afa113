"""Sources, sinks and text operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.catalog.registry import (
    BATCHES, CHUNK, DOC_TOKENS, TALK_TOKENS, chunk_of, doc_tokens, docs, drawn_sql, freq_sql, query,
    table, talk_tokens, talks, vocab_sql, with_sql, PARAMS, K,
)
from topicloom.functions.sampling import keyed_uniform
from topicloom.functions.segmenters import WORDS, pattern_segmenter
from topicloom.functions.text import json_terms, letter_terms, single_line, whitespace_terms
from topicloom.operators import tokens as T
from topicloom.operators.vocab import build_vocab_sorted
from topicloom.sources import documents as D
from topicloom.sources import sinks
from topicloom.storage import Workspace, is_directory, list_names, materialize

NEWLINES = "translate(text, chr(10) || chr(13), '  ')"
LETTERS = r"list_filter(string_split_regex(lower({text}), '[^\p{L}]+'), lambda x: x <> '')"


@query("read_text_docs", f"SELECT {NEWLINES} AS text FROM documents")
def read_text_docs(spark, sf):
    """The documents written as text files, one line each, and read by the text reader."""
    path = Workspace(spark).new_path("text")
    docs(spark, sf).select(single_line(F.col("text"))).write.text(path)
    return D.read_text_docs(spark, path).select("text")


@query("read_parquet_docs", "SELECT doc_id, text FROM documents")
def read_parquet_docs(spark, sf):
    return D.read_parquet_docs(spark, f"{sf}/documents.parquet")


@query("read_json_docs", "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def read_json_docs(spark, sf):
    """The documents written as JSON lines and read by the JSON reader."""
    path = Workspace(spark).new_path("json")
    lines = table(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("c"), "lang")))
    lines.write.text(path)
    return D.read_json_docs(spark, path)


@query("read_json_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def read_json_events(spark, sf):
    from topicloom.functions.text import json_field

    return table(spark, sf, "events").select("event_id", json_field(F.col("props"), "k").cast("bigint").alias("k"))


def streamed(spark, sf, work: Workspace):
    """The documents as a stream of about ``BATCHES`` micro-batches.

    A table folder is streamed as it is. A table that is one file would be one
    batch, so it is first cut into one file per batch.
    """
    path, files = f"{sf}/documents.parquet", BATCHES
    if is_directory(spark, path):
        files = sum(name.endswith(".parquet") for name in list_names(spark, path))
    else:
        cut = D.micro_batches(docs(spark, sf), chunk_of(spark, sf))
        path = work.new_path("staged")
        cut.write.partitionBy("batch_id").parquet(path)
    return D.stream_docs(spark, path, "doc_id bigint, text string", -(-files // BATCHES))


@query("stream_read_docs", "SELECT doc_id, text FROM documents")
def stream_read_docs(spark, sf):
    work = Workspace(spark)
    stream = D.stream_docs(spark, f"{sf}/documents.parquet", "doc_id bigint, text string")
    out = work.new_path("out")
    sinks.write_stream(stream, sinks.table_writer(out), work.new_path("checkpoint")).start().awaitTermination()
    return spark.read.parquet(out).select("doc_id", "text")


@query("micro_batch_docs", f"SELECT doc_id, CAST(doc_id // {CHUNK} AS BIGINT) AS batch_id FROM documents")
def micro_batch_docs(spark, sf):
    return D.micro_batches(docs(spark, sf).select("doc_id"), chunk_of(spark, sf))


@query(
    "time_batch_docs",
    "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS batch_id, count(*) AS events,"
    " count(DISTINCT user_id) AS docs FROM events GROUP BY 1",
)
def time_batch_docs(spark, sf):
    cut = D.time_batches(table(spark, sf, "events").select("ts", "user_id"), "ts", "1 day")
    per_user = cut.groupBy("batch_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("batch_id").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("docs"))


@query("write_text", f"SELECT CAST(doc_id // {CHUNK} AS INTEGER) AS batch_id, {NEWLINES} AS line FROM documents")
def write_text(spark, sf):
    work = Workspace(spark)
    out = work.new_path("text")
    write = sinks.text_writer(out)
    lines = D.micro_batches(docs(spark, sf), chunk_of(spark, sf)).select(
        "batch_id", single_line(F.col("text")).alias("line")
    )
    lines = materialize(lines, "lines")  # the texts are read once, not once per batch
    for (batch,) in lines.select("batch_id").distinct().collect():  # BATCHES of them, and one of rows without an id
        write(lines.where(F.col("batch_id").eqNullSafe(batch)).select("batch_id", "line"), "__HIVE_DEFAULT_PARTITION__" if batch is None else batch)
    return spark.read.text(out).select("batch_id", F.col("value").alias("line"))


@query("write_console", f"SELECT CAST(doc_id // {CHUNK} AS BIGINT) AS batch_id, count(*) AS docs FROM documents GROUP BY 1")
def write_console(spark, sf):
    cut = D.micro_batches(docs(spark, sf), chunk_of(spark, sf))
    counts = materialize(cut.groupBy("batch_id").agg(F.count(F.lit(1)).alias("docs")), "console")
    sinks.console_writer()(counts, 0)
    return counts


def _stop_terms(spark, sf):
    """The 20 most frequent letter terms."""
    tokens = T.token_table(docs(spark, sf), letter_terms)
    return T.term_frequency(tokens).orderBy(F.desc("freq"), F.asc("term")).limit(20).select("term")


@query(
    "segment_corpus",
    with_sql(
        f"parts AS (SELECT doc_id, {LETTERS.replace('{text}', NEWLINES)} AS t FROM documents)",
        "toks AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM parts)",
        "stops AS (SELECT term FROM toks GROUP BY term ORDER BY count(*) DESC, term LIMIT 20)",
        "lines AS (SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS line FROM toks"
        " WHERE term NOT IN (SELECT term FROM stops) GROUP BY doc_id)",
    )
    + "SELECT doc_id, coalesce(line, '') AS line FROM documents LEFT JOIN lines USING (doc_id)",
)
def segment_corpus(spark, sf):
    return T.segment_corpus(docs(spark, sf), letter_terms, materialize(_stop_terms(spark, sf), "stops"))


@query(
    "render_docs",
    with_sql(DOC_TOKENS, drawn_sql("dr", "tok"))
    + "SELECT doc_id, string_agg(term || '(' || topic || ')', ' ' ORDER BY pos) AS line FROM dr GROUP BY doc_id",
)
def render_docs(spark, sf):
    def topic(position):
        return F.floor(keyed_uniform(PARAMS.seed, F.col("doc_id"), position, 0) * K).cast("int")

    tagged = docs(spark, sf).select("doc_id", T.tagged_terms(whitespace_terms(F.col("text")), topic).alias("tokens"))
    return tagged.select("doc_id", T.render_terms(F.col("tokens")).alias("line"))


@query("tokenize_ws", with_sql(DOC_TOKENS) + "SELECT doc_id, pos, term FROM tok")
def tokenize_ws(spark, sf):
    return doc_tokens(spark, sf)


@query("normalize_newlines", f"SELECT doc_id, {NEWLINES} AS text FROM documents")
def normalize_newlines(spark, sf):
    return docs(spark, sf).select("doc_id", single_line(F.col("text")).alias("text"))


LETTER_TOKENS = (
    "toks AS (SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term FROM"
    f" (SELECT doc_id, {LETTERS.replace('{text}', 'text')} AS t FROM documents))"
)


@query("segment_terms", with_sql(LETTER_TOKENS) + "SELECT doc_id, pos, term FROM toks")
def segment_terms(spark, sf):
    return T.token_table(docs(spark, sf), letter_terms)


@query(
    "remove_stopwords",
    with_sql(
        DOC_TOKENS,
        "ranked AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rn"
        " FROM tok JOIN documents USING (doc_id) GROUP BY lang, term)",
        "stops AS (SELECT DISTINCT term FROM ranked WHERE rn <= 20)",
    )
    + "SELECT doc_id, pos, term FROM tok ANTI JOIN stops USING (term)",
)
def remove_stopwords(spark, sf):
    by_lang = T.token_table(table(spark, sf, "documents"), keep=("doc_id", "lang")).groupBy("lang", "term").count()
    order = W.partitionBy("lang").orderBy(F.desc("count"), F.asc("term"))
    top = by_lang.withColumn("rn", F.row_number().over(order)).where("rn <= 20").select("term").distinct()
    return T.remove_stopwords(doc_tokens(spark, sf), materialize(top, "stops")).select("doc_id", "pos", "term")


@query(
    "filter_oov",
    with_sql(
        DOC_TOKENS, TALK_TOKENS, freq_sql("tfreq", "talk"), vocab_sql("voc", "tfreq"),
        "looked AS (SELECT doc_id, pos, coalesce(wid, -1) AS wid FROM tok LEFT JOIN voc USING (term))",
    )
    + "SELECT doc_id, pos, CAST(wid AS BIGINT) AS wid FROM looked WHERE wid >= 0",
)
def filter_oov(spark, sf):
    freqs = materialize(T.term_frequency(doc_tokens(spark, sf)), "freqs")
    vocab = build_vocab_sorted(T.term_frequency(talk_tokens(spark, sf)))
    ids = T.lookup_term_ids(freqs, vocab).select("term", "wid")
    looked = T.keyed_join(doc_tokens(spark, sf), ids, "term", "inner", T.hot_terms(freqs), ("doc_id", "pos"))
    return T.filter_oov(looked).select("doc_id", "pos", "wid")


@query("formatter_plugin", with_sql(LETTER_TOKENS) + "SELECT doc_id, pos, term FROM toks")
def formatter_plugin(spark, sf):
    """A JSON formatter with a chosen segmenter plugged into the token table."""
    lines = docs(spark, sf).select("doc_id", F.to_json(F.struct(F.col("text").alias("c"))).alias("line"))
    return T.token_table(lines, json_terms(letter_terms), text="line")


@query(
    "segmenter_plugin",
    "SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term FROM"
    f" (SELECT doc_id, regexp_extract_all(text, '{WORDS.replace(chr(39), chr(39) * 2)}') AS t FROM documents)",
)
def segmenter_plugin(spark, sf):
    """A segmenter in Python, over Arrow batches, in the place of a column function."""
    return T.token_table(docs(spark, sf), pattern_segmenter())


@query("reader_plugin", with_sql(TALK_TOKENS) + "SELECT doc_id, pos, term FROM talk")
def reader_plugin(spark, sf):
    """Any callable giving (doc_id, text) is a reader; here every conversation turn is a document."""
    def reader(session):
        return talks(session, sf)

    return T.token_table(reader(spark))
