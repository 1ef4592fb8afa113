"""Documents, token tables and the way between terms and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import Segmenter, single_line, whitespace_terms
from topicloom.operators.skew import fits_broadcast, hot_keys, keyed_join
from topicloom.storage import spread

IN_ROW_STOPS = 200


def token_table(docs: DataFrame, segment: Segmenter = whitespace_terms, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per token: ``keep`` columns, ``pos`` and ``term``. A large
    input is not shuffled."""
    spread_docs = spread(docs.select(*dict.fromkeys((*keep, text))), keep[0])
    return spread_docs.select(*keep, F.posexplode(segment(F.col(text))).alias("pos", "term"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    """(term, freq), combined before the shuffle."""
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def hot_terms(freqs: DataFrame) -> DataFrame | None:
    return hot_keys(freqs, "term", "freq")


def remove_stopwords(tokens: DataFrame, stops: DataFrame) -> DataFrame:
    """Drop tokens in the stop list, a DataFrame with a ``term`` column.

    Stop words are the hottest keys there are: a short list is broadcast after
    its size is checked, a long one meets salted tokens.
    """
    listed = stops.select("term").distinct()
    if fits_broadcast(listed):
        return tokens.join(F.broadcast(listed), "term", "left_anti")
    hot = hot_terms(term_frequency(tokens))
    return keyed_join(tokens, listed, "term", "left_anti", hot, ("doc_id", "pos"))


def lookup_term_ids(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct terms -> ``wid``, -1 when unknown."""
    ids = vocab.select("term", "wid")
    return terms.join(ids, "term", "left").withColumn("wid", F.coalesce("wid", F.lit(-1).cast("bigint")))


def known_terms(freqs: DataFrame, vocab: DataFrame) -> DataFrame:
    return freqs.join(vocab.select("term"), "term", "left_semi")


def unknown_terms(freqs: DataFrame, vocab: DataFrame) -> DataFrame:
    return freqs.join(vocab.select("term"), "term", "left_anti")


def filter_oov(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("wid") >= 0)


def encode_docs(tokens: DataFrame, vocab: DataFrame, freqs: DataFrame | None = None) -> DataFrame:
    """Token table with ``wid`` in place of ``term``; unknown and -1 ids drop out.

    ``freqs`` are the term frequencies of these tokens, counted here if not given.
    """
    ids = vocab.where(F.col("wid") >= 0).select("term", "wid")
    hot = hot_terms(term_frequency(tokens) if freqs is None else freqs)
    return keyed_join(tokens, ids, "term", "inner", hot, ("doc_id", "pos")).drop("term")


def decode_docs(tokens: DataFrame, vocab: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Token table with ``term`` in place of ``wid``; ``counts`` (wid, freq) are taken here if not given."""
    found = tokens.groupBy("wid").agg(F.count(F.lit(1)).alias("freq")) if counts is None else counts
    hot = hot_keys(found, "wid", "freq")
    return keyed_join(tokens, vocab.select("term", "wid"), "wid", "inner", hot, ("doc_id", "pos")).drop("wid")


def tagged_terms(terms: Column, topic_of) -> Column:
    """array<struct<term, topic>> from an array of terms and ``topic_of(position)``."""
    return F.transform(terms, lambda term, i: F.struct(term.alias("term"), topic_of(i).alias("topic")))


def render_terms(tokens: Column) -> Column:
    """``"term(topic) term(topic)"`` for one document; empty for no tokens."""
    return F.array_join(
        F.transform(tokens, lambda t: F.concat(t["term"], F.lit("("), t["topic"].cast("string"), F.lit(")"))), " "
    )


def collect_docs(tokens: DataFrame) -> DataFrame:
    """Token table back to one row per document, in token order. A document came
    from one row, so the collected array is bounded by that row."""
    entry = F.struct("pos", "term", "topic")
    return tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("tokens"))


def segment_corpus(docs: DataFrame, segment: Segmenter, stops: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned corpus lines: segment, drop stop words, join with spaces.

    A stop list of at most ``IN_ROW_STOPS`` terms is checked inside each document
    row, so no token is shuffled; a longer one goes through the token join.
    Documents left without terms, and those without a text, stay, empty.
    """
    listed = stops.select("term").distinct()
    terms = spread(docs.select("doc_id", text), "doc_id").select("doc_id", segment(single_line(F.col(text))).alias("terms"))
    if fits_broadcast(listed, IN_ROW_STOPS):
        words = listed.agg(F.collect_set("term")).scalar()
        kept = F.filter("terms", lambda term: ~F.array_contains(F.col("_stops"), term))
        return terms.withColumn("_stops", words).select("doc_id", F.coalesce(F.array_join(kept, " "), F.lit("")).alias("line"))
    tokens = terms.select("doc_id", F.posexplode("terms").alias("pos", "term"))
    left = remove_stopwords(tokens, listed).withColumn("topic", F.lit(0))
    lines = collect_docs(left).select("doc_id", F.array_join(F.transform("tokens", lambda t: t["term"]), " ").alias("line"))
    return docs.select("doc_id").join(lines, "doc_id", "left").withColumn("line", F.coalesce("line", F.lit("")))
