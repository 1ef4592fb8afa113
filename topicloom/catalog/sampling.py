"""Draws, weights and synchronous sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.registry import (
    DOC_TOKENS, ENCODED, K, PARAMS, TALK_TOKENS, cells_sql, doc_tokens, docs, drawn, drawn_sql, draw_sql,
    encoded, freq_sql, packed_docs, query, sums_sql, talk_tokens, talks, topic_sql, uniform_sql, wide, with_sql,
)
from topicloom.catalog.relational import BOTH_ROWS, DOC_ROWS, doc_rows
from topicloom.functions import sampling as S
from topicloom.functions import vectors as V
from topicloom.operators import counts as C
from topicloom.operators import gibbs, quality
from topicloom.operators import texts as X
from topicloom.operators.skew import keyed_join
from topicloom.plans import online
from topicloom.storage import materialize

DRAWN_W = draw_sql([f"w{i}" for i in range(K)], "u")


def own_sql(i: int, topic: str = "topic") -> str:
    return f"(CASE WHEN {topic} = {i} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


@query(
    "categorical_draw",
    with_sql(DOC_TOKENS, drawn_sql("dr", "tok"), DOC_ROWS,
             f"w AS (SELECT doc_id, pos, {uniform_sql(1)} AS u, {cells_sql('n{i} + 1 AS w{i}')} FROM tok JOIN drow USING (term))")
    + f"SELECT doc_id, pos, {DRAWN_W} AS topic FROM w",
)
def categorical_draw(spark, sf):
    """Every token drawn from its word's topic counts plus one."""
    counted = materialize(X.counted_texts(docs(spark, sf), PARAMS), "texts")
    return X.draw_by_terms(counted, quality.smoothed(X.term_vectors(counted, K), 1.0, K), PARAMS, 1)


@query("init_topics_uniform", with_sql(DOC_TOKENS, drawn_sql("dr", "tok")) + "SELECT doc_id, pos, topic FROM dr")
def init_topics_uniform(spark, sf):
    return drawn(doc_tokens(spark, sf)).select("doc_id", "pos", "topic")


WEIGHTED = with_sql(
    *BOTH_ROWS,
    "docr AS (SELECT doc_id, " + sums_sql() + " FROM tdr GROUP BY doc_id)",
    "tot AS (SELECT " + sums_sql() + " FROM tdr)",
    f"local AS (SELECT term, {cells_sql('n{i}')} FROM drow UNION ALL SELECT DISTINCT term,"
    f" {cells_sql('CAST(1 AS DOUBLE) AS n{i}')} FROM talk WHERE term NOT IN (SELECT term FROM drow))",
    f"ptot AS (SELECT {cells_sql('sum(n{i}) AS n{i}')} FROM local)",
)


def _weight_sums() -> str:
    prior, blended, symmetric, smooth = [], [], [], []
    size = "(SELECT count(DISTINCT term) FROM talk)"
    for i in range(K):
        o = own_sql(i, "t.topic")
        prior.append(f"p.n{i} / pt.n{i}")
        blended.append(f"(d.n{i} - {o} + 1) * (w.n{i} - {o} + p.n{i}) / (a.n{i} - {o} + pt.n{i})")
        symmetric.append(f"(d.n{i} - {o} + 1) * (w.n{i} - {o} + 1) / (a.n{i} - {o} + {size})")
        smooth.append(f"(d.n{i} + 1) * (w.n{i} + 1) / (a.n{i} + 1)")
    named = {"prior_only": prior, "blended": blended, "symmetric": symmetric, "smoothed": smooth}
    return ", ".join(f"round({' + '.join(cells)}, 6) AS {name}" for name, cells in named.items())


@query(
    "gibbs_weights",
    WEIGHTED
    + f"SELECT t.doc_id, t.pos, {_weight_sums()} FROM tdr t JOIN trow w ON w.term = t.term JOIN docr d ON d.doc_id = t.doc_id"
    " JOIN local p ON p.term = t.term CROSS JOIN tot a CROSS JOIN ptot pt",
)
def gibbs_weights(spark, sf):
    """Total weight per conversation token under each formula; the documents are the model."""
    tokens = materialize(drawn(talk_tokens(spark, sf)), "tokens")
    model = materialize(C.overlay_unknown_prior(doc_rows(spark, sf), tokens, "term", PARAMS.beta, K), "model")
    size = tokens.select("term").distinct().count()
    totals, prior_totals = gibbs.token_totals(tokens, K), C.totals_list(model, K)
    ones = [1.0] * K
    counted = gibbs.with_counts(tokens, K, "term", gibbs.hot_in(tokens, "term"), gibbs.hot_in(tokens, "doc_id"))
    counted = keyed_join(
        counted, model.withColumnRenamed("n", "_p"), "term", "inner", gibbs.hot_in(tokens, "term"), ("doc_id", "pos")
    )
    doc, word, prior, topic = F.col("_doc"), F.col("_word"), F.col("_p"), F.col("topic")
    plus = lambda v: V.elementwise(lambda x: x + 1.0, K, v)
    formulas = {
        "prior_only": S.prior_weight(ones, prior, prior_totals),
        "blended": S.blended_weight(doc, word, totals, ones, prior, prior_totals, topic),
        "symmetric": S.symmetric_weight(doc, word, totals, 1.0, 1.0, size, topic),
        "smoothed": S.smoothed_weight(plus(doc), plus(word), [t + 1.0 for t in totals]),
    }
    vectors = counted.select("doc_id", "pos", *[V.from_cells(w, K).alias(name) for name, w in formulas.items()])
    return vectors.select("doc_id", "pos", *[F.round(V.total(F.col(name), K), 6).alias(name) for name in formulas])


def _prior_draw_sql(tokens: str, model: str, totals: str, alpha: str, sweep: int) -> str:
    """Rows (doc_id, pos, term, topic) drawn with the prior-only weight."""
    weights = ", ".join(
        f"al.n{i} * coalesce(m.n{i}, CAST(1 AS DOUBLE)) / (mt.n{i} + CASE WHEN m.term IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS w{i}"
        for i in range(K)
    )
    return (
        f"SELECT doc_id, pos, term, {DRAWN_W} AS topic FROM (SELECT t.doc_id, t.pos, t.term, {uniform_sql(sweep, 't')} AS u, {weights}"
        f" FROM {tokens} t LEFT JOIN {model} m ON m.term = t.term CROSS JOIN {totals} mt CROSS JOIN {alpha} al)"
    )


ONES = f"ones AS (SELECT {cells_sql('CAST(1 AS DOUBLE) AS n{i}')})"
DOC_TOTALS = f"dtot AS (SELECT {cells_sql('sum(n{i}) AS n{i}')} FROM drow)"


@query(
    "init_topics_prior",
    with_sql(*BOTH_ROWS, ONES, DOC_TOTALS) + f"SELECT doc_id, pos, topic FROM ({_prior_draw_sql('talk', 'drow', 'dtot', 'ones', 1)})",
)
def init_topics_prior(spark, sf):
    """Conversations drawn from the documents' model."""
    model = materialize(doc_rows(spark, sf), "model")
    tokens = talk_tokens(spark, sf)
    drawn_ = gibbs.init_topics_prior(
        tokens, model, [1.0] * K, C.totals_list(model, K), PARAMS, sweep=1, hot=gibbs.hot_in(tokens, "term")
    )
    return drawn_.select("doc_id", "pos", "topic")


@query(
    "assign_topics",
    with_sql(*BOTH_ROWS, DOC_TOTALS, f"al AS (SELECT {cells_sql('1 + n{i} AS n{i}')} FROM dtot)",
             f"a AS ({_prior_draw_sql('talk', 'drow', 'dtot', 'al', 0)})")
    + "SELECT doc_id, topic, count(*) AS cnt FROM a GROUP BY doc_id, topic",
)
def assign_topics(spark, sf):
    """Conversations scored against the documents' model: topic counts per turn."""
    model = materialize(doc_rows(spark, sf), "model")
    alpha = [1.0 + x for x in C.totals_list(model, K)]
    tokens = talk_tokens(spark, sf)
    scored = gibbs.assign_topics(tokens, model, alpha, PARAMS, hot=gibbs.hot_in(tokens, "term"))
    return C.topic_counts(scored, "doc_id")


def sweep_sql(source: str, word: str, doc: str, key: str, sweep: int, alpha: str, prior: str, totals: str, joins: str) -> str:
    """One synchronous sweep over ``source``; the prior parts are SQL patterns in {i}."""
    weights = ", ".join(
        f"(d.n{i} - {own_sql(i, 't.topic')} + {alpha.format(i=i)}) * (w.n{i} - {own_sql(i, 't.topic')} + {prior.format(i=i)})"
        f" / (a.n{i} - {own_sql(i, 't.topic')} + {totals.format(i=i)}) AS w{i}"
        for i in range(K)
    )
    return (
        f"SELECT doc_id, pos, {key}, {DRAWN_W} AS topic FROM (SELECT t.doc_id, t.pos, t.{key}, {uniform_sql(sweep, 't')} AS u, {weights}"
        f" FROM {source} t JOIN {word} w ON w.{key} = t.{key} JOIN {doc} d ON d.doc_id = t.doc_id {joins})"
    )


@query(
    "gibbs_sweep_sync",
    with_sql(
        *ENCODED,
        f"wr AS (SELECT wid, {sums_sql()} FROM enc GROUP BY wid)",
        f"docr AS (SELECT doc_id, {sums_sql()} FROM enc GROUP BY doc_id)",
        f"tot AS (SELECT {sums_sql()} FROM enc)",
        "size AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM voc)",
    )
    + "SELECT doc_id, pos, CAST(wid AS BIGINT) AS wid, topic FROM ("
    + sweep_sql("enc", "wr", "docr", "wid", 1, "1", "1", "s.v", "CROSS JOIN tot a CROSS JOIN size s") + ")",
)
def gibbs_sweep_sync(spark, sf):
    swept = gibbs.sync_packed(packed_docs(spark, sf)[1], PARAMS, 1)
    return swept.where(F.col("doc_id").isNotNull())  # tokens without a document meet no document counts


def _online_sql() -> str:
    """Two online batches: documents, then conversations."""
    first = with_sql(
        DOC_TOKENS, TALK_TOKENS, freq_sql("freq", "tok"), freq_sql("tfreq", "talk"), ONES,
        f"d1 AS (SELECT doc_id, pos, term, {topic_sql(2)} AS topic FROM tok)",
        f"w1 AS (SELECT term, {sums_sql()} FROM d1 GROUP BY term)",
        f"o1 AS (SELECT doc_id, {sums_sql()} FROM d1 GROUP BY doc_id)",
        f"t1 AS (SELECT {sums_sql()} FROM d1)",
        "s1 AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM freq)",
        "x1 AS (" + sweep_sql("d1", "w1", "o1", "term", 3, "1", "1", "s.v", "CROSS JOIN t1 a CROSS JOIN s1 s") + ")",
        f"m1 AS (SELECT term, {cells_sql('n{i} + 1 AS n{i}')} FROM (SELECT term, {sums_sql()} FROM x1 GROUP BY term))",
        f"al1 AS (SELECT {cells_sql('n{i} + 1 AS n{i}')} FROM (SELECT {sums_sql()} FROM x1))",
        f"mt1 AS (SELECT {cells_sql('sum(n{i}) AS n{i}')} FROM m1)",
        f"d2 AS ({_prior_draw_sql('talk', 'm1', 'mt1', 'al1', 4)})",
        f"local AS (SELECT term, {cells_sql('n{i}')} FROM m1 UNION ALL SELECT term,"
        f" {cells_sql('CAST(1 AS DOUBLE) AS n{i}')} FROM tfreq ANTI JOIN m1 USING (term))",
        f"lt AS (SELECT {cells_sql('sum(n{i}) AS n{i}')} FROM local)",
        f"w2 AS (SELECT term, {sums_sql()} FROM d2 GROUP BY term)",
        f"o2 AS (SELECT doc_id, {sums_sql()} FROM d2 GROUP BY doc_id)",
        f"t2 AS (SELECT {sums_sql()} FROM d2)",
        "x2 AS (" + sweep_sql(
            "d2", "w2", "o2", "term", 5, "al.n{i}", "p.n{i}", "lt.n{i}",
            "JOIN local p ON p.term = t.term CROSS JOIN t2 a CROSS JOIN lt CROSS JOIN al1 al",
        ) + ")",
        f"c2 AS (SELECT term, {sums_sql()} FROM x2 GROUP BY term)",
    )
    merged = cells_sql("l.n{i} + coalesce(c.n{i}, CAST(0 AS DOUBLE)) AS n{i}")
    return first + f"SELECT l.term, {merged} FROM local l LEFT JOIN c2 c ON c.term = l.term"


@query("fit_online", _online_sql())
def fit_online(spark, sf):
    model = online.fit_online_texts([docs(spark, sf), talks(spark, sf)], PARAMS)
    return wide(model.rows, "term")


@query("init_model_counts", with_sql(*ENCODED)
       + "SELECT CAST(wid AS BIGINT) AS wid, topic, count(*) AS cnt FROM enc GROUP BY wid, topic"
       " UNION ALL SELECT CAST(-1 AS BIGINT), topic, count(*) FROM enc GROUP BY topic")
def init_model_counts(spark, sf):
    """First word-topic counts, and the topic totals under wid -1."""
    counts = C.topic_counts(encoded(spark, sf)[1], "wid")
    totals = C.topic_totals(counts).select(F.lit(-1).cast("bigint").alias("wid"), "topic", "cnt")
    return counts.unionByName(totals)
