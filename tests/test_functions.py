"""Column functions and the small numeric cases of the blueprint."""

import math
import random

import pytest
from pyspark.sql import functions as F

from topicloom.functions import sampling as S
from topicloom.functions import vectors as V
from topicloom.functions.segmenters import dictionary_segmenter, longest_matches, pattern_segmenter
from topicloom.functions.text import json_terms, letter_terms, single_line, whitespace_terms
from topicloom.operators import counts as C
from topicloom.operators import decay, quality
from topicloom.operators import tokens as T
from topicloom.operators.skew import hot_keys, keyed_join
from topicloom.params import TopicParams


@pytest.fixture(params=[32, 1], ids=["unrolled", "higher-order"])
def unroll(request, monkeypatch):
    monkeypatch.setattr(V, "UNROLL", request.param)


def test_column_sums(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0, 1.0, 3.0, 4.0],)], "n array<double>")
    assert C.totals_list(rows, 4) == [2.0, 3.0, 6.0, 8.0]
    cells = C.vector_cells(rows.withColumn("w", F.lit(0)), "w")
    assert sorted((r["topic"], r["cnt"]) for r in C.topic_totals(cells).collect()) == [(0, 2.0), (1, 3.0), (2, 6.0), (3, 8.0)]


def test_model_priors(spark):
    rows = spark.createDataFrame([(t, [1.0] * 10) for t in "abcd"], "term string, n array<double>")
    assert C.totals_list(rows, 10) == [4.0] * 10
    assert C.totals_list(rows.limit(0), 10) == [0.0] * 10


def test_likelihood_case(spark):
    tokens = spark.createDataFrame([(0, 1, 2), (0, 3, 1), (0, 0, 1)], "doc_id bigint, wid bigint, topic int")
    words, docs = C.topic_vectors(tokens, "wid", 4), C.topic_vectors(tokens, "doc_id", 4)
    value = quality.loglik_no_prior(tokens, docs, words, 1.0, 1.0, 4).first()[0]
    assert value == pytest.approx((math.log(9) + 2 * math.log(10)) / 3)


def test_draw_frequencies(spark, unroll):
    df = spark.range(10000).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"))
    weights = [1.0, 9.0, 9.0]
    out = S.draw_topics(df, lambda i: V.at(weights, i), S.keyed_uniform(1, F.col("doc_id"), F.col("pos")), 3)
    got = {r["topic"]: r["count"] for r in out.groupBy("topic").count().collect()}
    assert abs(got[0] - 526.3) < 90 and abs(got[1] - 4736.8) < 200 and abs(got[2] - 4736.8) < 200


def test_draw_picks_last_on_zero_weights(spark, unroll):
    out = S.draw_topics(spark.range(1), lambda i: F.lit(0.0), F.lit(0.5), 3)
    assert out.first()["topic"] == 2


def test_vector_forms_agree(spark, unroll):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    row = df.select(
        V.add(F.col("a"), F.col("b"), 3).alias("s"), V.dot(F.col("a"), F.col("b"), 3).alias("d"),
        V.total(F.col("a"), 3).alias("t"), V.scale(F.col("a"), 2.0, 3).alias("x"),
    ).first()
    assert (row["s"], row["d"], row["t"], row["x"]) == ([5.0, 7.0, 9.0], 32.0, 6.0, [2.0, 4.0, 6.0])


def test_text(spark):
    row = spark.createDataFrame([(" a  b\tC \n",)], "t string").select(
        whitespace_terms(F.col("t")).alias("w"), letter_terms(F.col("t")).alias("l"), single_line(F.col("t")).alias("s")
    ).first()
    assert row["w"] == ["a", "b", "C"] and row["l"] == ["a", "b", "c"] and "\n" not in row["s"]
    line = spark.createDataFrame([('{"id": 3, "x": [1], "c": "Ein Wort"}',)], "t string")
    assert line.select(json_terms()(F.col("t")).alias("w")).first()["w"] == ["ein", "wort"]


def test_render(spark):
    df = spark.createDataFrame([(["x", "y"],), ([],)], "t array<string>")
    out = df.select(T.render_terms(T.tagged_terms(F.col("t"), lambda i: i)).alias("r")).collect()
    assert [r["r"] for r in out] == ["x(0) y(1)", ""]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(4000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("wid")
    )
    right = spark.range(0, 40).select(F.col("id").alias("wid"), (F.col("id") * 10).alias("v"))
    counts = left.groupBy("wid").agg(F.count(F.lit(1)).alias("cnt"))
    hot = hot_keys(counts, "wid", "cnt", share=20, min_rows=10)
    assert hot.where("_salts > 1").count() == 1
    salted = keyed_join(left, right, "wid", how, hot, ("pos",))
    plain = left.join(right, "wid", how)
    assert sorted(map(tuple, salted.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_no_hot_keys_below_the_floor(spark):
    counts = spark.createDataFrame([(1, 10)], "wid bigint, cnt bigint")
    assert hot_keys(counts, "wid", "cnt") is None
    assert hot_keys(counts.limit(0), "wid", "cnt") is None


@pytest.mark.parametrize("bad", [{"rate": 1.5}, {"num_topics": 0}, {"alpha": -1.0}, {"duration": 0}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        TopicParams(**bad)


def test_decay_clamps_late_batches_and_unseen_rows(spark):
    params = TopicParams(num_topics=2, rate=0.5, duration=10)
    rows = spark.createDataFrame(
        [(0, [8.0, 8.0], 0), (1, [8.0, 8.0], -1), (2, [8.0, 8.0], 90)], "wid bigint, n array<double>, last_batch bigint"
    )
    got = {r["wid"]: r["n"][0] for r in decay.decay_rows(rows, 29, params).collect()}
    assert got == {0: 2.0, 1: 4.0, 2: 8.0}


def test_backfill_equals_replay(spark):
    params = TopicParams(num_topics=2, rate=0.3, duration=1)
    tokens = spark.createDataFrame(
        [(w, (w * b + i) % 2, b) for b in range(4) for w in range(3) if (w + b) % 2 for i in range(b + 2)],
        "wid bigint, topic int, b bigint",
    )
    rows = spark.createDataFrame([], "wid bigint, n array<double>, last_batch bigint")
    for b in range(4):
        rows = decay.blend_batch(rows, C.topic_vectors(tokens.where(F.col("b") == b), "wid", 2), b, params)
    stepwise = {r["wid"]: r["n"] for r in decay.decay_rows(rows, 3, params).collect()}
    at_once = {r["wid"]: r["n"] for r in decay.backfill_rows(tokens, "wid", "b", 3, params).collect()}
    assert stepwise.keys() == at_once.keys()
    for wid in at_once:
        assert at_once[wid] == pytest.approx(stepwise[wid])


def test_count_vectors_of_many_topics_equal_the_unrolled_form(spark, monkeypatch):
    rows = [(d, (d * 7 + i * i) % 9, 0.5 * i) for d in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, topic int, w double")
    for weight in (None, F.col("w")):
        unrolled = V.count_vectors(df, ["doc_id"], 10, weight).orderBy("doc_id").collect()
        with monkeypatch.context() as patch:
            patch.setattr(V, "UNROLL", 4)
            assert V.count_vectors(df, ["doc_id"], 10, weight).orderBy("doc_id").collect() == unrolled


def test_python_segmenters_plug_in(spark):
    docs = spark.createDataFrame([(1, "l'été, well-known x1 -a-"), (2, None), (3, "")], "doc_id int, text string")
    got = T.token_table(docs, pattern_segmenter()).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.term) for r in got] == [(1, 0, "l'été"), (1, 1, "well-known"), (1, 2, "x"), (1, 3, "a")]
    cut = T.token_table(spark.createDataFrame([(1, "中国人民银行 a b")], "doc_id int, text string"), dictionary_segmenter(["中国", "人民", "中国人民", "银行"]))
    assert [r.term for r in cut.orderBy("pos").collect()] == ["中国人民", "银行", "a", "b"]


def test_longest_matches_against_every_cut():
    rng = random.Random(1)
    words = frozenset("".join(rng.choices("ab", k=rng.randint(2, 4))) for _ in range(6))
    for _ in range(200):
        text = "".join(rng.choices("ab ", k=rng.randint(0, 12)))
        want = []
        for run in text.split():
            while run:
                best = max([w for w in words if run.startswith(w)], key=len, default=run[0])
                want.append(best)
                run = run[len(best) :]
        assert longest_matches(text, words, 4) == want


def test_large_dictionaries_are_refused(monkeypatch):
    monkeypatch.setattr("topicloom.functions.segmenters.DICTIONARY_WORDS", 2)
    with pytest.raises(ValueError, match="too large"):
        dictionary_segmenter(["a", "b", "c"])


def test_salts_hold_a_bounded_number_of_rows_at_any_size(spark):
    """A key with 5 x 10^11 of 10^13 rows is cut to what a task copes with."""
    counts = spark.createDataFrame([(1, 5 * 10**11), (2, 10**13 - 5 * 10**11 - 10), (3, 10)], "wid bigint, cnt bigint")
    salts = {r.wid: r._salts for r in hot_keys(counts, "wid", "cnt").collect()}
    assert set(salts) == {1, 2} and 5 * 10**11 / salts[1] < 10**8
    assert sum(salts.values()) <= 2 * (1 << 17)


def test_a_python_segmenter_holds_the_terms_of_few_texts(monkeypatch):
    """Terms are Python objects for a slice of a batch only, whatever the batch holds."""
    import pyarrow as pa

    from topicloom.functions import segmenters

    class Term(str):
        alive, most = 0, 0

        def __init__(self, *_):
            Term.alive += 1
            Term.most = max(Term.most, Term.alive)

        def __del__(self):
            Term.alive -= 1

    monkeypatch.setattr(segmenters, "TEXTS", 4)
    segment = segmenters.python_segmenter(lambda text: [Term(word) for word in text.split()]).func
    got = segment(pa.array(["a b c"] * 41 + [None, ""])).to_pylist()
    assert got == [["a", "b", "c"]] * 41 + [None, []] and Term.most <= 2 * 4 * 3
    assert segment(pa.array([], pa.string())).to_pylist() == []
