"""Sequential Gibbs sweeps over shards of documents.

Tokens are packed into one row per document segment (parallel arrays of
positions, word ids and topics). Segments go to shards by a keyed hash; a
segment has a bounded length, so shards stay even and no task ever has to hold
a document or a word's tokens whole. Each shard gets the model rows of its own
words by a cogroup and sweeps with NumPy; sums over shards are Spark aggregates.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.functions.uniforms import keyed_uniforms
from topicloom.operators.skew import hot_keys, keyed_join
from topicloom.params import TopicParams

# Workers need no copy of this package: the kernel travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNT_TOKENS = 2_000_000  # tokens a task counts at a time
SCORE_TOKENS = 100_000  # tokens scored at a time
PAIR_ROWS = 100_000  # shards of one word whose rows a task sends; each is a vector
PACKED = "shard int, doc_id bigint, seg int, pos array<int>, wid array<bigint>, topic array<int>, base array<double>"


def shard_of(params: TopicParams, number: int) -> Column:
    """Shard of a document's segment."""
    return F.pmod(F.xxhash64(F.lit(params.seed), "doc_id", "seg"), F.lit(number)).cast("int").alias("shard")


def pack_segments(tokens: DataFrame, params: TopicParams, shards: int) -> DataFrame:
    """Token table -> one row per (document, segment), at most ``segment_tokens`` long.

    ``base`` holds the document's counts in its *other* segments; only documents
    longer than one segment have it.
    """
    seg = F.floor(F.col("pos") / F.lit(params.segment_tokens)).cast("int")
    entry = F.struct("pos", F.col("wid").cast("bigint").alias("wid"), "topic")
    rows = (
        tokens.withColumn("seg", seg).groupBy("doc_id", "seg")
        .agg(F.sort_array(F.collect_list(entry)).alias("t"))
        .select(
            shard_of(params, shards), "doc_id", "seg",
            F.col("t.pos").alias("pos"), F.col("t.wid").alias("wid"), F.col("t.topic").alias("topic"),
        )
    )
    return rows.withColumn("base", F.lit(None).cast("array<double>"))


def refresh_base(packed: DataFrame, params: TopicParams) -> DataFrame:
    """Recompute ``base`` for documents of several segments."""
    k = params.num_topics
    own = packed.select("doc_id", "seg", F.explode("topic").alias("topic"))
    per_segment = V.count_vectors(own, ["doc_id", "seg"], k, name="_own")
    long_docs = per_segment.where("seg > 0").select("doc_id").distinct()
    per_segment = per_segment.join(long_docs, "doc_id", "left_semi")
    whole = per_segment.groupBy("doc_id").agg(V.sum_cells(F.col("_own"), k).alias("_doc"))
    sizes = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    hot = hot_keys(sizes, "doc_id", "_rows")
    others = keyed_join(per_segment, whole, "doc_id", "inner", hot, ("seg",)).select(
        "doc_id", "seg", V.elementwise(lambda x, y: x - y, k, F.col("_doc"), F.col("_own")).alias("base")
    )
    return packed.drop("base").join(others, ["doc_id", "seg"], "left").select(*packed.columns)


def unpack_tokens(packed: DataFrame, *extra: str) -> DataFrame:
    """Back to (doc_id, pos, wid, topic) rows."""
    zipped = packed.select("doc_id", *extra, F.explode(F.arrays_zip("pos", "wid", "topic")).alias("t"))
    return zipped.select("doc_id", "t.pos", "t.wid", "t.topic", *extra)


def _counted(rows: DataFrame, key: str, k: int, samples: bool = False) -> DataFrame:
    """(key, n): topics of packed rows counted by ``wid`` or ``doc_id``, of all ``samples`` if asked.

    A task counts ``COUNT_TOKENS`` tokens at a time before the shuffle; for many topics it sends the cells that are not zero.
    """
    dense = k <= V.UNROLL
    per_sample = pa.list_(pa.float64()) if dense else pa.float64()
    schema = pa.schema([(key, pa.int64())] + ([("n", per_sample)] if dense else [("topic", pa.int32()), ("_cell", per_sample)]))

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = table["wid" if key == "wid" else "topic"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy()) if table.num_rows else []
            for first, last in row_slices(sizes, COUNT_TOKENS):
                part = table.slice(first, last - first)
                inner, lengths = flat_list(part["topic"])
                if samples:  # per row several arrays as long as the row
                    counts, inner = lengths, inner.flatten()
                    each = np.diff(flat_list(part["topic"])[0].offsets.to_numpy())
                    lengths = np.zeros(part.num_rows, dtype=np.int64)
                    np.add.at(lengths, np.repeat(np.arange(part.num_rows), counts), each)
                topic = inner.to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), lengths)
                if key == "doc_id":
                    keys, at = part["doc_id"].combine_chunks(), row
                else:
                    wid, own = flat(part["wid"])
                    if samples:
                        starts = np.cumsum(own) - own
                        place = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
                        wid = wid[starts[row] + place % own[row]]
                    words, at = np.unique(wid, return_inverse=True)
                    keys = pa.array(words, pa.int64())
                if dense:
                    n = np.bincount(at * k + topic, minlength=len(keys) * k).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([keys, list_array(n, np.full(len(keys), k))], schema=schema)
                else:
                    cells, n = np.unique(at * k + topic, return_counts=True)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(cells // k)), pa.array((cells % k).astype(np.int32)), pa.array(n.astype(np.float64))], schema=schema)

    parts = rows.mapInArrow(run, f"{key} bigint, n array<double>" if dense else f"{key} bigint, topic int, _cell double")
    if dense:
        return parts.groupBy(key).agg(V.sum_cells(F.col("n"), k).alias("n"))
    return V.count_vectors(parts, [key], k, F.col("_cell"))


def packed_counts(packed: DataFrame, k: int) -> DataFrame:
    """(wid, n) over packed rows."""
    return _counted(packed.select("wid", "topic"), "wid", k)


def document_counts(packed: DataFrame, k: int) -> DataFrame:
    """(doc_id, n) over packed rows."""
    return _counted(packed.select("doc_id", "topic"), "doc_id", k)


def shard_words(packed: DataFrame) -> DataFrame:
    """Distinct (shard, wid). Duplicates go inside the row, then before the shuffle;
    a word appears at most once per shard, so none is hot."""
    def words(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("shard")
            wid, lengths = flat(table["wid"])
            shard = np.repeat(table["shard"].to_numpy(), lengths)
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            for first, last in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
                found = np.unique(wid[first:last])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), shard[first], dtype=np.int32)), pa.array(found)], ["shard", "wid"])

    return packed.select("shard", "wid").mapInArrow(words, "shard int, wid bigint").distinct()


def salted_words(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``shard_words`` with a ``salt`` column, and the hot words ``(wid, _salts)``; as they are if there are none.

    A word of very many shards would be one task's rows in every exchange; its pairs are cut by shard.
    """
    hot = hot_keys(pairs.groupBy("wid").agg(F.count(F.lit(1)).alias("_rows")), "wid", "_rows", min_rows=PAIR_ROWS)
    if hot is None:
        return pairs, None
    salt = F.coalesce(F.pmod(F.xxhash64("shard"), F.col("_salts")), F.lit(0)).cast("int")
    return pairs.join(F.broadcast(hot), "wid", "left").withColumn("salt", salt).drop("_salts"), hot


def pull_shard_rows(pairs: DataFrame, model: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Model rows (shard, wid, n) each shard of ``shard_words`` needs; words without a row get none.

    With ``hot`` words, for which ``pairs`` are salted, their rows are repeated per salt.
    """
    rows = model.select("wid", "n")
    if hot is None:
        return pairs.join(rows, "wid").select("shard", "wid", "n")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    copies = rows.join(F.broadcast(hot), "wid", "left").select("wid", "n", F.explode(salts).alias("salt"))
    return pairs.join(copies, ["wid", "salt"]).select("shard", "wid", "n")


def flat_list(column: pa.ChunkedArray):
    """(values, lengths) of a list column; the values as an Arrow array."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], column.type)
    return array.flatten(), np.diff(array.offsets.to_numpy())


def flat(column: pa.ChunkedArray):
    """(values, lengths) of a list column."""
    values, lengths = flat_list(column)
    return values.to_numpy(zero_copy_only=False), lengths


def row_slices(lengths, limit: int):
    """(first, last) of runs of rows with at most ``limit`` items; a longer row is a run of its own."""
    first, held = 0, 0
    for i, size in enumerate(lengths):
        if i > first and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(lengths):
        yield first, len(lengths)


def resampled(word, doc, topic, a, b, t, uniforms):
    """Topics drawn from the smoothed counts ``a``, ``b`` and ``t`` as they are, each token less itself."""
    k = len(t)
    at_w, at_d = word * k, doc * k
    weight = a.take(doc, axis=0)
    weight *= b.take(word, axis=0)
    weight /= t
    # Only the token's own topic counts the token itself: put that cell right.
    own = np.arange(len(topic)) * k + topic
    weight.reshape(-1)[own] = (a.reshape(-1)[at_d + topic] - 1.0) * (b.reshape(-1)[at_w + topic] - 1.0) / (t[topic] - 1.0)
    if len(topic) > k:  # topic by topic: the same sums in the same order
        for i in range(1, k):
            weight[:, i] += weight[:, i - 1]
    else:
        np.cumsum(weight, axis=1, out=weight)
    mark = uniforms * weight[:, -1]
    return np.minimum((weight <= mark[:, None]).sum(axis=1), k - 1).astype(topic.dtype)


def _sweep(word, doc, topic, a, b, t, rng, block, uniforms=None):
    """Resample every token once, in order, ``block`` tokens at a time.

    ``a`` documents x K, ``b`` words x K and ``t`` K are the smoothed counts,
    updated in place. Within a block each token sees the counts as they were at
    the block's start, less itself; a block of one token is the plain
    sequential sampler. Given ``uniforms`` take the place of random numbers.
    """
    k = len(t)
    drawn = topic.copy()
    flat_a, flat_b = a.reshape(-1), b.reshape(-1)
    for start in range(0, len(topic), block):
        stop = min(start + block, len(topic))
        w, d, z = word[start:stop], doc[start:stop], topic[start:stop]
        at_w, at_d = w * k, d * k
        new = resampled(w, d, z, a, b, t, rng.random(stop - start) if uniforms is None else uniforms[start:stop])
        moved = np.flatnonzero(new != z)
        x, y, at_w, at_d = z[moved], new[moved], at_w[moved], at_d[moved]
        np.subtract.at(flat_a, at_d + x, 1.0)
        np.add.at(flat_a, at_d + y, 1.0)
        np.subtract.at(flat_b, at_w + x, 1.0)
        np.add.at(flat_b, at_w + y, 1.0)
        t += np.bincount(y, minlength=k) - np.bincount(x, minlength=k)
        drawn[start:stop] = new
    return drawn


class _WordProposal:
    """Topics drawn from each word's counts as they are now, ``fill`` in every cell included and the token itself left out.

    Counts are kept as a sparse running sum over all words, so building it costs a pass over the cells and a draw a binary search.
    """

    def __init__(self, b, fill: float) -> None:
        words, self.k = b.shape
        self.fill, self.cells = fill, b.copy()
        flat = self.cells.reshape(-1)
        self.at = np.flatnonzero(flat > fill)
        self.sums = np.concatenate([[0.0], np.cumsum(flat[self.at] - fill)])
        self.first = np.searchsorted(self.at, np.arange(words + 1) * self.k)

    def draw(self, word, own, u):
        """``own`` are the topics the tokens are counted under."""
        low, high = self.first[word], self.first[word + 1]
        mass = self.sums[high] - self.sums[low] - 1.0
        mark = u * (mass + self.k * self.fill)
        own_end = self.sums[np.searchsorted(self.at, word * self.k + own) + 1]
        place = self.sums[low] + mark
        place = np.where(place >= own_end - 1.0, place + 1.0, place)  # over the token's own count
        found = np.clip(np.searchsorted(self.sums, place, "right") - 1, low, high - 1)
        even = np.clip((mark - mass) / max(self.fill, 1e-300), 0, self.k - 1).astype(np.int64)
        return np.where(mark < mass, self.at[found] % self.k, even) if self.fill > 0 else self.at[found] % self.k

    def chance(self, word, own, x):
        """What ``x`` is drawn in proportion to."""
        return self.cells[word, x] - (x == own)


def _sweep_mh(word, doc, topic, a, base, alpha, b, t, rng, block, steps, fill, rebuild=None):
    """Resample every token once by ``steps`` Metropolis-Hastings steps; work per token does not depend on the topics.

    Proposals take turns: from the word's counts, and from the document's (the topic
    of another token of it, or one by ``alpha``). Neither counts the token itself, so
    a token's draw leaves what ``_sweep`` draws from as it is. Document counts are those at
    the block's start, the words' those of ``rebuild`` tokens ago at most (by default the sweep's start).
    ``base`` are counts of other segments in ``a``, or None.
    """
    k, rebuild = len(t), rebuild or len(topic)
    starts = np.searchsorted(doc, np.arange(len(a) + 1))
    sizes, prior = np.diff(starts) - 1, np.cumsum(alpha)
    drawn, words, built = topic.copy(), None, 0
    for start in range(0, len(topic), block):
        stop = min(start + block, len(topic))
        if words is None or start - built >= rebuild:
            words, built = _WordProposal(b, fill), start
        w, d, z = word[start:stop], doc[start:stop], topic[start:stop]
        here = np.arange(start, stop)

        def target(x):
            own = x == z
            return (a[d, x] - own) * (b[w, x] - own) / (t[x] - own)

        def by_document(x):
            return a[d, x] - (x == z) - (0.0 if base is None else base[d, x])

        def by_word(x):
            return words.chance(w, z, x)

        now, weight = z.astype(np.int64), target(z)
        for step in range(steps):
            u, accept = rng.random((2, stop - start))
            if step % 2 == 0:
                new, chance = words.draw(w, z, u), by_word
            else:
                mark, size = u * (sizes[d] + prior[-1]), sizes[d]
                token = starts[d] + np.minimum(mark, np.maximum(size - 1, 0)).astype(np.int64)
                token = np.where((token >= here) & (size > 0), token + 1, token)  # another token than this one
                spare = np.minimum(np.searchsorted(prior, mark - size, "right"), k - 1)
                new, chance = np.where(mark < size, drawn[token], spare), by_document
            offered = target(new)
            taken = accept * weight * chance(new) < offered * chance(now)
            now, weight = np.where(taken, new, now), np.where(taken, offered, weight)
        new = now.astype(topic.dtype)
        moved = np.flatnonzero(new != z)
        x, y = z[moved], new[moved]
        np.subtract.at(a, (d[moved], x), 1.0)
        np.add.at(a, (d[moved], y), 1.0)
        np.subtract.at(b, (w[moved], x), 1.0)
        np.add.at(b, (w[moved], y), 1.0)
        t += np.bincount(y, minlength=k) - np.bincount(x, minlength=k)
        drawn[start:stop] = new
    return drawn


def list_array(values, lengths) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), values)


def _shard_kernel(
    params: TopicParams, totals: list[float], fill: float, own: bool, sweeps: int, kept: int, first: int,
    alpha: list[float] | None = None, keyed: bool = False,
):
    """Arrow function of one shard: (segments, model rows) -> segments with samples."""
    k, seed, block = params.num_topics, params.seed, params.block_tokens
    start = np.full(k, float(params.alpha)) if alpha is None else np.array(alpha, dtype=float)

    def run(key, segments: pa.Table, rows: pa.Table) -> pa.Table:
        segments = segments.sort_by([("doc_id", "ascending"), ("seg", "ascending")])
        wid, lengths = flat(segments["wid"])
        topic = flat(segments["topic"])[0].astype(np.int32)
        doc = np.repeat(np.arange(segments.num_rows), lengths)
        words, word = np.unique(wid, return_inverse=True)

        a = np.tile(start, (segments.num_rows, 1))
        np.add.at(a, (doc, topic), 1.0)
        others = None
        for i, base in enumerate(segments["base"].to_pylist()):
            if base is not None:
                others = np.zeros_like(a) if others is None else others
                others[i] = base
        if others is not None:
            a += others
        b = np.full((len(words), k), fill)
        if rows.num_rows:
            b[np.searchsorted(words, rows["wid"].to_numpy())] += flat(rows["n"])[0].reshape(-1, k)
        t = np.array(totals, dtype=float)
        if own:
            np.add.at(b, (word, topic), 1.0)
            t += np.bincount(topic, minlength=k)

        uniforms = None
        if keyed:
            uniforms = keyed_uniforms(seed, segments["doc_id"].to_pylist(), doc, flat(segments["pos"])[0], first)
        samples = []
        for sweep in range(first, first + sweeps):
            rng = np.random.Generator(np.random.Philox(key=[seed, (int(key[0].as_py()) << 20) + sweep]))
            if params.sampler == "mh" and uniforms is None:
                topic = _sweep_mh(word, doc, topic, a, others, start, b, t, rng, block, params.mh_steps, fill)
            else:
                topic = _sweep(word, doc, topic, a, b, t, rng, block if uniforms is None else len(topic), uniforms)
            if sweep >= first + sweeps - kept and kept > 1:
                samples.append(topic)
        out = segments.set_column(segments.schema.get_field_index("topic"), "topic", list_array(topic, lengths))
        if kept > 1:
            # Per segment: the topics of every kept sweep, oldest first.
            order = np.argsort(np.tile(doc, kept), kind="stable")
            values = np.concatenate(samples)[order].astype(np.int32)
            inner = list_array(values, np.repeat(lengths, kept))
            out = out.append_column("samples", list_array(inner, np.full(segments.num_rows, kept)))
        return out

    return run


def sweep_shards(
    packed: DataFrame, model_rows: DataFrame, totals: list[float], params: TopicParams,
    fill: float = 0.0, own_counts: bool = False, sweeps: int = 1, kept: int = 1, first: int = 1, keyed: bool = False,
    pairs: DataFrame | None = None, alpha: list[float] | None = None, kernel: Callable | None = None,
) -> DataFrame:
    """Run ``sweeps`` sweeps in every shard from one snapshot of the model.

    ``totals`` are the smoothed topic totals (K numbers). Word rows are the
    pulled rows plus ``fill``; with ``own_counts`` the shard's own counts are
    added to rows and totals (for a model that does not yet contain them).
    Returns the packed rows with the last topics and, for ``kept`` > 1, the
    column ``samples``: one array of topics per kept sweep, oldest first (a
    ``samples`` column of ``packed`` is passed on as it is). With
    ``keyed`` a sweep draws all tokens from one state of the counts by uniforms
    keyed by (seed, document, position, sweep), the way of ``gibbs_sweep_sync``.
    ``pairs`` are the saved ``shard_words``, if there are any; ``alpha`` is a vector in place of the parameter.
    A ``kernel`` (``exchange.shard_kernel``) makes the function of a shard and its schema; ``packed`` and ``model_rows``
    are then rows by shard of its own making.
    """
    kept = min(kept, sweeps)
    if kernel is None:
        run = _shard_kernel(params, totals, fill, own_counts, sweeps, kept, first, alpha, keyed)
        schema = PACKED + (", samples array<array<int>>" if kept > 1 or "samples" in packed.columns else "")
        rows = pull_shard_rows(shard_words(packed) if pairs is None else pairs, model_rows)
    else:
        (run, schema), rows = kernel(params, totals, fill, sweeps, first, keyed), model_rows
    return packed.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, schema)


def score_shards(packed: DataFrame, word_rows: DataFrame, alpha: float, k: int, norm: list[float] | str | None, pairs: DataFrame | None = None) -> DataFrame:
    """(loglik, tokens) per shard: sum of ln of sum_k n_wk (n_dk + alpha) over its tokens that have a document and a word row.

    The document's part is divided by ``norm``, K numbers, or by its own sum with ``"document"``.
    """
    schema = pa.schema([("loglik", pa.float64()), ("tokens", pa.int64())])

    def score(key, segments: pa.Table, rows: pa.Table) -> pa.Table:
        segments, rows = segments.filter(segments["doc_id"].is_valid()), rows.sort_by("wid")
        if not segments.num_rows or not rows.num_rows:
            return schema.empty_table()
        wid, lengths = flat(segments["wid"])
        topic = flat(segments["topic"])[0].astype(np.int64)
        doc, known = np.repeat(np.arange(segments.num_rows), lengths), rows["wid"].to_numpy()
        theta = np.bincount(doc * k + topic, minlength=segments.num_rows * k).reshape(-1, k) + float(alpha)
        for i, base in enumerate(segments["base"].to_pylist()):
            if base is not None:
                theta[i] += base
        if norm is not None:
            theta /= theta.sum(axis=1, keepdims=True) if norm == "document" else np.array(norm)
        words = flat(rows["n"])[0].reshape(-1, k)
        at = np.minimum(np.searchsorted(known, wid), len(known) - 1)
        held = np.flatnonzero(known[at] == wid)
        whole = 0.0
        for first in range(0, len(held), SCORE_TOKENS):
            part = held[first : first + SCORE_TOKENS]
            p = np.einsum("ij,ij->i", theta.take(doc[part], axis=0), words.take(at[part], axis=0))
            whole += float(np.log(p[p > 0]).sum())
        return pa.Table.from_arrays([pa.array([whole]), pa.array([len(held)], pa.int64())], schema=schema)

    rows = pull_shard_rows(shard_words(packed) if pairs is None else pairs, word_rows)
    source = packed.select("shard", "doc_id", "wid", "topic", "base")
    return source.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(score, "loglik double, tokens bigint")


def sample_counts(swept: DataFrame, k: int) -> DataFrame:
    """(wid, n): mean counts over the kept samples."""
    return _sample_means(swept, "wid", k)


def sample_profiles(swept: DataFrame, k: int) -> DataFrame:
    """(doc_id, n): the same by document."""
    return _sample_means(swept, "doc_id", k)


def _sample_means(swept: DataFrame, key: str, k: int) -> DataFrame:
    if "samples" not in swept.columns:
        return _counted(swept.select(key, "topic"), key, k)
    kept = swept.select(F.size("samples")).first()
    counted = _counted(swept.select(key, F.col("samples").alias("topic")), key, k, samples=True)
    return counted.withColumn("n", V.scale(F.col("n"), 1.0 / (kept[0] if kept else 1), k))


def sample_tokens(swept: DataFrame, last: int) -> DataFrame:
    """(doc_id, pos, wid, topic, sweep) of the kept samples; ``last`` is the newest sweep."""
    if "samples" not in swept.columns:
        return unpack_tokens(swept).withColumn("sweep", F.lit(last))
    one = swept.select(
        "doc_id", "pos", "wid", F.size("samples").alias("_s"), F.posexplode("samples").alias("_i", "topic")
    )
    return unpack_tokens(one.withColumn("sweep", (F.lit(last + 1) - F.col("_s") + F.col("_i")).cast("int")), "sweep")


def sample_sizes(swept: DataFrame, last: int, k: int) -> DataFrame:
    """(sweep, doc_id, tokens): tokens with one of the k topics in every kept sample; ``last`` is the newest sweep."""
    samples = F.col("samples") if "samples" in swept.columns else F.array("topic")
    one = swept.select("doc_id", F.size(samples).alias("_s"), F.posexplode(samples).alias("_i", "topic"))
    held = F.size(F.filter("topic", lambda t: t.between(0, k - 1)))
    sizes = one.select((F.lit(last + 1) - F.col("_s") + F.col("_i")).cast("int").alias("sweep"), "doc_id", held.alias("_size"))
    return sizes.where("_size > 0").groupBy("sweep", "doc_id").agg(F.sum("_size").alias("tokens"))


def shard_count(tokens: int, params: TopicParams, at_least: int = 1) -> int:
    """Shards for a corpus; independent of the cluster, so results are too."""
    return max(at_least, math.ceil(tokens / params.tokens_per_shard))
