"""Near-duplicate documents by b-bit MinHash over word shingles.

A document's set holds its distinct shingles of ``SHINGLE`` lower-cased words
(all words as one shingle if there are fewer). Two documents are linked when
100 x intersection >= ``PERCENT`` x union. The job, stage by stage:

1. One pass over the texts takes ``BANDS x ROWS`` minima per set. Bands of whole
   minima become 64-bit bucket keys; only the low two bits of each minimum are
   kept as the signature, packed into longs.
2. Equal sets are one class, so groups of copies cost one member from here on.
3. Buckets of one class are dropped by a count that is combined before the
   shuffle. In the rest every class is first paired with its bucket's least
   class only; links found so far give components.
4. What is left are pairs of a bucket that lie in different components. Members
   outside the bucket's largest component meet those of like size in the rest of
   the bucket, so one filled by a group of near copies makes few pairs or none.
5. A pair leaves its bucket only if its sizes allow the threshold and the
   similarity estimated from the signatures, corrected for chance agreement of two
   bits, is not under ``PERCENT`` by more than six standard errors. Pairs of stage 4,
   which in a group of copies just below the threshold would be almost all pairs,
   must also pass a bound that is exact: every shingle that one set alone holds turns
   one of ``PARITY`` bits, so two sets differ in at least as many shingles as parity
   bits. Links are confirmed on full sets.

Every pair of a bucket is thus either compared or already in one component. A
pair exactly at the threshold misses all 34 bands of 6 with probability 1e-7.

Defined results: null or wordless text: an empty set, linked with nothing;
null ``doc_id``: linked with nothing, ``component_id`` null, kept; rows that
repeat a ``doc_id`` are one node whose links are those of all its texts; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import components
from topicloom.llm.hashing import gram_hashes, lower_ascii, mix, word_hashes
from topicloom.storage import materialize, spread

SHINGLE = 5
PERCENT = 85
BANDS = 34
ROWS = 6
BITS = 2
LONGS = -(-BANDS * ROWS * BITS // 64)
LANES = 64 // BITS
PARITY = 2048
STEP = 0.17  # of the logarithm of set sizes; over -log(PERCENT / 100)

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_FACTORS = (_SEEDS[: BANDS * ROWS] | np.uint64(1))[:, None]
_SHIFTS = _SEEDS[BANDS * ROWS :][:, None]
_WEIGHTS = mix(np.arange(1000, 1000 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND_SALTS = mix(np.arange(5000, 5000 + BANDS, dtype=np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = word_hashes(lower_ascii((text or "").encode()))
    return np.unique(gram_hashes(words, min(SHINGLE, max(len(words), 1))))


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of every hash function over a set, in slices of bounded size."""
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for start in range(0, len(shingles), 1024):
        block = _FACTORS * shingles[start : start + 1024] + _SHIFTS
        np.minimum(low, block.min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """Low ``BITS`` bits of every minimum, packed into longs."""
    lanes = np.zeros(LONGS * LANES, np.uint64)
    lanes[: len(low)] = mix(low) & np.uint64((1 << BITS) - 1)
    places = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(lanes.reshape(LONGS, LANES) << places, axis=1)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Per slot of a set's hashes whether it holds an odd number, packed into longs."""
    odd = np.bincount(((shingles >> np.uint64(16)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    return mix((mix(low).reshape(BANDS, ROWS) * _WEIGHTS).sum(axis=1, dtype=np.uint64) + _BAND_SALTS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, digests, bands, bits, odd = [], [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            shingles = shingle_set(text.as_py())
            ids.append(doc_id)
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            low = minima(shingles)
            bands.append(band_keys(low).view(np.int64))
            bits.append(packed(low).view(np.int64))
            odd.append(parity(shingles))
        yield pa.record_batch({
            "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
            "bits": pa.array(bits, pa.list_(pa.int64())), "parity": pa.array(odd, pa.list_(pa.int64())),
        })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        sets = [shingle_set(text.as_py()).view(np.int64) for text in texts]
        yield pa.record_batch({"node": batch.column("node"), "items": pa.array(sets, pa.list_(pa.int64()))})


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands, bits, parity)`` per document."""
    source = spread(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id")
    return source.mapInArrow(
        _signatures, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, bits array<bigint>, parity array<bigint>"
    )


def estimated_similarity(a: str, b: str):
    """Similarity from the packed signatures ``a`` and ``b``, corrected for chance agreement."""
    low = "CAST(6148914691236517205 AS BIGINT)"  # a one in every lane
    differing = [f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {low})" for x in (f"({a}[{i}] ^ {b}[{i}])" for i in range(LONGS))]
    share = 1 - F.expr(" + ".join(differing)) / F.lit(BANDS * ROWS)
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def estimate_floor() -> float:
    chance, s = 2.0**-BITS, PERCENT / 100
    match = chance + (1 - chance) * s
    return s - 6 * (match * (1 - match) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    sides = [sets.select(F.col("node").alias(n), F.col("items").alias(f"items_{n}")) for n in ("a", "b")]
    both = F.size(F.array_intersect("items_a", "items_b"))
    whole = F.size("items_a") + F.size("items_b") - both
    joined = reduce(lambda df, side: df.join(side, side.columns[0]), sides, pairs)
    return joined.where(both * 100 >= whole * PERCENT).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row."""
    signed = materialize(signatures(docs), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    copies = known.join(first, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    classes = materialize(
        known.join(first.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "bits", "parity"), "classes")

    members = classes.select("node", F.explode("bands").alias("bucket")).distinct()
    full = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    shared = materialize(members.join(full, "bucket").select("bucket", "node", "pivot"), "buckets")
    wanted = shared.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = materialize(texts.mapInArrow(_sets, "node bigint, items array<bigint>"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        return materialize(_confirmed(pairs.distinct(), sets), "links")

    held = materialize(shared.select("bucket", "node").join(classes.select("node", "n", "bits"), "node"), "held")
    stars = links(_around(held, shared.select("bucket", F.col("pivot").alias("b")).distinct(), classes))
    placed = materialize(_placed(held, components(stars)), "placed")
    most = _largest(placed)
    again = links(_around(placed.join(most, "bucket").where("component <> most"), most.select("bucket", F.col("most").alias("b")), classes))
    found = stars.union(again)
    placed = materialize(_placed(held, components(found)), "placed")
    contested = placed.join(_largest(placed), "bucket").join(classes.select("node", "bits", "parity"), ["node", "bits"])
    rest = links(_across(contested))
    labels = components(found.union(rest).union(copies))
    component = F.coalesce("component", "doc_id")
    return (
        signed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"),
                F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    )


def _around(members: DataFrame, centres: DataFrame, classes: DataFrame) -> DataFrame:
    """Plausible pairs of bucket members with their bucket's centre ``(bucket, b)``."""
    side = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    own = members.select("bucket", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    return own.join(centres.join(side, "b"), "bucket").where("a <> b").where(_allowed()).select("a", "b")


def _across(members: DataFrame) -> DataFrame:
    """Plausible pairs of a bucket in different components, one side outside its largest component.

    Only sets of like size can be linked, so members meet by bucket and size step
    (a step's ratio is below the threshold: neighbouring steps suffice), and what
    sizes or signatures rule out never leaves the join.
    """
    held = members.withColumn("step", F.floor(F.log("n") / STEP))
    x = held.where("component <> most").select(
        "bucket", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"),
        F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("parity").alias("parity_a"))
    y = held.select(
        "bucket", "step", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("n_b"),
        F.col("bits").alias("bits_b"), F.col("parity").alias("parity_b"), "most")
    apart = "ca <> cb and (cb = most or a > b)"
    return x.join(y, ["bucket", "step"]).where(apart).where(_allowed()).where(_near()).select("a", "b")


def _near():
    """Whether parity leaves the threshold possible: J >= p means a difference of at most (1 - p) / (1 + p) of both sizes."""
    turned = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return turned * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)


def _allowed():
    """Whether the sizes and signatures of a pair leave the threshold possible."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    return sizes & (estimated_similarity("bits_a", "bits_b") >= estimate_floor())


def _placed(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members with the component they are in so far."""
    return held.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _largest(placed: DataFrame) -> DataFrame:
    """``(bucket, most)``: the component with most members, of buckets that hold several components."""
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    return (
        sizes.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("top"))
        .where("parts > 1").select("bucket", F.col("top.component").alias("most"))
    )
