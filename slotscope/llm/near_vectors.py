"""Near duplicates among embeddings by randomised-rotation binary codes.

A unit vector is rotated at random and keeps one sign bit a dimension, with the correction factor
``<code, vector>``. For another vector, itself rotated and rounded at random to four bits a
dimension, ``<code, other> / <code, vector>`` is an unbiased estimate of the inner product, and
its error shrinks with the square root of the dimensions; it takes a few ANDs and bit counts on
longs. Pairs whose upper confidence bound misses the threshold are done with; all others are
computed again in double precision from the stored vectors.

Which pairs are estimated: further rotations give each vector ``TABLES`` keys of sign bits, and
vectors meet where they share a key. The number of bits follows the number of vectors, so that a
bucket of unlike vectors keeps its size. A pair at the threshold shares none of the keys with a
chance below a thousandth, closer pairs far more rarely still.

Equal vectors are one class from the start. Around the densest part of an overfull bucket a ball
is drawn whose radius is half the threshold's angle: its members all link with one another, so
they are counted and joined by the ball alone and never paired. A third of all rows may be in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotscope.llm import components
from slotscope.llm.durable import durable, release

#: Keys of a vector; vectors that share one are estimated.
TABLES = 24
#: Unlike vectors that a bucket holds on average; a bucket is overfull from twice as many on.
BUCKET = 32
#: Standard deviations of the estimate in its confidence bound.
SURE = 4.5
#: Bits a dimension of the vector that is set against a code.
PLANES = 4
#: Rows of an overfull bucket that say where its densest part is (the ball then takes members from all rows).
SAMPLE = 256
#: Tables whose overfull buckets are looked at, and tables by which members find their ball.
SEED_TABLES, BALL_TABLES = 2, 8
_SEED = 20_240


def _rotation(dim: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([_SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _padded(dim: int) -> int:
    return -(-dim // 64) * 64


def _packed(bits: np.ndarray) -> np.ndarray:
    """(rows, 64 k) booleans as (rows, k) signed longs."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


CODED = "node bigint, dim int, factor double, code array<bigint>, planes array<bigint>, low double, step double, keys array<bigint>"


def _encode(bits: int, tables: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[tuple[int, int], np.ndarray] = {}

        def rotate(unit: np.ndarray, number: int) -> np.ndarray:
            at = (unit.shape[1], number)
            if at not in turned:
                turned[at] = _rotation(*at)
            return unit @ turned[at]

        for batch in batches:
            node, vectors = batch.column("node").to_numpy(), batch.column("vector")
            dims = np.diff(vectors.offsets.to_numpy())
            flat, offset = vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.zeros((len(rows), _padded(dim)))
                x[:, :dim] = flat[offset[rows][:, None] + np.arange(dim)]
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y = rotate(x, 0)
                width = x.shape[1]
                factor = np.abs(y).sum(axis=1) / math.sqrt(width)
                low = y.min(axis=1)
                step = np.maximum((y.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
                # Rounding up or down at random, by the row alone, keeps the estimate unbiased.
                r = np.random.default_rng([_SEED, int(dim)]).random((1, width))
                levels = np.minimum(np.floor((y - low[:, None]) / step[:, None] + r), 2**PLANES - 1).astype(np.uint8)
                planes = np.concatenate([_packed(levels >> j & 1) for j in range(PLANES)], axis=1)
                signs = np.concatenate([rotate(x, 1 + k) > 0 for k in range(-(-bits * tables // width))], axis=1)[:, : bits * tables]
                keys = signs.reshape(len(rows), tables, bits) @ (np.int64(1) << np.arange(bits))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[rows]), pa.array(np.full(len(rows), dim, np.int32)), pa.array(factor), _lists(_packed(y > 0), pa.int64()), _lists(planes, pa.int64()), pa.array(low), pa.array(step), _lists(keys, pa.int64()),
                    ],
                    names=["node", "dim", "factor", "code", "planes", "low", "step", "keys"],
                )
        release()

    return encode


def _estimate_reaches(threshold: float, words: int) -> Column:
    """Whether the upper bound of the estimate of q's inner product with o's vector reaches ``threshold``; both have ``words`` longs of code."""
    d = 64 * words
    count = lambda c: sum((F.bit_count(x) for x in c), F.lit(0))
    code = [F.col("o.code")[w] for w in range(words)]
    ones = count(code)
    dot = sum((2**j * count([code[w].bitwiseAND(F.col("q.planes")[j * words + w]) for w in range(words)]) for j in range(PLANES)), F.lit(0))
    whole = sum((2**j * count([F.col("q.planes")[j * words + w] for w in range(words)]) for j in range(PLANES)), F.lit(0))
    signed = F.col("q.step") * (2 * dot - whole) + F.col("q.low") * (2 * ones - d)
    estimate = signed / (math.sqrt(d) * F.col("o.factor"))
    spread = F.sqrt((1 - F.col("o.factor") ** 2) / (d - 1) + F.col("q.step") ** 2 / 4) / F.col("o.factor")
    return estimate + SURE * spread >= threshold


def _cosine(a: Column, b: Column) -> Column:
    """In double precision; vectors are scaled by their largest component, so that squares neither overflow nor vanish."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _scaled(v: str) -> Column:
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.transform(v, lambda x: x / most)


def _centres(sampled: DataFrame, least: float, share: int) -> DataFrame:
    """(ball, weight, vector): the mean of the densest part of each bucket's sample, where that has enough rows."""

    def densest(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["vector"].tolist())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        at = int(near.sum(axis=1).argmax())
        if near[at].sum() < max(8, len(x) // share):
            return pd.DataFrame({"weight": pd.Series(dtype="int64"), "vector": pd.Series(dtype=object)})
        centre = x[near[at]].mean(axis=0)
        return pd.DataFrame({"weight": [int(rows["size"].iloc[0] * near[at].mean())], "vector": [centre / np.linalg.norm(centre)]})

    found = sampled.groupBy("dim", "t", "key").applyInPandas(densest, "weight bigint, vector array<double>")
    return found.select((-1 - F.monotonically_increasing_id()).alias("ball"), "weight", "vector")


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; ``threshold`` is a cosine above 0.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths; a row without an identifier keeps its row, links with nothing
    and has a null component. Equal vectors link. Rows that repeat an identifier count as vectors of
    their own. Other columns are ignored, an empty table gives no rows. No pair below ``threshold`` is
    ever linked; ``tables`` sets how rarely one above it is missed.
    """
    whole = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    # Classes of equal vectors, by the vectors themselves.
    classes = whole.where(good).groupBy("vector").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))
    classes = durable(classes.select(F.monotonically_increasing_id().alias("node"), "w", "least", _scaled("vector").alias("unit"), "vector"))
    n = classes.count()
    bits = min(40, max(4, math.ceil(math.log2(max(n, 2) / BUCKET))))
    coded = durable(classes.select("node", F.col("unit").alias("vector")).mapInArrow(_encode(bits, tables), CODED))
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    buckets = lambda rows, t: rows.select("*", F.posexplode(F.slice("keys", 1, t)).alias("t", "key")).drop("keys")

    # Balls.
    seeds = buckets(coded.select("node", "dim", "keys"), SEED_TABLES)
    full = seeds.groupBy("dim", "t", "key").agg(F.count("*").alias("size")).where(F.col("size") >= 2 * BUCKET)
    order = Window.partitionBy("dim", "t", "key").orderBy(F.xxhash64("node"))
    sampled = seeds.join(full, ["dim", "t", "key"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE)
    centres = durable(_centres(sampled.join(classes.select("node", F.col("unit").alias("vector")), "node"), half, 8))
    balls = classes.select("node", "w", F.lit(None).cast("bigint").alias("ball"))
    if not centres.isEmpty():
        around = centres.select(F.col("ball").alias("node"), "vector").mapInArrow(_encode(bits, tables), CODED).select("dim", F.col("node").alias("ball"), "keys")
        met = buckets(coded.select("node", "dim", "keys"), BALL_TABLES).join(buckets(around, BALL_TABLES), ["dim", "t", "key"]).select("node", "ball").distinct()
        inside = met.join(centres.withColumnRenamed("vector", "centre"), "ball").join(classes.select("node", "unit"), "node").where(_cosine(F.col("unit"), F.col("centre")) >= half)
        chosen = inside.groupBy("node").agg(F.min(F.struct((-F.col("weight")).alias("minus"), "ball")).alias("b")).select("node", "b.ball")
        balls = classes.select("node", "w").join(chosen, "node", "left")
    balls = durable(balls)
    weights = balls.where("ball IS NOT NULL").groupBy("ball").agg(F.sum("w").alias("ball_w"), F.min("node").alias("head"))

    # Pairs that are not of one ball.
    rows = coded.join(balls.select("node", "ball"), "node")
    entries = buckets(rows, tables)
    found = None
    for (dim,) in coded.select("dim").distinct().collect():
        words = _padded(dim) // 64
        here = entries.where(F.col("dim") == dim)
        # Both sides are cut to what they need: four bits a dimension here, one there.
        q = here.where("ball IS NULL").select("t", "key", "node", "planes", "low", "step").alias("q")
        o = here.select("t", "key", "node", "ball", "code", "factor").alias("o")
        meets = (F.col("q.t") == F.col("o.t")) & (F.col("q.key") == F.col("o.key"))
        once = F.col("o.ball").isNotNull() | (F.col("q.node") < F.col("o.node"))
        pairs = q.join(o, meets & once & (F.col("q.node") != F.col("o.node")) & _estimate_reaches(threshold, words)).select(F.col("q.node").alias("a"), F.col("o.node").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        if not centres.isEmpty():
            held = rows.where((F.col("dim") == dim) & F.col("ball").isNotNull())
            # Balls whose centres are too far apart for any two of their members.
            shared = buckets(held.select("ball", "keys"), tables).select("t", "key", "ball").distinct()
            close = shared.alias("x").join(shared.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.ball") < F.col("y.ball"))).select(F.col("x.ball").alias("qb"), F.col("y.ball").alias("ob")).distinct()
            apart = math.cos(min(math.pi, 2 * math.acos(threshold))) - 1e-9
            close = close.join(centres.select(F.col("ball").alias("qb"), F.col("vector").alias("qv")), "qb").join(centres.select(F.col("ball").alias("ob"), F.col("vector").alias("ov")), "ob").where(_cosine(F.col("qv"), F.col("ov")) >= apart).select("qb", "ob")
            q = held.select("ball", "node", "planes", "low", "step").join(close, F.col("ball") == F.col("qb")).alias("q")
            o = held.select("ball", "node", "code", "factor").alias("o")
            across = q.join(o, (F.col("q.ob") == F.col("o.ball")) & _estimate_reaches(threshold, words))
            found = found.unionByName(across.select(F.col("q.node").alias("a"), F.col("o.node").alias("b")))
    alone = lambda rows: rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if found is None:
        return alone(whole)
    # A pair may meet in several tables.
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda name: classes.select(F.col("node").alias(name), F.col("unit").alias(f"{name}_unit"), F.col("w").alias(f"{name}_w"))
    links = durable(pairs.join(side("a"), "a").join(side("b"), "b").where(_cosine(F.col("a_unit"), F.col("b_unit")) >= threshold).select("a", "b", "a_w", "b_w"))

    outside = links.select(F.col("a").alias("node"), F.col("b_w").alias("others")).unionByName(links.select(F.col("b").alias("node"), F.col("a_w").alias("others"))).groupBy("node").agg(F.sum("others").alias("others"))
    # A ball is one node among components: that of its head.
    heads = durable(balls.join(weights, "ball", "left").select("node", "w", "ball_w", F.coalesce("head", "node").alias("head")))
    ends = links.join(heads.select(F.col("node").alias("a"), F.col("head").alias("ha")), "a").join(heads.select(F.col("node").alias("b"), F.col("head").alias("hb")), "b")
    parts = components.connected_components(ends.select(F.col("ha").alias("a"), F.col("hb").alias("b")).where("a != b").distinct())
    told = heads.join(parts.withColumnRenamed("node", "head"), "head", "left").join(outside, "node", "left").join(classes.select("node", "least"), "node")
    told = durable(told.select("node", F.coalesce("component", "head").alias("part"), "least", (F.coalesce("ball_w", "w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    smallest = told.groupBy("part").agg(F.min("least").alias("component_id"))
    answer = told.join(smallest, "part").join(classes.select("node", "vector"), "node").select("vector", "n_links", "component_id")
    linked = whole.where(good).join(answer, "vector").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone(whole.where(~good)))
