"""Sharding by sampled splitters, DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. A size-weighted
sample of keys gives the splitters of many more ranges than shards; ranges that turn out overfull
are sampled again, more densely, and subdivided (the identifier is part of the key, so a group of
copies splits as well). The exact sizes of the ranges give every range its place in the whole
order, a running sum inside each range gives every row its own, and a shard is a stretch of equal
bytes: shards differ by less than two rows' sizes.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotscope.llm.durable import durable, parallelism

#: Rows drawn for each range that the splitters make.
DRAWN_PER_RANGE = 24
#: A range is overfull beyond so many times the size aimed at.
OVERFULL = 2.0
#: Rounds of subdividing; what one identifier repeated holds can't be divided further.
ROUNDS = 4


def _key() -> Column:
    return F.struct("h", "doc_id")


def _order(key: tuple[int, int | None]) -> tuple:
    """Sorts keys as Spark does: null identifiers first."""
    return key[0], key[1] is not None, key[1] or 0


def _uniform(salt: int) -> Column:
    """A fixed number in [0, 1) of each row."""
    return F.pmod(F.xxhash64("h", "doc_id", F.lit(salt)), F.lit(1 << 30)) / (1 << 30)


def _draw(rows: DataFrame, every: float, salt: int) -> list[tuple[int, int | None]]:
    """Keys, each as often as once in ``every`` bytes of its row on average."""
    times = F.floor(F.col("size") / every + _uniform(salt)).cast("int")
    drawn = rows.withColumn("times", times).where("times > 0").select("h", "doc_id", F.least("times", F.lit(DRAWN_PER_RANGE)).alias("times")).collect()
    return sorted(((r["h"], r["doc_id"]) for r in drawn for _ in range(r["times"])), key=_order)


def _quantiles(keys: list, n: int) -> list:
    """Up to n - 1 distinct splitters between n parts of equal weight."""
    return list(dict.fromkeys(keys[len(keys) * i // n] for i in range(1, n) if keys))


def _range_of(splitters: list[tuple[int, int | None]]) -> Column:
    """How many splitters are <= the row's key, by bisection in a constant array."""
    if not splitters:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(h).cast("bigint").alias("h"), F.lit(i).cast("bigint").alias("doc_id")) for h, i in splitters])
    n = len(splitters)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    take = lambda lo, s: F.when((lo + s <= n) & (F.element_at(table, F.least(lo + s, F.lit(n))) <= _key()), lo + s).otherwise(lo)
    return F.aggregate(steps, F.lit(0), take)


def range_places(rows: DataFrame, range_bytes: int) -> DataFrame:
    """``rows`` (h, doc_id, size, ...) with ``before`` (bytes in front) and ``at`` (rows in front) in key order.

    ``rows`` must be cheap to read again. The splitters and the ranges' sizes pass through the
    driver: a few numbers for each ``range_bytes`` bytes of ``size``, and at least one a shuffle partition.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return rows.withColumns({"before": F.lit(0).cast("bigint"), "at": F.lit(0).cast("bigint")})
    n = max(parallelism(rows.sparkSession), math.ceil(total["b"] / range_bytes))
    aim = total["b"] / n
    splitters = _quantiles(_draw(rows, aim / DRAWN_PER_RANGE, 0), n)
    for again in range(1, ROUNDS + 1):
        ranged = rows.withColumn("range", _range_of(splitters))
        sizes = {r["range"]: (r["b"], r["n"], r["k"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), (F.min(_key()) != F.max(_key())).alias("k")).collect()}
        overfull = [k for k, (b, _, several) in sizes.items() if b > OVERFULL * aim and several]
        if not overfull or again == ROUNDS:
            break
        dense = aim / (DRAWN_PER_RANGE * 4**again)
        ends = list(map(_order, splitters))
        inside: dict[int, list] = {}
        for key in _draw(ranged.where(F.col("range").isin(overfull)), dense, again):
            inside.setdefault(bisect_right(ends, _order(key)), []).append(key)
        for k, drawn in inside.items():
            splitters += _quantiles(drawn, math.ceil(sizes[k][0] / aim) + 1)
        splitters = sorted(set(splitters), key=_order)
    starts, b, at = [], 0, 0
    for k in range(len(splitters) + 1):
        starts.append((b, at))
        b, at = b + sizes.get(k, (0, 0))[0], at + sizes.get(k, (0, 0))[1]
    first = [F.array(*[F.lit(x[i]).cast("bigint") for x in starts]) for i in (0, 1)]
    w = Window.partitionBy("range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"before": F.sum("size").over(w) - F.col("size"), "at": F.count(F.lit(1)).over(w) - 1})
    return placed.withColumns({"before": F.element_at(first[0], F.col("range") + 1) + F.col("before"), "at": F.element_at(first[1], F.col("range") + 1) + F.col("at")}).drop("range")


def shard_documents(docs: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text", overhead: int = 16, range_bytes: int = 64 << 20) -> DataFrame:
    """For every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: each shard holds a stretch of total / n_shards bytes of the key order, a
    row belonging where its middle byte falls. ``slot`` numbers a shard's rows from 0 without gaps.
    Null text has size ``overhead``. Null identifiers sort first among equal texts. Repeated rows
    get a slot each. An empty table gives an empty result; other columns are ignored.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = durable(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(t) + overhead).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    middle = (F.col("before") + F.floor(F.col("size") / 2)).cast("decimal(30,0)")
    shard = F.least(F.floor(middle * n_shards / max(total, 1)).cast("int"), F.lit(n_shards - 1))
    placed = durable(range_places(rows, range_bytes).select("doc_id", "size", "text_crc32", "at", shard.alias("shard")))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
