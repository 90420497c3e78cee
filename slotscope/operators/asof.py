"""As-of lookup: for every point the latest fact up to it, or the nearest one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("backward", "nearest")


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def as_of(points: DataFrame, facts: DataFrame, at: str, since: str, values: Sequence[str], by: Sequence[str] = (), direction: str = "backward", cell_hours: float = 24.0) -> DataFrame:
    """``points`` with the ``values`` and the time ``since`` of a fact of the same ``by``, null where there is none.

    ``backward`` takes the latest fact with since <= at, ``nearest`` the one with the least distance
    (of two equally far ones the later). Of facts at one time the largest values count. Points
    without a time get nulls; facts without one, and rows with a null key, match nothing.

    Both sides are put in one order by time within cells of ``cell_hours``: that is what is
    partitioned, so no key and no stretch of time comes to one task as a whole. Across cells only
    the first and last fact of each is carried, a row a key and cell. Work is linear in both sides.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    span = int(cell_hours * 3_600_000_000)
    keys = [f"__k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    fact = F.struct(F.col("__t").alias("t"), *values, since)
    known = facts.withColumn("__t", _micros(F.col(since))).where("__t is not null").select(*named, "__t", F.floor(F.col("__t") / span).alias("__cell"), fact.alias("__fact"))
    asked = points.withColumn("__t", _micros(F.col(at))).select(*named, "__t", F.floor(F.col("__t") / span).alias("__cell"), F.struct(*points.columns).alias("__point"))
    both = known.withColumn("__point", F.lit(None).cast(asked.schema["__point"].dataType)).unionByName(asked.withColumn("__fact", F.lit(None).cast(known.schema["__fact"].dataType)))
    # In time order; facts come before the points of their time, and the largest of them last.
    w = Window.partitionBy(*keys, "__cell").orderBy("__t", F.col("__point").isNotNull(), "__fact")
    found = {"__before": F.last("__fact", True).over(w.rowsBetween(Window.unboundedPreceding, 0))}
    if direction == "nearest":
        # Facts of a later time, in order; within one time the largest comes first here.
        back = Window.partitionBy(*keys, "__cell").orderBy(F.desc("__t"), F.col("__point").isNotNull(), "__fact")
        found["__after"] = F.last("__fact", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns(found).where("__point is not null")
    # One row a key and cell: what earlier and later cells hand on.
    earliest = F.max_by("__fact", F.struct(-F.col("__t"), "__fact"))
    cells = known.groupBy(*keys, "__cell").agg(F.max("__fact").alias("last"), earliest.alias("first"))
    wanted = asked.select(*keys, "__cell").where("__cell is not null").distinct()
    none = F.lit(None).cast(known.schema["__fact"].dataType)
    ladder = cells.select(*keys, "__cell", "last", "first", F.lit(False).alias("asked")).unionByName(wanted.select(*keys, "__cell", none.alias("last"), none.alias("first"), F.lit(True).alias("asked")))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__cell")
    up, down = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(1, Window.unboundedFollowing)
    ladder = ladder.select(*keys, "__cell", "asked", F.last("last", True).over(up).alias("earlier"), F.first("first", True).over(down).alias("later")).where("asked").drop("asked")
    on = F.expr(" and ".join(["p.__cell = l.__cell", *[f"p.{k} <=> l.{k}" for k in keys]]))
    joined = placed.alias("p").join(ladder.alias("l"), on, "left")
    valid = F.expr(" and ".join(["p.__t is not null", *[f"p.{k} is not null" for k in keys]]))
    before = F.when(valid, F.coalesce("__before", "earlier"))
    if direction == "nearest":
        after = F.when(valid, F.coalesce("__after", "later"))
        t = F.col("p.__t")
        pick = F.when(before.isNull(), after).when(after.isNull(), before).when(after["t"] - t <= t - before["t"], after).otherwise(before)
    else:
        pick = before
    return joined.withColumn("__pick", pick).select("__point.*", *[F.col(f"__pick.{c}").alias(c) for c in (*values, since)])
