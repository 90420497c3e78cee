"""Report rollups and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import classify as c

def _sums():
    return [F.sum("avg_claimed").alias("claimed"), F.sum("avg_drained").alias("drained"), F.sum("avg_total_available").alias("available")]


def _percent(of: str = "claimed", by: str = "available"):
    return F.when(F.col(by) > 0, F.col(of) / F.col(by) * 100).otherwise(0.0)


def class_totals(by_device: DataFrame) -> DataFrame:
    """Sums over devices; percentage is the ratio of the sums; classes with devices only."""
    return by_device.groupBy("class").agg(*_sums()).where("available > 0").withColumn("percent", _percent())


def cluster_summary(totals: DataFrame) -> DataFrame:
    """Rows of the summary: available devices of the prioritised total are the primaries alone."""
    prim, back, open_ = (F.col("class").isin(*k) for k in (("Priority-ResearcherOwned", "Priority-PoolOwned"), c.BACKFILL_CLASSES, ("Shared",)))
    s = lambda x, cond: F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0.0))
    rows = (("Prioritized (Primary)", prim, prim), ("Prioritized (Secondary)", back, back), ("Prioritized (TOTAL)", prim | back, prim), ("Open Capacity", open_, open_), ("TOTAL", prim | back | open_, prim | open_))
    wide = totals.agg(F.array(*[F.struct(F.lit(k).alias("row"), s("claimed", u).alias("claimed"), s("drained", u).alias("drained"), s("available", a).alias("available")) for k, u, a in rows]).alias("rows"))
    return wide.select(F.inline("rows")).withColumn("percent", _percent())


def open_tiers(by_device: DataFrame) -> DataFrame:
    return by_device.where("class = 'Shared'").groupBy(d.performance_tier(F.col("device")).alias("tier")).agg(*_sums()).withColumn("percent", _percent())


def prevented_rollup(prevented: DataFrame) -> DataFrame:
    """(row, avg_prevented): classes, prioritised, grand total (primary and shared only) and open tiers.

    ``prevented``: class, device (null for the class itself), avg_prevented.
    """
    whole = prevented.where("device is null")
    s = lambda *k: F.coalesce(F.sum(F.when(F.col("class").isin(*k), F.col("avg_prevented"))), F.lit(0.0))
    sums = (("Prioritized", s("Priority-ResearcherOwned", "Priority-PoolOwned")), ("Secondary", s(*c.BACKFILL_CLASSES)), ("TOTAL", s(*c.REAL_CLASSES)))
    grand = whole.agg(F.array(*[F.struct(F.lit(k).alias("row"), v.alias("avg_prevented")) for k, v in sums]).alias("rows")).select(F.inline("rows"))
    tiers = prevented.where("device is not null and class = 'Shared'").groupBy(F.concat(F.lit("Open Capacity "), d.performance_tier(F.col("device"))).alias("row")).agg(F.sum("avg_prevented").alias("avg_prevented"))
    return whole.select(F.col("class").alias("row"), "avg_prevented").unionByName(grand).unionByName(tiers)


def memory_table(by_memory: DataFrame) -> DataFrame:
    """(memory_category, allocated incl. drained, available, percent, place): TOTAL first, then by size, Unknown last."""
    allocated = (F.col("avg_claimed") + F.col("avg_drained")).alias("allocated")
    rows = by_memory.select("memory_category", allocated, F.col("avg_total_available").alias("available"))
    total = rows.agg(F.sum("allocated").alias("allocated"), F.sum("available").alias("available")).select(F.lit("TOTAL").alias("memory_category"), "allocated", "available")
    k = F.col("memory_category")
    n = F.regexp_extract(k, r"(\d+)", 1).try_cast("double")
    place = F.when(k == "TOTAL", -1.0).when(k == "Unknown", 999.0).when(F.startswith(k, F.lit("<")), n - 0.1).when(F.startswith(k, F.lit(">")), n + 0.1).otherwise(F.coalesce(n, F.lit(0.0)))
    return total.unionByName(rows).withColumns({"percent": _percent("allocated"), "place": place}).orderBy("place")


def user_table(breakdown: DataFrame) -> DataFrame:
    """Per class its total hours, users and share of all, and its users' hours; for ordering by both, descending."""
    grand = F.sum("gpu_hours").over(Window.partitionBy(F.lit(0)))  # one row a class and user
    w = Window.partitionBy("class")
    return breakdown.select("class", "user", "gpu_hours", F.sum("gpu_hours").over(w).alias("class_hours"), F.count(F.lit(1)).over(w).alias("class_users"), (F.sum("gpu_hours").over(w) / grand * 100).alias("class_percent"))


def three_class_totals(by_device: DataFrame) -> DataFrame:
    """Primary (Priority, Shared) and secondary (Backfill) sums, and both together (null)."""
    kind = F.when(F.col("class") == "Backfill", "secondary").otherwise("primary")
    return by_device.rollup(kind.alias("kind")).agg(*_sums()).withColumn("percent", _percent())


def headlines(by_device: DataFrame) -> DataFrame:
    """Percentages by class with all backfill as one."""
    name = F.when(F.startswith("class", F.lit("Backfill")), "Backfill").otherwise(F.col("class"))
    return by_device.groupBy(name.alias("headline")).agg(*_sums()).withColumn("percent", _percent()).select("headline", "percent")


def sparse_coverage(raw: DataFrame, least: float = 0.25) -> DataFrame:
    """One row: share of the window's buckets that have any reason, and whether that is sparse."""
    per = raw.groupBy("bucket").agg(F.max("pj_set").alias("p"))
    out = per.agg(F.count_if("p").alias("pj_buckets"), F.count(F.lit(1)).alias("total_buckets"))
    return out.withColumn("sparse", F.col("pj_buckets") / F.col("total_buckets") < least)


def snapshot_rollup(classes: DataFrame) -> DataFrame:
    """Real (Priority and Shared) and backfill totals of a snapshot's class rows."""
    kind = F.when(F.col("class") == "Backfill", "backfill").otherwise("real")
    out = classes.groupBy(kind.alias("kind")).agg(F.sum("total").alias("total"), F.sum("claimed").alias("claimed"))
    return out.withColumn("percent", _percent("claimed", "total"))


def set_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: devices of ``a`` and ``b``, in both, and in ``b`` only."""
    x, y = a.select("AssignedGPUs").where("AssignedGPUs is not null").distinct(), b.select("AssignedGPUs").where("AssignedGPUs is not null").distinct()
    marks = x.withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(y.withColumns({"a": F.lit(0), "b": F.lit(1)})).groupBy("AssignedGPUs").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return marks.agg(F.sum("a").alias("first"), F.sum("b").alias("second"), F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.col("b") * (1 - F.col("a"))).alias("second_only"))


def backfill_only(frames: c.Frames) -> DataFrame:
    """(bucket, Machine, gpus): devices in a bucket's backfill that neither priority nor shared rows have."""
    rest = c.state_filter(frames, "Priority").select("bucket", "AssignedGPUs").union(c.state_filter(frames, "Shared").select("bucket", "AssignedGPUs"))
    only = c.state_filter(frames, "Backfill").where("AssignedGPUs is not null").select("bucket", "Machine", "AssignedGPUs").distinct().join(rest, ["bucket", "AssignedGPUs"], "left_anti")
    return only.groupBy("bucket", "Machine").agg(F.count(F.lit(1)).alias("gpus"))


def backfill_only_projects(frames: c.Frames) -> DataFrame:
    """(Machine, project, rows, gpus): backfill rows of devices that no priority row has, by machine and project (none: ``None``)."""
    known = c.state_filter(frames, "Priority").where("AssignedGPUs is not null").select("AssignedGPUs").distinct()
    only = c.state_filter(frames, "Backfill").where("AssignedGPUs is not null").join(known, "AssignedGPUs", "left_anti")
    project = F.when(F.coalesce("PrioritizedProjects", F.lit("")) == "", "None").otherwise(F.col("PrioritizedProjects"))
    gpus = only.groupBy("Machine", project.alias("project"), "AssignedGPUs").agg(F.count(F.lit(1)).alias("n"))
    return gpus.groupBy("Machine", "project").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("gpus"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
