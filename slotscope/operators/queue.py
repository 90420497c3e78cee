"""Idle-job intervals, queue pressure, fair share and contention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotscope.functions import derive as d

BUCKET = 900


def merge_sightings(sightings: DataFrame, gap: int = 5400, kept: Sequence[str] = ("Owner", "RequestGPUs", "Project")) -> DataFrame:
    """Intervals of each job: sightings at most ``gap`` seconds apart merge; attributes of the first stay."""
    return merge_intervals(sightings.select("GlobalJobId", *kept, F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen")), gap, kept)


def merge_intervals(rows: DataFrame, gap: int, kept: Sequence[str] = ("Owner", "RequestGPUs", "Project")) -> DataFrame:
    """As merge_sightings for intervals: a row joins if it starts at most ``gap`` after the row before ended; the last row's end counts."""
    w = Window.partitionBy("GlobalJobId").orderBy("first_seen", "last_seen", *kept)
    new = F.coalesce((F.col("first_seen") - F.lag("last_seen").over(w) > gap).cast("int"), F.lit(1))
    islands = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    order = F.struct("first_seen", "last_seen", *kept)
    out = islands.groupBy("GlobalJobId", "island").agg(F.min(order).alias("a"), F.max(order).alias("z"))
    return out.select("GlobalJobId", *[F.col(f"a.{k}").alias(k) for k in kept], F.col("a.first_seen").alias("first_seen"), F.col("z.last_seen").alias("last_seen"))


def sampling_interval(sightings: DataFrame, default: int = 1800) -> DataFrame:
    """One row: most common positive gap between a job's sightings (ties: the smallest), and twice that as threshold."""
    w = Window.partitionBy("GlobalJobId").orderBy("seen")
    gaps = sightings.select((F.col("seen") - F.lag("seen").over(w)).alias("gap")).where("gap > 0")
    return gaps.agg(F.coalesce(F.mode("gap", True), F.lit(default).cast("bigint")).alias("interval")).select("interval", (F.col("interval") * 2).alias("threshold"))


def upsert_intervals(open_rows: DataFrame, polled: DataFrame, now: int, gap: int = 5400) -> DataFrame:
    """One poll: jobs last seen within ``gap`` of ``now`` are extended, others open a new interval."""
    extend = F.col("last_seen") >= now - gap
    recent = open_rows.where(extend).select("GlobalJobId", "first_seen").groupBy("GlobalJobId").agg(F.max("first_seen").alias("open"))
    seen = polled.join(recent, "GlobalJobId", "left")
    opened = seen.where("open is null").drop("open").withColumns({"first_seen": F.lit(now).cast("bigint"), "last_seen": F.lit(now).cast("bigint")})
    hit = seen.where("open is not null").select("GlobalJobId", F.col("open").alias("first_seen"), F.lit(True).alias("hit"))
    kept = open_rows.join(hit, ["GlobalJobId", "first_seen"], "left").withColumn("last_seen", F.when(F.col("hit"), F.lit(now).cast("bigint")).otherwise(F.col("last_seen"))).drop("hit")
    return kept.unionByName(opened.select(kept.columns))


def pressure(intervals: DataFrame, start: int, end: int, project: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    """(bucket, owner, queued_gpus): each interval counts in every 15-minute bucket that it overlaps.

    Intervals are clipped to the window first, so one explodes into its buckets only; no range join.
    """
    rows = intervals
    if project:
        rows = rows.where(F.contains(F.lower("Project"), F.lit(project.lower())))
    if exclude:
        rows = rows.where(~d.user_name(F.col("Owner")).isin(*exclude) | F.col("Owner").isNull())
    lo = start - start % BUCKET
    hi = lo + (end - lo) // BUCKET * BUCKET
    first, last = F.greatest(F.floor(F.col("first_seen") / BUCKET) * BUCKET, F.lit(lo)), F.least(F.floor(F.col("last_seen") / BUCKET) * BUCKET, F.lit(hi))
    rows = rows.withColumns({"b0": first, "b1": last}).where("b0 <= b1")
    long = rows.select(F.explode(F.sequence("b0", "b1", F.lit(BUCKET).cast("bigint"))).alias("bucket"), F.when(F.coalesce("Owner", F.lit("")) == "", "Unknown").otherwise(F.col("Owner")).alias("owner"), F.coalesce("RequestGPUs", F.lit(0.0)).alias("g"))
    return long.groupBy("bucket", "owner").agg(F.sum("g").alias("queued_gpus"))


def pressure_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("owner").agg((F.sum("queued_gpus") * 0.25).alias("gpu_hours"), F.max("queued_gpus").alias("peak"))


def user_series(rows: DataFrame) -> DataFrame:
    """(bucket, user, gpus): distinct devices of claimed rows with an owner."""
    mine = rows.where("State = 'Claimed' and RemoteOwner != '' and AssignedGPUs is not null")
    return mine.groupBy("bucket", F.col("RemoteOwner").alias("user")).agg(F.count_distinct("AssignedGPUs").alias("gpus"))


def user_hours(series: DataFrame) -> DataFrame:
    """Hours of each user and their share; the total is one row beside, from the same shuffle."""
    hours = series.groupBy("user").agg((F.sum("gpus") * 0.25).alias("gpu_hours"))
    total = hours.agg(F.sum("gpu_hours").alias("whole"))
    return hours.join(F.broadcast(total)).select("user", "gpu_hours", (F.col("gpu_hours") / F.col("whole") * 100).alias("share"))


def gini(hours: DataFrame, cells: int = 256) -> DataFrame:
    """One row: Gini coefficient of the users' hours, by ranks; 0 for fewer than two users or none used.

    Users with equal hours are one row. Ranks come from ``cells`` ranges of about equal size: within
    a range from its order, across ranges from a running total of one row a range, so that no task
    sorts all users. Where the ranges lie changes no rank.
    """
    values = hours.where("gpu_hours is not null").groupBy("gpu_hours").agg(F.count(F.lit(1)).alias("m"))
    cuts = values.agg(F.percentile_approx("gpu_hours", [i / cells for i in range(1, cells)], 100 * cells).alias("cuts"))
    placed = values.join(F.broadcast(cuts)).select("gpu_hours", "m", F.size(F.filter("cuts", lambda c: c < F.col("gpu_hours"))).alias("cell"))
    sums = placed.groupBy("cell").agg(F.sum("m").alias("held"))
    earlier = sums.select("cell", F.coalesce(F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # at most ``cells`` rows
    inside = Window.partitionBy("cell").orderBy("gpu_hours").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(F.broadcast(earlier), "cell")
    m, before = F.col("m"), F.col("earlier") + F.col("inside")
    s = ranked.agg(F.sum(F.col("gpu_hours") * (m * before + m * (m + 1) / 2)).alias("ix"), F.sum(F.col("gpu_hours") * m).alias("x"), F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    value = (2 * F.col("ix") - (F.col("n") + 1) * F.col("x")) / (F.col("n") * F.col("x"))
    return s.select(F.when((F.col("n") < 2) | (F.col("x") == 0), 0.0).otherwise(value).alias("gini"), F.col("n").alias("users"))


def fair_share(hours: DataFrame) -> DataFrame:
    """Each user's surplus or deficit against an equal share of what was used."""
    one = hours.agg(F.avg("gpu_hours").alias("equal_share"))
    return hours.join(F.broadcast(one)).select("user", "gpu_hours", "equal_share", (F.col("gpu_hours") - F.col("equal_share")).alias("surplus"))


def contention(series: DataFrame, queued: DataFrame, capacity: int) -> DataFrame:
    """Queued hours of each owner in full buckets: own (running there as well) and others'.

    ``series``: (bucket seconds, user, gpus); full: claimed devices reach the capacity.
    """
    full = series.groupBy("bucket").agg(F.sum("gpus").alias("g")).where(F.col("g") >= capacity).select("bucket")
    running = series.select("bucket", d.user_name(F.col("user")).alias("short")).distinct().withColumn("runs", F.lit(True))
    blocked = queued.join(full, "bucket", "left_semi").withColumn("short", d.user_name(F.col("owner"))).join(running, ["bucket", "short"], "left")
    hours = F.col("queued_gpus") * 0.25
    out = blocked.groupBy("owner").agg(F.sum(F.when(F.col("runs"), hours).otherwise(0.0)).alias("self_hours"), F.sum(F.when(F.col("runs"), 0.0).otherwise(hours)).alias("other_hours"))
    return out.where("self_hours + other_hours > 0")


def full_buckets(series: DataFrame, capacity: int) -> DataFrame:
    per = series.groupBy("bucket").agg(F.sum("gpus").alias("g"))
    return per.agg(F.count_if(F.col("g") >= capacity).alias("full"), F.count(F.lit(1)).alias("total"))


def host_project(slots: DataFrame, host: str) -> DataFrame:
    """The most common project of a host's prioritised primary slots (ties: the smallest)."""
    rows = slots.where((F.col("Machine") == host) & ~d.is_backfill(F.col("Name")) & (F.col("PrioritizedProjects") != ""))
    return rows.groupBy(F.col("PrioritizedProjects").alias("project")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "project").limit(1)


def project_overview(slots: DataFrame, project: str, minutes: int = 15) -> DataFrame:
    """One row over a project's machines: machines, capacity, available and used hours, utilisation."""
    rows = slots.where(~d.is_backfill(F.col("Name")) & (F.col("PrioritizedProjects") == project)).withColumn("bucket", d.bucket_floor(F.col("timestamp"), minutes))
    used = rows.where("State = 'Claimed' and AssignedGPUs is not null").select("bucket", "AssignedGPUs").distinct().agg((F.count(F.lit(1)) * (minutes / 60)).alias("used_hours"))
    out = rows.agg(F.count_distinct("Machine").alias("machines"), F.count_distinct("AssignedGPUs").alias("capacity"), F.count_distinct("bucket").alias("b"))
    out = out.join(F.broadcast(used)).withColumn("available_hours", F.col("capacity") * F.col("b") * (minutes / 60))
    return out.select("machines", "capacity", "available_hours", "used_hours", F.when(F.col("available_hours") > 0, F.col("used_hours") / F.col("available_hours") * 100).otherwise(0.0).alias("utilization"))
