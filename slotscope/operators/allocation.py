"""Allocation of devices by class, device, memory and user."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import classify as c
from slotscope.sources import snapshots

THREE_CLASSES = ("Priority", "Shared", "Backfill")


def pair_bucket_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: mean bucket percentages, sums of claimed, drained and all devices, buckets.

    A device is claimed (drained) in a bucket if any of its rows there is; claimed wins. Distinct
    devices come from grouping by device first, so no distinct aggregate is expanded.
    """
    state = F.col("State")
    devices = rows.where("AssignedGPUs is not null").groupBy(*by, "bucket", "AssignedGPUs").agg(F.max(F.coalesce(state == "Claimed", F.lit(False))).alias("c"), F.max(F.coalesce(state == "Drained", F.lit(False))).alias("d"))
    buckets = devices.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("total"), F.count_if("c").alias("claimed"), F.count_if(F.col("d") & ~F.col("c")).alias("drained"))
    share = lambda x: F.avg(F.col(x).cast("double") / F.col("total") * 100)
    return buckets.groupBy(*by).agg(
        share("claimed").alias("pct_claimed"), share("drained").alias("pct_drained"), F.sum("claimed").alias("claimed_sum"), F.sum("drained").alias("drained_sum"),
        F.sum("total").alias("total_sum"), F.count(F.lit(1)).alias("num_buckets"),
    )


def window_buckets(raw: DataFrame) -> DataFrame:
    """One row: the window's distinct buckets."""
    return raw.select("bucket").distinct().agg(F.count(F.lit(1)).alias("window_buckets"))


def _with_one(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of the one-row ``one`` beside."""
    return rows.join(F.broadcast(one))


def _averages(stats: DataFrame, n: Column) -> list[Column]:
    return [
        (F.col("claimed_sum") / n).alias("avg_claimed"), (F.col("drained_sum") / n).alias("avg_drained"), (F.col("total_sum") / n).alias("avg_total_available"),
        F.col("pct_claimed").alias("allocation_usage_percent"), F.col("pct_drained").alias("drained_percent"),
    ]


def by_device(frames: c.Frames, include_all: bool = True) -> DataFrame:
    """Five classes by device; averages over all buckets of the window."""
    rows = c.class_rows(frames, ("Machine", "GPUs_DeviceName")).where("GPUs_DeviceName is not null")
    if not include_all:
        rows = rows.where(~d.is_old_device(F.col("GPUs_DeviceName")))
    stats = _with_one(pair_bucket_stats(rows, ("class", "GPUs_DeviceName")), window_buckets(frames.raw))
    return stats.select("class", F.col("GPUs_DeviceName").alias("device"), *_averages(stats, F.col("window_buckets")))


def by_memory(frames: c.Frames, include_all: bool = True) -> DataFrame:
    """Real classes together by memory category; averages over the category's own buckets."""
    m = F.col("prio") & ~F.col("is_bf") | F.col("shared") & ~F.col("is_bf") & ~F.col("is_inter")
    rows = frames.dedup.where(m)
    if not include_all:
        rows = rows.where(~d.is_old_device(F.col("GPUs_DeviceName")))
    stats = pair_bucket_stats(rows.withColumn("memory_category", d.memory_category_mb(F.col("GPUs_GlobalMemoryMb"))), ("memory_category",))
    return stats.select("memory_category", *_averages(stats, F.col("num_buckets")), F.col("num_buckets").alias("num_intervals"))


def user_totals(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over buckets of the distinct devices that an owner has claimed; an empty owner is Unknown."""
    mine = rows.where("State = 'Claimed' and RemoteOwner is not null and AssignedGPUs is not null").select(*by, "bucket", "RemoteOwner", "AssignedGPUs").distinct()
    user = F.when(F.col("RemoteOwner") == "", "Unknown").otherwise(F.col("RemoteOwner")).alias("user")
    return mine.groupBy(*by, user).agg(F.count(F.lit(1)).alias("total"))


def _user_breakdown(totals: DataFrame, buckets: DataFrame, hours_back: float) -> DataFrame:
    hours = _with_one(totals, buckets).select("user", "class", (F.col("total") / F.col("n") * hours_back).alias("gpu_hours")).where("gpu_hours > 0")
    from pyspark.sql import Window

    whole = F.sum("gpu_hours").over(Window.partitionBy("user"))
    return hours.select("user", "class", "gpu_hours", (F.col("gpu_hours") / whole * 100).alias("percentage"), whole.alias("total_gpu_hours"))


def device_users(frames: c.Frames, device: str = "NVIDIA H200", hours_back: float = 1) -> DataFrame:
    """Hours of one device's users by class; denominator: buckets in which the device is seen at all."""
    of_device = F.col("GPUs_DeviceName") == device
    buckets = frames.raw.where(of_device).select("bucket").distinct().agg(F.count(F.lit(1)).alias("n"))
    return _user_breakdown(user_totals(c.class_rows(frames, device=device).where(of_device), ("class",)), buckets, hours_back)


def backfill_users(frames: c.Frames, hours_back: float = 1, include_all: bool = False) -> DataFrame:
    """Hours of backfill users by class on devices that aren't old (case ignored)."""
    keep = F.lit(True) if include_all else ~d.is_old_device(F.col("GPUs_DeviceName"), ignore_case=True)
    some = c.Frames(frames.raw.where(keep), frames.dedup, frames.raw_backfill.where(keep))
    buckets = some.raw.select("bucket").distinct().agg(F.count(F.lit(1)).alias("n"))
    return _user_breakdown(user_totals(c.class_rows(some, classes=c.BACKFILL_CLASSES), ("class",)), buckets, hours_back)


def idle_machines(frames: c.Frames, include_all: bool = True) -> DataFrame:
    """Machines none of whose primary devices was claimed in the window.

    Rows are grouped by machine, device and bucket first, so that no distinct count is expanded.
    """
    bf = F.coalesce(F.rlike("Name", F.lit("(?i)backfill")), F.lit(False))
    claimed = F.coalesce(F.col("State") == "Claimed", F.lit(False))
    rows = frames.raw.where(~F.col("excluded"))
    cells = rows.groupBy("Machine", "bucket", "AssignedGPUs").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(~bf).alias("primary"), F.bool_or(~bf & claimed).alias("held"), F.bool_or(bf).alias("backfill"), F.bool_or(bf & claimed).alias("bf_held"),
        F.collect_set(F.trim("PrioritizedProjects")).alias("projects"),
    )
    known = F.col("AssignedGPUs").isNotNull()
    by_gpu = cells.groupBy("Machine", "AssignedGPUs").agg(F.sum("n").alias("n"), F.bool_or("primary").alias("primary"), F.bool_or("held").alias("held"), F.count_if(F.col("bf_held") & known).alias("bf_pairs"), F.flatten(F.collect_set("projects")).alias("projects"))
    per = by_gpu.groupBy("Machine").agg(
        F.sum("n").alias("total_observations"), F.count_if(F.col("primary") & known).alias("total_gpus"), F.count_if(F.col("held") & known).alias("claimed"), F.sum("bf_pairs").alias("bf_pairs"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set("projects")), lambda p: p != ""))).alias("projects"),
    ).where("claimed = 0 and total_gpus > 0")
    buckets = cells.where("backfill").select("Machine", "bucket").distinct().groupBy("Machine").agg(F.count(F.lit(1)).alias("bf_buckets"))
    models = rows.where("GPUs_DeviceName is not null").groupBy("Machine", "GPUs_DeviceName").agg(F.count(F.lit(1)).alias("n"))
    models = models.groupBy("Machine").agg(F.min(F.struct((-F.col("n")).alias("minus"), "GPUs_DeviceName")).alias("best")).select("Machine", F.col("best.GPUs_DeviceName").alias("model"))
    per = per.join(buckets, "Machine", "left").join(models, "Machine", "left").withColumns({"bf_buckets": F.coalesce("bf_buckets", F.lit(0)), "gpu_model": F.coalesce("model", F.lit("Unknown"))})
    if not include_all:
        per = per.where(~d.is_old_device(F.col("gpu_model")))
    average = F.when(F.col("bf_buckets") > 0, F.col("bf_pairs") / F.col("bf_buckets")).otherwise(0.0)
    return per.select(F.col("Machine").alias("machine"), "gpu_model", "total_gpus", "total_observations", F.array_join("projects", ",").alias("prioritized_projects"), average.alias("avg_backfill_claimed"))


def idle_totals(machines: DataFrame) -> DataFrame:
    """(gpu_model, project, machines, gpus_idle) of ``idle_machines``: by model, by project (a machine of several counts in each,
    one of none as ``None``), and overall with both null. No machines give one row of zeros."""
    listed = F.when(F.col("prioritized_projects") == "", F.array(F.lit("None"))).otherwise(F.split("prioritized_projects", ","))
    marked = F.concat(F.array(F.lit(None).cast("string")), listed)
    # The two dimensions stand beside each other, not within: a machine's row of no project serves the model's and the overall sum.
    rows = machines.select("gpu_model", "total_gpus", F.explode(marked).alias("project"))
    sums = (F.count(F.lit(1)).alias("machines"), F.sum("total_gpus").alias("gpus_idle"))
    parts = rows.groupingSets([["gpu_model", "project"], ["project"]], "gpu_model", "project").agg(*sums, F.grouping("gpu_model").alias("all_models"))
    parts = parts.where("project is null or all_models = 1").drop("all_models")
    zero = machines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("gpu_model"), F.lit(None).cast("string").alias("project"), F.lit(0).cast("bigint").alias("machines"), F.lit(0).cast("bigint").alias("gpus_idle"))
    return parts.unionByName(zero)


def prevented_hosts(raw: DataFrame) -> DataFrame:
    """Hosts with devices kept from jobs: devices, reasons, last seen, and whether seen in the latest such bucket."""
    rows = raw.where("pj_set")
    last = rows.agg(F.max("bucket").alias("latest"))
    hosts = rows.groupBy("Machine").agg(F.count_distinct("AssignedGPUs").alias("gpus"), F.array_join(F.array_sort(F.collect_set("PreventJobsReason")), "; ").alias("reasons"), F.max("timestamp").alias("last_seen"), F.max("bucket").alias("b"))
    return _with_one(hosts, last).select(F.col("Machine").alias("machine"), "gpus", "reasons", "last_seen", (F.col("b") == F.col("latest")).alias("active"))


def prevented_totals(raw: DataFrame) -> DataFrame:
    """Hosts and devices kept from jobs at any time of the window, one row; pairs first, so that few rows are counted."""
    pairs = raw.where("pj_set").select("Machine", "AssignedGPUs").distinct()
    return pairs.agg(F.count_distinct("Machine").alias("hosts"), F.count_distinct("AssignedGPUs").alias("gpus"))


def prevented_reasons(raw: DataFrame) -> DataFrame:
    return raw.where("pj_set").groupBy(F.col("PreventJobsReason").alias("reason")).agg(F.count_distinct("Machine").alias("hosts"), F.count_distinct("AssignedGPUs").alias("gpus"))


def prevented_average(frames: c.Frames) -> DataFrame:
    """By class and device: sum over buckets of distinct idle devices with a reason, over the window's buckets; device null: the class."""
    rows = c.class_rows(frames).where("pj_set and State != 'Claimed' and AssignedGPUs is not null")
    held = rows.groupBy("class", "bucket", "AssignedGPUs").agg(F.collect_set("GPUs_DeviceName").alias("devices"))
    # A device identifier counts once for each of its models and once, as null, for the class.
    each = held.select("class", F.explode(F.concat(F.array(F.lit(None).cast("string")), "devices")).alias("device")).groupBy("class", "device").agg(F.count(F.lit(1)).alias("n"))
    return _with_one(each, window_buckets(frames.raw)).select("class", "device", (F.col("n") / F.col("window_buckets")).alias("avg_prevented"))


def state_aware_counts(frames: c.Frames, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(class, bucket, *by, claimed, unclaimed): distinct devices, each counted in both if seen in both."""
    rows = c.state_rows(frames, classes, ("Claimed", "Unclaimed"), ("bucket", *by, "AssignedGPUs")).where("AssignedGPUs is not null")
    gpus = rows.groupBy("class", "bucket", *by, "AssignedGPUs").agg(F.bool_or(F.col("s") == "Claimed").alias("c"), F.bool_or(F.col("s") == "Unclaimed").alias("u"))
    return gpus.groupBy("class", "bucket", *by).agg(F.count_if("c").alias("claimed"), F.count_if("u").alias("unclaimed"))


def allocation(frames: c.Frames, classes: Sequence[str] = THREE_CLASSES) -> DataFrame:
    """State-aware allocation: mean bucket percentage where the class has devices, averages over all buckets."""
    counts = state_aware_counts(frames, classes).withColumn("total", F.col("claimed") + F.col("unclaimed")).where("total > 0")
    sums = counts.groupBy("class").agg(F.avg(F.col("claimed").cast("double") / F.col("total") * 100).alias("allocation_usage_percent"), F.sum("claimed").alias("cs"), F.sum("total").alias("ts"))
    return _with_one(sums, window_buckets(frames.raw)).select("class", (F.col("cs") / F.col("window_buckets")).alias("avg_claimed"), (F.col("ts") / F.col("window_buckets")).alias("avg_total_available"), "allocation_usage_percent")


def usage_series(frames: c.Frames, classes: Sequence[str] = THREE_CLASSES) -> DataFrame:
    """Per bucket and class claimed, total and percent, as wide columns."""
    counts = state_aware_counts(frames, classes).withColumn("total", F.col("claimed") + F.col("unclaimed"))
    grid = frames.raw.select("bucket").distinct()
    wide = [
        F.coalesce(F.max(F.when(F.col("class") == k, F.col(v))), F.lit(0)).alias(f"{k.lower().replace('-', '_')}_{v}")
        for k in classes for v in ("claimed", "total")
    ]
    out = grid.join(counts, "bucket", "left").groupBy("bucket").agg(*wide)
    for k in (x.lower().replace("-", "_") for x in classes):
        out = out.withColumn(f"{k}_usage_percent", F.when(F.col(f"{k}_total") > 0, F.col(f"{k}_claimed").cast("double") / F.col(f"{k}_total") * 100).otherwise(0.0))
    return out


def by_device_three(frames: c.Frames, include_all: bool = True) -> DataFrame:
    """Three classes by device: distinct devices of the class, those claimed and those drained (which may overlap)."""
    rows = c.state_rows(frames, THREE_CLASSES, ("",), ("bucket", "GPUs_DeviceName", "AssignedGPUs", "State")).where("AssignedGPUs is not null and GPUs_DeviceName is not null")
    if not include_all:
        rows = rows.where(~d.is_old_device(F.col("GPUs_DeviceName")))
    gpu = rows.groupBy("class", "GPUs_DeviceName", "bucket", "AssignedGPUs").agg(F.max(F.col("State") == "Claimed").alias("c"), F.max(F.col("State") == "Drained").alias("d"))
    per = gpu.groupBy("class", "GPUs_DeviceName", "bucket").agg(F.count(F.lit(1)).alias("t"), F.count_if("c").alias("c"), F.count_if("d").alias("d"))
    sums = per.groupBy("class", F.col("GPUs_DeviceName").alias("device")).agg(F.avg(F.col("c").cast("double") / F.col("t") * 100).alias("allocation_usage_percent"), F.avg(F.col("d").cast("double") / F.col("t") * 100).alias("drained_percent"), F.sum("c").alias("cs"), F.sum("d").alias("ds"), F.sum("t").alias("ts"))
    n = F.col("window_buckets")
    return _with_one(sums, window_buckets(frames.raw)).select("class", "device", (F.col("cs") / n).alias("avg_claimed"), (F.col("ds") / n).alias("avg_drained"), (F.col("ts") / n).alias("avg_total_available"), "allocation_usage_percent", "drained_percent")


def backfill_by_day(frames: c.Frames) -> DataFrame:
    """Daily averages of bucket counts for the backfill classes and the ratio of the averages."""
    classes = ("Backfill-ResearcherOwned", "Backfill-PoolOwned", "Backfill-OpenCapacity")
    rows = c.state_rows(frames, classes, ("",), ("bucket", "AssignedGPUs", "State")).where("AssignedGPUs is not null")
    gpu = rows.groupBy("class", "bucket", "AssignedGPUs").agg(F.max(F.col("State") == "Claimed").alias("c"))
    per = gpu.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("t"), F.count_if("c").alias("c"))
    daily = per.groupBy("class", d.truncated(F.col("bucket"), "day").alias("day")).agg(F.avg("c").alias("avg_claimed"), F.avg("t").alias("avg_total"))
    return daily.select("class", "day", "avg_claimed", "avg_total", (F.col("avg_claimed") / F.col("avg_total") * 100).alias("utilization_percent"))


def backfill_totals(daily: DataFrame) -> DataFrame:
    """The classes of ``backfill_by_day`` summed by day, as class ``All``; no devices at all make 0 percent."""
    total = daily.groupBy("day").agg(F.sum("avg_claimed").alias("avg_claimed"), F.sum("avg_total").alias("avg_total"))
    share = F.when(F.col("avg_total") > 0, F.col("avg_claimed") / F.col("avg_total") * 100).otherwise(0.0)
    return total.select(F.lit("All").alias("class"), "day", "avg_claimed", "avg_total", share.alias("utilization_percent"))


def backfill_day_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("class").agg(F.avg("utilization_percent").alias("mean_percent"), F.max("utilization_percent").alias("max_percent"), F.avg("avg_total").alias("mean_total"), F.max("avg_claimed").alias("max_claimed"), F.count(F.lit(1)).alias("days"))


def previous_month(latest: dt.datetime) -> tuple[dt.datetime, dt.datetime, int]:
    """Start and end (the next month's first instant) of the month before ``latest``, and its hours."""
    end = latest.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    start = (end - dt.timedelta(days=1)).replace(day=1)
    return start, end, (end - start).days * 24


def monthly_summary(slots: DataFrame, owned: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Allocation by class and device (old devices left out) over the calendar month before the latest row, both ends included.
    Empty in, empty out.

    The latest time is fetched first: the bounds are literals, which reach the scan.
    """
    latest = snapshots.latest(slots).first()["latest"]
    if latest is None:
        rows = slots.limit(0)
    else:
        lo, hi, _ = previous_month(latest)
        rows = slots.where(F.col("timestamp").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")))
    return by_device(c.prepare(rows, owned, excluded), include_all=False)


@dataclass
class MonthlyReport:
    """The parts of one month's report; all come from ``frames``, which are persisted until ``close``."""

    start: dt.datetime
    end: dt.datetime
    hours: int
    frames: c.Frames
    devices: DataFrame
    memory: DataFrame
    users: DataFrame
    coverage: DataFrame

    def close(self) -> None:
        self.frames.unpersist()

    def table(self) -> DataFrame:
        """(section, k1, k2, v1 .. v5): all parts as one frame, for storing."""
        number = lambda names: [(F.col(n).cast("double") if n else F.lit(None).cast("double")).alias(f"v{i}") for i, n in enumerate(names, 1)]
        text = lambda c, n: F.col(c).cast("string").alias(n)
        shares = ("avg_claimed", "avg_drained", "avg_total_available", "allocation_usage_percent", "drained_percent")
        parts = [
            self.devices.select(F.lit("device").alias("section"), text("class", "k1"), text("device", "k2"), *number(shares)),
            self.memory.select(F.lit("memory").alias("section"), text("memory_category", "k1"), F.lit(None).cast("string").alias("k2"), *number(shares)),
            self.users.select(F.lit("user").alias("section"), text("user", "k1"), text("class", "k2"), *number(("gpu_hours", "percentage", "total_gpu_hours", None, None))),
            self.coverage.select(F.lit("coverage").alias("section"), text("start", "k1"), text("end", "k2"), *number(("total", "buckets", None, None, None))),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def monthly_report(spark: SparkSession, path: str, owned: Sequence[str], excluded: Sequence[str], end: dt.datetime | None = None, device: str = "NVIDIA H200") -> MonthlyReport | None:
    """The complete report over the month before ``end`` (default: the latest stored row); None where the table is empty or the month has no rows.

    The month's rows are read once, from the month partitions that the bounds touch, and prepared
    once for all parts.
    """
    end = snapshots.latest_stored(spark, path) if end is None else end
    if end is None:
        return None
    lo, hi, hours = previous_month(end)
    frames = c.prepare(snapshots.scan(spark, path, lo, hi), owned, excluded).persist()
    coverage = c.metadata(frames.raw)
    if frames.raw.isEmpty():
        frames.unpersist()
        return None
    return MonthlyReport(lo, hi - dt.timedelta(seconds=1), hours, frames, by_device(frames, include_all=False), by_memory(frames, include_all=False), device_users(frames, device, hours), coverage)


def category_audit(frames: c.Frames, classes: Sequence[str] = THREE_CLASSES) -> DataFrame:
    """Rows and distinct devices of each class in each state."""
    rows = c.state_rows(frames, classes, ("Claimed", "Unclaimed"), ("AssignedGPUs",))
    gpus = rows.groupBy("class", F.col("s").alias("state"), "AssignedGPUs").agg(F.count(F.lit(1)).alias("n"))
    return gpus.groupBy("class", "state").agg(F.sum("n").alias("rows"), F.count("AssignedGPUs").alias("gpus"))


def category_totals(frames: c.Frames, classes: Sequence[str] = THREE_CLASSES) -> DataFrame:
    """(class, claimed, unclaimed, total, unique_gpus): rows in either state, and distinct devices over both."""
    gpus = c.state_rows(frames, classes, ("Claimed", "Unclaimed"), ("AssignedGPUs",)).groupBy("class", "AssignedGPUs").agg(F.count_if(F.col("s") == "Claimed").alias("c"), F.count_if(F.col("s") == "Unclaimed").alias("u"))
    distinct = F.count_if(F.col("AssignedGPUs") != "").alias("unique_gpus")
    return gpus.groupBy("class").agg(F.sum("c").alias("claimed"), F.sum("u").alias("unclaimed"), F.sum(F.col("c") + F.col("u")).alias("total"), distinct)


def category_slots(frames: c.Frames, classes: Sequence[str] = THREE_CLASSES) -> DataFrame:
    """The slot rows behind ``category_audit``, one for each class and state that a row belongs to."""
    columns = ("timestamp", "Name", "AssignedGPUs", "Machine", "GPUs_DeviceName", "PrioritizedProjects", "State")
    return c.state_rows(frames, classes, ("Claimed", "Unclaimed"), columns).withColumnsRenamed({"s": "as_state"})


def count_anomalies(frames: c.Frames, device: str, expected: int, classes: Sequence[str] = THREE_CLASSES) -> DataFrame:
    """Buckets in which a class has another number of the device than expected."""
    some = c.Frames(frames.raw, frames.dedup.where(F.col("GPUs_DeviceName") == device), frames.raw_backfill.where(F.col("GPUs_DeviceName") == device))
    counts = state_aware_counts(some, classes).withColumn("total", F.col("claimed") + F.col("unclaimed"))
    return counts.where(F.col("total") != expected).select("class", "bucket", "claimed", "unclaimed", "total")


def device_counts(frames: c.Frames, utilization: str, state: str) -> DataFrame:
    """Rows by device of a class in a state, each with whether its project is prioritised."""
    return c.state_filter(frames, utilization, state).groupBy("GPUs_DeviceName", "prio").agg(F.count(F.lit(1)).alias("rows"))


def value_histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n): ``bins`` bins of equal width between the least and the largest value, empty ones included.

    The last bin holds its upper edge; where all values are equal, the edges lie half a unit to both
    sides. Null and non-finite values are left out; without any value there are no rows.
    """
    v = F.col(value).cast("double")
    rows = rows.select(v.alias("v")).where("v is not null and not isnan(v) and abs(v) != double('infinity')")
    span = rows.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    span = span.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.width_bucket("v", "a", "b", F.lit(bins)), F.lit(bins).cast("bigint"))
    counts = _with_one(rows, span).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("b") - F.col("a")) / bins
    edges = span.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"), "a", step.alias("step"))
    full = edges.join(counts, "bin", "left")
    return full.select("bin", (F.col("a") + F.col("step") * (F.col("bin") - 1)).alias("lo"), (F.col("a") + F.col("step") * F.col("bin")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def binned_usage(frames: c.Frames, utilization: str, by: str | None = None) -> DataFrame:
    """Used and all devices of a class per bucket, by a column (old devices skipped) if given."""
    columns = (by,) if by else ()
    counts = state_aware_counts(frames, (utilization,), columns)
    if by == "GPUs_DeviceName":
        counts = counts.where(~d.is_old_device(F.col(by)))
    return counts.select("bucket", *columns, F.col("claimed").alias("used"), (F.col("claimed") + F.col("unclaimed")).alias("total"))
