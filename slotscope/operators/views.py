"""Dashboard and timeline views as DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import classify as c


def heatmap(frames: c.Frames) -> DataFrame:
    """(machine, gpu, device, states): display codes aligned to the window's buckets in order, 5 where missing.

    Buckets get dense ordinals (one row a bucket). A device's states are its (ordinal, code) entries in
    order, each after the run of missing ones before it: linear in buckets, without a lookup by bucket.
    """
    rows = c.bucket_winners(frames.dedup).select("Machine", "AssignedGPUs", "GPUs_DeviceName", "bucket", d.state_code(F.col("State"), F.col("is_bf"), F.col("prio")).alias("code"))
    ordinals = rows.select("bucket").distinct().select("bucket", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket")).alias("at"))
    per = rows.join(ordinals, "bucket").groupBy("Machine", "AssignedGPUs").agg(F.coalesce(F.min("GPUs_DeviceName"), F.lit("Unknown")).alias("device"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("runs"))
    missing = F.lit(d.STATE_CODES["na"])
    before = lambda i: F.coalesce(F.get("runs", i - 1)["at"], F.lit(0))
    runs = F.flatten(F.transform("runs", lambda x, i: F.concat(F.array_repeat(missing, x["at"] - before(i) - 1), F.array(x["code"]))))
    rest = F.array_repeat(missing, F.col("buckets") - F.element_at("runs", -1)["at"])
    size = ordinals.agg(F.count(F.lit(1)).cast("int").alias("buckets"))
    return per.join(F.broadcast(size)).select(F.col("Machine").alias("machine"), F.col("AssignedGPUs").alias("gpu"), "device", F.concat(runs, rest).alias("states"))


def category_counts(raw: DataFrame) -> DataFrame:
    """Per bucket total and claimed distinct devices of prioritized, open_capacity and backfill, each by itself before dedup."""
    rows = raw.where(~F.col("excluded"))
    claimed = F.col("State") == "Claimed"
    gpu, bf = F.col("AssignedGPUs"), F.col("is_bf")
    kinds = {"prioritized": ~bf & F.col("prio") & gpu.isNotNull(), "open_capacity": ~bf & ~F.col("prio") & gpu.isNotNull(), "backfill": bf}
    # one row for each device of a bucket first, so that no distinct count is expanded; a null device is one as well where it isn't filtered
    conditions = {f"{k}_{label}": cond for k, member in kinds.items() for label, cond in (("total", member), ("claimed", member & claimed))}
    per = rows.groupBy("bucket", gpu).agg(*(F.bool_or(cond).alias(k) for k, cond in conditions.items()))
    return per.groupBy("bucket").agg(*(F.count_if(k).alias(k) for k in conditions))


def open_users(slots: DataFrame, owned: Sequence[str], excluded: Sequence[str], minutes: int = 15, top_n: int = 6) -> DataFrame:
    """(label, bucket, gpu_count): peak snapshot counts of the top users on open capacity, without names, zero-filled."""
    fine = c.prepare(slots, owned, excluded, minutes=1).dedup
    rows = fine.where((F.col("State") == "Claimed") & ~F.col("is_bf") & ~F.col("prio") & (F.col("RemoteOwner") != ""))
    snap = rows.groupBy("bucket", "RemoteOwner").agg(F.count_distinct("AssignedGPUs").alias("n"))
    shown = snap.groupBy(d.bucket_floor(F.col("bucket"), minutes).alias("b"), "RemoteOwner").agg(F.max("n").alias("gpu_count"))
    peaks = shown.groupBy("RemoteOwner").agg(F.max("gpu_count").alias("peak")).orderBy(F.desc("peak"), "RemoteOwner").limit(top_n)
    label = F.concat(F.lit("User "), F.row_number().over(Window.orderBy(F.desc("peak"), "RemoteOwner")))  # top_n rows
    labels = peaks.select("RemoteOwner", label.alias("label"))
    grid = shown.select("b").distinct().crossJoin(F.broadcast(labels))  # top_n rows a bucket
    full = grid.join(shown, ["b", "RemoteOwner"], "left")
    return full.select("label", F.col("b").alias("bucket"), F.coalesce("gpu_count", F.lit(0)).alias("gpu_count"))


def timeline(slots: DataFrame, minutes: int = 5, policy: str = "unclaimed_primary", variant: str = "scalar") -> DataFrame:
    """Winning row per (device id, bucket) with its state label, host and device."""
    keyed = slots.where("AssignedGPUs is not null").withColumns({"bucket": d.bucket_floor(F.col("timestamp"), minutes), "gpu": d.gpu_identity(F.col("Machine"), F.col("AssignedGPUs"))})
    best = c.winners(keyed, ("gpu", "bucket"), c.simple_rank(d.is_backfill(F.col("Name")), F.col("State"), policy), c.KEPT)
    return best.select("gpu", "bucket", d.state_label(F.col("State"), F.col("Name"), F.col("PrioritizedProjects"), variant).alias("label"), "Machine", "GPUs_DeviceName")


def host_rollup(slots: DataFrame, min_gpus: int = 1) -> DataFrame:
    """Hosts with at least ``min_gpus`` devices: devices (a null one counts), models, rows, claimed share.

    Rows are summed by host, device and model first, so no distinct count sees them.
    """
    per = slots.groupBy("Machine", "AssignedGPUs", "GPUs_DeviceName").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("State") == "Claimed").alias("held"), F.count("State").alias("known"))
    gpus = per.groupBy("Machine", "AssignedGPUs").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.sum("known").alias("known"), F.collect_set("GPUs_DeviceName").alias("models"))
    rows = gpus.groupBy("Machine").agg(
        F.count(F.lit(1)).alias("gpus"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))), ", ").alias("models"), F.sum("n").alias("rows"), (F.sum("held") / F.sum("known")).alias("claimed_share")
    )
    return rows.where(F.col("gpus") >= min_gpus)


def host_list(slots: DataFrame, min_gpus: int = 1) -> DataFrame:
    """(Machine, gpus, device, rows, claimed_share): as ``host_rollup``, with the host's most frequent model (ties: the smallest; none: Unknown)."""
    models = slots.where("GPUs_DeviceName is not null").groupBy("Machine", "GPUs_DeviceName").agg(F.count(F.lit(1)).alias("n"))
    first = models.groupBy("Machine").agg(F.min(F.struct((-F.col("n")).alias("minus"), "GPUs_DeviceName")).alias("best")).select("Machine", F.col("best.GPUs_DeviceName").alias("device"))
    return host_rollup(slots, min_gpus).join(first, "Machine", "left").select("Machine", "gpus", F.coalesce("device", F.lit("Unknown")).alias("device"), "rows", "claimed_share")


def hosts_by_device(hosts: DataFrame) -> DataFrame:
    """(device, hosts, gpus, mean_claimed_share) of ``host_list`` by model, and of all hosts together as null; no hosts give no rows."""
    return hosts.rollup("device").agg(F.count(F.lit(1)).alias("hosts"), F.sum("gpus").alias("gpus"), F.avg("claimed_share").alias("mean_claimed_share"))


def prioritised_hosts(slots: DataFrame) -> DataFrame:
    return slots.where("PrioritizedProjects != ''").select("Machine").distinct()


def _around(slots: DataFrame, at: dt.datetime, minutes: int) -> DataFrame:
    lo, hi = (F.lit(at + dt.timedelta(minutes=m)).cast("timestamp_ntz") for m in (-minutes, minutes))
    return slots.where(F.col("timestamp").between(lo, hi))


def models_at(slots: DataFrame, at: dt.datetime, minutes: int) -> DataFrame:
    return _around(slots, at, minutes).where("GPUs_DeviceName is not null").select("GPUs_DeviceName").distinct().orderBy("GPUs_DeviceName")


def model_activity(slots: DataFrame, model: str, at: dt.datetime, minutes: int) -> DataFrame:
    """Rows of one model around a time, latest first."""
    rows = _around(slots, at, minutes).where(F.col("GPUs_DeviceName") == model)
    return rows.orderBy(F.desc("timestamp"), "Machine", "AssignedGPUs")


def nearest_snapshot(slots: DataFrame, model: str, at: dt.datetime, minutes: int) -> DataFrame:
    """The model's rows at the time nearest to ``at`` (of equally near ones the later)."""
    rows = _around(slots, at, minutes).where(F.col("GPUs_DeviceName") == model)
    gap = F.abs(F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lit(at).cast("timestamp_ntz").cast("timestamp")))
    best = rows.agg(F.min_by("timestamp", F.struct(gap, -F.unix_micros(F.col("timestamp").cast("timestamp")))).alias("nearest"))
    return rows.join(F.broadcast(best), F.col("timestamp") == F.col("nearest")).drop("nearest")


def snapshot_summary(snapshot: DataFrame) -> DataFrame:
    """One row: devices, active ones (claimed with an owner), idle, utilisation, mean use of claimed rows in percent (0 without any), machines."""
    claimed = F.col("State") == "Claimed"
    active = claimed & F.col("RemoteOwner").isNotNull()
    out = snapshot.agg(F.count_distinct("AssignedGPUs").alias("total"), F.count_distinct(F.when(active, F.col("AssignedGPUs"))).alias("active"), F.coalesce(F.avg(F.when(claimed, F.col("GPUsAverageUsage"))) * 100, F.lit(0.0)).alias("mean_use"), F.count_distinct("Machine").alias("machines"))
    return out.select("total", "active", (F.col("total") - F.col("active")).alias("idle"), F.when(F.col("total") > 0, F.col("active") / F.col("total") * 100).otherwise(0.0).alias("utilization"), "mean_use", "machines")


def snapshot_classes(snapshot: DataFrame, owned: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """Total and claimed distinct devices by Priority, Shared and Backfill of a snapshot, through the state-aware filter:
    excluded hosts left out, primary classes after dedup, interactive slots not Shared. Classes without rows are left out."""
    rows = c.state_rows(c.prepare(snapshot, owned, excluded), ("Priority", "Shared", "Backfill"), ("",), ("AssignedGPUs", "State"))
    gpus = rows.groupBy("class", "AssignedGPUs").agg(F.bool_or(F.coalesce(F.col("State") == "Claimed", F.lit(False))).alias("held"))
    known = F.col("AssignedGPUs").isNotNull()
    return gpus.groupBy("class").agg(F.count("AssignedGPUs").alias("total"), F.count_if(F.col("held") & known).alias("claimed"))


def inactive_devices(snapshot: DataFrame) -> DataFrame:
    """Unclaimed devices of a snapshot that no active row holds, with a machine and the projects given priority there."""
    active = snapshot.where("State = 'Claimed' and RemoteOwner is not null").select("AssignedGPUs")
    idle = snapshot.where("State = 'Unclaimed' and AssignedGPUs is not null").join(active, "AssignedGPUs", "left_anti")
    first = idle.groupBy("AssignedGPUs").agg(F.min(F.struct("Machine", "PrioritizedProjects")).alias("first"))
    return first.select("AssignedGPUs", F.col("first.Machine").alias("machine"), F.col("first.PrioritizedProjects").alias("projects"))


def active_jobs(snapshot: DataFrame) -> DataFrame:
    """One job of each active device of a snapshot: device, owner, job, machine; of several the smallest job identifier."""
    active = snapshot.where("State = 'Claimed' and RemoteOwner is not null and AssignedGPUs is not null")
    first = active.groupBy("AssignedGPUs").agg(F.min(F.struct("GlobalJobId", "RemoteOwner", "Machine")).alias("first"))
    return first.select("AssignedGPUs", F.col("first.RemoteOwner").alias("owner"), F.col("first.GlobalJobId").alias("job"), F.col("first.Machine").alias("machine"))


def host_users(slots: DataFrame, host: str, slot_kind: str = "All") -> DataFrame:
    """Users seen on a host by slot type Primary, Shared, Backfill or All."""
    bf = d.is_backfill(F.col("Name"))
    project = F.col("PrioritizedProjects")
    keep = {"Primary": ~bf & d.is_prioritised(project), "Shared": ~bf & d.is_shared(project), "Backfill": bf, "All": F.lit(True)}[slot_kind]
    return slots.where((F.col("Machine") == host) & keep & (F.col("RemoteOwner") != "")).select("RemoteOwner").distinct()


def open_backfill_machines(rows: DataFrame) -> DataFrame:
    """Machines of open backfill rows: modal model, devices, owned flag."""
    return rows.groupBy("Machine").agg(F.mode("GPUs_DeviceName", True).alias("model"), F.count_distinct("AssignedGPUs").alias("gpus"), F.max("owned").alias("owned"))


def open_backfill_user_machines(rows: DataFrame) -> DataFrame:
    """Claimed observations and devices of each user on each machine."""
    mine = rows.where("State = 'Claimed' and RemoteOwner != ''").groupBy("RemoteOwner", "Machine", "AssignedGPUs").agg(F.count(F.lit(1)).alias("n"))
    return mine.groupBy("RemoteOwner", "Machine").agg(F.sum("n").alias("observations"), F.count("AssignedGPUs").alias("gpus"))


def open_backfill_users(rows: DataFrame) -> DataFrame:
    """Users' shares of the claimed observations, with their machines."""
    mine = rows.where("State = 'Claimed' and RemoteOwner != ''").groupBy("RemoteOwner").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("Machine").alias("machines"))
    return mine.withColumn("share", F.col("observations") / F.sum("observations").over(Window.partitionBy(F.lit(0))))  # one row a user


def filter_heatmap(shown: DataFrame, part: str = "", codes: Sequence[int] = ()) -> DataFrame:
    """Rows of machines whose name holds ``part`` (case ignored) and devices that ever had one of ``codes``."""
    keep = F.contains(F.lower("machine"), F.lit(part.lower())) if part else F.lit(True)
    if codes:
        keep &= F.arrays_overlap("states", F.array(*map(F.lit, codes)))
    return shown.where(keep)
