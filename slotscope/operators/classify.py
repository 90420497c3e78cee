"""Slot ranking, dedup to one row for each device and time, and class membership."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotscope.functions import derive as d

REAL_CLASSES = ("Priority-ResearcherOwned", "Priority-PoolOwned", "Shared")
BACKFILL_CLASSES = ("Backfill-ResearcherOwned", "Backfill-PoolOwned")
CLASSES = (*REAL_CLASSES, *BACKFILL_CLASSES)
#: What a winning row keeps; equal ranks fall to the larger values, in this order.
KEPT = ("Name", "State", "Machine", "GPUs_DeviceName", "GPUs_GlobalMemoryMb", "RemoteOwner", "PrioritizedProjects", "GlobalJobId", "GPUsAverageUsage", "PreventJobsReason")


def slot_rank(backfill: Column, state: Column, prev_idle: Column) -> Column:
    """Canonical rank 0 to 6 of concurrent rows of one device; the highest wins."""
    c, u = state == "Claimed", state == "Unclaimed"
    return F.when(~backfill & c, 6).when(~backfill & prev_idle, 2).when(~backfill & u, 5).when(~backfill, 4).when(backfill & c, 3).when(backfill & u, 1).otherwise(0)


def simple_rank(backfill: Column, state: Column, policy: str) -> Column:
    """Plainer ranks: ``claimed_first`` (4 tiers), ``unclaimed_primary`` (its variant in which only
    Unclaimed primaries rank 1) and ``three_tier`` (claimed primary, other primary, claimed backfill)."""
    c, u = state == "Claimed", state == "Unclaimed"
    if policy == "claimed_first":
        return F.when(c & ~backfill, 3).when(c & backfill, 2).when(~backfill, 1).otherwise(0)
    if policy == "unclaimed_primary":
        return F.when(c & ~backfill, 3).when(c & backfill, 2).when(u & ~backfill, 1).otherwise(0)
    if policy == "three_tier":
        return F.when(c & ~backfill, 3).when(u & ~backfill, 2).when(c & backfill, 1).otherwise(0)
    raise ValueError(f"unknown policy {policy!r}")


def with_flags(slots: DataFrame, owned: Sequence[str] = (), excluded: Sequence[str] = (), minutes: int = 15) -> DataFrame:
    """The window's rows with bucket and flag columns; exclusions are marked, not applied."""
    name, project, state, reason = (F.col(c) for c in ("Name", "PrioritizedProjects", "State", "PreventJobsReason"))
    return slots.withColumns(
        {
            "bucket": d.bucket_floor(F.col("timestamp"), minutes),
            "is_bf": d.is_backfill(name),
            "is_inter": d.is_interactive(name),
            "prio": d.is_prioritised(project),
            "shared": d.is_shared(project),
            "owned": d.is_owned(F.col("Machine"), owned),
            "excluded": d.is_excluded(F.col("Machine"), excluded),
            "pj_set": d.reason_set(reason),
            "prev_idle": d.prevented_idle(reason, state),
        }
    )


def winners(rows: DataFrame, keys: Sequence[str], rank: Column, kept: Sequence[str]) -> DataFrame:
    """One row for each key: the highest rank, ties to the larger kept values. One shuffle, combined map-side."""
    top = F.max(F.struct(rank.alias("rank"), *kept)).alias("top")
    return rows.groupBy(*keys).agg(top).select(*keys, "top.*")


def dedup(raw: DataFrame) -> DataFrame:
    """One winner for each (timestamp, device) among the rows that aren't excluded and have a device."""
    flags = ("is_bf", "is_inter", "prio", "shared", "owned", "pj_set", "bucket")
    rows = raw.where(~F.col("excluded") & F.col("AssignedGPUs").isNotNull())
    return winners(rows, ("timestamp", "AssignedGPUs"), slot_rank(F.col("is_bf"), F.col("State"), F.col("prev_idle")), (*KEPT, *flags))


def bucket_winners(deduped: DataFrame) -> DataFrame:
    """One row for each (bucket, device) among dedup rows, by the same rank."""
    prev_idle = F.col("pj_set") & (F.col("State") != "Claimed")
    kept = (*KEPT, "is_bf", "is_inter", "prio", "shared", "owned", "pj_set")
    return winners(deduped.drop("rank"), ("bucket", "AssignedGPUs"), slot_rank(F.col("is_bf"), F.col("State"), prev_idle), kept)


def simple_dedup(slots: DataFrame, policy: str, keys: Sequence[str] = ("timestamp", "AssignedGPUs"), drop_empty: bool = False) -> DataFrame:
    """Winners by a plainer rank; ``drop_empty`` leaves out rows without a device."""
    rows = slots.where("AssignedGPUs is not null and AssignedGPUs != ''") if drop_empty else slots
    kept = [c for c in slots.columns if c not in keys]
    return winners(rows, keys, simple_rank(d.is_backfill(F.col("Name")), F.col("State"), policy), [*[c for c in KEPT if c in kept], *[c for c in kept if c not in KEPT]])


@dataclass
class Frames:
    """The shared inputs of the allocation operators."""

    raw: DataFrame
    dedup: DataFrame
    raw_backfill: DataFrame
    minutes: int = 15

    def persist(self) -> Frames:
        """Keep the window's rows and the dedup rows for several results over one scan; what an executor loses is computed again."""
        for f in (self.raw, self.dedup):
            f.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for f in (self.dedup, self.raw):
            f.unpersist()


def prepare(slots: DataFrame, owned: Sequence[str] = (), excluded: Sequence[str] = (), minutes: int = 15) -> Frames:
    raw = with_flags(slots, owned, excluded, minutes)
    backfill = raw.where(~F.col("excluded") & F.col("is_bf"))
    return Frames(raw, dedup(raw), backfill, minutes)


def metadata(raw: DataFrame) -> DataFrame:
    """Rows, first and last time, distinct buckets (exclusions not applied) and excluded rows."""
    return raw.agg(F.count(F.lit(1)).alias("total"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count_distinct("bucket").alias("buckets"), F.count_if("excluded").alias("excluded_rows"))


def researcher_scope(raw: DataFrame, keys: Sequence[str] = ("Machine",), device: str | None = None) -> DataFrame:
    """Machines (or machine and device) with a primary slot that has a project, on hosts not owned."""
    rows = raw.where(~F.col("excluded") & ~F.col("is_bf") & ~F.col("owned") & F.coalesce(F.col("PrioritizedProjects") != "", F.lit(False)))
    if device is not None:
        rows = rows.where(F.col("GPUs_DeviceName") == device)
    return rows.select(*keys).distinct()


def _membership() -> dict[str, Column]:
    prio, owned, bf = F.col("prio"), F.col("owned"), F.col("is_bf")
    return {"Priority-ResearcherOwned": prio & ~owned & ~bf, "Priority-PoolOwned": prio & owned & ~bf, "Shared": F.col("shared") & ~bf & ~F.col("is_inter")}


def class_rows(frames: Frames, keys: Sequence[str] = ("Machine",), device: str | None = None, classes: Sequence[str] = CLASSES) -> DataFrame:
    """All classes as one long frame (class, bucket, AssignedGPUs, State, Machine, device, owner, pj_set).

    Real classes come from dedup rows, backfill classes from all backfill rows: of owned hosts, or
    of machines in the researchers' scope.
    """
    cols = ("bucket", "AssignedGPUs", "State", "Name", "Machine", "GPUs_DeviceName", "GPUs_GlobalMemoryMb", "RemoteOwner", "pj_set")
    named = lambda conditions: F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in conditions.items() if k in classes])))
    parts = []
    if set(classes) & set(REAL_CLASSES):
        parts.append(frames.dedup.withColumn("class", named(_membership())).select("class", *cols))
    if set(classes) & set(BACKFILL_CLASSES):
        rows = with_scope(frames, keys, device) if "Backfill-ResearcherOwned" in classes else frames.raw_backfill.withColumn("scoped", F.lit(False))
        parts.append(rows.withColumn("class", named({"Backfill-ResearcherOwned": F.col("scoped"), "Backfill-PoolOwned": F.col("owned")})).select("class", *cols))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_scope(frames: Frames, keys: Sequence[str] = ("Machine",), device: str | None = None) -> DataFrame:
    """All backfill rows with ``scoped``: whether they are in the researchers' scope. One join for all classes that ask."""
    scope = researcher_scope(frames.raw, keys, device).withColumn("__in", F.lit(True))
    return frames.raw_backfill.join(scope, list(keys), "left").withColumn("scoped", F.coalesce("__in", F.lit(False))).drop("__in")


def open_backfill(frames: Frames) -> DataFrame:
    """Backfill rows on machines neither owned nor in the researchers' scope."""
    return frames.raw_backfill.where(~F.col("owned")).join(researcher_scope(frames.raw), ["Machine"], "left_anti")


#: Rows of the state-aware filters: (class, whether it has duplicates removed first).
STATE_AWARE = ("Priority", "Shared", "Priority-ResearcherOwned", "Priority-PoolOwned", "Backfill", "Backfill-ResearcherOwned", "Backfill-PoolOwned", "Backfill-OpenCapacity")


def _in_state(utilization: str, state: str) -> Column:
    """Whether a dedup row belongs to a primary class in a state."""
    bf, inter, owned, s = F.col("is_bf"), F.col("is_inter"), F.col("owned"), F.col("State")
    member = F.col("shared") if utilization == "Shared" else F.col("prio")
    if utilization == "Priority-ResearcherOwned":
        member &= ~owned
    elif utilization == "Priority-PoolOwned":
        member &= owned
    primary = ~bf & ~inter if utilization == "Shared" else ~bf
    if state == "Unclaimed":
        return member & (((s == "Unclaimed") & primary) | ((s == "Claimed") & bf))
    return member & (s == "Claimed") & primary if state == "Claimed" else member & primary


def _backfill_in_state(utilization: str, state: str) -> Column:
    """Whether a backfill row (with ``scoped``) belongs to a backfill class in a state."""
    owned, scoped = F.col("owned"), F.col("scoped")
    member = {"Backfill": F.lit(True), "Backfill-PoolOwned": owned, "Backfill-ResearcherOwned": scoped, "Backfill-OpenCapacity": ~owned & ~scoped}[utilization]
    return member & (F.col("State") == state) if state else member


def state_filter(frames: Frames, utilization: str, state: str = "", host: str = "") -> DataFrame:
    """Rows of a class in a state.

    ``Unclaimed`` of a primary class also has its devices that backfill claimed (what wins there is
    the backfill row). An unknown class gives all rows that aren't excluded. ``host`` is a regular
    expression on the slot's name.
    """
    on_host = F.rlike("Name", F.lit(host)) if host else F.lit(True)
    if utilization not in STATE_AWARE:
        return frames.raw.where(~F.col("excluded") & on_host if host else ~F.col("excluded"))
    if not utilization.startswith("Backfill"):
        return frames.dedup.where(_in_state(utilization, state) & on_host)
    needs_scope = utilization in ("Backfill-ResearcherOwned", "Backfill-OpenCapacity")
    rows = with_scope(frames) if needs_scope else frames.raw_backfill.withColumn("scoped", F.lit(False))
    return rows.where(_backfill_in_state(utilization, state) & on_host).drop("scoped")


def state_rows(frames: Frames, classes: Sequence[str], states: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(class, s, *columns): the rows of ``state_filter`` for all ``classes`` and ``states`` at once.

    Each row carries an array of its memberships, which is taken apart; so dedup rows and backfill
    rows are computed once each, and the researchers' scope once, however many classes are asked for.
    """
    tag = lambda k, s: F.struct(F.lit(k).alias("class"), F.lit(s).alias("s"))
    of = lambda rows, cond, names: rows.select(*columns, F.explode(F.array_compact(F.array(*[F.when(cond(k, s), tag(k, s)) for k in names for s in states]))).alias("__f"))
    real, back = [k for k in classes if not k.startswith("Backfill")], [k for k in classes if k.startswith("Backfill")]
    parts = [of(frames.dedup, _in_state, real)] if real else []
    if back:
        needs_scope = {"Backfill-ResearcherOwned", "Backfill-OpenCapacity"} & set(back)
        parts.append(of(with_scope(frames) if needs_scope else frames.raw_backfill.withColumn("scoped", F.lit(False)), _backfill_in_state, back))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select("__f.class", "__f.s", *columns)
