"""Derived columns of slot snapshots and jobs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
OLD_DEVICES = ("GTX 1080", "P100", "Quadro", "A30", "A40")
FLAGSHIP = ("H100", "H200", "A100-SXM4-80GB", "A100 80GB")
DISPLAY_NAMES = {
    "NVIDIA A100-SXM4-40GB": "A100 40GB",
    "NVIDIA A100-SXM4-80GB": "A100 80GB",
    "NVIDIA A30": "A30",
    "NVIDIA A40": "A40",
    "NVIDIA GeForce GTX 1080 Ti": "GTX 1080 Ti",
    "NVIDIA GeForce RTX 2080 Ti": "RTX 2080 Ti",
    "NVIDIA H100 80GB HBM3": "H100 80GB",
    "NVIDIA H200": "H200",
    "NVIDIA L40": "L40",
    "NVIDIA L40S": "L40S",
    "Quadro RTX 6000": "Quadro RTX 6000",
    "Tesla P100-PCIE-16GB": "Tesla P100 16GB",
}
MEMORY_GB = {
    "NVIDIA A100-SXM4-40GB": 40,
    "NVIDIA A100-SXM4-80GB": 80,
    "NVIDIA A30": 24,
    "NVIDIA A40": 48,
    "NVIDIA GeForce GTX 1080 Ti": 11,
    "NVIDIA GeForce RTX 2080 Ti": 11,
    "NVIDIA H100 80GB HBM3": 80,
    "NVIDIA H200": 141,
    "NVIDIA L40": 48,
    "NVIDIA L40S": 48,
    "Quadro RTX 6000": 24,
    "Tesla P100-PCIE-16GB": 16,
}
MEMORY_RANGES = (("10-12GB", 10, 12), ("16GB", 15, 17), ("24GB", 20, 25), ("40GB", 35, 42), ("48GB", 45, 50), ("80GB", 75, 85), ("140GB+", 135, 200))
CLASS_LABELS = {
    "Priority": "Prioritized service",
    "Priority-ResearcherOwned": "Researcher-Owned Hardware",
    "Priority-PoolOwned": "Researcher-Reserved Capacity",
    "Shared": "Open Capacity",
    "Backfill": "Secondary (Backfill)",
    "Backfill-ResearcherOwned": "Researcher-Owned Hardware",
    "Backfill-PoolOwned": "Researcher-Reserved Capacity",
    "Backfill-OpenCapacity": "Secondary (Backfill) - Open Capacity",
}
STATE_CODES = {"idle_prioritized": 0, "idle_shared": 1, "busy_prioritized": 2, "busy_shared": 3, "busy_backfill": 4, "na": 5, "idle_backfill": 6}


def lookup(key: Column, values: Mapping[str, object], default: Column) -> Column:
    """A small constant table as a chain of conditions."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return default if out is None else out.otherwise(default)


def quoted(patterns: Sequence[str]) -> str:
    """A regular expression for any of the literal ``patterns``."""
    return "|".join(re.escape(p) for p in patterns)


def bucket(ts: Column, minutes: int = 15) -> Column:
    """Start of the ``minutes`` bucket that holds a time."""
    return F.window(ts, f"{minutes} minutes")["start"]


def bucket_floor(ts: Column, minutes: int = 15) -> Column:
    """As ``bucket``, in places where window() isn't allowed; NTZ in, NTZ out."""
    step = minutes * 60
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(seconds / step) * step).cast("timestamp_ntz")


def truncated(ts: Column, unit: str) -> Column:
    """Hour, day, Monday week or month of a time."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def is_backfill(name: Column) -> Column:
    return F.coalesce(F.contains(name, F.lit("backfill")), F.lit(False))


def is_interactive(name: Column) -> Column:
    return F.coalesce(F.contains(name, F.lit("interactive")), F.lit(False))


def is_partitionable(name: Column) -> Column:
    return F.coalesce(F.rlike(name, F.lit(r"^slot\d+@")), F.lit(False))


def is_prioritised(project: Column) -> Column:
    """A null project counts as prioritised."""
    return F.coalesce(project != "", F.lit(True))


def is_shared(project: Column) -> Column:
    return F.coalesce(project == "", F.lit(False))


def is_owned(machine: Column, owned: Sequence[str]) -> Column:
    return F.coalesce(machine.isin(*owned), F.lit(False)) if owned else F.lit(False)


def is_excluded(machine: Column, patterns: Sequence[str]) -> Column:
    """Any pattern as a literal, case-insensitive part of the machine's name; null is kept."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(F.rlike(machine, F.lit(f"(?i){quoted(patterns)}")), F.lit(False))


def reason_set(reason: Column) -> Column:
    return reason.isNotNull() & ~F.rlike(reason, F.lit(r"^\s*$"))


def prevented_idle(reason: Column, state: Column) -> Column:
    return reason_set(reason) & (state != "Claimed")


def is_old_device(device: Column, old: Sequence[str] = OLD_DEVICES, ignore_case: bool = False) -> Column:
    return F.coalesce(F.rlike(device, F.lit(("(?i)" if ignore_case else "") + quoted(old))), F.lit(False))


def display_name(device: Column) -> Column:
    return lookup(device, DISPLAY_NAMES, device)


def memory_gb(device: Column) -> Column:
    return lookup(device, MEMORY_GB, F.lit(0))


def memory_category(device: Column) -> Column:
    """Memory range of a known device; Unknown at 0, else its own size."""
    gb = memory_gb(device)
    out = F.when(gb == 0, "Unknown")
    for label, lo, hi in MEMORY_RANGES:
        out = out.when(gb.between(lo, hi), label)
    return out.otherwise(F.concat(gb.cast("string"), F.lit("GB")))


def memory_category_mb(mb: Column) -> Column:
    gb = mb / 1024
    return F.when(mb.isNull() | (mb <= 0), "Unknown").when(gb < 44, "<48GB").when(gb.between(44, 50), "48GB").when(gb.between(75, 85), "80GB").when(gb > 80, ">80GB").otherwise("<48GB")


def performance_tier(device: Column, empty_unknown: bool = False) -> Column:
    tier = F.when(F.coalesce(F.rlike(device, F.lit(quoted(FLAGSHIP))), F.lit(False)), "Flagship").otherwise("Standard")
    return F.when(device.isNull() | (device == ""), "Unknown").otherwise(tier) if empty_unknown else tier


def class_label(name: Column) -> Column:
    return lookup(name, CLASS_LABELS, name)


def host_matches(machine: Column, hosts: str) -> Column:
    """A comma-separated list of literal parts of the machine's name, case ignored."""
    parts = [h.strip() for h in hosts.split(",") if h.strip()]
    return F.coalesce(F.rlike(machine, F.lit(f"(?i){quoted(parts)}")), F.lit(False)) if parts else F.lit(True)


def gpu_identity(machine: Column, gpu: Column) -> Column:
    return F.concat_ws("_", machine, gpu)


def user_name(owner: Column) -> Column:
    """Without its domain."""
    return F.substring_index(owner, "@", 1)


def state_code(state: Column, backfill: Column, prioritised: Column) -> Column:
    """Display codes 0 to 6; other states than Claimed and Unclaimed are 5."""
    c, u = state == "Claimed", state == "Unclaimed"
    k = STATE_CODES
    return (
        F.when(c & backfill, k["busy_backfill"]).when(c & prioritised, k["busy_prioritized"]).when(c, k["busy_shared"])
        .when(u & backfill, k["idle_backfill"]).when(u & prioritised, k["idle_prioritized"]).when(u, k["idle_shared"])
        .otherwise(k["na"])
    )


def state_label(state: Column, name: Column, project: Column, variant: str = "scalar") -> Column:
    """Six labels. ``scalar`` counts idle backfill as idle_shared; ``vectorised`` judges idle by the project alone."""
    backfill = F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("backfill"))
    s = F.lower(state)
    c, u = s == "claimed", s == "unclaimed"
    if variant == "scalar":
        prio = is_prioritised(project)
        idle = F.when(u & ~backfill & prio, "idle_prioritized").when(u, "idle_shared")
    else:
        prio = F.coalesce(project != "", F.lit(False))
        idle = F.when(u & prio, "idle_prioritized").when(u, "idle_shared")
    busy = F.when(c & backfill, "busy_backfill").when(c & prio, "busy_prioritized").when(c, "busy_shared")
    return F.coalesce(busy, idle, F.lit("na"))


def slot_type(name: Column, project: Column, owned: Column) -> Column:
    """Seven labels by the slot's own project."""
    b = is_backfill(name)
    has, empty, blank = F.coalesce(project != "", F.lit(False)), F.coalesce(project == "", F.lit(False)), F.coalesce(project == "", F.lit(True))
    return (
        F.when(b & has & ~owned, "Backfill-ResearcherOwned").when(b & owned, "Backfill-PoolOwned").when(b & blank & ~owned, "Backfill-OpenCapacity")
        .when(~b & has & ~owned, "Priority-ResearcherOwned").when(~b & has & owned, "Priority-PoolOwned").when(~b & empty, "Shared")
        .otherwise("Other")
    )


def slot_category(slot: Column) -> Column:
    """prioritized, open_capacity or backfill; null for Other."""
    return F.when(F.startswith(slot, F.lit("Priority")), "prioritized").when(slot == "Shared", "open_capacity").when(F.startswith(slot, F.lit("Backfill")), "backfill")


def gpu_hex(assigned: Column) -> Column:
    found = F.regexp_extract(assigned, "GPU-([a-f0-9]+)", 1)
    return F.when(found != "", found)


def safe_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def positive_or_null(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when(n > 0, n)


def safe_long(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("double").cast("bigint"), F.lit(default))
