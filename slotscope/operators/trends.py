"""Daily, weekly, monthly and period trends."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import classify as c

CATEGORIES = ("prioritized", "open_capacity", "backfill")


def category_buckets(slots: DataFrame, owned: Sequence[str], excluded: Sequence[str], minutes: int = 15) -> DataFrame:
    """(week, bucket, category, total_gpus, claimed_gpus) by the slots' own projects.

    Totals of primary categories come from all rows, claimed ones from deduplicated rows, backfill
    from all rows.
    """
    dev = F.col("GPUs_DeviceName")
    kept = slots.where(~d.is_excluded(F.col("Machine"), excluded) & dev.isNotNull() & (dev != "") & ~d.is_old_device(dev) & F.col("AssignedGPUs").isNotNull())
    label = d.slot_category(d.slot_type(F.col("Name"), F.col("PrioritizedProjects"), d.is_owned(F.col("Machine"), owned)))
    rows = kept.withColumn("category", label).where("category is not null").withColumn("bucket", d.bucket_floor(F.col("timestamp"), minutes))
    best = c.winners(rows, ("timestamp", "AssignedGPUs"), c.simple_rank(d.is_backfill(F.col("Name")), F.col("State"), "claimed_first"), (*c.KEPT, "category", "bucket"))
    keys = ("bucket", "category")
    total = _distinct_devices(rows, keys, {"total_gpus": F.lit(True), "own": (F.col("category") == "backfill") & (F.col("State") == "Claimed")})
    held = _distinct_devices(best.where("category != 'backfill' and State = 'Claimed'"), keys, {"held": F.lit(True)})
    out = total.join(held, list(keys), "left")
    got = F.when(F.col("category") == "backfill", F.col("own")).otherwise(F.coalesce("held", F.lit(0)))
    return out.select(d.truncated(F.col("bucket"), "week").alias("week_start"), "bucket", "category", "total_gpus", got.alias("claimed_gpus"))


def category_means(buckets: DataFrame) -> DataFrame:
    pct = F.when(F.col("total_gpus") > 0, F.col("claimed_gpus").cast("double") / F.col("total_gpus") * 100)
    return buckets.groupBy("category").agg(F.avg("total_gpus").alias("avg_total"), F.avg("claimed_gpus").alias("avg_claimed"), F.avg(pct).alias("avg_percent"))


def weekly_summary(buckets: DataFrame) -> DataFrame:
    """Weeks with seven distinct days: ratio of sums, averages and hours by category as columns, 0 where missing."""
    days = F.size(F.collect_set(F.to_date("bucket"))).alias("days")  # seven at most
    of = lambda k, x: F.when(F.col("category") == k, x)
    cols: list[Column] = []
    for k in CATEGORIES:
        t, g, n = F.sum(of(k, F.col("total_gpus"))), F.sum(of(k, F.col("claimed_gpus"))), F.count(of(k, F.lit(1)))
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        cols += [
            zero(F.when(t > 0, g / t * 100)).alias(f"{k}_pct"), n.alias(f"{k}_intervals"), zero(F.when(n > 0, t / n)).alias(f"{k}_avg_total"),
            zero(F.when(n > 0, g / n)).alias(f"{k}_avg_claimed"), zero(g * 0.25).alias(f"{k}_gpu_hours"),
        ]
    out = buckets.groupBy("week_start").agg(*cols, days).where("days >= 7").drop("days")
    return out.withColumn("primary_gpu_hours", F.col("prioritized_gpu_hours") + F.col("open_capacity_gpu_hours")).withColumn("total_gpu_hours", F.col("primary_gpu_hours") + F.col("backfill_gpu_hours"))


def series_summary(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, average, least, most) of columns."""
    long = rows.unpivot([], list(columns), "metric", "value") if columns else rows
    return long.groupBy("metric").agg(F.avg("value").alias("average"), F.min("value").alias("least"), F.max("value").alias("most"))


def weekly_allocation(frames: c.Frames) -> DataFrame:
    """Weekly mean of bucket percentages by headline category, seven days of the category needed, gap weeks null."""
    rows = c.class_rows(frames)
    dev = F.col("GPUs_DeviceName")
    kind = F.when(F.startswith("class", F.lit("Priority")), "Prioritized (Primary)").when(F.col("class") == "Shared", "Open Capacity").otherwise("Secondary (Backfill)")
    rows = rows.where(dev.isNotNull() & (dev != "") & ~d.is_old_device(dev) & F.col("AssignedGPUs").isNotNull()).withColumn("category", kind)
    gpu = rows.groupBy("category", "bucket", "AssignedGPUs").agg(F.max(F.col("State") == "Claimed").alias("c"))
    per = gpu.groupBy("category", "bucket").agg(F.count(F.lit(1)).alias("t"), F.count_if("c").alias("c"))
    weekly = per.groupBy("category", d.truncated(F.col("bucket"), "week").alias("week_start")).agg(
        F.avg(F.col("c").cast("double") / F.col("t") * 100).alias("pct"), (F.sum("c") / F.count(F.lit(1))).alias("avg_claimed"), (F.sum("t") / F.count(F.lit(1))).alias("avg_total"),
        F.count(F.lit(1)).alias("intervals"), F.count_distinct(F.to_date("bucket")).alias("n_days"),
    ).where("n_days >= 7")
    return weekly


def week_grid(weekly: DataFrame) -> DataFrame:
    """Every category on every week from the first to the last, with null where there is none."""
    span = weekly.agg(F.min("week_start").alias("lo"), F.max("week_start").alias("hi")).where("lo is not null")
    weeks = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week_start"))
    grid = weeks.join(F.broadcast(weekly.select("category").distinct()))
    return grid.join(weekly, ["week_start", "category"], "left")


def interval_hours(counts: DataFrame, by: Sequence[str], single: float) -> Column:
    """Hours from a row to the next of its kind; the last takes the gap before it, a single one ``single``."""
    w = Window.partitionBy(*by).orderBy("timestamp")
    s = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    ahead, behind = F.lead(s).over(w) - s, s - F.lag(s).over(w)
    return F.coalesce(ahead / 3600.0, behind / 3600.0, F.lit(single))


def daily_hours(slots: DataFrame) -> DataFrame:
    """(day, kind, gpu_hours, avg_claimed, measurements): claimed rows by slot prefix times the time to the next such snapshot, by month."""
    kind = F.when(F.col("Name").like("slot1_%"), "primary").when(F.col("Name").like("backfill2_%"), "backfill")
    rows = slots.where("State = 'Claimed'").withColumn("kind", kind).where("kind is not null")
    counts = rows.groupBy("kind", "timestamp").agg(F.count(F.lit(1)).alias("n")).withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    timed = counts.withColumn("h", interval_hours(counts, ("month", "kind"), 0.25))
    return timed.groupBy(F.to_date("timestamp").alias("day"), "kind").agg(F.sum(F.col("n") * F.col("h")).alias("gpu_hours"), F.avg("n").alias("avg_claimed"), F.count(F.lit(1)).alias("measurements"))


def daily_wide(daily: DataFrame) -> DataFrame:
    """One row a day: primary, backfill and total hours, mean claimed counts."""
    pick = lambda k, v: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(v))), F.lit(0.0))
    out = daily.groupBy("day").agg(pick("primary", "gpu_hours").alias("primary_hours"), pick("backfill", "gpu_hours").alias("backfill_hours"), pick("primary", "avg_claimed").alias("primary_claimed"), pick("backfill", "avg_claimed").alias("backfill_claimed"))
    return out.withColumn("total_hours", F.col("primary_hours") + F.col("backfill_hours"))


def monthly_hours(wide: DataFrame) -> DataFrame:
    out = wide.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("total_hours").alias("total_hours"), F.sum("primary_hours").alias("primary_hours"), F.sum("backfill_hours").alias("backfill_hours"), F.count(F.lit(1)).alias("days"))
    return out.withColumn("avg_per_day", F.col("total_hours") / F.col("days"))


def weekly_hours(wide: DataFrame) -> DataFrame:
    """Monday weeks of seven days: sums of hours, means of counts."""
    week = F.to_date(F.date_trunc("week", F.col("day"))).alias("week_start")
    out = wide.groupBy(week).agg(F.sum("total_hours").alias("total_hours"), F.sum("primary_hours").alias("primary_hours"), F.sum("backfill_hours").alias("backfill_hours"), F.avg("primary_claimed").alias("primary_claimed"), F.avg("backfill_claimed").alias("backfill_claimed"), F.count(F.lit(1)).alias("days"))
    return out.where("days = 7")


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c_, dd = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = dd
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            dd = 1.0 / (1 + num * dd or 1e-300)
            c_ = 1 + num / c_ or 1e-300
            h *= dd * c_
        if abs(dd * c_ - 1) < 1e-14:
            break
    return front * h


def student_p(t: float, degrees: float) -> float:
    """Two-sided tail of Student's t."""
    return _beta_tail(degrees / (degrees + t * t), degrees / 2, 0.5)


def linear_trend(series: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope a day, intercept, r, r2, standard error and rates; ``x`` is a date."""
    t = F.datediff(F.col(x), F.lit("1970-01-01")).cast("double")
    rows = series.select(t.alias("t"), F.col(y).cast("double").alias("v")).where("v is not null")
    first = rows.agg(F.min("t").alias("t0"))
    rows = rows.join(F.broadcast(first)).select((F.col("t") - F.col("t0")).alias("t"), "v")
    fit = rows.agg(F.regr_slope("v", "t").alias("slope"), F.regr_intercept("v", "t").alias("intercept"), F.corr("v", "t").alias("r"), F.regr_sxx("v", "t").alias("sxx"), F.regr_syy("v", "t").alias("syy"), F.count(F.lit(1)).alias("n"))
    error = F.when(F.col("n") > 2, F.sqrt(F.greatest((F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("n") - 2), F.lit(0.0)) / F.col("sxx")))
    strength = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.3, "moderate").otherwise("weak")
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat")
    return fit.select("slope", "intercept", "r", (F.col("r") * F.col("r")).alias("r2"), error.alias("std_err"), (F.col("slope") * 30.44).alias("per_month"), (F.col("slope") * 365.25).alias("per_year"), strength.alias("strength"), direction.alias("direction"), "n")


def with_significance(trend: DataFrame) -> DataFrame:
    """The trend row with its p-value, computed on the driver from that row alone."""
    r = trend.first()
    if r is None or r["std_err"] is None or r["n"] <= 2:
        return trend.withColumns({"p_value": F.lit(None).cast("double"), "significant": F.lit(False)})
    p = student_p(r["slope"] / r["std_err"], r["n"] - 2) if r["std_err"] > 0 else 0.0
    return trend.withColumns({"p_value": F.lit(float(p)), "significant": F.lit(p < 0.05)})


def fitted_line(series: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, fitted, residual): the series beside the straight line of ``linear_trend``; null where that has none."""
    days = F.date_diff(F.col(x), F.col("first_day"))
    one = linear_trend(series, x, y).select("slope", "intercept")
    first = series.where(F.col(y).isNotNull()).agg(F.min(x).alias("first_day"))
    rows = series.select(x, y).join(F.broadcast(one)).join(F.broadcast(first))  # a row each
    line = F.col("intercept") + F.col("slope") * days
    return rows.select(x, y, line.alias("fitted"), (F.col(y) - line).alias("residual"))


def moving_average(series: DataFrame, x: str, y: str, rows: int = 4) -> DataFrame:
    """Trailing mean over ``rows`` rows, partial at the start; for small aggregated series."""
    return series.withColumn("moving_average", F.avg(y).over(Window.partitionBy(F.lit(0)).orderBy(x).rowsBetween(1 - rows, 0)))


def split_periods(wide: DataFrame, at: str) -> DataFrame:
    """Sum, mean, most and least of the hours before and after a date, and the kinds' shares."""
    period = F.when(F.col("day") < F.lit(at).cast("date"), "before").otherwise("after")
    out = wide.groupBy(period.alias("period")).agg(F.sum("total_hours").alias("total"), F.avg("total_hours").alias("mean"), F.max("total_hours").alias("most"), F.min("total_hours").alias("least"), F.sum("primary_hours").alias("p"), F.sum("backfill_hours").alias("b"))
    share = lambda k: F.when(F.col("total") > 0, F.col(k) / F.col("total") * 100).otherwise(0.0)
    return out.select("period", "total", "mean", "most", "least", share("p").alias("primary_share"), share("b").alias("backfill_share"))


def _listed(gpus: Column) -> Column:
    """Devices in a comma list, 1 without a list."""
    return F.when(F.coalesce(gpus, F.lit("")) == "", 1).otherwise(F.size(F.filter(F.split(gpus, ","), lambda g: F.trim(g) != "")))


def period_jobs(slots: DataFrame, start: str, end: str) -> DataFrame:
    """(category, jobs, gpu_hours, samples) of claimed rows with a job in [start, end)."""
    rows = slots.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")).where(F.col("timestamp") < F.lit(end).cast("timestamp_ntz")).where("State = 'Claimed' and GlobalJobId != ''")
    b = F.startswith("Name", F.lit("backfill"))
    has = F.trim(F.coalesce("PrioritizedProjects", F.lit(""))) != ""
    kind = F.when(b, "backfill").when(F.startswith("Name", F.lit("slot")) | F.startswith("Name", F.lit("interactive")), F.when(has, "prioritized").otherwise("open_capacity"))
    rows = rows.withColumn("n", _listed(F.col("AssignedGPUs")))
    labelled = rows.withColumn("category", F.explode(F.array_compact(F.array(F.lit("total"), kind))))
    jobs = labelled.groupBy("category").agg(F.count_distinct("GlobalJobId").alias("jobs"))
    counts = labelled.groupBy("category", "timestamp").agg(F.sum("n").alias("n"))
    times = rows.select("timestamp").distinct().withColumn("m", F.date_format("timestamp", "yyyy-MM"))
    times = times.withColumn("h", interval_hours(times, ("m",), 5.0 / 60))
    hours = counts.join(times, "timestamp").groupBy("category").agg(F.sum(F.col("n") * F.col("h")).alias("gpu_hours"), F.count_if(F.col("n") > 0).alias("samples"))
    return jobs.join(hours, "category")


def available_hours(slots: DataFrame, start: str, end: str) -> DataFrame:
    """One row: hours of distinct devices (comma lists taken apart) over the snapshots of [start, end)."""
    rows = slots.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")).where(F.col("timestamp") < F.lit(end).cast("timestamp_ntz")).where("AssignedGPUs != ''")
    gpus = rows.select("timestamp", F.explode(F.split("AssignedGPUs", ",")).alias("g")).select("timestamp", F.trim("g").alias("g")).where("g != ''")
    counts = gpus.distinct().groupBy("timestamp").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.date_format("timestamp", "yyyy-MM"))
    timed = counts.withColumn("h", interval_hours(counts, ("m",), 5.0 / 60))
    return timed.agg(F.sum(F.col("n") * F.col("h")).alias("available_hours"))


def period_efficiency(jobs: DataFrame, available: DataFrame) -> DataFrame:
    """Shares of jobs and hours by category, and claimed over available hours."""
    total = jobs.where("category = 'total'").select(F.col("jobs").alias("all_jobs"), F.col("gpu_hours").alias("all_hours"))
    out = jobs.where("category != 'total'").join(F.broadcast(total)).join(F.broadcast(available))
    return out.select("category", (F.col("jobs") / F.col("all_jobs") * 100).alias("job_share"), (F.col("gpu_hours") / F.col("all_hours") * 100).alias("hour_share"), (F.col("all_hours") / F.col("available_hours") * 100).alias("efficiency"))


def _distinct_devices(rows: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """By ``keys`` the devices that meet each condition in some row: devices first, so that no distinct count is expanded."""
    per = rows.groupBy(*keys, "AssignedGPUs").agg(*(F.bool_or(cond).alias(k) for k, cond in conditions.items()))
    return per.groupBy(*keys).agg(*(F.count_if(F.col(k) & F.col("AssignedGPUs").isNotNull()).alias(k) for k in conditions))


OPEN, RESEARCHER = "Open Capacity", "Researcher Owned"


def _is_backfill_any_case() -> Column:
    return F.coalesce(F.rlike("Name", F.lit("(?i)backfill")), F.lit(False))


def machine_category(project: Column) -> Column:
    return F.when(F.coalesce(project, F.lit("")) == "", OPEN).otherwise(RESEARCHER)


def with_project(slots: DataFrame) -> DataFrame:
    """Rows with ``project`` and ``machine_category``: a backfill row takes the project of the primary slot that has its device at its time.

    Of several primary rows the largest project counts, so one that has a project wins; a device
    without a primary row at the time keeps its row's own. Primary rows are summed to one for each
    (time, device) and joined back; rows without a device are spread over keys that match nothing.
    """
    key = F.coalesce("AssignedGPUs", F.concat(F.lit("\x00"), F.coalesce("Name", F.lit(""))))
    primary = slots.where(~_is_backfill_any_case() & F.col("AssignedGPUs").isNotNull())
    found = primary.groupBy(F.col("timestamp").alias("__t"), F.col("AssignedGPUs").alias("__g")).agg(F.max(F.coalesce("PrioritizedProjects", F.lit(""))).alias("__p"))
    joined = slots.join(found, (F.col("timestamp") == F.col("__t")) & (key == F.col("__g")), "left")
    project = F.coalesce("__p", "PrioritizedProjects", F.lit(""))
    return joined.withColumns({"project": project, "machine_category": machine_category(project)}).drop("__t", "__g", "__p")


def type_summary(slots: DataFrame, by: Sequence[str] = ("GPUs_DeviceName",), include_all: bool = True, category: str | None = None) -> DataFrame:
    """By device (and machine): averages over its snapshots, allocated percentage, slot-creation efficiency.

    Claimed primaries count on dynamic slots only; efficiency looks at snapshots with unused primaries.
    ``category`` keeps the devices of one machine category, see ``with_project``.
    """
    if category is not None:
        slots = with_project(slots).where(F.col("machine_category") == category)
    bf = _is_backfill_any_case()
    dynamic = ~F.coalesce(F.rlike("Name", F.lit(r"(?i)^slot\d+@")), F.lit(False))
    claimed = F.col("State") == "Claimed"
    rows = slots.where("GPUs_DeviceName is not null")
    if not include_all:
        rows = rows.where(~d.is_old_device(F.col("GPUs_DeviceName")))
    snap = _distinct_devices(rows, (*by, "timestamp"), {"p": ~bf, "pc": ~bf & dynamic & claimed, "b": bf, "bc": bf & claimed})
    unused = F.col("p") - F.col("pc")
    out = snap.groupBy(*by).agg(F.avg("p").alias("total_gpus"), F.avg("pc").alias("avg_primary_allocated"), F.avg("bc").alias("avg_backfill_allocated"), F.avg("b").alias("avg_backfill_available"), (F.sum(F.when(unused > 0, F.col("b"))) / F.sum(F.when(unused > 0, unused)) * 100).alias("slot_creation_efficiency"))
    share = F.when(F.col("total_gpus") > 0, (F.col("avg_primary_allocated") + F.col("avg_backfill_allocated")) / F.col("total_gpus") * 100).otherwise(0.0)
    return out.withColumn("allocated_pct", share)


def snapshot_efficiency(slots: DataFrame, machine: str) -> DataFrame:
    """Per snapshot of a machine: unused primaries, backfill slots, and their ratio in percent."""
    bf = d.is_backfill(F.col("Name"))
    dynamic = ~d.is_partitionable(F.col("Name"))
    snap = _distinct_devices(slots.where(F.col("Machine") == machine), ("timestamp",), {"p": ~bf, "pc": ~bf & dynamic & (F.col("State") == "Claimed"), "backfill": bf})
    rows = snap.withColumn("unused", F.col("p") - F.col("pc")).where("unused > 0")
    return rows.select("timestamp", "unused", "backfill", (F.col("backfill") / F.col("unused") * 100).alias("efficiency"))


def efficiency_by_project(slots: DataFrame, by: Sequence[str] = ("Machine",), propagate: bool = False) -> DataFrame:
    """By machine and machine category: intervals, those with unused primaries, mean devices, slot-creation efficiency.

    Rows are split by their own project, or with ``propagate`` by that of the device's primary slot.
    Without an unused primary the means over such intervals and the efficiency are 0.
    """
    rows = with_project(slots) if propagate else slots.withColumn("machine_category", machine_category(F.col("PrioritizedProjects")))
    bf = _is_backfill_any_case()
    dynamic = ~F.coalesce(F.rlike("Name", F.lit(r"(?i)^slot\d+@")), F.lit(False))
    snap = _distinct_devices(rows, (*by, "machine_category", "timestamp"), {"p": ~bf, "pc": ~bf & dynamic & (F.col("State") == "Claimed"), "b": bf})
    unused = F.col("p") - F.col("pc")
    out = snap.groupBy(*by, "machine_category").agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(unused > 0).alias("with_unused"), F.avg("p").alias("avg_primary_available"), F.avg("pc").alias("avg_primary_claimed"), F.avg("b").alias("avg_backfill_available"),
        F.coalesce(F.avg(F.when(unused > 0, unused)), F.lit(0.0)).alias("avg_unused"), F.coalesce(F.avg(F.when(unused > 0, F.col("b"))), F.lit(0.0)).alias("avg_backfill_when_unused"),
    )
    return out.withColumn("efficiency", F.when(F.col("avg_unused") > 0, F.col("avg_backfill_when_unused") / F.col("avg_unused") * 100).otherwise(0.0))


def efficiency_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("snapshots"), F.min("efficiency").alias("least"), F.max("efficiency").alias("most"), F.avg("efficiency").alias("mean"), F.percentile("efficiency", F.lit(0.5)).alias("median"), F.count_if(F.col("efficiency") > 100).alias("over_100"))


def never_claimed(slots: DataFrame, excluded_pattern: str = "") -> DataFrame:
    """(machine, gpu, device, tier, records, claimed, projects) of every device with a model; never claimed where claimed is 0.

    ``projects`` are the trimmed projects of its rows, sorted; identifiers are trimmed, empty ones left out.
    """
    gpu = F.trim("AssignedGPUs")
    rows = slots.where("AssignedGPUs is not null and GPUs_DeviceName is not null").withColumn("AssignedGPUs", gpu).where("AssignedGPUs != ''")
    if excluded_pattern:
        rows = rows.where(~F.rlike("Machine", F.lit(excluded_pattern)))
    project = F.trim(F.coalesce("PrioritizedProjects", F.lit("")))
    per = rows.groupBy("Machine", "AssignedGPUs").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("State") == "Claimed").alias("claimed"), F.max_by("GPUs_DeviceName", F.struct("timestamp", "GPUs_DeviceName")).alias("device"),
        F.array_sort(F.collect_set(F.when(project != "", project))).alias("projects"),
    )
    return per.select("Machine", "AssignedGPUs", "device", d.performance_tier(F.col("device"), empty_unknown=True).alias("tier"), "records", "claimed", "projects")


def never_claimed_hosts(devices: DataFrame) -> DataFrame:
    """(tier, device, Machine, unused, of, projects, gpus): never claimed devices of each host, beside all the host's devices.

    One aggregation over two sets of dimensions gives both numbers; ``projects`` of none is ``None (Open Capacity)``.
    """
    unused = F.col("claimed") == 0
    sets = devices.groupingSets([["tier", "device", "Machine"], ["Machine"]], "tier", "device", "Machine").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(unused).alias("unused"), F.array_sort(F.flatten(F.collect_set(F.when(unused, F.col("projects"))))).alias("projects"),
        F.array_sort(F.collect_set(F.when(unused, F.col("AssignedGPUs")))).alias("gpus"), F.grouping("tier").alias("whole"),
    )
    of = Window.partitionBy("Machine")
    rows = sets.withColumn("of", F.max(F.when(F.col("whole") == 1, F.col("n"))).over(of)).where("whole = 0 and unused > 0")
    listed = F.array_join(F.array_distinct("projects"), ", ")
    return rows.select("tier", "device", "Machine", "unused", "of", F.when(listed == "", "None (Open Capacity)").otherwise(listed).alias("projects"), F.array_join("gpus", ", ").alias("gpus"))


def never_claimed_devices(devices: DataFrame) -> DataFrame:
    """(tier, device, gpus, unused, hosts): devices by tier and model, by tier, and overall (nulls); ``hosts`` have an unused one."""
    unused = F.col("claimed") == 0
    by_host = devices.groupBy("tier", "device", "Machine").agg(F.count(F.lit(1)).alias("n"), F.count_if(unused).alias("u"))
    # A host may have several models: its row in a wider set must count once.
    sets = by_host.groupingSets([["tier", "device", "Machine"], ["tier", "Machine"], ["Machine"]], "tier", "device", "Machine").agg(F.sum("n").alias("n"), F.sum("u").alias("u"), F.grouping_id("tier", "device", "Machine").alias("set"))
    return sets.groupBy("set", "tier", "device").agg(F.sum("n").alias("gpus"), F.sum("u").alias("unused"), F.count_if(F.col("u") > 0).alias("hosts")).drop("set")


def never_claimed_summary(devices: DataFrame) -> DataFrame:
    """By tier and overall (null): devices, never claimed ones, share ever used."""
    out = devices.rollup("tier").agg(F.count(F.lit(1)).alias("gpus"), F.count_if(F.col("claimed") == 0).alias("unused"))
    return out.withColumn("used_percent", (F.col("gpus") - F.col("unused")) / F.col("gpus") * 100)


def concurrency(slots: DataFrame, minutes: int = 15) -> DataFrame:
    """Per bucket and user: distinct jobs, device rows and a map of devices to rows, claimed rows with an owner only."""
    rows = slots.where("State = 'Claimed' and RemoteOwner != ''").withColumn("bucket", d.bucket_floor(F.col("timestamp"), minutes))
    per = rows.groupBy("bucket", "RemoteOwner", "GPUs_DeviceName").agg(F.count(F.lit(1)).alias("n"))
    jobs = rows.groupBy("bucket", "RemoteOwner").agg(F.count_distinct("GlobalJobId").alias("jobs"), F.count(F.lit(1)).alias("gpu_rows"))
    maps = per.groupBy("bucket", "RemoteOwner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("GPUs_DeviceName", F.lit("Unknown")), "n")))).alias("devices"))
    return jobs.join(maps, ["bucket", "RemoteOwner"])


def top_users(rows: DataFrame, metric: str, top_n: int = 10) -> DataFrame:
    """Users by mean of a metric, with its most and their windows."""
    out = rows.groupBy("RemoteOwner").agg(F.avg(metric).alias("mean"), F.max(metric).alias("most"), F.count(F.lit(1)).alias("windows"))
    return out.orderBy(F.desc("mean"), "RemoteOwner").limit(top_n)


def open_user_series(slots: DataFrame, minutes: int = 15) -> DataFrame:
    """(bucket, user, gpus): most distinct devices in any snapshot of the bucket, open capacity, 3-tier dedup."""
    best = c.simple_dedup(slots, "three_tier", drop_empty=True)
    rows = best.where((F.col("State") == "Claimed") & ~d.is_backfill(F.col("Name")) & (F.coalesce("PrioritizedProjects", F.lit("")) == "") & (F.col("RemoteOwner") != ""))
    snap = rows.groupBy("timestamp", d.user_name(F.col("RemoteOwner")).alias("user")).agg(F.count_distinct("AssignedGPUs").alias("n"))
    return snap.groupBy(d.bucket_floor(F.col("timestamp"), minutes).alias("bucket"), "user").agg(F.max("n").alias("gpus"))


def open_user_peaks(series: DataFrame, top_n: int = 10) -> DataFrame:
    """Users by their peak, with its first bucket and approximate hours."""
    out = series.groupBy("user").agg(F.max("gpus").alias("peak"), F.max_by("bucket", F.struct("gpus", -F.unix_timestamp(F.col("bucket").cast("timestamp")))).alias("at"), (F.sum("gpus") * 0.25).alias("gpu_hours"))
    return out.orderBy(F.desc("peak"), "user").limit(top_n)


def top_by_peak(series: DataFrame, top_n: int) -> DataFrame:
    """(rank, user, peak): the users with the largest bucket counts, ties by name; ``top_n`` rows at most."""
    peaks = series.groupBy("user").agg(F.max("gpus").alias("peak")).orderBy(F.desc("peak"), "user").limit(top_n)
    return peaks.select(F.row_number().over(Window.orderBy(F.desc("peak"), "user")).cast("bigint").alias("rank"), "user", "peak")


def open_user_pivot(series: DataFrame, top_n: int = 50, names: bool = True) -> DataFrame:
    """A row a bucket, a column for each of the ``top_n`` users by peak (0 where absent), and ``others``: the most of any other user.

    Two phases: the users are found first, so the pivot has at most ``top_n`` columns, whatever the
    number of users. Columns are named by user, or by rank (``u1`` ...) without ``names``; ranks
    beyond the number of users give columns of zeros.
    """
    top = top_by_peak(series, top_n)
    labels = [(r["user"], r["user"] if names else f"u{r['rank']}") for r in top.collect()]  # top_n rows
    if not names:
        labels += [(None, f"u{i}") for i in range(len(labels) + 1, top_n + 1)]
    known = [u for u, _ in labels if u is not None]
    columns = [F.coalesce(F.max(F.when(F.col("user") == u, F.col("gpus"))), F.lit(0).cast("bigint")).alias(c) if u is not None else F.lit(0).cast("bigint").alias(c) for u, c in labels]
    others = F.coalesce(F.max(F.when(~F.col("user").isin(known), F.col("gpus"))), F.lit(0).cast("bigint")).alias("others")
    return series.groupBy("bucket").agg(*columns, others)


def bucket_peaks(series: DataFrame) -> DataFrame:
    """(bucket, peak, user): the largest count of a single user in each bucket, ties to the smallest name."""
    best = F.min(F.struct((-F.col("gpus")).alias("minus"), "user")).alias("best")
    return series.groupBy("bucket").agg(best).select("bucket", (-F.col("best.minus")).alias("peak"), F.col("best.user").alias("user"))


def overall_peak(peaks: DataFrame) -> DataFrame:
    """(peak, bucket, user) of the first bucket with the largest peak, one row; none of an empty series."""
    best = peaks.agg(F.min(F.struct((-F.col("peak")).alias("minus"), "bucket", "user")).alias("best")).where("best is not null")
    return best.select((-F.col("best.minus")).alias("peak"), "best.bucket", "best.user")


def class_quartiles(series: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Of each class of a usage series: mean percent and counts, quartiles of the percentages."""
    parts = [series.select(F.lit(k).alias("class"), F.col(f"{k}_usage_percent").alias("pct"), F.col(f"{k}_claimed").alias("claimed"), F.col(f"{k}_total").alias("total")) for k in classes]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    q = F.percentile("pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("class").agg(F.avg("pct").alias("mean_percent"), F.avg("claimed").alias("mean_claimed"), F.avg("total").alias("mean_total"), q.alias("q")).select("class", "mean_percent", "mean_claimed", "mean_total", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def device_matrix(by_device: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Devices by classes with the allocation percentage, 0 where none."""
    return by_device.groupBy("device").pivot("class", list(classes)).agg(F.first("allocation_usage_percent")).fillna(0.0)
