"""Job history: waits, bursts, mismatch of supply and waits, machine use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import classify as c
from slotscope.operators.asof import as_of

HALF_HOUR = 1800


def _time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def _epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def _whole(*order: str):
    """One window over a small aggregated series."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def clean_waits(jobs: DataFrame, cap_hours: float = 168.0, anchor: str = "submit", least_seconds: float = 1.0) -> DataFrame:
    """(at, wait_h, Owner) of single-device jobs that waited, anchored at submission or start."""
    at = F.col("QDate") if anchor == "submit" else F.col("JobCurrentStartDate")
    rows = jobs.where((F.col("RequestGpus") == 1) & (F.col("initialwaitduration") >= least_seconds) & at.isNotNull())
    return rows.select(_time(at).alias("at"), (F.col("initialwaitduration") / 3600).alias("wait_h"), "Owner").where(F.col("wait_h") <= cap_hours)


def cleaning_counts(jobs: DataFrame, cap_hours: float = 168.0) -> DataFrame:
    keep = (F.col("RequestGpus") == 1) & (F.col("initialwaitduration") >= 1) & F.col("QDate").isNotNull() & (F.col("initialwaitduration") / 3600 <= cap_hours)
    return jobs.agg(F.count_if(keep).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("dropped"))


def rolling_medians(waits: DataFrame, hours: int = 6, least: int = 5) -> DataFrame:
    """(at, rolling_median, jobs) on a half-hour grid over [at - hours, at), null under ``least`` jobs.

    Each job falls into the sliding windows that hold it; a window's end is its grid point.
    """
    w = waits.groupBy(F.window("at", f"{hours} hours", "30 minutes").alias("w")).agg(F.percentile("wait_h", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n"))
    by_end = w.select(F.col("w.end").alias("at"), F.when(F.col("n") >= least, F.col("m")).alias("rolling_median"), F.col("n").alias("jobs"))
    span = waits.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo is not null")
    lo, hi = F.floor(_epoch(F.col("lo")) / HALF_HOUR) * HALF_HOUR, F.ceil(_epoch(F.col("hi")) / HALF_HOUR) * HALF_HOUR
    grid = span.select(F.explode(F.sequence(lo, hi, F.lit(HALF_HOUR).cast("bigint"))).alias("s")).select(_time(F.col("s")).alias("at"))
    return grid.join(by_end, "at", "left").select("at", "rolling_median", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def daily_baseline(waits: DataFrame, days: int = 14, least: int = 3) -> DataFrame:
    """(day, daily_median, baseline): median of the last ``days`` daily medians, null under ``least``.

    The unpartitioned window has a row for each day that has data.
    """
    daily = waits.groupBy(d.truncated(F.col("at"), "day").alias("day")).agg(F.percentile("wait_h", F.lit(0.5)).alias("daily_median"))
    w = _whole("day").rowsBetween(1 - days, 0)
    return daily.select("day", "daily_median", F.when(F.count("daily_median").over(w) >= least, F.percentile("daily_median", F.lit(0.5)).over(w)).alias("baseline"))


def wait_stats(waits: DataFrame, hours: int = 6, days: int = 14) -> DataFrame:
    """Rolling medians with the baseline of the last data day up to each point, and their ratio."""
    rows = as_of(rolling_medians(waits, hours), daily_baseline(waits, days), "at", "day", ["baseline"])
    return rows.select("at", "rolling_median", "baseline", (F.col("rolling_median") / F.col("baseline")).alias("ratio"))


def recent_against_history(waits: DataFrame, recent_days: int = 7) -> DataFrame:
    """Median, 90th percentile and jobs of the recent days and before, and the medians' ratio."""
    cut = waits.agg((F.max("at") - F.make_dt_interval(days=F.lit(recent_days))).alias("cut"))
    rows = waits.join(F.broadcast(cut)).withColumn("recent", F.col("at") > F.col("cut"))
    of = lambda k, p: F.percentile(F.when(k, F.col("wait_h")), F.lit(p))
    r, h = F.col("recent"), ~F.col("recent")
    out = rows.agg(of(r, 0.5).alias("recent_median"), of(r, 0.9).alias("recent_p90"), F.count_if(r).alias("recent_jobs"), of(h, 0.5).alias("history_median"), of(h, 0.9).alias("history_p90"), F.count_if(h).alias("history_jobs"))
    return out.withColumn("ratio", F.col("recent_median") / F.col("history_median"))


def event_starts(rows: DataFrame, gap_hours: float, at: str = "at") -> DataFrame:
    """The first of the rows after every gap of more than ``gap_hours``."""
    s = _epoch(F.col(at))
    return rows.withColumn("gap", s - F.lag(s).over(_whole(at))).where(F.col("gap").isNull() | (F.col("gap") > gap_hours * 3600)).drop("gap")


def elevated_events(stats: DataFrame, ratio: float = 2.0, gap_hours: float = 6.0) -> DataFrame:
    """Starts of elevated periods with the peaks of the next hours."""
    rows = stats.where("rolling_median is not null and baseline is not null and ratio is not null").withColumn("s", _epoch(F.col("at")))
    ahead = _whole("s").rangeBetween(0, int(gap_hours * 3600))
    rows = rows.select("at", "ratio", F.max("ratio").over(ahead).alias("peak_ratio"), F.max("rolling_median").over(ahead).alias("peak_median"))
    return event_starts(rows.where(F.col("ratio") > ratio), gap_hours).select("at", "peak_ratio", "peak_median")


def hour_grid(lo: Column, hi: Column) -> Column:
    step = F.lit(3600).cast("bigint")
    return F.sequence(F.floor(_epoch(lo) / 3600) * 3600, F.floor(_epoch(hi) / 3600) * 3600, step)


def jobs_per_hour(waits: DataFrame) -> DataFrame:
    """Jobs in every hour, 0 in empty ones."""
    counts = waits.groupBy(d.truncated(F.col("at"), "hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = waits.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo is not null").select(F.explode(hour_grid(F.col("lo"), F.col("hi"))).alias("s")).select(_time(F.col("s")).alias("hour"))
    return grid.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("jobs"))


def hourly_open_slots(slots: DataFrame) -> DataFrame:
    """(hour, open_unclaimed, open_claimed, samples): mean distinct open-capacity devices a snapshot, 3-tier dedup."""
    best = c.simple_dedup(slots, "three_tier", drop_empty=True)
    rows = best.where(~d.is_backfill(F.col("Name")) & (F.coalesce("PrioritizedProjects", F.lit("")) == ""))
    gpu = F.col("AssignedGPUs")
    snap = rows.groupBy("timestamp").agg(F.count_distinct(F.when(F.col("State") == "Unclaimed", gpu)).alias("u"), F.count_distinct(F.when(F.col("State") == "Claimed", gpu)).alias("c"))
    return snap.groupBy(d.truncated(F.col("timestamp"), "hour").alias("hour")).agg(F.avg("u").alias("open_unclaimed"), F.avg("c").alias("open_claimed"), F.count(F.lit(1)).alias("samples"))


def mismatch_hours(slots_hourly: DataFrame, stats: DataFrame, baseline_days: int = 5, deviations: float = 1.0, ratio: float = 2.0) -> DataFrame:
    """Hours with unusually many unclaimed devices (against the first days) while waits are elevated."""
    first = slots_hourly.agg(F.min("hour").alias("h0"))
    early = slots_hourly.join(F.broadcast(first)).where(F.col("hour") <= F.col("h0") + F.make_dt_interval(days=F.lit(baseline_days)))
    limit = early.agg((F.avg("open_unclaimed") + deviations * F.stddev_samp("open_unclaimed")).alias("threshold"))
    waits = stats.groupBy(d.truncated(F.col("at"), "hour").alias("hour")).agg(F.max("ratio").alias("ratio"))
    rows = slots_hourly.join(waits, "hour").join(F.broadcast(limit))
    return rows.where((F.col("open_unclaimed") > F.col("threshold")) & (F.col("ratio") > ratio)).select("hour", "open_unclaimed", "ratio", "threshold")


def mismatch_events(hours: DataFrame, gap_hours: float = 2.0) -> DataFrame:
    """Mismatch hours as events, with the peaks of the following six hours."""
    rows = hours.withColumn("s", _epoch(F.col("hour")))
    ahead = _whole("s").rangeBetween(0, 6 * 3600)
    rows = rows.select("hour", F.max("open_unclaimed").over(ahead).alias("peak_unclaimed"), F.max("ratio").over(ahead).alias("peak_ratio"))
    return event_starts(rows, gap_hours, "hour")


def bursts(jobs: DataFrame, least: int = 500, gap_hours: float = 6.0) -> DataFrame:
    """Starts of submission bursts with the hour's jobs and most common owner (ties: the smallest)."""
    hourly = jobs.groupBy(d.truncated(_time(F.col("QDate")), "hour").alias("hour")).agg(F.count(F.lit(1)).alias("jobs"), F.mode("Owner", True).alias("owner"))
    return event_starts(hourly.where(F.col("jobs") > least), gap_hours, "hour")


def rolling_correlation(slots_hourly: DataFrame, stats: DataFrame, rows: int = 24, least: int = 8) -> DataFrame:
    """(hour, correlation) of unclaimed devices and waits over the last ``rows`` hours of the full grid."""
    waits = stats.groupBy(d.truncated(F.col("at"), "hour").alias("hour")).agg(F.percentile("rolling_median", F.lit(0.5)).alias("wait"))
    both = slots_hourly.select("hour", "open_unclaimed").join(waits, "hour", "full_outer")
    span = both.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).where("lo is not null")
    grid = span.select(F.explode(hour_grid(F.col("lo"), F.col("hi"))).alias("s")).select(_time(F.col("s")).alias("hour"))
    full = grid.join(both, "hour", "left")
    w = _whole("hour").rowsBetween(1 - rows, 0)
    pairs = F.count(F.when(F.col("open_unclaimed").isNotNull() & F.col("wait").isNotNull(), 1)).over(w)
    value = F.corr("open_unclaimed", "wait").over(w)
    return full.select("hour", F.when((pairs >= least) & ~F.isnan(value), value).alias("correlation"))


def positive_runs(series: DataFrame, least_hours: int = 4) -> DataFrame:
    """(start, end, hours) of runs of positive correlation; a run open at the end counts its last hour too."""
    pos = F.coalesce(F.col("correlation") > 0, F.lit(False))
    w = _whole("hour")
    marked = series.withColumn("pos", pos).withColumn("new", (F.col("pos") != F.lag("pos").over(w)).cast("int"))
    runs = marked.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(w)).groupBy("run", "pos").agg(F.min("hour").alias("start"), F.max("hour").alias("last"))
    nxt = runs.withColumn("next", F.lead("start").over(_whole("start"))).where("pos")
    end = F.coalesce("next", "last")
    hours = ((_epoch(end) - _epoch(F.col("start"))) / 3600).cast("bigint") + F.when(F.col("next").isNull(), 1).otherwise(0)
    return nxt.select("start", end.alias("end"), hours.alias("hours")).where(F.col("hours") >= least_hours)


def day_mean(series: DataFrame, value: str, least: int = 6) -> DataFrame:
    """Mean over the 24 hours up to each row, null under ``least`` values."""
    rows = series.withColumn("s", _epoch(F.col("hour")))
    w = _whole("s").rangeBetween(-86399, 0)
    return rows.select("hour", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)).alias("mean_24h"))


def wait_statistics(jobs: DataFrame) -> DataFrame:
    """By request size and flag (all, true, false): jobs, mean, median, deviation, least and most wait hours, share of all."""
    h = (F.col("initialwaitduration") / 3600).alias("h")
    rows = jobs.where("initialwaitduration >= 0").select("RequestGpus", "Prioritized", h)
    cols = [F.count(F.lit(1)).alias("jobs"), F.avg("h").alias("mean"), F.percentile("h", F.lit(0.5)).alias("median"), F.stddev_samp("h").alias("std"), F.min("h").alias("least"), F.max("h").alias("most")]
    every = rows.groupBy("RequestGpus").agg(*cols).withColumn("prioritized", F.lit("all"))
    out = every.unionByName(rows.groupBy("RequestGpus", F.col("Prioritized").cast("string").alias("prioritized")).agg(*cols))
    return out.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("all")))).select("RequestGpus", "prioritized", "jobs", "mean", "median", "std", "least", "most", (F.col("jobs") / F.col("all") * 100).alias("share"))


def wait_histogram(jobs: DataFrame, top: int = 25) -> DataFrame:
    """Hour bins 0 to ``top`` (all longer waits in the last) by flag and size, with the waits of a day or more."""
    h = F.col("initialwaitduration") / 3600
    return jobs.groupBy("Prioritized", "RequestGpus", F.least(F.floor(F.greatest(h, F.lit(0.0))), F.lit(top)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(h >= 24).alias("over_24h"))


def waits_by_day(jobs: DataFrame) -> DataFrame:
    """Quartiles, mean and jobs by start day and flag."""
    h = F.col("initialwaitduration") / 3600
    q = F.percentile(h, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = jobs.groupBy(d.truncated(_time(F.col("JobStartDate")), "day").alias("day"), "Prioritized").agg(q.alias("q"), F.avg(h).alias("mean"), F.count(F.lit(1)).alias("jobs"))
    return out.select("day", "Prioritized", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "jobs")


def host_hours(jobs: DataFrame, host: str) -> DataFrame:
    """(hour, gpus): requested devices of the jobs that run at each full hour."""
    rows = jobs.where((F.col("StartdName") == host) & (F.col("CompletionDate") >= F.col("JobStartDate")))
    lo, hi = F.ceil(F.col("JobStartDate") / 3600) * 3600, F.floor(F.col("CompletionDate") / 3600) * 3600
    long = rows.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").select(F.explode(F.sequence("lo", "hi", F.lit(3600).cast("bigint"))).alias("s"), "RequestGpus")
    return long.groupBy(_time(F.col("s")).alias("hour")).agg(F.sum("RequestGpus").alias("gpus"))


def job_spans(jobs: DataFrame, host: str) -> DataFrame:
    """(gpu, start, hours) of a host's jobs."""
    return jobs.where(F.col("StartdName") == host).select(F.col("AssignedGPUs").alias("gpu"), _time(F.col("JobStartDate")).alias("start"), ((F.col("CompletionDate") - F.col("JobStartDate")) / 3600).alias("hours")).orderBy("gpu", "start")


def idle_gaps(jobs: DataFrame, machine: str, least_hours: float = 1.0) -> DataFrame:
    """(start, end, hours) in which no job ran on a machine, longer than ``least_hours``."""
    rows = jobs.where((F.col("StartdName") == machine) & F.col("JobStartDate").isNotNull() & F.col("CompletionDate").isNotNull())
    w = Window.partitionBy("StartdName").orderBy("JobStartDate", "CompletionDate").rowsBetween(Window.unboundedPreceding, -1)
    gaps = rows.select(F.max("CompletionDate").over(w).alias("until"), "JobStartDate")
    hours = (F.col("JobStartDate") - F.col("until")) / 3600
    return gaps.withColumn("hours", hours).where(F.col("hours") > least_hours).select(_time(F.col("until")).alias("start"), _time(F.col("JobStartDate")).alias("end"), "hours")


def gap_summary(gaps: DataFrame, jobs: DataFrame, machine: str) -> DataFrame:
    span = jobs.where(F.col("StartdName") == machine).agg(((F.max("CompletionDate") - F.min("JobStartDate")) / 3600).alias("range_hours"))
    out = gaps.agg(F.count(F.lit(1)).alias("gaps"), F.sum("hours").alias("total"), F.avg("hours").alias("mean"), F.min("hours").alias("least"), F.max("hours").alias("most"))
    return out.join(F.broadcast(span)).withColumn("idle_percent", F.col("total") / F.col("range_hours") * 100)


def machine_months(jobs: DataFrame, machine: str) -> DataFrame:
    """Jobs, run hours and share of 30 days by month."""
    rows = jobs.where(F.col("StartdName") == machine)
    out = rows.groupBy(F.date_format(_time(F.col("JobStartDate")), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("jobs"), (F.sum(F.col("CompletionDate") - F.col("JobStartDate")) / 3600).alias("hours"))
    return out.withColumn("utilization", F.col("hours") / (30 * 24) * 100)


def host_days(jobs: DataFrame, now: int, days: int = 7, host_part: str = "") -> DataFrame:
    """(host, days_back, jobs, wall_hours): records of each of the last days, 0 where none, long again after a pivot."""
    back = F.floor((F.lit(now) - F.col("RecordTime")) / 86400) + 1
    rows = jobs.where((F.col("RecordTime") <= now) & (back <= days) & F.contains(F.lower("StartdName"), F.lit(host_part.lower()))).withColumn("back", back)
    wide = rows.groupBy("StartdName").pivot("back", list(range(1, days + 1))).agg(F.count(F.lit(1)).alias("jobs"), F.sum("RemoteWallClockTime").alias("wall")).fillna(0)
    parts = [wide.select(F.col("StartdName").alias("host"), F.lit(k).cast("bigint").alias("days_back"), F.col(f"{k}_jobs").alias("jobs"), (F.col(f"{k}_wall") / 3600).alias("wall_hours")) for k in range(1, days + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suspicious_jobs(slots: DataFrame, info: DataFrame, patterns: Sequence[str], least_hours: float = 1.0) -> DataFrame:
    """Claimed open-capacity jobs whose command's base name fits a pattern and that run long enough.

    ``info``: GlobalJobId, Cmd, runtime_hours.
    """
    rows = slots.where(F.col("State") == "Claimed").where(~d.is_backfill(F.col("Name")) & d.is_shared(F.col("PrioritizedProjects")))
    name = F.regexp_extract("Cmd", "([^/]*)$", 1)
    fits = F.rlike(name, F.lit("|".join(f"(?:{p})" for p in patterns)))
    flagged = info.where(fits & (F.col("runtime_hours") >= least_hours))
    out = rows.join(flagged, "GlobalJobId").groupBy("GlobalJobId", "Cmd", "RemoteOwner").agg(F.count_distinct("AssignedGPUs").alias("gpus"), F.max("runtime_hours").alias("runtime_hours"))
    return out


def job_columns(jobs: DataFrame, hosts: Sequence[str], projects: Sequence[str]) -> DataFrame:
    """Wait hours, run seconds, and whether both the host and the project are prioritised."""
    return jobs.select("ClusterId", ((F.col("JobStartDate") - F.col("FirstjobmatchDate")) / 3600).alias("waittime"), (F.col("CompletionDate") - F.col("JobCurrentStartDate")).alias("runtime"), (F.col("StartdName").isin(*hosts) & F.col("ProjectName").isin(*projects)).alias("prioritised"))


def node_devices(nodes: DataFrame) -> DataFrame:
    """(node, gpu) of a comma list of detected devices, distinct, without 0."""
    return nodes.select("node", F.explode(F.transform(F.split("detected", ","), lambda g: F.trim(g))).alias("gpu")).where("gpu != '0' and gpu != ''").dropDuplicates()
