"""Job event logs: starts, evictions and which job evicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines after a start that may describe it.
CONTEXT = 24
_TIME = r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)"


def lines(logs: DataFrame) -> DataFrame:
    """(log, no, line) of (log, text)."""
    return logs.select("log", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _found(pattern: str, group: int = 1) -> Column:
    v = F.regexp_extract("line", pattern, group)
    return F.when(v != "", v)


#: Lines that a start, its description or an eviction can be on.
_MARKERS = r"^001 \(|^004 \(|SlotName: |AvailableGPUs = \{|GPUs_GPU_[a-f0-9]+ = \["
_EVICTED = rf"^004 \(\d+\.\d+\.\d+\) {_TIME} Job was evicted"


def marked_lines(logs: DataFrame, pattern: str) -> DataFrame:
    """(log, no, line) of the lines that match ``pattern``; the others are dropped before the array is taken apart."""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("no"), line.alias("line")))
    return logs.select("log", F.explode(F.filter(numbered, lambda x: F.rlike(x["line"], F.lit(pattern)))).alias("x")).select("log", "x.no", "x.line")


def _events(logs: DataFrame) -> DataFrame:
    """(log, no, t, host, slot, gpu, device, evicted, code) of starts (with ``t``) and evictions (with ``evicted``), each time as text.

    Only marker lines become rows. A start's context is a range of line numbers, so it means the same as
    over all lines. One log is one partition key, so a window stays within one file.
    """
    rows = marked_lines(logs, _MARKERS).select(
        "log", "no", _found(rf"^001 \(\d+\.\d+\.\d+\) {_TIME} Job executing on host").alias("t"), _found(r"alias=([^&>]+)").alias("host"), _found(r"SlotName: (\S+)").alias("slot"),
        _found(r"AvailableGPUs = \{ *GPUs_GPU_([a-f0-9]+)").alias("gpu"), _found(r"GPUs_GPU_([a-f0-9]+) = \[").alias("of"), _found(r'DeviceName = "([^"]+)"').alias("device"),
        _found(_EVICTED).alias("evicted"), _found(r"evicted\. Code (\d+)").try_cast("bigint").alias("code"),
    )
    w = Window.partitionBy("log").orderBy("no").rangeBetween(1, CONTEXT)
    near = lambda c: F.coalesce(F.first(c, True).over(w), F.lit("Unknown"))
    named = F.when(F.col("of").isNotNull() & F.col("device").isNotNull(), F.struct("of", "device"))  # nulls are not gathered
    rows = rows.select("log", "no", "t", "host", near("slot").alias("slot"), near("gpu").alias("gpu"), F.collect_list(named).over(w).alias("devices"), "evicted", "code").where("t is not null or evicted is not null")
    device = F.get(F.filter("devices", lambda x: x["of"] == F.col("gpu")), F.lit(0))["device"]
    return rows.select("log", F.col("no").cast("bigint").alias("no"), "t", F.coalesce("host", F.lit("Unknown")).alias("host"), "slot", "gpu", F.coalesce(device, F.lit("Unknown")).alias("device"), "evicted", "code")


def starts(logs: DataFrame) -> DataFrame:
    """(log, no, at, host, slot, gpu, device) of execution starts; details from the ``CONTEXT`` lines that follow."""
    return _events(logs).where("t is not null").select("log", "no", F.col("t").try_cast("timestamp_ntz").alias("at"), "host", "slot", "gpu", "device")


def evictions(logs: DataFrame) -> DataFrame:
    """(log, no, at, code) of evictions."""
    rows = marked_lines(logs, r"^004 \(").select("log", F.col("no").cast("bigint").alias("no"), _found(_EVICTED).try_cast("timestamp_ntz").alias("at"), _found(r"evicted\. Code (\d+)").try_cast("bigint").alias("code"))
    return rows.where("at is not null")


def identity(logs: DataFrame) -> DataFrame:
    """(log, gpus, sleep, capability, cluster, proc) from a five-part or two-part name, else the job number in the text."""
    base = F.regexp_replace(F.regexp_extract("log", "([^/]+)$", 1), r"\.log$", "")
    p, inside = F.split(base, "_"), F.regexp_extract("text", r"\((\d+)\.(\d+)\.\d+\)", 0)
    n = F.size(p)
    part = lambda i: F.get(p, F.lit(i))
    five = lambda i: F.when(n == 5, part(i))
    cluster = F.when(n == 5, part(3)).when(n == 2, part(0)).otherwise(F.regexp_extract(inside, r"\((\d+)\.", 1))
    proc = F.when(n == 5, part(4)).when(n == 2, part(1)).otherwise(F.regexp_extract(inside, r"\(\d+\.(\d+)\.", 1))
    return logs.select("log", five(0).alias("gpus"), five(1).alias("sleep"), five(2).alias("capability"), cluster.try_cast("bigint").alias("cluster"), proc.try_cast("bigint").alias("proc"))


def evicted_runs(logs: DataFrame) -> DataFrame:
    """Each eviction with the latest start up to it in its log, else the first start, and the seconds run.

    Starts and evictions come from one pass over the logs and one shuffle by log: an eviction takes
    the last start before it in order of time (starts without a readable time come first). A log
    without an eviction gives no row, so it is left out before its lines are taken apart.
    """
    rows = _events(logs.where(F.contains("text", F.lit("Job was evicted")))).withColumn("at", F.coalesce(F.col("t"), F.col("evicted")).try_cast("timestamp_ntz")).withColumn("ends", F.col("t").isNull())
    rows = rows.withColumn("run", F.when(~F.col("ends"), F.struct("at", "host", "slot", "gpu", "device")))
    w = Window.partitionBy("log").orderBy("at", "ends", "no")
    last, first = F.last("run", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("run", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    picked = rows.select("log", "no", "at", "code", "ends", F.coalesce(last, first).alias("run")).where("ends and at is not null")
    run = F.col("run")
    seconds = F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(run["at"].cast("timestamp"))
    unknown = lambda k: F.coalesce(run[k], F.lit("Unknown")).alias(k)
    return picked.select("log", F.col("no").alias("eviction"), "at", "code", unknown("host"), unknown("slot"), unknown("gpu"), unknown("device"), seconds.alias("runtime"))


def succeeded(logs: DataFrame) -> DataFrame:
    """Whether a log has a normal termination and at least one start."""
    return logs.select("log", (F.rlike("text", F.lit(r"\n005 \(|^005 \(")) & F.rlike("text", F.lit(r"\(1\) Normal termination")) & F.rlike("text", F.lit(r"(?m)^001 \("))).alias("succeeded"))


def name_parts(names: DataFrame) -> DataFrame:
    """(part, StartdName): every part of each distinct name, case ignored, the empty one as well, so that "the name holds it" is an equality.

    A name of L characters has L * L / 2 parts; host names have 253 at most, and there is one row a machine, not a job.
    """
    names = names.select("StartdName").distinct().where("StartdName is not null")
    low, size = F.lower("StartdName"), F.length("StartdName")
    ends = lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(low, i, n))
    parts = F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(1), size), ends))).otherwise(F.array().cast("array<string>"))
    return names.select("StartdName", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), parts))).alias("part"))


def _queued_near(jobs: DataFrame, cell: int) -> DataFrame:
    """(near, first, before): by cell of ``cell`` seconds its earliest queue time, and the latest of the cell before. A row a cell."""
    ends = jobs.where("QDate is not null").groupBy(F.floor(F.col("QDate") / cell).alias("near")).agg(F.min("QDate").alias("first"), F.max("QDate").alias("last"))
    none = F.lit(None).cast(ends.schema["last"].dataType)
    both = ends.select("near", "first", none.alias("before")).unionByName(ends.select((F.col("near") + 1).alias("near"), none.alias("first"), F.col("last").alias("before")))
    return both.groupBy("near").agg(F.max("first").alias("first"), F.max("before").alias("before"))


def evicting_jobs(runs: DataFrame, jobs: DataFrame, minutes: int = 30) -> DataFrame:
    """For every eviction the job that likely caused it, with confidence and reasons.

    Candidates are jobs queued in the ``minutes`` before an eviction, on a machine whose name holds the
    eviction's host or its part before the first dot. Of those, each narrower rule is used only where
    it leaves any: host before base name, slot, device; then the nearest in time wins.

    No eviction meets its candidates one by one. An eviction is a row for each machine (an equi-join by
    part of a name) and each slot there that holds its slot; of each rule the nearest job is then the
    last one before it of that machine, slot and device, in one order by time. Evictions and jobs are
    dealt by machine and cell of time, once, and a job that reaches into the next cell is in both. Work
    is linear in both sides, but for the slots of a machine that queue jobs in a cell, which each row
    of it carries for a while.
    """
    cell, span = minutes * 60, 8 * minutes * 60
    t, number = F.unix_timestamp(F.col("at").cast("timestamp")), lambda c: F.floor(c / span)
    ev = runs.withColumn("t", t).withColumn("near", F.floor(F.col("t") / cell)).join(F.broadcast(_queued_near(jobs, cell)), "near", "left")
    queued = F.coalesce(F.col("first") <= F.col("t"), F.lit(False)) | F.coalesce(F.col("before") >= F.col("t") - cell, F.lit(False))
    ev = ev.select(*runs.columns, "t", queued.alias("queued"), F.lower(F.substring_index("host", ".", 1)).alias("part")).join(name_parts(jobs), "part", "left")
    full = F.coalesce(F.contains(F.lower("StartdName"), F.lower("host")), F.lit(False))
    point = F.struct(*runs.columns, "queued", full.alias("full"))
    asked = ev.select("StartdName", number(F.col("t")).alias("cell"), "t", "gpu", point.alias("point"))
    job = F.struct("ClusterId", "ProcId", "StartdSlot", F.col("User").alias("job_user"), F.col("ProjectName").alias("job_project"), "QDate")
    cells = F.array_distinct(F.array(number(F.col("QDate")), number(F.col("QDate") + cell)))
    known = jobs.where("QDate is not null and StartdName is not null").select("StartdName", F.explode(cells).alias("cell"), F.col("QDate").alias("t"), F.regexp_extract("AssignedGPUs", "GPU-([a-f0-9]+)", 1).alias("gpu"), job.alias("job"))
    both = asked.unionByName(known, allowMissingColumns=True)
    # Up to a time jobs come before evictions; of jobs of one time the least comes last.
    order = ["t", F.col("point").isNotNull(), F.desc("job")]
    nearest = lambda *keys: F.last("job", True).over(Window.partitionBy("StartdName", "cell", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    slots = F.collect_set("job.StartdSlot").over(Window.partitionBy("StartdName", "cell"))
    part, known_gpu, known_slot = F.lower(F.substring_index("point.slot", "@", 1)), F.coalesce(F.col("point.gpu") != "Unknown", F.lit(False)), F.coalesce(F.col("point.slot") != "Unknown", F.lit(False))
    held = F.when(F.col("point").isNull(), F.array("job.StartdSlot")).when(known_slot, F.filter("slots", lambda x: F.contains(F.lower(x), part)))
    both = both.withColumn("any", nearest()).withColumn("slots", slots).withColumn("slots", held).withColumn("of_gpu", nearest("gpu"))
    both = both.select("*", F.explode_outer("slots").alias("on")).drop("slots").withColumn("of_slot", nearest("on")).withColumn("of_both", nearest("on", "gpu"))
    placed = both.where("point is not null")
    on_slot = F.col("on").isNotNull()

    def ranked(name: str, rule: Column, no_slot: bool, no_gpu: bool) -> Column:
        diff, at = F.col("t") - F.col(f"{name}.QDate"), lambda k: F.col(f"{name}.{k}").alias(k)
        rank = F.struct((~F.col("point.full")).alias("other"), F.lit(no_slot).alias("no_slot"), F.lit(no_gpu).alias("no_gpu"), diff.alias("diff"), at("ClusterId"), at("ProcId"), at("StartdSlot"), at("job_user"), at("job_project"))
        return F.when(rule & (diff <= cell), rank)

    best = F.coalesce(ranked("of_both", on_slot & known_gpu, False, False), ranked("of_slot", on_slot, False, True), ranked("of_gpu", known_gpu, True, False), ranked("any", F.lit(True), True, True))
    best = placed.select("point.*", best.alias("best")).groupBy(*runs.columns, "queued").agg(F.min("best").alias("best"))
    known_gpu, known_slot, slot = F.col("gpu") != "Unknown", F.col("slot") != "Unknown", F.substring_index("slot", "@", 1)
    found, gap, exact = F.col("best").isNotNull(), F.col("best.diff"), ~F.col("best.no_gpu")
    level = F.when(gap > 15 * 60, "low").when(known_gpu & exact, "high").when(known_gpu, "medium").otherwise("low")
    same_slot = known_slot & F.contains(F.coalesce("best.StartdSlot", F.lit("")), slot)
    reason = F.array_join(F.array_compact(F.array(F.when(known_gpu & exact, "exact_gpu_match").when(known_gpu, "host_time_match").otherwise("host_time_only"), F.when(same_slot, "slot_match"), F.when(gap <= 5 * 60, "close_time_match"))), ",")
    none = F.when(F.col("queued"), "no_match").otherwise("no_candidates")
    job = F.when(found, F.concat_ws(".", "best.ClusterId", "best.ProcId"))
    return best.select(*runs.columns, job.alias("evicting_job"), "best.job_user", "best.job_project", F.when(found, level).otherwise(none).alias("confidence"), F.when(found, reason).otherwise("").alias("reason"), (gap / 60).alias("minutes"))


def eviction_summary(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Per job: evictions, devices (Unknown only if alone) and configuration, most evictions first."""
    devices = F.array_sort(F.collect_set("device"))
    known = F.filter(devices, lambda x: x != "Unknown")
    out = runs.groupBy("log").agg(F.count(F.lit(1)).alias("evictions"), F.array_join(F.when(F.size(known) > 0, known).otherwise(devices), ", ").alias("devices"))
    return out.join(names, "log").orderBy(F.desc("evictions"), "cluster", "proc")


def mean_evictions(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Mean evictions and jobs by configuration; jobs without evictions count as 0."""
    counts = runs.groupBy("log").agg(F.count(F.lit(1)).alias("n"))
    return names.where("gpus is not null").join(counts, "log", "left").groupBy("gpus", "sleep", "capability").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_evictions"), F.count(F.lit(1)).alias("jobs"))


def confidence_counts(matches: DataFrame, host_part: str = "") -> DataFrame:
    """Matches by confidence, of hosts that hold ``host_part``, and how many of all were kept; in one pass over the matches."""
    kept = F.contains(F.lower("host"), F.lit(host_part.lower())) if host_part else F.lit(True)
    counts = matches.groupBy("confidence").agg(F.count_if(kept).alias("n"), F.count(F.lit(1)).alias("all"))
    total = F.sum("all").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row a confidence
    return counts.select("confidence", "n", total.alias("total")).where("n > 0")
