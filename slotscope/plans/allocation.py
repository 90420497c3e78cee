"""Queries over slot snapshots: sources, derivations, dedup, classes, allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import allocation as a
from slotscope.operators import classify as c
from slotscope.plans import fixtures as x
from slotscope.sources import snapshots


def frames(spark: SparkSession, sf_dir: str) -> c.Frames:
    return c.prepare(x.slots(spark, sf_dir), x.OWNED, x.EXCLUDED)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and dates as text, so that both engines agree."""
    as_told = {"double": lambda c: F.round(c, digits), "date": lambda c: c.cast("string")}
    return df.select(*[as_told.get(t, lambda c: c)(F.col(n)).alias(n) for n, t in df.dtypes])


def row_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev, name, mb = F.col("GPUs_DeviceName"), F.col("Name"), F.col("GPUs_GlobalMemoryMb")
    rows = c.with_flags(x.slots(spark, sf_dir), x.OWNED, x.EXCLUDED)
    return rows.select(
        "timestamp", "Name", "bucket", d.truncated(F.col("timestamp"), "week").alias("week"), "is_bf", "is_inter", d.is_partitionable(name).alias("partitionable"), "prio", "shared", "owned", "excluded",
        "pj_set", "prev_idle", d.is_old_device(dev).alias("old"), d.display_name(dev).alias("display"), d.memory_gb(dev).cast("bigint").alias("gb"), d.memory_category(dev).alias("by_name"), d.memory_category_mb(mb).alias("by_mb"),
        d.performance_tier(dev).alias("tier"), d.gpu_identity(F.col("Machine"), F.col("AssignedGPUs")).alias("identity"), d.user_name(F.col("RemoteOwner")).alias("user"),
        d.state_code(F.col("State"), F.col("is_bf"), F.col("prio")).cast("bigint").alias("code"), d.state_label(F.col("State"), name, F.col("PrioritizedProjects")).alias("label_a"),
        d.state_label(F.col("State"), name, F.col("PrioritizedProjects"), "vectorised").alias("label_b"), d.slot_type(name, F.col("PrioritizedProjects"), F.col("owned")).alias("slot_type"),
        d.slot_category(d.slot_type(name, F.col("PrioritizedProjects"), F.col("owned"))).alias("category"),
    ).groupBy(*"bucket week is_bf is_inter partitionable prio shared owned excluded pj_set prev_idle old display gb by_name by_mb tier identity user code label_a label_b slot_type category".split()).agg(F.count(F.lit(1)).alias("n"))


_ROWS_SQL = f"""WITH {x.RAW_SQL},
r AS (SELECT bucket, date_trunc('week', timestamp)::TIMESTAMP AS week, is_bf, is_inter, regexp_matches(Name, '^slot\\d+@') AS partitionable, prio, shared, owned, excluded, pj_set, prev_idle,
  coalesce(regexp_matches(GPUs_DeviceName, 'GTX 1080|P100|Quadro|A30|A40'), false) AS old,
  CASE GPUs_DeviceName WHEN 'NVIDIA H200' THEN 'H200' WHEN 'NVIDIA A100-SXM4-80GB' THEN 'A100 80GB' WHEN 'NVIDIA L40S' THEN 'L40S' WHEN 'NVIDIA A40' THEN 'A40' ELSE 'Tesla P100 16GB' END AS display,
  CAST(CASE GPUs_DeviceName WHEN 'NVIDIA H200' THEN 141 WHEN 'NVIDIA A100-SXM4-80GB' THEN 80 WHEN 'NVIDIA L40S' THEN 48 WHEN 'NVIDIA A40' THEN 48 ELSE 16 END AS BIGINT) AS gb,
  CASE GPUs_DeviceName WHEN 'NVIDIA H200' THEN '140GB+' WHEN 'NVIDIA A100-SXM4-80GB' THEN '80GB' WHEN 'NVIDIA L40S' THEN '48GB' WHEN 'NVIDIA A40' THEN '48GB' ELSE '16GB' END AS by_name,
  CASE WHEN GPUs_GlobalMemoryMb IS NULL THEN 'Unknown' WHEN GPUs_GlobalMemoryMb = 143771 THEN '>80GB' WHEN GPUs_GlobalMemoryMb = 81920 THEN '80GB' WHEN GPUs_GlobalMemoryMb = 46068 THEN '48GB' ELSE '<48GB' END AS by_mb,
  CASE WHEN GPUs_DeviceName IN ('NVIDIA H200', 'NVIDIA A100-SXM4-80GB') THEN 'Flagship' ELSE 'Standard' END AS tier,
  concat_ws('_', Machine, AssignedGPUs) AS identity, split_part(RemoteOwner, '@', 1) AS user,
  CAST(CASE WHEN State = 'Claimed' AND is_bf THEN 4 WHEN State = 'Claimed' AND prio THEN 2 WHEN State = 'Claimed' THEN 3 WHEN State = 'Unclaimed' AND is_bf THEN 6 WHEN State = 'Unclaimed' AND prio THEN 0 WHEN State = 'Unclaimed' THEN 1 ELSE 5 END AS BIGINT) AS code,
  CASE WHEN State = 'Claimed' AND is_bf THEN 'busy_backfill' WHEN State = 'Claimed' AND prio THEN 'busy_prioritized' WHEN State = 'Claimed' THEN 'busy_shared' WHEN State = 'Unclaimed' AND NOT is_bf AND prio THEN 'idle_prioritized' WHEN State = 'Unclaimed' THEN 'idle_shared' ELSE 'na' END AS label_a,
  CASE WHEN State = 'Claimed' AND is_bf THEN 'busy_backfill' WHEN State = 'Claimed' AND coalesce(PrioritizedProjects != '', false) THEN 'busy_prioritized' WHEN State = 'Claimed' THEN 'busy_shared' WHEN State = 'Unclaimed' AND coalesce(PrioritizedProjects != '', false) THEN 'idle_prioritized' WHEN State = 'Unclaimed' THEN 'idle_shared' ELSE 'na' END AS label_b,
  CASE WHEN is_bf AND coalesce(PrioritizedProjects != '', false) AND NOT owned THEN 'Backfill-ResearcherOwned' WHEN is_bf AND owned THEN 'Backfill-PoolOwned' WHEN is_bf AND NOT owned THEN 'Backfill-OpenCapacity'
    WHEN coalesce(PrioritizedProjects != '', false) AND NOT owned THEN 'Priority-ResearcherOwned' WHEN coalesce(PrioritizedProjects != '', false) THEN 'Priority-PoolOwned' WHEN PrioritizedProjects = '' THEN 'Shared' ELSE 'Other' END AS slot_type FROM raw),
q AS (SELECT *, CASE WHEN slot_type LIKE 'Priority%' THEN 'prioritized' WHEN slot_type = 'Shared' THEN 'open_capacity' WHEN slot_type LIKE 'Backfill%' THEN 'backfill' END AS category FROM r)
SELECT *, count(*) AS n FROM q GROUP BY ALL"""

_STATS = "SELECT {by}, bucket, count(*) AS total, count(*) FILTER (c) AS claimed, count(*) FILTER (d AND NOT c) AS drained FROM (SELECT {by}, bucket, AssignedGPUs, bool_or(coalesce(State = 'Claimed', false)) AS c, bool_or(coalesce(State = 'Drained', false)) AS d FROM {rows} WHERE AssignedGPUs IS NOT NULL GROUP BY {by}, bucket, AssignedGPUs) GROUP BY {by}, bucket"
_W = "(SELECT count(DISTINCT bucket) FROM raw)"


def _averages_sql(n: str) -> str:
    return f"round(sum(claimed) / {n}, 6) AS avg_claimed, round(sum(drained) / {n}, 6) AS avg_drained, round(sum(total) / {n}, 6) AS avg_total_available, round(avg(claimed::DOUBLE / total * 100), 6) AS allocation_usage_percent, round(avg(drained::DOUBLE / total * 100), 6) AS drained_percent"


def filters_sql() -> str:
    """CTE ``f``: (class, state, rows) of the state-aware filters, after classes_sql()."""
    cols = "bucket, AssignedGPUs, State, GPUs_DeviceName, prio, Machine"
    parts = []
    real = {"Priority": "prio", "Shared": "shared", "Priority-ResearcherOwned": "prio AND NOT owned", "Priority-PoolOwned": "prio AND owned"}
    for k, member in real.items():
        primary = "NOT is_bf AND NOT is_inter" if k == "Shared" else "NOT is_bf"
        for s, keep in (("Claimed", f"State = 'Claimed' AND {primary}"), ("Unclaimed", f"((State = 'Unclaimed' AND {primary}) OR (State = 'Claimed' AND is_bf))"), ("", primary)):
            parts.append(f"SELECT '{k}' AS class, '{s}' AS s, {cols} FROM dedup WHERE {member} AND {keep}")
    back = {"Backfill": "true", "Backfill-PoolOwned": "owned", "Backfill-ResearcherOwned": "Machine IN (SELECT Machine FROM scope)", "Backfill-OpenCapacity": "NOT owned AND Machine NOT IN (SELECT Machine FROM scope)"}
    for k, member in back.items():
        for s in ("Claimed", "Unclaimed", ""):
            parts.append(f"SELECT '{k}' AS class, '{s}' AS s, {cols} FROM raw_bf WHERE {member}" + (f" AND State = '{s}'" if s else ""))
    return "f AS (" + "\n UNION ALL ".join(parts) + ")"


def counts_sql(classes: tuple[str, ...], by: str = "", where: str = "true") -> str:
    """CTEs up to ``k``: (class, bucket[, by], claimed, unclaimed)."""
    names = ", ".join(f"'{k}'" for k in classes)
    g = f", {by}" if by else ""
    return f"""WITH {x.classes_sql()}, {filters_sql()},
k AS (SELECT class, bucket{g}, count(*) FILTER (s = 'Claimed') AS claimed, count(*) FILTER (s = 'Unclaimed') AS unclaimed FROM (SELECT DISTINCT class, s, bucket{g}, AssignedGPUs FROM f WHERE class IN ({names}) AND s != '' AND AssignedGPUs IS NOT NULL AND {where}) GROUP BY class, bucket{g})"""


def _allocation_sql(classes: tuple[str, ...]) -> str:
    return counts_sql(classes) + f" SELECT class, round(sum(claimed) / {_W}, 6) AS avg_claimed, round(sum(claimed + unclaimed) / {_W}, 6) AS avg_total_available, round(avg(claimed::DOUBLE / (claimed + unclaimed) * 100), 6) AS allocation_usage_percent FROM k WHERE claimed + unclaimed > 0 GROUP BY class"


FIVE = ("Priority-ResearcherOwned", "Priority-PoolOwned", "Shared", "Backfill-ResearcherOwned", "Backfill-PoolOwned")

_SERIES_SQL = counts_sql(a.THREE_CLASSES) + " SELECT bucket, " + ", ".join(
    f"coalesce(max(CASE WHEN class = '{k}' THEN claimed END), 0) AS {k.lower()}_claimed, coalesce(max(CASE WHEN class = '{k}' THEN claimed + unclaimed END), 0) AS {k.lower()}_total, "
    f"round(coalesce(max(CASE WHEN class = '{k}' AND claimed + unclaimed > 0 THEN claimed::DOUBLE / (claimed + unclaimed) * 100 END), 0), 6) AS {k.lower()}_usage_percent"
    for k in a.THREE_CLASSES
) + " FROM (SELECT DISTINCT bucket FROM raw) LEFT JOIN k USING (bucket) GROUP BY bucket"

_USERS = "SELECT class, CASE WHEN RemoteOwner = '' THEN 'Unknown' ELSE RemoteOwner END AS user, count(*) AS total FROM (SELECT DISTINCT class, bucket, RemoteOwner, AssignedGPUs FROM cls WHERE State = 'Claimed' AND RemoteOwner IS NOT NULL AND AssignedGPUs IS NOT NULL AND {where}) GROUP BY ALL"
_BREAKDOWN = "SELECT user, class, round(h, 6) AS gpu_hours, round(h / sum(h) OVER (PARTITION BY user) * 100, 6) AS percentage, round(sum(h) OVER (PARTITION BY user), 6) AS total_gpu_hours FROM (SELECT user, class, total / (SELECT count(DISTINCT bucket) FROM raw WHERE {denominator}) * 24.0 AS h FROM u)"
_OLD = "regexp_matches(lower(coalesce(GPUs_DeviceName, '')), 'gtx 1080|p100|quadro|a30|a40')"


def _d(*names: str) -> str:
    return ", ".join(names)


def _state_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    rows = c.state_rows(fr, c.STATE_AWARE, ("Claimed", "Unclaimed", ""), ("AssignedGPUs", "State"))
    gpus = rows.groupBy("class", "s", "State", "AssignedGPUs").agg(F.count(F.lit(1)).alias("n"))
    return gpus.groupBy("class", "s", "State").agg(F.sum("n").alias("rows"), F.count("AssignedGPUs").alias("gpus"))


def _simple(policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = c.simple_dedup(x.slots(spark, sf_dir).drop("AvailableGPUs", "Disk"), policy, drop_empty=True)
        return rows.groupBy("State", d.is_backfill(F.col("Name")).alias("backfill"), "rank").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("AssignedGPUs").alias("gpus"), F.count_distinct("Name").alias("names")).withColumn("rank", F.col("rank").cast("bigint"))

    return run


_RANKS = {
    "claimed_first": "CASE WHEN State = 'Claimed' AND NOT is_bf THEN 3 WHEN State = 'Claimed' THEN 2 WHEN NOT is_bf THEN 1 ELSE 0 END",
    "unclaimed_primary": "CASE WHEN State = 'Claimed' AND NOT is_bf THEN 3 WHEN State = 'Claimed' THEN 2 WHEN NOT is_bf AND State = 'Unclaimed' THEN 1 ELSE 0 END",
    "three_tier": "CASE WHEN State = 'Claimed' AND NOT is_bf THEN 3 WHEN State = 'Unclaimed' AND NOT is_bf THEN 2 WHEN State = 'Claimed' AND is_bf THEN 1 ELSE 0 END",
}


def simple_sql(policy: str) -> str:
    """CTE ``s``: winners of a plainer rank per (timestamp, device)."""
    return f"s AS (SELECT * FROM (SELECT *, {_RANKS[policy]} AS rank, row_number() OVER (PARTITION BY timestamp, AssignedGPUs ORDER BY {_RANKS[policy]} DESC, {x.TIES_SQL}) AS rn FROM raw WHERE AssignedGPUs IS NOT NULL AND AssignedGPUs != '') WHERE rn = 1)"


def _simple_sql(policy: str) -> str:
    return f"WITH {x.RAW_SQL}, {simple_sql(policy)} SELECT State, is_bf AS backfill, CAST(rank AS BIGINT) AS rank, count(*) AS n, count(DISTINCT AssignedGPUs) AS gpus, count(DISTINCT Name) AS names FROM s GROUP BY ALL"


#: Compute capability by model; unknown models have none.
_CAPABILITY = "CASE GPUs_DeviceName WHEN 'NVIDIA H200' THEN 9.0 WHEN 'NVIDIA A100-SXM4-80GB' THEN 8.0 WHEN 'NVIDIA L40S' THEN 8.9 WHEN 'NVIDIA A40' THEN 8.6 END"
_DEDUP_COLS = ("timestamp", "AssignedGPUs", "Name", "State", "Machine", "RemoteOwner", "GlobalJobId", "rank")

QUERIES = {
    "s1_window_scan": lambda s, p: snapshots.window(x.slots(s, p), hours_back=48).select("timestamp", "Machine", "Name", "State", "AssignedGPUs"),
    "s2_latest_time": lambda s, p: snapshots.latest(x.slots(s, p)),
    "r1_r18_row_derivations": row_derivations,
    "r5_excluded_rows": lambda s, p: x.slots(s, p).select(d.is_excluded(F.col("Machine"), ("HOST13", "ost2")).alias("excluded")).groupBy("excluded").agg(F.count(F.lit(1)).alias("n")),
    "r12_class_labels": lambda s, p: c.class_rows(frames(s, p)).groupBy("class", d.class_label(F.col("class")).alias("label")).agg(F.count(F.lit(1)).alias("rows")),
    "r13_host_filters": lambda s, p: x.slots(s, p).where(d.host_matches(F.col("Machine"), "HOST3, ost21")).groupBy("Machine").agg(F.count(F.lit(1)).alias("n")),
    "r14_device_filter": lambda s, p: snapshots.filter_devices(x.slots(s, p), gpu_ids=["GPU-1", "7"], host_pattern="^host[12]", device_pattern="H200|L40S").groupBy("Machine", "AssignedGPUs").agg(F.count(F.lit(1)).alias("n")),
    "d2_dedup_winners": lambda s, p: frames(s, p).dedup.withColumn("rank", F.col("rank").cast("bigint")).select(*_DEDUP_COLS),
    "d3_bucket_winners": lambda s, p: c.bucket_winners(frames(s, p).dedup).withColumn("rank", F.col("rank").cast("bigint")).select("bucket", "AssignedGPUs", "Name", "State", "RemoteOwner", "rank"),
    "d4_claimed_first": _simple("claimed_first"),
    "d4_unclaimed_primary": _simple("unclaimed_primary"),
    "d4_three_tier": _simple("three_tier"),
    "d5_researcher_scope": lambda s, p: c.researcher_scope(frames(s, p).raw, ("Machine", "GPUs_DeviceName")),
    "d6_class_membership": lambda s, p: c.class_rows(frames(s, p)).groupBy("class", "State").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("AssignedGPUs").alias("gpus"), F.count_distinct("Machine").alias("machines")),
    "d7_open_backfill": lambda s, p: c.open_backfill(frames(s, p)).groupBy("Machine", "State").agg(F.count(F.lit(1)).alias("rows")),
    "d8_d9_state_filters": _state_filter_audit,
    "d10_window_metadata": lambda s, p: c.metadata(frames(s, p).raw),
    "a1_pair_bucket_stats": lambda s, p: rounded(a.pair_bucket_stats(c.class_rows(frames(s, p)), ("class", "Machine"))),
    "a2_allocation_by_device": lambda s, p: rounded(a.by_device(frames(s, p))),
    "a2_allocation_new_devices": lambda s, p: rounded(a.by_device(frames(s, p), include_all=False)),
    "a3_allocation_by_memory": lambda s, p: rounded(a.by_memory(frames(s, p))),
    "a4_user_totals": lambda s, p: a.user_totals(c.class_rows(frames(s, p)), ("class",)),
    "a5_device_users": lambda s, p: rounded(a.device_users(frames(s, p), hours_back=24)),
    "a6_backfill_users": lambda s, p: rounded(a.backfill_users(frames(s, p), hours_back=24)),
    "a7_idle_machines": lambda s, p: rounded(a.idle_machines(frames(s, p))),
    "a7_idle_totals": lambda s, p: a.idle_totals(a.idle_machines(frames(s, p))),
    "a8_prevented_hosts": lambda s, p: a.prevented_hosts(frames(s, p).raw),
    "a8_prevented_totals": lambda s, p: a.prevented_totals(frames(s, p).raw),
    "a9_prevented_reasons": lambda s, p: a.prevented_reasons(frames(s, p).raw),
    "a10_prevented_average": lambda s, p: rounded(a.prevented_average(frames(s, p))),
    "a11_allocation_three": lambda s, p: rounded(a.allocation(frames(s, p))),
    "a12_allocation_five": lambda s, p: rounded(a.allocation(frames(s, p), FIVE)),
    "a13_usage_series": lambda s, p: rounded(a.usage_series(frames(s, p))),
    "a14_by_device_three": lambda s, p: rounded(a.by_device_three(frames(s, p))),
    "a15_backfill_by_day": lambda s, p: rounded(a.backfill_by_day(frames(s, p))),
    "a15_backfill_totals": lambda s, p: rounded(a.backfill_totals(a.backfill_by_day(frames(s, p)))),
    "a15_backfill_totals_summary": lambda s, p: rounded(a.backfill_day_summary(a.backfill_totals(a.backfill_by_day(frames(s, p))))),
    "a15_backfill_day_summary": lambda s, p: rounded(a.backfill_day_summary(a.backfill_by_day(frames(s, p)))),
    "a16_monthly_summary": lambda s, p: rounded(a.monthly_summary(x.slots(s, p).withColumn("timestamp", F.expr("timestamp + interval 28 days")), x.OWNED, x.EXCLUDED)),
    "a17_category_audit": lambda s, p: a.category_audit(frames(s, p)),
    "a17_category_totals": lambda s, p: a.category_totals(frames(s, p)),
    "a17_category_slots": lambda s, p: a.category_slots(frames(s, p)).groupBy("class", "as_state", "Machine", "State", "PrioritizedProjects").agg(F.count(F.lit(1)).alias("rows"), F.min("Name").alias("first_slot")),
    "a18_count_anomalies": lambda s, p: a.count_anomalies(frames(s, p), "NVIDIA H200", 3),
    "a19_device_counts": lambda s, p: a.device_counts(frames(s, p), "Priority", "Unclaimed"),
    "a19_capability_histogram": lambda s, p: rounded(a.value_histogram(x.slots(s, p).select(F.expr(_CAPABILITY).alias("capability")), "capability")),
    "a20_binned_usage": lambda s, p: a.binned_usage(frames(s, p), "Priority", "GPUs_DeviceName"),
}

_CLS = f"WITH {x.classes_sql()}"
_MEM = "CASE WHEN GPUs_GlobalMemoryMb IS NULL THEN 'Unknown' WHEN GPUs_GlobalMemoryMb / 1024 < 44 THEN '<48GB' WHEN GPUs_GlobalMemoryMb / 1024 BETWEEN 44 AND 50 THEN '48GB' WHEN GPUs_GlobalMemoryMb / 1024 BETWEEN 75 AND 85 THEN '80GB' WHEN GPUs_GlobalMemoryMb / 1024 > 80 THEN '>80GB' ELSE '<48GB' END"
_DAY = f"""{_CLS}, {filters_sql()}, g AS (SELECT class, bucket, AssignedGPUs, bool_or(State = 'Claimed') AS c FROM f WHERE class IN ('Backfill-ResearcherOwned', 'Backfill-PoolOwned', 'Backfill-OpenCapacity') AND s = '' AND AssignedGPUs IS NOT NULL GROUP BY ALL),
p AS (SELECT class, bucket, count(*) AS t, count(*) FILTER (c) AS c FROM g GROUP BY ALL),
day AS (SELECT class, date_trunc('day', bucket)::TIMESTAMP AS day, avg(c) AS avg_claimed, avg(t) AS avg_total, avg(c) / avg(t) * 100 AS utilization_percent FROM p GROUP BY 1, 2)"""
_LAST_MONTH = "timestamp BETWEEN (SELECT date_trunc('month', max(timestamp + INTERVAL 28 DAY)) - INTERVAL 1 MONTH FROM slots0) AND (SELECT date_trunc('month', max(timestamp + INTERVAL 28 DAY)) FROM slots0)"


def _shifted(sql: str) -> str:
    """The query over snapshots 28 days later, of the month before the last."""
    sql = sql.replace("slots AS (SELECT Name", "slots AS (SELECT * FROM (SELECT Name", 1)
    return sql.replace("PreventJobsReason, timestamp FROM slots0)", f"PreventJobsReason, timestamp + INTERVAL 28 DAY AS timestamp FROM slots0) WHERE {_LAST_MONTH})", 1)


_NEW_ONLY = "NOT regexp_matches(coalesce(GPUs_DeviceName, ''), 'GTX 1080|P100|Quadro|A30|A40')"
_MONTH_DEVICES = _shifted(f"WITH {x.classes_sql('Machine, GPUs_DeviceName')}, b AS ({_STATS.format(by='class, GPUs_DeviceName', rows='cls')}) SELECT class, GPUs_DeviceName AS device, {_averages_sql(_W)} FROM b WHERE {_NEW_ONLY} GROUP BY class, GPUs_DeviceName")
_MONTH_MEMORY = _shifted(f"WITH {x.DEDUP_SQL}, m AS (SELECT *, {_MEM} AS memory_category FROM dedup WHERE NOT is_bf AND (prio OR (shared AND NOT is_inter)) AND {_NEW_ONLY}), b AS ({_STATS.format(by='memory_category', rows='m')}) SELECT memory_category, {_averages_sql('count(*)')} FROM b GROUP BY memory_category")
_MONTH_USERS = _shifted(f"""WITH {x.classes_sql('Machine', "GPUs_DeviceName = 'NVIDIA H200'")}, u AS ({_USERS.format(where="GPUs_DeviceName = 'NVIDIA H200'")}) {_BREAKDOWN.format(denominator="GPUs_DeviceName = 'NVIDIA H200'").replace("24.0", "744.0")}""")
_MONTH_COVERAGE = _shifted(f"""WITH {x.RAW_SQL} SELECT strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS k1, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS k2, count(*) AS total, count(DISTINCT bucket) AS buckets FROM raw""")
_SHARES = "avg_claimed AS v1, avg_drained AS v2, avg_total_available AS v3, allocation_usage_percent AS v4, drained_percent AS v5"
_NO_MORE = "CAST(NULL AS DOUBLE) AS v4, CAST(NULL AS DOUBLE) AS v5"
_MONTH_REPORT = f"""SELECT 'device' AS section, class AS k1, device AS k2, {_SHARES} FROM ({_MONTH_DEVICES})
UNION ALL SELECT 'memory', memory_category, NULL, {_SHARES} FROM ({_MONTH_MEMORY})
UNION ALL SELECT 'user', user, class, gpu_hours, percentage, total_gpu_hours, {_NO_MORE} FROM ({_MONTH_USERS})
UNION ALL SELECT 'coverage', k1, k2, CAST(total AS DOUBLE), CAST(buckets AS DOUBLE), CAST(NULL AS DOUBLE), {_NO_MORE} FROM ({_MONTH_COVERAGE})"""

ORACLE_SQL = {
    "s1_window_scan": f"WITH {x.SLOTS_SQL} SELECT timestamp, Machine, Name, State, AssignedGPUs FROM slots WHERE timestamp BETWEEN (SELECT max(timestamp) FROM slots) - INTERVAL 48 HOUR AND (SELECT max(timestamp) FROM slots)",
    "s2_latest_time": f"WITH {x.SLOTS_SQL} SELECT max(timestamp) AS latest FROM slots",
    "r1_r18_row_derivations": _ROWS_SQL,
    "r5_excluded_rows": f"WITH {x.SLOTS_SQL} SELECT contains(lower(Machine), 'host13') OR contains(lower(Machine), 'ost2') AS excluded, count(*) AS n FROM slots GROUP BY 1",
    "r12_class_labels": f"""{_CLS} SELECT class, count(*) AS rows, CASE class WHEN 'Priority' THEN 'Prioritized service' WHEN 'Shared' THEN 'Open Capacity' WHEN 'Backfill' THEN 'Secondary (Backfill)'
        WHEN 'Priority-ResearcherOwned' THEN 'Researcher-Owned Hardware' WHEN 'Backfill-ResearcherOwned' THEN 'Researcher-Owned Hardware'
        WHEN 'Priority-PoolOwned' THEN 'Researcher-Reserved Capacity' WHEN 'Backfill-PoolOwned' THEN 'Researcher-Reserved Capacity'
        WHEN 'Backfill-OpenCapacity' THEN 'Secondary (Backfill) - Open Capacity' ELSE class END AS label FROM cls GROUP BY class""",
    "r13_host_filters": f"WITH {x.SLOTS_SQL} SELECT Machine, count(*) AS n FROM slots WHERE contains(lower(Machine), 'host3') OR contains(lower(Machine), 'ost21') GROUP BY 1",
    "r14_device_filter": f"WITH {x.SLOTS_SQL} SELECT Machine, AssignedGPUs, count(*) AS n FROM slots WHERE (contains(AssignedGPUs, 'GPU-1') OR contains(AssignedGPUs, '7')) AND regexp_matches(Machine, '^host[12]') AND regexp_matches(GPUs_DeviceName, 'H200|L40S') GROUP BY ALL",
    "d2_dedup_winners": f"WITH {x.DEDUP_SQL} SELECT timestamp, AssignedGPUs, Name, State, Machine, RemoteOwner, GlobalJobId, CAST(rank AS BIGINT) AS rank FROM dedup",
    "d3_bucket_winners": f"WITH {x.DEDUP_SQL} SELECT bucket, AssignedGPUs, Name, State, RemoteOwner, CAST(r AS BIGINT) AS rank FROM (SELECT * EXCLUDE (rank), {x.RANK_SQL.format(prev="(pj_set AND State != 'Claimed')")} AS r, row_number() OVER (PARTITION BY bucket, AssignedGPUs ORDER BY {x.RANK_SQL.format(prev="(pj_set AND State != 'Claimed')")} DESC, {x.TIES_SQL}) AS rn FROM dedup) WHERE rn = 1",
    **{f"d4_{k}": _simple_sql(k) for k in _RANKS},
    "d5_researcher_scope": f"WITH {x.RAW_SQL} {x.scope_sql('Machine, GPUs_DeviceName')}",
    "d6_class_membership": f"{_CLS} SELECT class, State, count(*) AS rows, count(DISTINCT AssignedGPUs) AS gpus, count(DISTINCT Machine) AS machines FROM cls GROUP BY ALL",
    "d7_open_backfill": f"WITH {x.DEDUP_SQL} SELECT Machine, State, count(*) AS rows FROM raw_bf WHERE NOT owned AND Machine NOT IN ({x.scope_sql()}) GROUP BY ALL",
    "d8_d9_state_filters": f"{_CLS}, {filters_sql()} SELECT class, s, State, count(*) AS rows, count(DISTINCT AssignedGPUs) AS gpus FROM f GROUP BY ALL",
    "d10_window_metadata": f'WITH {x.RAW_SQL} SELECT count(*) AS total, min(timestamp) AS "start", max(timestamp) AS "end", count(DISTINCT bucket) AS buckets, count(*) FILTER (excluded) AS excluded_rows FROM raw',
    "a1_pair_bucket_stats": f"{_CLS}, b AS ({_STATS.format(by='class, Machine', rows='cls')}) SELECT class, Machine, round(avg(claimed::DOUBLE / total * 100), 6) AS pct_claimed, round(avg(drained::DOUBLE / total * 100), 6) AS pct_drained, CAST(sum(claimed) AS BIGINT) AS claimed_sum, CAST(sum(drained) AS BIGINT) AS drained_sum, CAST(sum(total) AS BIGINT) AS total_sum, count(*) AS num_buckets FROM b GROUP BY ALL",
    "a2_allocation_by_device": f"WITH {x.classes_sql('Machine, GPUs_DeviceName')}, b AS ({_STATS.format(by='class, GPUs_DeviceName', rows='cls')}) SELECT class, GPUs_DeviceName AS device, {_averages_sql(_W)} FROM b WHERE GPUs_DeviceName IS NOT NULL GROUP BY class, GPUs_DeviceName",
    "a2_allocation_new_devices": f"WITH {x.classes_sql('Machine, GPUs_DeviceName')}, b AS ({_STATS.format(by='class, GPUs_DeviceName', rows='cls')}) SELECT class, GPUs_DeviceName AS device, {_averages_sql(_W)} FROM b WHERE NOT regexp_matches(GPUs_DeviceName, 'GTX 1080|P100|Quadro|A30|A40') GROUP BY class, GPUs_DeviceName",
    "a3_allocation_by_memory": f"WITH {x.DEDUP_SQL}, m AS (SELECT *, {_MEM} AS memory_category FROM dedup WHERE NOT is_bf AND (prio OR (shared AND NOT is_inter))), b AS ({_STATS.format(by='memory_category', rows='m')}) SELECT memory_category, {_averages_sql('count(*)')}, count(*) AS num_intervals FROM b GROUP BY memory_category",
    "a4_user_totals": f"{_CLS} {_USERS.format(where='true')}",
    "a5_device_users": f"""WITH {x.classes_sql('Machine', "GPUs_DeviceName = 'NVIDIA H200'")}, u AS ({_USERS.format(where="GPUs_DeviceName = 'NVIDIA H200'")}) {_BREAKDOWN.format(denominator="GPUs_DeviceName = 'NVIDIA H200'")}""",
    "a6_backfill_users": f"WITH {x.classes_sql('Machine', f'NOT {_OLD}')}, u AS ({_USERS.format(where=f'''class LIKE 'Backfill%' AND NOT {_OLD}''')}) {_BREAKDOWN.format(denominator=f'NOT {_OLD}')}",
    "a7_idle_machines": f"""WITH {x.RAW_SQL}, m AS (SELECT Machine, count(*) AS obs, count(DISTINCT AssignedGPUs) FILTER (NOT is_bf) AS gpus, count(DISTINCT AssignedGPUs) FILTER (NOT is_bf AND State = 'Claimed') AS claimed, count(DISTINCT bucket) FILTER (is_bf) AS bb,
      count(DISTINCT bucket::VARCHAR || AssignedGPUs) FILTER (is_bf AND State = 'Claimed' AND AssignedGPUs IS NOT NULL) AS bp, coalesce(array_to_string(list_sort(list_distinct(list(PrioritizedProjects) FILTER (trim(coalesce(PrioritizedProjects, '')) != ''))), ','), '') AS projects FROM raw WHERE NOT excluded GROUP BY Machine),
      dev AS (SELECT Machine, GPUs_DeviceName, row_number() OVER (PARTITION BY Machine ORDER BY count(*) DESC, GPUs_DeviceName) AS rn FROM raw WHERE NOT excluded AND GPUs_DeviceName IS NOT NULL GROUP BY Machine, GPUs_DeviceName)
      SELECT m.Machine AS machine, coalesce(dev.GPUs_DeviceName, 'Unknown') AS gpu_model, gpus AS total_gpus, obs AS total_observations, projects AS prioritized_projects, round(CASE WHEN bb > 0 THEN bp / bb ELSE 0 END, 6) AS avg_backfill_claimed FROM m LEFT JOIN dev ON dev.Machine = m.Machine AND rn = 1 WHERE claimed = 0 AND gpus > 0""",
    "a8_prevented_totals": f"WITH {x.RAW_SQL} SELECT count(DISTINCT Machine) AS hosts, count(DISTINCT AssignedGPUs) AS gpus FROM raw WHERE pj_set",
    "a8_prevented_hosts": f"WITH {x.RAW_SQL} SELECT Machine AS machine, count(DISTINCT AssignedGPUs) AS gpus, array_to_string(list_sort(list_distinct(list(PreventJobsReason))), '; ') AS reasons, max(timestamp) AS last_seen, max(bucket) = (SELECT max(bucket) FROM raw WHERE pj_set) AS active FROM raw WHERE pj_set GROUP BY Machine",
    "a9_prevented_reasons": f"WITH {x.RAW_SQL} SELECT PreventJobsReason AS reason, count(DISTINCT Machine) AS hosts, count(DISTINCT AssignedGPUs) AS gpus FROM raw WHERE pj_set GROUP BY 1",
    "a10_prevented_average": f"{_CLS}, p AS (SELECT DISTINCT class, GPUs_DeviceName AS device, bucket, AssignedGPUs FROM cls WHERE pj_set AND State != 'Claimed' AND AssignedGPUs IS NOT NULL) SELECT class, device, round(count(*) / {_W}, 6) AS avg_prevented FROM p WHERE device IS NOT NULL GROUP BY class, device UNION ALL SELECT class, NULL, round(count(*) / {_W}, 6) FROM (SELECT DISTINCT class, bucket, AssignedGPUs FROM p) GROUP BY class",
    "a11_allocation_three": _allocation_sql(a.THREE_CLASSES),
    "a12_allocation_five": _allocation_sql(FIVE),
    "a13_usage_series": _SERIES_SQL,
    "a14_by_device_three": f"""{_CLS}, {filters_sql()}, g AS (SELECT class, GPUs_DeviceName AS device, bucket, AssignedGPUs, bool_or(State = 'Claimed') AS c, bool_or(State = 'Drained') AS d FROM f WHERE class IN ('Priority', 'Shared', 'Backfill') AND s = '' AND AssignedGPUs IS NOT NULL AND GPUs_DeviceName IS NOT NULL GROUP BY ALL),
      p AS (SELECT class, device, bucket, count(*) AS total, count(*) FILTER (c) AS claimed, count(*) FILTER (d) AS drained FROM g GROUP BY ALL) SELECT class, device, {_averages_sql(_W)} FROM p GROUP BY class, device""",
    "a15_backfill_by_day": f"{_DAY} SELECT class, day, round(avg_claimed, 6) AS avg_claimed, round(avg_total, 6) AS avg_total, round(utilization_percent, 6) AS utilization_percent FROM day",
    "a15_backfill_totals": f"{_DAY} SELECT 'All' AS class, day, round(sum(avg_claimed), 6) AS avg_claimed, round(sum(avg_total), 6) AS avg_total, round(sum(avg_claimed) / sum(avg_total) * 100, 6) AS utilization_percent FROM day GROUP BY day",
    "a15_backfill_totals_summary": f"""{_DAY}, total AS (SELECT day, sum(avg_claimed) AS c, sum(avg_total) AS t FROM day GROUP BY day)
        SELECT 'All' AS class, round(avg(c / t * 100), 6) AS mean_percent, round(max(c / t * 100), 6) AS max_percent, round(avg(t), 6) AS mean_total, round(max(c), 6) AS max_claimed, count(*) AS days FROM total""",
    "a15_backfill_day_summary": f"{_DAY} SELECT class, round(avg(utilization_percent), 6) AS mean_percent, round(max(utilization_percent), 6) AS max_percent, round(avg(avg_total), 6) AS mean_total, round(max(avg_claimed), 6) AS max_claimed, count(*) AS days FROM day GROUP BY class",
    "a16_monthly_summary": _MONTH_DEVICES,
    "a16_monthly_report": _MONTH_REPORT,
    "a17_category_audit": f"{_CLS}, {filters_sql()} SELECT class, s AS state, count(*) AS rows, count(DISTINCT AssignedGPUs) AS gpus FROM f WHERE s != '' AND class IN ('Priority', 'Shared', 'Backfill') GROUP BY ALL",
    "a17_category_totals": f"{_CLS}, {filters_sql()} SELECT class, count(*) FILTER (s = 'Claimed') AS claimed, count(*) FILTER (s = 'Unclaimed') AS unclaimed, count(*) AS total, count(DISTINCT AssignedGPUs) AS unique_gpus FROM f WHERE s != '' AND class IN ('Priority', 'Shared', 'Backfill') GROUP BY class",
    "a17_category_slots": f"{_CLS}, {filters_sql().replace('prio, Machine', 'prio, Machine, Name, PrioritizedProjects')} SELECT class, s AS as_state, Machine, State, PrioritizedProjects, count(*) AS rows, min(Name) AS first_slot FROM f WHERE s != '' AND class IN ('Priority', 'Shared', 'Backfill') GROUP BY ALL",
    "a18_count_anomalies": counts_sql(a.THREE_CLASSES, where="GPUs_DeviceName = 'NVIDIA H200'") + " SELECT class, bucket, claimed, unclaimed, claimed + unclaimed AS total FROM k WHERE claimed + unclaimed != 3",
    "a19_device_counts": f"{_CLS}, {filters_sql()} SELECT GPUs_DeviceName, prio, count(*) AS rows FROM f WHERE class = 'Priority' AND s = 'Unclaimed' GROUP BY ALL",
    "a20_binned_usage": counts_sql(("Priority",), "GPUs_DeviceName") + " SELECT bucket, GPUs_DeviceName, claimed AS used, claimed + unclaimed AS total FROM k WHERE NOT regexp_matches(GPUs_DeviceName, 'GTX 1080|P100|Quadro|A30|A40')",
}
ORACLE_SQL["a7_idle_totals"] = f"""WITH idle AS ({ORACLE_SQL["a7_idle_machines"]})
SELECT gpu_model, NULL AS project, count(*) AS machines, CAST(sum(total_gpus) AS BIGINT) AS gpus_idle FROM idle GROUP BY gpu_model
UNION ALL SELECT NULL, project, count(*), CAST(sum(total_gpus) AS BIGINT) FROM (SELECT total_gpus, unnest(CASE WHEN prioritized_projects = '' THEN ['None'] ELSE string_split(prioritized_projects, ',') END) AS project FROM idle) GROUP BY project
UNION ALL SELECT NULL, NULL, count(*), CAST(coalesce(sum(total_gpus), 0) AS BIGINT) FROM idle"""
ORACLE_SQL["a19_capability_histogram"] = f"""WITH {x.SLOTS_SQL}, c AS (SELECT CAST({_CAPABILITY} AS DOUBLE) AS v FROM slots), z AS (SELECT min(v) AS a, max(v) AS b FROM c),
h AS (SELECT least(CAST(floor((v - a) / (b - a) * 20) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM c, z WHERE v IS NOT NULL GROUP BY 1)
SELECT g.bin, round(a + (b - a) / 20 * (g.bin - 1), 6) AS lo, round(a + (b - a) / 20 * g.bin, 6) AS hi, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 21)) AS bin) g, z LEFT JOIN h ON h.bin = g.bin"""
