"""Queries over draining, the job queue and the report rollups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotscope.operators import allocation as a
from slotscope.operators import classify as c
from slotscope.operators import draining as g
from slotscope.operators import queue as q
from slotscope.operators import rollups as t
from slotscope.operators import views as v
from slotscope.plans import allocation as pa
from slotscope.plans import fixtures as x
from slotscope.plans import views as pv
from slotscope.plans.allocation import frames, rounded

GAP = 5400
#: 2024-01-03 00:07 to 2024-01-20 06:00, epoch seconds.
START, END = 1704240420, 1705730400
CAPACITY = 6
HOST, PROJECT = "host5", "Proj5"


def _intervals(s, p):
    return q.merge_sightings(x.sightings(s, p), GAP)


def _queued(s, p):
    return q.pressure(_intervals(s, p), START, END)


def _series(s, p):
    """Claimed devices of prioritised primary slots by bucket (epoch seconds) and user."""
    fr = frames(s, p)
    rows = c.state_filter(fr, "Priority", "Claimed")
    out = q.user_series(rows)
    return out.select(F.unix_timestamp(F.col("bucket").cast("timestamp")).alias("bucket"), "user", "gpus")


def _hours(s, p):
    return q.user_hours(_series(s, p))


def _device3(s, p):
    return a.by_device_three(frames(s, p))


_DRAIN = f"""WITH {x.SLOTS_SQL}, p AS (SELECT DISTINCT Machine, AssignedGPUs, timestamp FROM slots WHERE State = 'Drained' AND AssignedGPUs IS NOT NULL EXCEPT SELECT Machine, AssignedGPUs, timestamp FROM slots WHERE State = 'Claimed' AND AssignedGPUs IS NOT NULL),
n AS (SELECT *, coalesce(CAST(epoch(timestamp) - lag(epoch(timestamp)) OVER w > 1200 AS INTEGER), 1) AS new FROM p WINDOW w AS (PARTITION BY Machine, AssignedGPUs ORDER BY timestamp)),
i AS (SELECT *, sum(new) OVER (PARTITION BY Machine, AssignedGPUs ORDER BY timestamp) AS island FROM n),
s0 AS (SELECT Machine, AssignedGPUs, min(timestamp) AS "start", max(timestamp) AS last FROM i GROUP BY Machine, AssignedGPUs, island),
iv AS (SELECT Machine, AssignedGPUs, "start", CASE WHEN "start" = last THEN last + INTERVAL 15 MINUTE ELSE last END AS "end" FROM s0),
ivh AS (SELECT *, (epoch("end") - epoch("start")) / 3600.0 AS hours FROM iv)"""
_MERGE = f"""WITH {x.SIGHTINGS_SQL}, n AS (SELECT *, coalesce(CAST(seen - lag(seen) OVER w > {GAP} AS INTEGER), 1) AS new FROM sightings WINDOW w AS (PARTITION BY GlobalJobId ORDER BY seen, Owner, RequestGPUs, Project)),
i AS (SELECT *, sum(new) OVER (PARTITION BY GlobalJobId ORDER BY seen, Owner, RequestGPUs, Project ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY GlobalJobId ORDER BY seen, Owner, RequestGPUs, Project) AS rn FROM n),
iv AS (SELECT GlobalJobId, arg_min(Owner, rn) AS Owner, arg_min(RequestGPUs, rn) AS RequestGPUs, arg_min(Project, rn) AS Project, min(seen) AS first_seen, max(seen) AS last_seen FROM i GROUP BY GlobalJobId, island)"""
_LO = START - START % 900
_HI = _LO + (END - _LO) // 900 * 900
_QUEUED = f"qd AS (SELECT b AS bucket, Owner AS owner, sum(RequestGPUs) AS queued_gpus FROM iv, (SELECT unnest(range({_LO}, {_HI} + 1, 900)) AS b) WHERE b <= last_seen AND b + 900 > first_seen GROUP BY ALL)"
_SERIES = f"us AS (SELECT CAST(epoch(bucket) AS BIGINT) AS bucket, RemoteOwner AS user, count(DISTINCT AssignedGPUs) AS gpus FROM dedup WHERE prio AND NOT is_bf AND State = 'Claimed' AND RemoteOwner != '' GROUP BY ALL)"
_BASE = f"WITH {x.DEDUP_SQL}, {_SERIES}"
_UH = "uh AS (SELECT user, CAST(sum(gpus) * 0.25 AS DOUBLE) AS gpu_hours FROM us GROUP BY user)"
_BOTH = f"{_BASE}, {_MERGE.removeprefix('WITH ')}, {_QUEUED}"
_A2 = pa.ORACLE_SQL["a2_allocation_by_device"]
_S = "sum(avg_claimed) AS claimed, sum(avg_drained) AS drained, sum(avg_total_available) AS available"
_A2_RAW = f"WITH {x.classes_sql('Machine, GPUs_DeviceName')}, b AS ({pa._STATS.format(by='class, GPUs_DeviceName', rows='cls')}), bd AS (SELECT class, GPUs_DeviceName AS device, sum(claimed) / {pa._W} AS avg_claimed, sum(drained) / {pa._W} AS avg_drained, sum(total) / {pa._W} AS avg_total_available FROM b GROUP BY class, GPUs_DeviceName)"
_PCT = "round(CASE WHEN available > 0 THEN claimed / available * 100 ELSE 0 END, 6) AS percent"
_TOT = f"{_A2_RAW}, tot AS (SELECT class, {_S} FROM bd GROUP BY class)"
_R = "round(claimed, 6) AS claimed, round(drained, 6) AS drained, round(available, 6) AS available"


def _row(name: str, used: str, held: str) -> str:
    c_ = lambda col, cond: f"coalesce(sum({col}) FILTER ({cond}), 0)"
    return f"SELECT '{name}' AS row, {c_('claimed', used)} AS claimed, {c_('drained', used)} AS drained, {c_('available', held)} AS available FROM tot"


_P, _B, _O = "class LIKE 'Priority%'", "class LIKE 'Backfill%'", "class = 'Shared'"
_SUMMARY = " UNION ALL ".join([_row("Prioritized (Primary)", _P, _P), _row("Prioritized (Secondary)", _B, _B), _row("Prioritized (TOTAL)", f"({_P} OR {_B})", _P), _row("Open Capacity", _O, _O), _row("TOTAL", "true", f"({_P} OR {_O})")])
_A10 = pa.ORACLE_SQL["a10_prevented_average"].replace(", 6)", ", 12)")
_A3_RAW = f"WITH {x.DEDUP_SQL}, m AS (SELECT *, {pa._MEM} AS memory_category FROM dedup WHERE NOT is_bf AND (prio OR (shared AND NOT is_inter))), b AS ({pa._STATS.format(by='memory_category', rows='m')}), bm AS (SELECT memory_category, (sum(claimed) + sum(drained)) / count(*) AS allocated, sum(total) / count(*) AS available FROM b GROUP BY 1)"
_A14_RAW = pa.ORACLE_SQL["a14_by_device_three"].replace(", 6)", ", 12)")
_F = f"WITH {x.classes_sql()}, {pa.filters_sql()}"

QUERIES = {
    "g1_drained": lambda s, p: g.drained(x.slots(s, p)),
    "g2_drain_intervals": lambda s, p: rounded(g.drain_intervals(g.drained(x.slots(s, p)))),
    "g3_drain_rollup": lambda s, p: rounded(g.drain_rollup(g.drain_intervals(g.drained(x.slots(s, p))))),
    "p2_merged_intervals": _intervals,
    "p3_remerged_intervals": lambda s, p: q.merge_intervals(q.merge_sightings(x.sightings(s, p), 1800), GAP),
    "p4_sampling_interval": lambda s, p: q.sampling_interval(x.sightings(s, p)),
    "p5_pressure": _queued,
    "p6_pressure_summary": lambda s, p: rounded(q.pressure_summary(_queued(s, p))),
    "p7_user_hours": lambda s, p: rounded(_hours(s, p)),
    "p8_user_series": _series,
    "p9_gini": lambda s, p: rounded(q.gini(_hours(s, p))),
    "p10_fair_share": lambda s, p: rounded(q.fair_share(_hours(s, p))),
    "p11_contention": lambda s, p: rounded(q.contention(_series(s, p), _queued(s, p), CAPACITY)),
    "p11_full_buckets": lambda s, p: q.full_buckets(_series(s, p), CAPACITY),
    "p12_host_project": lambda s, p: q.host_project(x.slots(s, p), HOST),
    "p12_project_overview": lambda s, p: rounded(q.project_overview(x.slots(s, p), PROJECT)),
    "t1_class_totals": lambda s, p: rounded(t.class_totals(a.by_device(frames(s, p)))),
    "t2_cluster_summary": lambda s, p: rounded(t.cluster_summary(t.class_totals(a.by_device(frames(s, p))))),
    "t3_open_tiers": lambda s, p: rounded(t.open_tiers(a.by_device(frames(s, p)))),
    "t4_prevented_rollup": lambda s, p: rounded(t.prevented_rollup(a.prevented_average(frames(s, p)))),
    "t5_memory_table": lambda s, p: rounded(t.memory_table(a.by_memory(frames(s, p)))),
    "t6_user_table": lambda s, p: rounded(t.user_table(a.device_users(frames(s, p), hours_back=24))),
    "t7_three_class_totals": lambda s, p: rounded(t.three_class_totals(_device3(s, p))),
    "t8_headlines": lambda s, p: rounded(t.headlines(a.by_device(frames(s, p)))),
    "t9_sparse_coverage": lambda s, p: t.sparse_coverage(frames(s, p).raw),
    "t10_snapshot_rollup": lambda s, p: rounded(t.snapshot_rollup(v.snapshot_classes(pv._near(s, p)))),
    "u1_backfill_by_project": lambda s, p: t.backfill_only_projects(frames(s, p)),
    "u1_set_comparison": lambda s, p: t.set_comparison(c.state_filter(frames(s, p), "Priority"), c.state_filter(frames(s, p), "Backfill")),
    "u2_backfill_only": lambda s, p: t.backfill_only(frames(s, p)),
    "u3_union_by_name": lambda s, p: t.union_all(x.slots(s, p).select("Machine", "State"), x.slots(s, p).select("State", "Name").where("State = 'Drained'")).groupBy("Machine", "State").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Name").alias("names")),
}

ORACLE_SQL = {
    "g1_drained": f"{_DRAIN} SELECT * FROM p",
    "g2_drain_intervals": f"{_DRAIN} SELECT Machine, AssignedGPUs, \"start\", \"end\", round(hours, 6) AS hours FROM ivh",
    "g3_drain_rollup": f"{_DRAIN} SELECT Machine, AssignedGPUs, count(DISTINCT Machine) AS hosts, count(DISTINCT Machine || '/' || AssignedGPUs) AS gpus, count(*) AS intervals, round(sum(hours), 6) AS hours, round(avg(hours), 6) AS mean_hours FROM ivh GROUP BY ROLLUP (Machine, AssignedGPUs)",
    "p2_merged_intervals": f"{_MERGE} SELECT * FROM iv",
    "p3_remerged_intervals": f"{_MERGE} SELECT * FROM iv",
    "p4_sampling_interval": f"WITH {x.SIGHTINGS_SQL}, gp AS (SELECT seen - lag(seen) OVER (PARTITION BY GlobalJobId ORDER BY seen) AS gap FROM sightings), m AS (SELECT gap FROM gp WHERE gap > 0 GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1) SELECT gap AS interval, gap * 2 AS threshold FROM m",
    "p5_pressure": f"{_MERGE}, {_QUEUED} SELECT * FROM qd",
    "p6_pressure_summary": f"{_MERGE}, {_QUEUED} SELECT owner, round(sum(queued_gpus) * 0.25, 6) AS gpu_hours, max(queued_gpus) AS peak FROM qd GROUP BY owner",
    "p7_user_hours": f"{_BASE}, {_UH} SELECT user, round(gpu_hours, 6) AS gpu_hours, round(gpu_hours / sum(gpu_hours) OVER () * 100, 6) AS share FROM uh",
    "p8_user_series": f"{_BASE} SELECT * FROM us",
    "p9_gini": f"{_BASE}, {_UH} SELECT round(CASE WHEN n < 2 THEN 0 ELSE d / (2 * n * n * mean) END, 6) AS gini, n AS users FROM (SELECT (SELECT sum(abs(a.gpu_hours - b.gpu_hours)) FROM uh a, uh b) AS d, count(*) AS n, avg(gpu_hours) AS mean FROM uh)",
    "p10_fair_share": f"{_BASE}, {_UH} SELECT user, round(gpu_hours, 6) AS gpu_hours, round(avg(gpu_hours) OVER (), 6) AS equal_share, round(gpu_hours - avg(gpu_hours) OVER (), 6) AS surplus FROM uh",
    "p11_contention": f"{_BOTH}, fb AS (SELECT bucket FROM us GROUP BY bucket HAVING sum(gpus) >= {CAPACITY}), k AS (SELECT owner, queued_gpus * 0.25 AS h, EXISTS (SELECT 1 FROM us WHERE us.bucket = qd.bucket AND split_part(us.user, '@', 1) = split_part(qd.owner, '@', 1)) AS runs FROM qd WHERE bucket IN (SELECT bucket FROM fb)) SELECT owner, round(coalesce(sum(h) FILTER (runs), 0), 6) AS self_hours, round(coalesce(sum(h) FILTER (NOT runs), 0), 6) AS other_hours FROM k GROUP BY owner HAVING sum(h) > 0",
    "p11_full_buckets": f"{_BASE} SELECT count(*) FILTER (g >= {CAPACITY}) AS \"full\", count(*) AS total FROM (SELECT bucket, sum(gpus) AS g FROM us GROUP BY bucket)",
    "p12_host_project": f"WITH {x.SLOTS_SQL} SELECT PrioritizedProjects AS project, count(*) AS rows FROM slots WHERE Machine = '{HOST}' AND NOT contains(Name, 'backfill') AND PrioritizedProjects != '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "p12_project_overview": f"WITH {x.RAW_SQL}, r AS (SELECT * FROM raw WHERE NOT is_bf AND PrioritizedProjects = '{PROJECT}'), o AS (SELECT count(DISTINCT Machine) AS machines, count(DISTINCT AssignedGPUs) AS capacity, count(DISTINCT AssignedGPUs) * count(DISTINCT bucket) * 0.25::DOUBLE AS available_hours, (SELECT count(*) * 0.25::DOUBLE FROM (SELECT DISTINCT bucket, AssignedGPUs FROM r WHERE State = 'Claimed' AND AssignedGPUs IS NOT NULL)) AS used_hours FROM r) SELECT *, round(used_hours / available_hours * 100, 6) AS utilization FROM o",
    "t1_class_totals": f"{_TOT} SELECT class, {_R}, {_PCT} FROM tot WHERE available > 0",
    "t2_cluster_summary": f"{_TOT}, sm AS ({_SUMMARY}) SELECT row, {_R}, {_PCT} FROM sm",
    "t3_open_tiers": f"{_A2_RAW}, ti AS (SELECT CASE WHEN regexp_matches(device, 'H100|H200|A100-SXM4-80GB|A100 80GB') THEN 'Flagship' ELSE 'Standard' END AS tier, {_S} FROM bd WHERE class = 'Shared' GROUP BY 1) SELECT tier, {_R}, {_PCT} FROM ti",
    "t4_prevented_rollup": f"""WITH pr AS ({_A10}) SELECT class AS row, round(avg_prevented, 6) AS avg_prevented FROM pr WHERE device IS NULL
      UNION ALL SELECT 'Prioritized', round(coalesce(sum(avg_prevented) FILTER (class LIKE 'Priority%'), 0), 6) FROM pr WHERE device IS NULL UNION ALL SELECT 'Secondary', round(coalesce(sum(avg_prevented) FILTER (class LIKE 'Backfill%'), 0), 6) FROM pr WHERE device IS NULL
      UNION ALL SELECT 'TOTAL', round(coalesce(sum(avg_prevented) FILTER (class NOT LIKE 'Backfill%'), 0), 6) FROM pr WHERE device IS NULL
      UNION ALL SELECT 'Open Capacity ' || CASE WHEN regexp_matches(device, 'H100|H200|A100-SXM4-80GB|A100 80GB') THEN 'Flagship' ELSE 'Standard' END, round(sum(avg_prevented), 6) FROM pr WHERE device IS NOT NULL AND class = 'Shared' GROUP BY 1""",
    "t5_memory_table": f"{_A3_RAW}, al AS (SELECT * FROM bm UNION ALL SELECT 'TOTAL', sum(allocated), sum(available) FROM bm) SELECT memory_category, round(allocated, 6) AS allocated, round(available, 6) AS available, round(CASE WHEN available > 0 THEN allocated / available * 100 ELSE 0 END, 6) AS percent, CAST(CASE memory_category WHEN 'TOTAL' THEN -1 WHEN 'Unknown' THEN 999 WHEN '<48GB' THEN 47.9 WHEN '48GB' THEN 48 WHEN '80GB' THEN 80 ELSE 80.1 END AS DOUBLE) AS place FROM al",
    "t6_user_table": f"WITH br AS ({pa.ORACLE_SQL['a5_device_users'].replace(', 6)', ', 12)')}) SELECT class, user, round(gpu_hours, 6) AS gpu_hours, round(sum(gpu_hours) OVER (PARTITION BY class), 6) AS class_hours, count(*) OVER (PARTITION BY class) AS class_users, round(sum(gpu_hours) OVER (PARTITION BY class) / sum(gpu_hours) OVER () * 100, 6) AS class_percent FROM br",
    "t7_three_class_totals": f"WITH bd AS ({_A14_RAW}), tk AS (SELECT CASE WHEN class = 'Backfill' THEN 'secondary' ELSE 'primary' END AS kind, * FROM bd), k AS (SELECT kind, {_S} FROM tk GROUP BY ROLLUP (kind)) SELECT kind, {_R}, {_PCT} FROM k",
    "t8_headlines": f"{_A2_RAW}, k AS (SELECT CASE WHEN class LIKE 'Backfill%' THEN 'Backfill' ELSE class END AS headline, {_S} FROM bd GROUP BY 1) SELECT headline, {_PCT} FROM k",
    "t9_sparse_coverage": f"WITH {x.RAW_SQL} SELECT count(*) FILTER (p) AS pj_buckets, count(*) AS total_buckets, count(*) FILTER (p) / count(*) < 0.25 AS sparse FROM (SELECT bucket, bool_or(pj_set) AS p FROM raw GROUP BY bucket)",
    "t10_snapshot_rollup": f"WITH sc AS ({pv.ORACLE_SQL['v9_snapshot_classes']}) SELECT CASE WHEN class = 'Backfill' THEN 'backfill' ELSE 'real' END AS kind, CAST(sum(total) AS BIGINT) AS total, CAST(sum(claimed) AS BIGINT) AS claimed, round(CASE WHEN sum(total) > 0 THEN sum(claimed) / sum(total) * 100 ELSE 0 END, 6) AS percent FROM sc GROUP BY 1",
    "u1_backfill_by_project": f"WITH {x.DEDUP_SQL}, o AS (SELECT * FROM raw_bf WHERE AssignedGPUs IS NOT NULL AND AssignedGPUs NOT IN (SELECT AssignedGPUs FROM dedup WHERE prio AND NOT is_bf)) SELECT Machine, CASE WHEN coalesce(PrioritizedProjects, '') = '' THEN 'None' ELSE PrioritizedProjects END AS project, count(*) AS rows, count(DISTINCT AssignedGPUs) AS gpus FROM o GROUP BY ALL",
    "u1_set_comparison": f"{_F}, pr AS (SELECT DISTINCT AssignedGPUs AS g FROM f WHERE class = 'Priority' AND s = '' AND AssignedGPUs IS NOT NULL), bf AS (SELECT DISTINCT AssignedGPUs AS g FROM f WHERE class = 'Backfill' AND s = '' AND AssignedGPUs IS NOT NULL) SELECT (SELECT count(*) FROM pr) AS first, (SELECT count(*) FROM bf) AS second, (SELECT count(*) FROM pr JOIN bf USING (g)) AS both, (SELECT count(*) FROM bf ANTI JOIN pr USING (g)) AS second_only",
    "u2_backfill_only": f"{_F}, o AS (SELECT DISTINCT bucket, Machine, AssignedGPUs FROM f WHERE class = 'Backfill' AND s = '' AND AssignedGPUs IS NOT NULL), r AS (SELECT DISTINCT bucket, AssignedGPUs FROM f WHERE class IN ('Priority', 'Shared') AND s = '') SELECT o.bucket, Machine, count(*) AS gpus FROM o ANTI JOIN r ON r.bucket = o.bucket AND r.AssignedGPUs = o.AssignedGPUs GROUP BY ALL",
    "u3_union_by_name": f"WITH {x.SLOTS_SQL} SELECT Machine, State, count(*) AS n, count(DISTINCT Name) AS names FROM (SELECT Machine, State, NULL AS Name FROM slots UNION ALL SELECT NULL, State, Name FROM slots WHERE State = 'Drained') GROUP BY ALL",
}
