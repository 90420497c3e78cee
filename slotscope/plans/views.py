"""Queries of the dashboard views and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slotscope.operators import classify as c
from slotscope.operators import views as v
from slotscope.operators.asof import as_of
from slotscope.plans import fixtures as x
from slotscope.plans.allocation import frames, rounded

AT = dt.datetime(2024, 1, 4, 10, 2, 30)
MODEL = "NVIDIA H200"


def _heat(s, p):
    shown = v.heatmap(frames(s, p))
    return shown.select("machine", "gpu", "device", F.array_join("states", "").alias("states"))


def _near(s, p):
    return v.nearest_snapshot(x.slots(s, p), MODEL, AT, 60)


_AROUND = "timestamp BETWEEN TIMESTAMP '2024-01-04 09:02:30' AND TIMESTAMP '2024-01-04 11:02:30'"
_NEAR = f"""WITH {x.SLOTS_SQL}, a AS (SELECT * FROM slots WHERE {_AROUND} AND GPUs_DeviceName = 'NVIDIA H200'),
n AS (SELECT * FROM a WHERE timestamp = (SELECT timestamp FROM a ORDER BY abs(epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-04 10:02:30')), timestamp DESC LIMIT 1))"""
_ACTIVE = "State = 'Claimed' AND RemoteOwner IS NOT NULL"
_HEAT = f"""WITH {x.DEDUP_SQL}, w AS (SELECT *, CASE WHEN State = 'Claimed' AND is_bf THEN 4 WHEN State = 'Claimed' AND prio THEN 2 WHEN State = 'Claimed' THEN 3 WHEN State = 'Unclaimed' AND is_bf THEN 6 WHEN State = 'Unclaimed' AND prio THEN 0 WHEN State = 'Unclaimed' THEN 1 ELSE 5 END AS code
  FROM (SELECT *, row_number() OVER (PARTITION BY bucket, AssignedGPUs ORDER BY {x.RANK_SQL.format(prev="(pj_set AND State != 'Claimed')")} DESC, {x.TIES_SQL}) AS rn FROM dedup) WHERE rn = 1),
g AS (SELECT Machine, AssignedGPUs, coalesce(min(GPUs_DeviceName), 'Unknown') AS device FROM w GROUP BY ALL),
h AS (SELECT g.Machine AS machine, g.AssignedGPUs AS gpu, g.device, string_agg(CAST(coalesce(w.code, 5) AS VARCHAR), '' ORDER BY b.bucket) AS states FROM g CROSS JOIN (SELECT DISTINCT bucket FROM w) b
  LEFT JOIN w ON w.Machine = g.Machine AND w.AssignedGPUs = g.AssignedGPUs AND w.bucket = b.bucket GROUP BY ALL)"""
_FINE = x.DEDUP_SQL.replace("INTERVAL '15 minutes'", "INTERVAL '1 minute'")
_TIMELINE = f"""WITH {x.RAW_SQL}, k AS (SELECT *, time_bucket(INTERVAL '5 minutes', timestamp) AS b, concat_ws('_', Machine, AssignedGPUs) AS gpu, CASE WHEN State = 'Claimed' AND NOT is_bf THEN 3 WHEN State = 'Claimed' THEN 2 WHEN NOT is_bf AND State = 'Unclaimed' THEN 1 ELSE 0 END AS rank FROM raw WHERE AssignedGPUs IS NOT NULL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gpu, b ORDER BY rank DESC, {x.TIES_SQL}) AS rn FROM k) WHERE rn = 1)
SELECT gpu, b AS bucket, CASE WHEN State = 'Claimed' AND is_bf THEN 'busy_backfill' WHEN State = 'Claimed' AND prio THEN 'busy_prioritized' WHEN State = 'Claimed' THEN 'busy_shared' WHEN State = 'Unclaimed' AND NOT is_bf AND prio THEN 'idle_prioritized' WHEN State = 'Unclaimed' THEN 'idle_shared' ELSE 'na' END AS label, Machine, GPUs_DeviceName FROM t"""

def _nearest_times(s, p):
    """For every job the snapshot of its machine that is nearest to its submission."""
    points = x.jobs(s, p).select("ClusterId", F.col("StartdName").alias("Machine"), F.timestamp_seconds("QDate").cast("timestamp_ntz").alias("at"))
    return as_of(points, x.slots(s, p).select("Machine", "timestamp").distinct(), "at", "timestamp", [], ["Machine"], "nearest", cell_hours=24)


QUERIES = {
    "v1_heatmap": _heat,
    "v2_category_counts": lambda s, p: v.category_counts(frames(s, p).raw),
    "v3_open_users": lambda s, p: v.open_users(x.slots(s, p), x.OWNED, x.EXCLUDED),
    "v4_timeline": lambda s, p: v.timeline(x.slots(s, p)),
    "v5_host_rollup": lambda s, p: rounded(v.host_rollup(x.slots(s, p), 3)),
    "v5_hosts_by_device": lambda s, p: rounded(v.hosts_by_device(v.host_list(x.slots(s, p), 3))),
    "v6_prioritised_hosts": lambda s, p: v.prioritised_hosts(x.slots(s, p)),
    "v7_models_at": lambda s, p: v.models_at(x.slots(s, p), AT, 20),
    "v8_model_activity": lambda s, p: v.model_activity(x.slots(s, p), MODEL, AT, 60).select("timestamp", "Machine", "AssignedGPUs", "Name", "State"),
    "v9_nearest_snapshot": lambda s, p: rounded(v.snapshot_summary(_near(s, p))),
    "v9_snapshot_classes": lambda s, p: v.snapshot_classes(_near(s, p), x.OWNED, x.EXCLUDED),
    "v9_nearest_times": _nearest_times,
    "v9_inactive_devices": lambda s, p: v.inactive_devices(_near(s, p)),
    "v9_active_jobs": lambda s, p: v.active_jobs(_near(s, p)),
    "v10_host_users": lambda s, p: v.host_users(x.slots(s, p), "host5", "Primary"),
    "v11_open_backfill_machines": lambda s, p: v.open_backfill_machines(c.open_backfill(frames(s, p))),
    "v11_open_backfill_users": lambda s, p: rounded(v.open_backfill_users(c.open_backfill(frames(s, p)))),
    "v11_open_backfill_user_machines": lambda s, p: v.open_backfill_user_machines(c.open_backfill(frames(s, p))),
    "v12_filtered_heatmap": lambda s, p: v.filter_heatmap(v.heatmap(frames(s, p)), "OST1", [4]).select("machine", "gpu"),
}

ORACLE_SQL = {
    "v1_heatmap": f"{_HEAT} SELECT * FROM h",
    "v2_category_counts": f"""WITH {x.RAW_SQL} SELECT bucket, """ + ", ".join(
        f"count(DISTINCT AssignedGPUs) FILTER ({m} AND {cl}) + coalesce(max(CASE WHEN {m} AND {cl} AND AssignedGPUs IS NULL THEN 1 END), 0) AS {k}_{lab}"
        for k, m in (("prioritized", "NOT is_bf AND prio AND AssignedGPUs IS NOT NULL"), ("open_capacity", "NOT is_bf AND NOT prio AND AssignedGPUs IS NOT NULL"), ("backfill", "is_bf"))
        for lab, cl in (("total", "true"), ("claimed", "State = 'Claimed'"))
    ) + " FROM raw WHERE NOT excluded GROUP BY bucket",
    "v3_open_users": f"""WITH {_FINE}, s AS (SELECT bucket, RemoteOwner, count(DISTINCT AssignedGPUs) AS n FROM dedup WHERE State = 'Claimed' AND NOT is_bf AND NOT prio AND RemoteOwner != '' GROUP BY ALL),
      b AS (SELECT time_bucket(INTERVAL '15 minutes', bucket) AS b, RemoteOwner, max(n) AS gpu_count FROM s GROUP BY ALL),
      l AS (SELECT RemoteOwner, 'User ' || row_number() OVER (ORDER BY peak DESC, RemoteOwner) AS label FROM (SELECT RemoteOwner, max(gpu_count) AS peak FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6))
      SELECT label, g.b AS bucket, coalesce(gpu_count, 0) AS gpu_count FROM (SELECT DISTINCT b FROM b) g CROSS JOIN l LEFT JOIN b ON b.b = g.b AND b.RemoteOwner = l.RemoteOwner""",
    "v4_timeline": _TIMELINE,
    "v5_host_rollup": f"WITH {x.SLOTS_SQL} SELECT Machine, count(DISTINCT AssignedGPUs) + max(CAST(AssignedGPUs IS NULL AS INTEGER)) AS gpus, array_to_string(list_sort(list_distinct(list(GPUs_DeviceName))), ', ') AS models, count(*) AS rows, round(avg(CAST(State = 'Claimed' AS INTEGER)), 6) AS claimed_share FROM slots GROUP BY Machine HAVING count(DISTINCT AssignedGPUs) + max(CAST(AssignedGPUs IS NULL AS INTEGER)) >= 3",
    "v5_hosts_by_device": f"""WITH {x.SLOTS_SQL}, h AS (SELECT Machine, count(DISTINCT AssignedGPUs) + max(CAST(AssignedGPUs IS NULL AS INTEGER)) AS gpus, avg(CAST(State = 'Claimed' AS INTEGER)) AS share FROM slots GROUP BY Machine HAVING gpus >= 3),
      m AS (SELECT Machine, GPUs_DeviceName AS device FROM slots WHERE GPUs_DeviceName IS NOT NULL GROUP BY Machine, GPUs_DeviceName QUALIFY row_number() OVER (PARTITION BY Machine ORDER BY count(*) DESC, GPUs_DeviceName) = 1)
      SELECT device, count(*) AS hosts, CAST(sum(gpus) AS BIGINT) AS gpus, round(avg(share), 6) AS mean_claimed_share FROM (SELECT h.*, coalesce(device, 'Unknown') AS device FROM h LEFT JOIN m USING (Machine)) GROUP BY ROLLUP (device) HAVING count(*) > 0""",
    "v6_prioritised_hosts": f"WITH {x.SLOTS_SQL} SELECT DISTINCT Machine FROM slots WHERE PrioritizedProjects != ''",
    "v7_models_at": f"WITH {x.SLOTS_SQL} SELECT DISTINCT GPUs_DeviceName FROM slots WHERE timestamp BETWEEN TIMESTAMP '2024-01-04 09:42:30' AND TIMESTAMP '2024-01-04 10:22:30' AND GPUs_DeviceName IS NOT NULL",
    "v8_model_activity": f"WITH {x.SLOTS_SQL} SELECT timestamp, Machine, AssignedGPUs, Name, State FROM slots WHERE {_AROUND} AND GPUs_DeviceName = 'NVIDIA H200'",
    "v9_nearest_snapshot": f"{_NEAR} SELECT t AS total, a AS active, t - a AS idle, round(CASE WHEN t > 0 THEN a / t * 100 ELSE 0 END, 6) AS utilization, mean_use, machines FROM (SELECT count(DISTINCT AssignedGPUs) AS t, count(DISTINCT AssignedGPUs) FILTER ({_ACTIVE}) AS a, round(coalesce(avg(GPUsAverageUsage) FILTER (State = 'Claimed') * 100, 0), 6) AS mean_use, count(DISTINCT Machine) AS machines FROM n)",
    "v9_snapshot_classes": f"""{_NEAR}, {x.DEDUP_SQL.removeprefix(x.SLOTS_SQL).lstrip(", ").replace("FROM slots)", "FROM n)")},
      f AS (SELECT 'Priority' AS class, AssignedGPUs, State FROM dedup WHERE prio AND NOT is_bf UNION ALL SELECT 'Shared', AssignedGPUs, State FROM dedup WHERE shared AND NOT is_bf AND NOT is_inter UNION ALL SELECT 'Backfill', AssignedGPUs, State FROM raw_bf)
      SELECT class, count(DISTINCT AssignedGPUs) AS total, count(DISTINCT AssignedGPUs) FILTER (State = 'Claimed') AS claimed FROM f GROUP BY class""",
    "v9_nearest_times": f"""WITH {x.SLOTS_SQL}, {x.JOBS_SQL}, p AS (SELECT ClusterId, StartdName AS Machine, make_timestamp(QDate * 1000000) AS "at" FROM jobs), s AS (SELECT DISTINCT Machine, timestamp FROM slots),
      b AS (SELECT p.*, s.timestamp AS "before" FROM p ASOF LEFT JOIN s ON p.Machine = s.Machine AND p."at" >= s.timestamp), z AS (SELECT b.*, s.timestamp AS "after" FROM b ASOF LEFT JOIN s ON b.Machine = s.Machine AND b."at" <= s.timestamp)
      SELECT ClusterId, Machine, z."at", CASE WHEN "before" IS NULL THEN "after" WHEN "after" IS NULL THEN "before" WHEN "after" - z."at" <= z."at" - "before" THEN "after" ELSE "before" END AS timestamp FROM z""",
    "v9_inactive_devices": f"{_NEAR}, k AS (SELECT AssignedGPUs, Machine, PrioritizedProjects, row_number() OVER (PARTITION BY AssignedGPUs ORDER BY Machine NULLS FIRST, PrioritizedProjects NULLS FIRST) AS rn FROM n WHERE State = 'Unclaimed' AND AssignedGPUs IS NOT NULL AND AssignedGPUs NOT IN (SELECT AssignedGPUs FROM n WHERE {_ACTIVE} AND AssignedGPUs IS NOT NULL)) SELECT AssignedGPUs, Machine AS machine, PrioritizedProjects AS projects FROM k WHERE rn = 1",
    "v9_active_jobs": f"{_NEAR}, k AS (SELECT AssignedGPUs, RemoteOwner, GlobalJobId, Machine, row_number() OVER (PARTITION BY AssignedGPUs ORDER BY GlobalJobId NULLS FIRST, RemoteOwner NULLS FIRST, Machine NULLS FIRST) AS rn FROM n WHERE {_ACTIVE} AND AssignedGPUs IS NOT NULL) SELECT AssignedGPUs, RemoteOwner AS owner, GlobalJobId AS job, Machine AS machine FROM k WHERE rn = 1",
    "v10_host_users": f"WITH {x.SLOTS_SQL} SELECT DISTINCT RemoteOwner FROM slots WHERE Machine = 'host5' AND NOT contains(Name, 'backfill') AND coalesce(PrioritizedProjects != '', true) AND RemoteOwner != ''",
    "v11_open_backfill_machines": f"""WITH {x.DEDUP_SQL}, o AS (SELECT * FROM raw_bf WHERE NOT owned AND Machine NOT IN ({x.scope_sql()})),
      m AS (SELECT Machine, GPUs_DeviceName, row_number() OVER (PARTITION BY Machine ORDER BY count(*) DESC, GPUs_DeviceName) AS rn FROM o WHERE GPUs_DeviceName IS NOT NULL GROUP BY Machine, GPUs_DeviceName)
      SELECT o.Machine, m.GPUs_DeviceName AS model, count(DISTINCT AssignedGPUs) AS gpus, bool_or(owned) AS owned FROM o LEFT JOIN m ON m.Machine = o.Machine AND m.rn = 1 GROUP BY ALL""",
    "v11_open_backfill_users": f"WITH {x.DEDUP_SQL}, o AS (SELECT * FROM raw_bf WHERE NOT owned AND Machine NOT IN ({x.scope_sql()})), u AS (SELECT RemoteOwner, count(*) AS observations, count(DISTINCT Machine) AS machines FROM o WHERE State = 'Claimed' AND RemoteOwner != '' GROUP BY 1) SELECT *, round(observations / sum(observations) OVER (), 6) AS share FROM u",
    "v11_open_backfill_user_machines": f"WITH {x.DEDUP_SQL}, o AS (SELECT * FROM raw_bf WHERE NOT owned AND Machine NOT IN ({x.scope_sql()})) SELECT RemoteOwner, Machine, count(*) AS observations, count(DISTINCT AssignedGPUs) AS gpus FROM o WHERE State = 'Claimed' AND RemoteOwner != '' GROUP BY ALL",
    "v12_filtered_heatmap": f"{_HEAT} SELECT machine, gpu FROM h WHERE contains(lower(machine), 'ost1') AND contains(states, '4')",
}
