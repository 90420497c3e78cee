"""Domain tables derived from the driver's tables, in Spark and in SQL, by the same integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWNED = ("host3", "host7")
EXCLUDED = ("HOST13",)
#: Device names by supplier number modulo 5, and their memory in MB.
DEVICES = (("NVIDIA H200", 143771), ("NVIDIA A100-SXM4-80GB", 81920), ("NVIDIA L40S", 46068), ("NVIDIA A40", 46068), ("Tesla P100-PCIE-16GB", 16384))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that lies in fewer splits than there are cores (small files) is dealt over them, as deriving from it
    costs more than reading it; larger tables stay as they are read."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot snapshots from lineitem: one ship date is one 5-minute snapshot."""
    device = "CASE l_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(DEVICES)) + " END"
    memory = "CASE l_suppkey % 5 " + " ".join(f"WHEN {i} THEN {m}L" for i, (_, m) in enumerate(DEVICES)) + " END"
    host = "(l_suppkey % 25)"
    state = f"CASE WHEN {host} = 20 AND l_linenumber % 4 != 3 THEN 'Unclaimed' WHEN l_returnflag = 'R' THEN 'Claimed' WHEN l_returnflag = 'A' THEN 'Unclaimed' WHEN l_linestatus = 'O' THEN 'Claimed' ELSE 'Drained' END"
    base = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_tax", "l_discount",
        "CAST(TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, 5 * datediff(l_shipdate, DATE'1995-01-02')) AS TIMESTAMP_NTZ) AS timestamp",
        f"concat('host', {host}) AS Machine",
        "CASE WHEN l_quantity != 50 THEN concat('GPU-', l_suppkey) END AS AssignedGPUs",
        f"CASE WHEN l_linenumber = 4 THEN concat('slot1@host', {host}) ELSE concat(CASE l_linenumber % 4 WHEN 3 THEN 'backfill2_' WHEN 2 THEN 'interactive1_' ELSE 'slot1_' END, l_linenumber, '@host', {host}) END AS Name",
        f"{state} AS State", f"{device} AS GPUs_DeviceName",
        f"CASE WHEN l_partkey % 97 != 0 THEN {memory} END AS GPUs_GlobalMemoryMb",
        f"CASE WHEN {host} < 10 THEN concat('Proj', {host}) WHEN {host} = 24 THEN NULL ELSE '' END AS PrioritizedProjects",
    )
    return base.selectExpr(
        "Name", "AssignedGPUs", "CAST(NULL AS STRING) AS AvailableGPUs", "State", "GPUs_DeviceName", "GPUs_GlobalMemoryMb", "PrioritizedProjects",
        "CASE WHEN State = 'Claimed' THEN CAST(l_discount * 10 AS DOUBLE) END AS GPUsAverageUsage", "Machine",
        "CASE WHEN State = 'Claimed' THEN CASE WHEN l_orderkey % 41 = 0 THEN '' ELSE concat('user', l_orderkey % 40, '@domain') END END AS RemoteOwner",
        "CASE WHEN State = 'Claimed' THEN concat(l_orderkey, '.0') END AS GlobalJobId",
        "CASE WHEN round(l_tax * 100) = 8 THEN 'INF-1' WHEN round(l_tax * 100) = 7 THEN '  ' END AS PreventJobsReason",
        "CAST(NULL AS BIGINT) AS Disk", "timestamp",
    )


_HOST = "(l_suppkey % 25)"
SLOTS_SQL = f"""slots0 AS (SELECT l_orderkey, l_linenumber, l_tax, l_discount,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(5 * date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS BIGINT)) AS timestamp,
  'host' || {_HOST} AS Machine, CASE WHEN l_quantity != 50 THEN 'GPU-' || l_suppkey END AS AssignedGPUs,
  CASE WHEN l_linenumber = 4 THEN 'slot1@host' || {_HOST} ELSE (CASE l_linenumber % 4 WHEN 3 THEN 'backfill2_' WHEN 2 THEN 'interactive1_' ELSE 'slot1_' END) || l_linenumber || '@host' || {_HOST} END AS Name,
  CASE WHEN {_HOST} = 20 AND l_linenumber % 4 != 3 THEN 'Unclaimed' WHEN l_returnflag = 'R' THEN 'Claimed' WHEN l_returnflag = 'A' THEN 'Unclaimed' WHEN l_linestatus = 'O' THEN 'Claimed' ELSE 'Drained' END AS State,
  CASE l_suppkey % 5 {" ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(DEVICES))} END AS GPUs_DeviceName,
  CASE WHEN l_partkey % 97 != 0 THEN CASE l_suppkey % 5 {" ".join(f"WHEN {i} THEN {m}" for i, (_, m) in enumerate(DEVICES))} END END AS GPUs_GlobalMemoryMb,
  CASE WHEN {_HOST} < 10 THEN 'Proj' || {_HOST} WHEN {_HOST} = 24 THEN NULL ELSE '' END AS PrioritizedProjects FROM lineitem),
slots AS (SELECT Name, AssignedGPUs, State, GPUs_DeviceName, CAST(GPUs_GlobalMemoryMb AS BIGINT) AS GPUs_GlobalMemoryMb, PrioritizedProjects,
  CASE WHEN State = 'Claimed' THEN CAST(l_discount * 10 AS DOUBLE) END AS GPUsAverageUsage, Machine,
  CASE WHEN State = 'Claimed' THEN CASE WHEN l_orderkey % 41 = 0 THEN '' ELSE 'user' || (l_orderkey % 40) || '@domain' END END AS RemoteOwner,
  CASE WHEN State = 'Claimed' THEN l_orderkey || '.0' END AS GlobalJobId,
  CASE WHEN round(l_tax * 100) = 8 THEN 'INF-1' WHEN round(l_tax * 100) = 7 THEN '  ' END AS PreventJobsReason, timestamp FROM slots0)"""

def mixed_projects(slots: DataFrame) -> DataFrame:
    """Snapshots whose backfill rows have no project of their own, and whose primary rows of one device differ."""
    return slots.withColumn("PrioritizedProjects", F.expr(_MIXED))


_MIXED = "CASE WHEN Name LIKE 'backfill%' THEN NULL WHEN Name LIKE 'slot1_5@%' THEN '' WHEN Name LIKE 'interactive1_2@%' THEN 'ProjX' ELSE PrioritizedProjects END"
MIXED_SQL = f"{SLOTS_SQL},\nmixed AS (SELECT * REPLACE ({_MIXED} AS PrioritizedProjects) FROM slots)"


def idle_hosts(slots: DataFrame) -> DataFrame:
    """Snapshots in which two hosts, one with a project, never have a device claimed."""
    return slots.withColumn("State", F.expr(_IDLE))


_IDLE = "CASE WHEN Machine IN ('host4', 'host20') THEN 'Unclaimed' ELSE State END"
IDLE_SQL = f"{SLOTS_SQL},\nidle AS (SELECT * REPLACE ({_IDLE} AS State) FROM slots)"

_OWNED = ", ".join(f"'{h}'" for h in OWNED)
RAW_SQL = f"""{SLOTS_SQL},
raw AS (SELECT *, time_bucket(INTERVAL '15 minutes', timestamp) AS bucket, coalesce(contains(Name, 'backfill'), false) AS is_bf, coalesce(contains(Name, 'interactive'), false) AS is_inter,
  coalesce(PrioritizedProjects != '', true) AS prio, coalesce(PrioritizedProjects = '', false) AS shared, coalesce(Machine IN ({_OWNED}), false) AS owned,
  coalesce(contains(lower(Machine), 'host13'), false) AS excluded, (PreventJobsReason IS NOT NULL AND trim(PreventJobsReason) != '') AS pj_set,
  (PreventJobsReason IS NOT NULL AND trim(PreventJobsReason) != '') AND State != 'Claimed' AS prev_idle FROM slots)"""
RANK_SQL = "CASE WHEN NOT is_bf AND State = 'Claimed' THEN 6 WHEN NOT is_bf AND {prev} THEN 2 WHEN NOT is_bf AND State = 'Unclaimed' THEN 5 WHEN NOT is_bf THEN 4 WHEN State = 'Claimed' THEN 3 WHEN State = 'Unclaimed' THEN 1 ELSE 0 END"
_KEPT = ("Name", "State", "Machine", "GPUs_DeviceName", "GPUs_GlobalMemoryMb", "RemoteOwner", "PrioritizedProjects", "GlobalJobId", "GPUsAverageUsage", "PreventJobsReason")
TIES_SQL = ", ".join(f"{c} DESC NULLS LAST" for c in _KEPT)
DEDUP_SQL = f"""{RAW_SQL},
dedup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {RANK_SQL.format(prev="prev_idle")} AS rank,
  row_number() OVER (PARTITION BY timestamp, AssignedGPUs ORDER BY {RANK_SQL.format(prev="prev_idle")} DESC, {TIES_SQL}) AS rn FROM raw WHERE NOT excluded AND AssignedGPUs IS NOT NULL) WHERE rn = 1),
raw_bf AS (SELECT * FROM raw WHERE NOT excluded AND is_bf)"""


def scope_sql(keys: str = "Machine", extra: str = "true") -> str:
    return f"SELECT DISTINCT {keys} FROM raw WHERE NOT excluded AND NOT is_bf AND NOT owned AND coalesce(PrioritizedProjects != '', false) AND {extra}"


def classes_sql(keys: str = "Machine", extra: str = "true") -> str:
    """CTEs up to ``cls``: the long frame of all five classes."""
    on = " AND ".join(f"b.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    cols = "bucket, AssignedGPUs, State, Name, Machine, GPUs_DeviceName, GPUs_GlobalMemoryMb, RemoteOwner, pj_set"
    return f"""{DEDUP_SQL},
scope AS ({scope_sql(keys, extra)}),
cls AS (SELECT 'Priority-ResearcherOwned' AS class, {cols} FROM dedup WHERE prio AND NOT owned AND NOT is_bf
  UNION ALL SELECT 'Priority-PoolOwned', {cols} FROM dedup WHERE prio AND owned AND NOT is_bf
  UNION ALL SELECT 'Shared', {cols} FROM dedup WHERE shared AND NOT is_bf AND NOT is_inter
  UNION ALL SELECT 'Backfill-PoolOwned', {cols} FROM raw_bf WHERE owned
  UNION ALL SELECT 'Backfill-ResearcherOwned', {cols} FROM raw_bf b WHERE EXISTS (SELECT 1 FROM scope s WHERE {on}))"""


# --- the other tables -------------------------------------------------------------------------


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old-form queue snapshots from events: one row a sighting."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS GlobalJobId", "concat('user', user_id % 12) AS Owner", "CAST(1 + event_id % 4 AS DOUBLE) AS RequestGPUs",
        "concat('Proj', user_id % 5) AS Project", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS seen", "event_id",
    )


SIGHTINGS_SQL = """sightings AS (SELECT CAST(user_id AS VARCHAR) AS GlobalJobId, 'user' || (user_id % 12) AS Owner, CAST(1 + event_id % 4 AS DOUBLE) AS RequestGPUs,
  'Proj' || (user_id % 5) AS Project, CAST(floor(epoch(ts)) AS BIGINT) AS seen, event_id FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job history from orders."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "unix_timestamp(TIMESTAMP'2024-01-01 00:00:00') + 1800L * datediff(o_orderdate, DATE'1995-01-01') + o_orderkey % 1800 AS QDate",
        "(o_orderkey * 7919) % 200000 AS wait", "(o_custkey * 131) % 86400 AS run",
    )
    return base.selectExpr(
        "o_orderkey AS ClusterId", "CAST(0 AS BIGINT) AS ProcId", "QDate", "QDate + wait AS JobStartDate", "QDate + wait DIV 2 AS FirstjobmatchDate", "QDate + wait AS JobCurrentStartDate",
        "QDate + wait + run AS CompletionDate", "QDate + wait + run AS RecordTime", "CAST(wait AS DOUBLE) AS initialwaitduration", "CAST(1 + o_orderkey % 3 AS DOUBLE) AS RequestGpus",
        "CAST(run AS DOUBLE) AS RemoteWallClockTime", "concat('user', o_custkey % 40) AS Owner", "concat('user', o_custkey % 40, '@domain') AS User", "concat('Proj', o_custkey % 12) AS ProjectName",
        "concat('host', o_custkey % 25) AS StartdName", "concat('slot1_', 1 + o_orderkey % 4, '@host', o_custkey % 25) AS StartdSlot", "concat('GPU-', lower(hex(o_custkey % 100 + 4096))) AS AssignedGPUs",
        "o_custkey % 3 = 0 AS Prioritized",
    )


JOBS_SQL = """jobs0 AS (SELECT o_orderkey, o_custkey, CAST(1704067200 + 1800 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 1800 AS BIGINT) AS QDate,
  CAST((o_orderkey * 7919) % 200000 AS BIGINT) AS wait, CAST((o_custkey * 131) % 86400 AS BIGINT) AS run FROM orders),
jobs AS (SELECT o_orderkey AS ClusterId, CAST(0 AS BIGINT) AS ProcId, QDate, QDate + wait AS JobStartDate, QDate + wait // 2 AS FirstjobmatchDate, QDate + wait AS JobCurrentStartDate,
  QDate + wait + run AS CompletionDate, QDate + wait + run AS RecordTime, CAST(wait AS DOUBLE) AS initialwaitduration, CAST(1 + o_orderkey % 3 AS DOUBLE) AS RequestGpus,
  CAST(run AS DOUBLE) AS RemoteWallClockTime, 'user' || (o_custkey % 40) AS Owner, 'user' || (o_custkey % 40) || '@domain' AS "User", 'Proj' || (o_custkey % 12) AS ProjectName,
  'host' || (o_custkey % 25) AS StartdName, 'slot1_' || (1 + o_orderkey % 4) || '@host' || (o_custkey % 25) AS StartdSlot, 'GPU-' || lower(to_hex(o_custkey % 100 + 4096)) AS AssignedGPUs,
  o_custkey % 3 = 0 AS Prioritized FROM jobs0)"""


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, text): an event log for every order, some evicted once or twice and started again."""
    stamp = lambda s: f"date_format(timestamp_seconds({s}), 'yyyy-MM-dd HH:mm:ss')"
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS c", "o_custkey AS u", "unix_timestamp(TIMESTAMP'2024-01-01 00:00:00') + 1800L * datediff(o_orderdate, DATE'1995-01-01') + o_orderkey % 1800 AS t0",
        "lower(hex(o_custkey % 100 + 4096)) AS g", "CASE o_custkey % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(DEVICES)) + " END AS dev",
    ).selectExpr("*", "t0 + 60 AS s1", "t0 + 60 + (c % 7 + 1) * 600 AS e1", "t0 + 180 + (c % 7 + 1) * 600 AS s2", "t0 + 1080 + (c % 7 + 1) * 600 AS e2")
    id_ = "concat('(', c, '.0.0) ')"
    parts = [
        f"concat('000 ', {id_}, {stamp('t0')}, ' Job submitted')",
        f"concat('001 ', {id_}, {stamp('s1')}, ' Job executing on host: <10.0.0.1:9618?alias=host', u % 25, '.pool&x=1>')",
        "concat('\\tSlotName: slot1_', 1 + c % 4, '@host', u % 25, '.pool')", "concat('\\tAvailableGPUs = { GPUs_GPU_', g, ' }')", "concat('\\tGPUs_GPU_', g, ' = [ DeviceName = \"', dev, '\"; ]')", "'...'",
        f"CASE WHEN u % 3 = 0 THEN concat('004 ', {id_}, {stamp('e1')}, ' Job was evicted. Code 1 Subcode 2') END",
        f"CASE WHEN u % 3 = 0 THEN concat('001 ', {id_}, {stamp('s2')}, ' Job executing on host: <10.0.0.2:9618?alias=host', (u + 1) % 25, '.pool>') END",
        f"CASE WHEN u % 6 = 0 THEN concat('004 ', {id_}, {stamp('e2')}, ' Job was evicted. Code 2 Subcode 0') END",
        f"CASE WHEN c % 4 != 0 THEN concat('005 ', {id_}, {stamp('t0 + 20000')}, ' Job terminated.\\n\\t(1) Normal termination (return value 0)') END",
    ]
    name = "CASE WHEN c % 70 = 0 THEN concat('job', c, '.log') WHEN c % 30 = 0 THEN concat(c, '_0.log') ELSE concat(1 + c % 3, '_', (c % 4) * 10, '_', 70 + (c % 3) * 10, '_', c, '_0.log') END"
    return base.selectExpr(f"{name} AS log", "concat_ws('\\n', " + ", ".join(parts) + ") AS text")


LOGS_SQL = f"""lg AS (SELECT o_orderkey AS c, o_custkey AS u, CAST(1704067200 + 1800 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 1800 AS BIGINT) AS t0,
  lower(to_hex(o_custkey % 100 + 4096)) AS g, CASE o_custkey % 5 {" ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(DEVICES))} END AS dev,
  CASE WHEN o_orderkey % 70 = 0 THEN 'job' || o_orderkey || '.log' WHEN o_orderkey % 30 = 0 THEN o_orderkey || '_0.log' ELSE (1 + o_orderkey % 3) || '_' || ((o_orderkey % 4) * 10) || '_' || (70 + (o_orderkey % 3) * 10) || '_' || o_orderkey || '_0.log' END AS log FROM orders),
st AS (SELECT log, make_timestamp((t0 + 60) * 1000000) AS at, 'host' || (u % 25) || '.pool' AS host, 'slot1_' || (1 + c % 4) || '@host' || (u % 25) || '.pool' AS slot, g AS gpu, dev AS device FROM lg
  UNION ALL SELECT log, make_timestamp((t0 + 180 + (c % 7 + 1) * 600) * 1000000), 'host' || ((u + 1) % 25) || '.pool', 'Unknown', 'Unknown', 'Unknown' FROM lg WHERE u % 3 = 0),
ru AS (SELECT log, make_timestamp((t0 + 60 + (c % 7 + 1) * 600) * 1000000) AS at, CAST(1 AS BIGINT) AS code, 'host' || (u % 25) || '.pool' AS host, 'slot1_' || (1 + c % 4) || '@host' || (u % 25) || '.pool' AS slot, g AS gpu, dev AS device, CAST((c % 7 + 1) * 600 AS BIGINT) AS runtime FROM lg WHERE u % 3 = 0
  UNION ALL SELECT log, make_timestamp((t0 + 1080 + (c % 7 + 1) * 600) * 1000000), 2, 'host' || ((u + 1) % 25) || '.pool', 'Unknown', 'Unknown', 'Unknown', 900 FROM lg WHERE u % 6 = 0),
nm AS (SELECT log, CASE WHEN c % 70 != 0 AND c % 30 != 0 THEN CAST(1 + c % 3 AS VARCHAR) END AS gpus, CASE WHEN c % 70 != 0 AND c % 30 != 0 THEN CAST((c % 4) * 10 AS VARCHAR) END AS sleep, CASE WHEN c % 70 != 0 AND c % 30 != 0 THEN CAST(70 + (c % 3) * 10 AS VARCHAR) END AS capability, c AS cluster, CAST(0 AS BIGINT) AS proc FROM lg)"""
