"""Queries over sources, sinks and streams of data that Spark derives from the tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slotscope.operators import allocation
from slotscope.operators import queue as q
from slotscope.plans import fixtures as x
from slotscope.plans.allocation import rounded
from slotscope.schema import SLOTS
from slotscope.sources import jobs as src
from slotscope.sources import config, snapshots
from slotscope.streaming import streams


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share; a temporary one where none is named and all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    base = base or f"file:///tmp/spark-{uuid.uuid4().hex}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "slots")
    snapshots.append(x.slots(spark, sf_dir), path)
    return path


def stored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by month, read back by window."""
    rows = snapshots.scan(spark, _stored(spark, sf_dir), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 12))
    return rows.groupBy("Machine", "State").agg(F.count(F.lit(1)).alias("n"))


def tolerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a window from stored snapshots beside a file that is no Parquet file, one without rows and one that isn't there: (Machine, n), the warnings as null."""
    path, odd = _folder(spark, "slots"), _folder(spark, "odd")
    x.slots(spark, sf_dir).write.parquet(path)
    x.slots(spark, sf_dir).limit(0).coalesce(1).write.parquet(f"{odd}/empty")
    x.slots(spark, sf_dir).select("Name").limit(3).coalesce(1).write.text(f"{odd}/text")
    rows, warnings = snapshots.tolerant(spark, [path, f"{odd}/empty", f"{odd}/text", f"{odd}/nothing"], dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5))
    counts = rows.groupBy("Machine").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(warnings.agg(F.lit(None).cast("string").alias("Machine"), F.count(F.lit(1)).alias("n")))


def monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a month's report over snapshots stored by month, as one frame.

    The parts stay persisted, as the caller has the frame still to compute; Spark drops them with the session.
    """
    path = _folder(spark, "months")
    snapshots.append(x.slots(spark, sf_dir).withColumn("timestamp", F.expr("timestamp + interval 28 days")), path)
    report = allocation.monthly_report(spark, path, x.OWNED, x.EXCLUDED)
    return rounded(report.table())


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts beside what configuration files, written from the tables, and an inline list say of them."""
    machines = x.slots(spark, sf_dir).select("Machine").distinct()
    owned, masked = _folder(spark, "owned"), _folder(spark, "masked")
    lines = F.explode(F.array(F.concat(F.lit("  "), "Machine", F.lit(" ")), F.lit("")))
    machines.where("Machine rlike '[37]$'").select(lines).write.text(owned)
    listed = F.explode(F.array(F.lit("excluded_hosts:"), F.concat(F.lit("  "), "Machine", F.lit(": kept out as "), "Machine")))
    machines.where("Machine rlike '1'").select(listed).write.text(masked)
    reasons = config.host_exclusions(spark, masked, "host12:inline,host4").withColumnRenamed("pattern", "Machine")
    mine = config.owned_hosts(spark, owned).withColumn("owned", F.lit(True))
    return machines.join(mine, "Machine", "left").join(reasons, "Machine", "left").select("Machine", F.coalesce("owned", F.lit(False)).alias("owned"), "reason")


def _advertised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.slots(spark, sf_dir).where("AssignedGPUs is not null")
    listed = F.array(F.concat(F.lit("GPUs_GPU_"), F.substring_index("AssignedGPUs", "-", -1)), F.concat(F.lit("GPUs_GPU_x"), F.substring_index("Machine", "t", -1)))
    ads = rows.withColumn("AvailableGPUs", listed).withColumn("AssignedGPUs", F.concat("AssignedGPUs", F.lit(", GPU_y")))
    return ads.select("Name", "Machine", "State", "AvailableGPUs", "AssignedGPUs")


def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertisements that arrive as files, streamed into a month-partitioned table and read back."""
    ads, path = _folder(spark, "ads"), _folder(spark, "ingested")
    _advertised(spark, sf_dir).repartition(4).write.parquet(ads)
    stream = streams.read(spark, ads, spark.read.parquet(ads).schema, files_per_trigger=2)
    streams.ingest(stream, path, _folder(spark, "ingest-checkpoint")).awaitTermination()
    return snapshots.read(spark, path).groupBy("Machine", "AssignedGPUs").agg(F.count(F.lit(1)).alias("n"))


def stream_live_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval that each job is in after the last batch of sightings."""
    path = _folder(spark, "live")
    x.sightings(spark, sf_dir).select("GlobalJobId", F.timestamp_seconds("seen").alias("seen")).repartitionByRange(4, "seen").write.parquet(path)
    rows = spark.readStream.schema("GlobalJobId string, seen timestamp").parquet(path)
    name = f"live_{uuid.uuid4().hex}"
    out = streams.drain(streams.live_intervals(rows), name, _folder(spark, "live-checkpoint"), "update")
    return out.groupBy("GlobalJobId").agg(F.max_by("first_seen", "last_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy rows with text times, some bad, through the import."""
    text = F.when(F.length("Name") % 7 == 0, "bad").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    path = _folder(spark, "legacy")
    snapshots.import_text(x.slots(spark, sf_dir).withColumn("timestamp", text).select("timestamp", "State", "Machine", "Name"), path)
    return snapshots.read(spark, path).groupBy("Machine").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("timed"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertisements with lists of devices, one row a device."""
    out = snapshots.ingest(_advertised(spark, sf_dir), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    return out.groupBy("Machine", "AssignedGPUs").agg(F.count(F.lit(1)).alias("n"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job history written as CSV with chosen columns and read by name."""
    path = _folder(spark, "jobs")
    columns = ("RecordTime", "ClusterId", "RequestGpus", "Owner", "StartdName")
    src.write_csv(x.jobs(spark, sf_dir), path, columns)
    rows = src.device_jobs(src.read_csv(spark, path), 1705000000, 1706000000)
    return rows.groupBy("StartdName", "ProjectName").agg(F.count(F.lit(1)).alias("jobs"), F.sum("RequestGpus").alias("gpus"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs written as text files and read back whole."""
    path = _folder(spark, "logs")
    x.job_logs(spark, sf_dir).select("text").repartition(8).write.option("lineSep", "\n\n").text(path)
    return src.read_logs(spark, path, "*.txt").select(F.size(F.filter(F.split("text", "\n"), lambda z: F.startswith(z, F.lit("001 (")))).alias("n")).agg(F.sum("n").alias("starts"))


def poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll over stored intervals: jobs seen in the last day are extended or opened anew."""
    now = 1706000000
    intervals = q.merge_sightings(x.sightings(spark, sf_dir).where(F.col("seen") <= now))
    polled = x.sightings(spark, sf_dir).where(F.col("seen").between(now - 86400, now)).groupBy("GlobalJobId").agg(F.min("Owner").alias("Owner"), F.min("RequestGPUs").alias("RequestGPUs"), F.min("Project").alias("Project"))
    return q.upsert_intervals(intervals, polled, now)


#: Rows of a slice of a stream for each core, and the minutes of a bucket, which no slice divides.
SLICE_ROWS, BUCKET = 1_000_000, 15


def _slices(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> tuple[str, list[int]]:
    """Slot snapshots as files in slices of whole buckets, one after another in time: their folder and numbers.

    A slice has about as many rows as the cores can hold the state of; each ends with a later row, which
    closes all its buckets. Counts of buckets make the slices, so the rows are read twice and not shuffled.
    """
    path, cuts = _folder(spark, "stream"), _folder(spark, "cuts")
    bucket = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / (60 * BUCKET)).alias("bucket")
    slots = x.slots(spark, sf_dir).select("timestamp", "AssignedGPUs", *columns).where("timestamp is not null").withColumn("bucket", bucket)
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    counts = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))
    counts.select("bucket", "last", F.floor(rows / (SLICE_ROWS * spark.sparkContext.defaultParallelism)).alias("slice")).write.parquet(cuts)
    found = spark.read.parquet(cuts)
    ends = found.groupBy("slice").agg((F.max("last") + F.expr("INTERVAL 1 DAY")).alias("timestamp"), F.lit("GPU-end").alias("AssignedGPUs"))
    placed = slots.join(F.broadcast(found.select("bucket", "slice")), "bucket").drop("bucket")
    placed.unionByName(ends, allowMissingColumns=True).write.partitionBy("slice").parquet(path)
    return path, sorted(r["slice"] for r in found.select("slice").distinct().collect())


def _sliced(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``query`` gives over the stream of slots, with these columns beside time and device. Its buckets are the same in slices as at once.

    State is that of one slice: it goes with the slice's last bucket, and its files when the slice has ended.
    """
    path, slices = _slices(spark, sf_dir, columns)
    schema = StructType([f for f in SLOTS if f.name in {"timestamp", "AssignedGPUs", *columns}])
    stream = lambda folder: query(streams.read(spark, folder, schema, files_per_trigger=2**31 - 1))
    held = "spark.sql.streaming.maxBatchesToRetainInMemory"
    before = spark.conf.get(held)
    spark.conf.set(held, "1")  # a slice's batch is not kept beside the one that closes it
    try:
        parts = [_drained(spark, stream(f"{path}/slice={k}"), ended=(f"{path}/slice={k}",)) for k in slices]
    finally:
        spark.conf.set(held, before)
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], stream(path).schema)
    return rows.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append", ended: tuple[str, ...] = ()) -> DataFrame:
    """A finite stream's result from a file sink, so that no result passes through the driver. Its checkpoint and the folders ``ended`` go afterwards."""
    out, ck = _folder(spark, "out"), _folder(spark, "ck")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    for folder in (ck, *ended):
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(stream.schema).parquet(out)


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners and their states by bucket, from a stream that later rows close."""
    columns = ("Name", "State")
    return _sliced(spark, sf_dir, (*columns, "PreventJobsReason"), lambda s: streams.bucket_counts(streams.winners(s, kept=columns), BUCKET))


def stream_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir, ("State",), lambda s: streams.distinct_devices(s, BUCKET))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "sightings")
    seen = x.sightings(spark, sf_dir).select("GlobalJobId", F.timestamp_seconds("seen").alias("seen"))
    seen.repartitionByRange(4, "seen").write.parquet(path)
    last = seen.agg(F.lit("end").alias("GlobalJobId"), (F.max("seen") + F.expr("INTERVAL 1 DAY")).alias("seen")).where("seen is not null")
    last.write.mode("append").parquet(path)  # closes all sessions
    rows = spark.readStream.schema("GlobalJobId string, seen timestamp").parquet(path)
    out = _drained(spark, streams.idle_intervals(rows))
    s = lambda k: F.unix_timestamp(k).alias(k)
    return out.select("GlobalJobId", s("first_seen"), s("last_seen"), "sightings")


_SESSIONS = f"""WITH {x.SIGHTINGS_SQL}, n AS (SELECT *, coalesce(CAST(seen - lag(seen) OVER w > 5400 AS INTEGER), 1) AS new FROM sightings WINDOW w AS (PARTITION BY GlobalJobId ORDER BY seen, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY GlobalJobId ORDER BY seen, event_id) AS island FROM n)
SELECT GlobalJobId, min(seen) AS first_seen, max(seen) AS last_seen, count(*) AS sightings FROM i GROUP BY GlobalJobId, island"""
_NOW = x.SIGHTINGS_SQL.replace("FROM events)", "FROM events WHERE CAST(floor(epoch(ts)) AS BIGINT) <= 1706000000)")
_POLL = f"""WITH {_NOW}, n AS (SELECT *, coalesce(CAST(seen - lag(seen) OVER w > 5400 AS INTEGER), 1) AS new FROM sightings WINDOW w AS (PARTITION BY GlobalJobId ORDER BY seen, Owner, RequestGPUs, Project)),
i AS (SELECT *, sum(new) OVER (PARTITION BY GlobalJobId ORDER BY seen, Owner, RequestGPUs, Project ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY GlobalJobId ORDER BY seen, Owner, RequestGPUs, Project) AS rn FROM n),
iv AS (SELECT GlobalJobId, arg_min(Owner, rn) AS Owner, arg_min(RequestGPUs, rn) AS RequestGPUs, arg_min(Project, rn) AS Project, min(seen) AS first_seen, max(seen) AS last_seen FROM i GROUP BY GlobalJobId, island),
po AS (SELECT GlobalJobId, min(Owner) AS Owner, min(RequestGPUs) AS RequestGPUs, min(Project) AS Project FROM sightings WHERE seen >= 1706000000 - 86400 GROUP BY 1),
op AS (SELECT GlobalJobId, max(first_seen) AS f FROM iv WHERE last_seen >= 1706000000 - 5400 GROUP BY 1)
SELECT iv.GlobalJobId, Owner, RequestGPUs, Project, first_seen, CASE WHEN op.f = first_seen AND iv.GlobalJobId IN (SELECT GlobalJobId FROM po) THEN 1706000000 ELSE last_seen END AS last_seen FROM iv LEFT JOIN op ON op.GlobalJobId = iv.GlobalJobId
UNION ALL SELECT GlobalJobId, Owner, RequestGPUs, Project, 1706000000, 1706000000 FROM po WHERE GlobalJobId NOT IN (SELECT GlobalJobId FROM op)"""

QUERIES = {
    "s3_s6_stored_window": stored_window,
    "s4_imported_rows": imported,
    "s7_tolerant_load": tolerated,
    "a16_monthly_report": monthly_report,
    "s5_ingested_rows": ingested,
    "s9_s10_csv_round_trip": csv_round_trip,
    "s11_log_files": log_files,
    "p1_poll_upsert": poll,
    "s8_configuration": configured,
    "x1_stream_ingest": stream_ingested,
    "x6_live_intervals": stream_live_intervals,
    "x2_x3_stream_buckets": stream_buckets,
    "x4_stream_devices": stream_devices,
    "x5_stream_sessions": stream_sessions,
}

ORACLE_SQL = {
    "s3_s6_stored_window": f"WITH {x.SLOTS_SQL} SELECT Machine, State, count(*) AS n FROM slots WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 12:00:00' GROUP BY ALL",
    "s7_tolerant_load": f"WITH {x.SLOTS_SQL} SELECT Machine, count(*) AS n FROM slots WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05' GROUP BY Machine UNION ALL SELECT NULL, 2",
    "s4_imported_rows": f"WITH {x.SLOTS_SQL} SELECT Machine, count(*) AS n, count(*) FILTER (length(Name) % 7 != 0) AS timed FROM slots GROUP BY Machine",
    "s5_ingested_rows": f"WITH {x.RAW_SQL}, k AS (SELECT Machine, unnest(CASE WHEN is_bf THEN [AssignedGPUs, 'GPU-x' || substr(Machine, 5)] ELSE [AssignedGPUs, 'GPU-y'] END) AS AssignedGPUs FROM raw WHERE AssignedGPUs IS NOT NULL) SELECT Machine, AssignedGPUs, count(*) AS n FROM k GROUP BY ALL",
    "s9_s10_csv_round_trip": f"WITH {x.JOBS_SQL} SELECT StartdName, 'UNKNOWN' AS ProjectName, count(*) AS jobs, sum(RequestGpus) AS gpus FROM jobs WHERE RequestGpus > 0 AND RecordTime >= 1705000000 AND RecordTime < 1706000000 GROUP BY 1",
    "s11_log_files": f"WITH {x.LOGS_SQL} SELECT count(*) AS starts FROM st",
    "p1_poll_upsert": _POLL,
    "x2_x3_stream_buckets": f"WITH {x.RAW_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY timestamp, AssignedGPUs ORDER BY {x.RANK_SQL.format(prev='prev_idle')} DESC, {x.TIES_SQL}) AS rn FROM raw WHERE AssignedGPUs IS NOT NULL) SELECT bucket, State, count(*) AS rows FROM d WHERE rn = 1 GROUP BY ALL",
    "x4_stream_devices": f"WITH {x.RAW_SQL} SELECT bucket, count(DISTINCT AssignedGPUs) AS total, count(DISTINCT AssignedGPUs) FILTER (State = 'Claimed') AS claimed FROM raw WHERE AssignedGPUs IS NOT NULL GROUP BY bucket",
    "x5_stream_sessions": _SESSIONS,
    "s8_configuration": f"""WITH {x.SLOTS_SQL}, m AS (SELECT DISTINCT Machine FROM slots) SELECT Machine, regexp_matches(Machine, '[37]$') AS owned,
      CASE WHEN Machine = 'host12' THEN 'inline' WHEN Machine = 'host4' THEN '' WHEN contains(Machine, '1') THEN 'kept out as ' || Machine END AS reason FROM m""",
    "x6_live_intervals": f"{_SESSIONS.split('SELECT GlobalJobId, min(seen)')[0]}, z AS (SELECT GlobalJobId, island, min(seen) AS first_seen, max(seen) AS last_seen FROM i GROUP BY GlobalJobId, island) SELECT GlobalJobId, arg_max(first_seen, last_seen) AS first_seen, max(last_seen) AS last_seen FROM z GROUP BY GlobalJobId",
}
ORACLE_SQL["x1_stream_ingest"] = ORACLE_SQL["s5_ingested_rows"]
