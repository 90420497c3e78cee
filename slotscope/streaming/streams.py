"""Streams of slot snapshots and queue sightings. Event time is TIMESTAMP in UTC."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from slotscope.functions import derive as d
from slotscope.operators import classify as c
from slotscope.schema import SLOTS
from slotscope.sources import snapshots

LATE = "1 hour"


def read(spark: SparkSession, path: str, schema: StructType = SLOTS, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(ads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Slot advertisements to a month-partitioned table."""
    rows = snapshots.with_month(snapshots.ingest(ads))
    return rows.writeStream.format("parquet").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def winners(slots: DataFrame, late: str = LATE, kept: Sequence[str] = c.KEPT) -> DataFrame:
    """(time window, device, winning row): dedup by the canonical rank per 5-minute window.

    ``kept`` is the start of ``KEPT`` that the state holds of a row; ties are settled in that order, so
    what it holds is the same as of whole rows.
    """
    if tuple(kept) != c.KEPT[: len(kept)]:
        raise ValueError(f"kept must be the first of {c.KEPT}, not {tuple(kept)}")
    rows = slots.where("AssignedGPUs is not null").withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    rank = c.slot_rank(d.is_backfill(F.col("Name")), F.col("State"), d.prevented_idle(F.col("PreventJobsReason"), F.col("State")))
    top = F.max(F.struct(rank.alias("rank"), *kept)).alias("top")
    return rows.groupBy(F.window("ts", "5 minutes").alias("w"), "AssignedGPUs").agg(top).select("w", "AssignedGPUs", "top.*")


def bucket_counts(won: DataFrame, minutes: int = 15) -> DataFrame:
    """(bucket, State, rows) of winners: a second stateful stage over the first's windows."""
    counts = won.groupBy(F.window("w", f"{minutes} minutes").alias("b"), "State").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(F.col("b.start").alias("bucket"), "State", "rows")


def distinct_devices(slots: DataFrame, minutes: int = 15, late: str = LATE) -> DataFrame:
    """(bucket, total, claimed): exact distinct devices, by grouping by device first."""
    rows = slots.where("AssignedGPUs is not null").withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    device = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "AssignedGPUs").agg(F.max((F.col("State") == "Claimed").cast("int")).alias("c"))
    counts = device.groupBy(F.window("w", f"{minutes} minutes").alias("b")).agg(F.count(F.lit(1)).alias("total"), F.sum("c").alias("claimed"))
    return counts.select(F.col("b.start").alias("bucket"), "total", "claimed")


def idle_intervals(sightings: DataFrame, gap: str = "90 minutes", late: str = LATE) -> DataFrame:
    """(GlobalJobId, first_seen, last_seen, sightings): sessions of sightings (GlobalJobId, seen as TIMESTAMP)."""
    rows = sightings.withWatermark("seen", late)
    s = rows.groupBy(F.session_window("seen", gap).alias("w"), "GlobalJobId").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))
    return s.select("GlobalJobId", "first_seen", "last_seen", "sightings")


def live_intervals(sightings: DataFrame, gap_seconds: int = 5400) -> DataFrame:
    """Current interval of every job after each batch: (GlobalJobId, first_seen, last_seen) in epoch seconds.

    State is two numbers a job; a job unseen for the gap is forgotten by timeout.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last = state.get if state.exists else (None, None)
        for t in sorted(int(x) for b in batches for x in b["seen_s"]):
            if last is None or t - last > gap_seconds:
                first = t
            last = t
        state.update((first, last))
        state.setTimeoutTimestamp((last + gap_seconds) * 1000 + 1)
        yield pd.DataFrame({"GlobalJobId": [key[0]], "first_seen": [first], "last_seen": [last]})

    rows = sightings.withWatermark("seen", LATE).withColumn("seen_s", F.unix_timestamp("seen"))
    return rows.groupBy("GlobalJobId").applyInPandasWithState(update, "GlobalJobId string, first_seen bigint, last_seen bigint", "first bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream over the files that are there gives, as a table in memory (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
