"""Drained devices and their intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drained(slots: DataFrame) -> DataFrame:
    """(Machine, AssignedGPUs, timestamp) seen drained and not claimed at that time; one shuffle."""
    seen = slots.where("AssignedGPUs is not null and State in ('Drained', 'Claimed')").groupBy("Machine", "AssignedGPUs", "timestamp").agg(F.max(F.col("State") == "Drained").alias("d"), F.max(F.col("State") == "Claimed").alias("c"))
    return seen.where("d and not c").select("Machine", "AssignedGPUs", "timestamp")


def drain_intervals(points: DataFrame, gap_minutes: int = 20, single_minutes: int = 15) -> DataFrame:
    """Intervals of each device: a new one after a gap over ``gap_minutes``; a single point lasts ``single_minutes``."""
    w = Window.partitionBy("Machine", "AssignedGPUs").orderBy("timestamp")
    s = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    new = F.coalesce((s - F.lag(s).over(w) > gap_minutes * 60).cast("int"), F.lit(1))
    islands = points.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    spans = islands.groupBy("Machine", "AssignedGPUs", "island").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("last"))
    end = F.when(F.col("start") == F.col("last"), F.col("start") + F.make_dt_interval(mins=F.lit(single_minutes))).otherwise(F.col("last")).cast("timestamp_ntz")
    out = spans.select("Machine", "AssignedGPUs", "start", end.alias("end"))
    hours = (F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / 3600.0
    return out.withColumn("hours", hours)


def drain_rollup(intervals: DataFrame) -> DataFrame:
    """Totals (nulls), by host and by device: hosts, devices, intervals, hours, mean hours."""
    return intervals.rollup("Machine", "AssignedGPUs").agg(F.count_distinct("Machine").alias("hosts"), F.count_distinct(F.struct("Machine", "AssignedGPUs")).alias("gpus"), F.count(F.lit(1)).alias("intervals"), F.sum("hours").alias("hours"), F.avg("hours").alias("mean_hours"))
