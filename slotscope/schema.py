"""Schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Slot snapshots: one row for each (slot, device) and snapshot time. Null and '' projects differ.
SLOTS = T.StructType(
    [
        T.StructField("Name", T.StringType()),
        T.StructField("AssignedGPUs", T.StringType()),
        T.StructField("AvailableGPUs", T.StringType()),
        T.StructField("State", T.StringType()),
        T.StructField("GPUs_DeviceName", T.StringType()),
        T.StructField("GPUs_GlobalMemoryMb", T.LongType()),
        T.StructField("PrioritizedProjects", T.StringType()),
        T.StructField("GPUsAverageUsage", T.DoubleType()),
        T.StructField("Machine", T.StringType()),
        T.StructField("RemoteOwner", T.StringType()),
        T.StructField("GlobalJobId", T.StringType()),
        T.StructField("PreventJobsReason", T.StringType()),
        T.StructField("Disk", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

#: Intervals in which a queued job was seen (epoch seconds).
INTERVALS = T.StructType(
    [
        T.StructField("GlobalJobId", T.StringType(), False),
        T.StructField("ScheddName", T.StringType()),
        T.StructField("Owner", T.StringType()),
        T.StructField("RequestGPUs", T.DoubleType()),
        T.StructField("RequestCPUs", T.DoubleType()),
        T.StructField("RequestMemory", T.DoubleType()),
        T.StructField("RequestGPUMemory", T.DoubleType()),
        T.StructField("QDate", T.LongType()),
        T.StructField("Project", T.StringType()),
        T.StructField("first_seen", T.LongType(), False),
        T.StructField("last_seen", T.LongType(), False),
    ]
)

#: Finished jobs (epoch seconds, durations in seconds).
JOBS = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("ClusterId", "ProcId", "QDate", "JobStartDate", "FirstjobmatchDate", "JobCurrentStartDate", "CompletionDate", "RecordTime")],
        *[T.StructField(c, T.DoubleType()) for c in ("initialwaitduration", "RequestGpus", "RemoteWallClockTime")],
        *[T.StructField(c, T.StringType()) for c in ("Owner", "User", "ProjectName", "StartdName", "StartdSlot", "AssignedGPUs")],
        T.StructField("Prioritized", T.BooleanType()),
    ]
)
