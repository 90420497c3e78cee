"""Intervals, gaps, pressure and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slotscope.operators import draining as g
from slotscope.operators import jobs as j
from slotscope.operators import logs as lo
from slotscope.operators import queue as q
from slotscope.operators import trends as w
from slotscope.streaming import streams

T0 = dt.datetime(2024, 1, 1, 10, 0)


def minutes(*ms):
    return [T0 + dt.timedelta(minutes=m) for m in ms]


def test_drain_gap_is_strict_and_a_point_lasts(spark):
    rows = [("m", "G", t) for t in minutes(0, 20, 40, 61, 200)]
    got = g.drain_intervals(spark.createDataFrame(rows, "Machine string, AssignedGPUs string, timestamp timestamp_ntz")).orderBy("start").collect()
    assert [(r["start"], r["hours"]) for r in got] == [(T0, 40 / 60), (minutes(61)[0], 0.25), (minutes(200)[0], 0.25)]


def test_claimed_cancels_drained_at_the_same_time_only(spark):
    rows = [("m", "G", T0, "Drained"), ("m", "G", T0, "Claimed"), ("m", "G", minutes(5)[0], "Drained")]
    got = g.drained(spark.createDataFrame(rows, "Machine string, AssignedGPUs string, timestamp timestamp_ntz, State string")).collect()
    assert [r["timestamp"] for r in got] == minutes(5)


def test_queue_gap_is_inclusive_and_the_first_attributes_stay(spark):
    rows = [("j", "a", 1.0, "p", 0), ("j", "b", 2.0, "p", 5400), ("j", "c", 1.0, "p", 10801)]
    got = q.merge_sightings(spark.createDataFrame(rows, "GlobalJobId string, Owner string, RequestGPUs double, Project string, seen bigint")).orderBy("first_seen").collect()
    assert [(r["Owner"], r["first_seen"], r["last_seen"]) for r in got] == [("a", 0, 5400), ("c", 10801, 10801)]


def test_pressure_counts_every_bucket_touched(spark):
    rows = [("j", "u", 2.0, "P", 900, 1800), ("k", "", 1.0, "P", 0, 10)]
    got = q.pressure(spark.createDataFrame(rows, "GlobalJobId string, Owner string, RequestGPUs double, Project string, first_seen bigint, last_seen bigint"), 0, 3600).collect()
    assert {(r["bucket"], r["owner"], r["queued_gpus"]) for r in got} == {(900, "u", 2.0), (1800, "u", 2.0), (0, "Unknown", 1.0)}


def test_poll_extends_or_opens(spark):
    rows = spark.createDataFrame([("a", "u", 1.0, "p", 0, 100), ("b", "u", 1.0, "p", 0, 10)], "GlobalJobId string, Owner string, RequestGPUs double, Project string, first_seen bigint, last_seen bigint")
    polled = spark.createDataFrame([("a", "u", 1.0, "p"), ("b", "u", 1.0, "p"), ("c", "u", 1.0, "p")], "GlobalJobId string, Owner string, RequestGPUs double, Project string")
    got = {(r["GlobalJobId"], r["first_seen"], r["last_seen"]) for r in q.upsert_intervals(rows, polled, 5500).collect()}
    assert got == {("a", 0, 5500), ("b", 0, 10), ("b", 5500, 5500), ("c", 5500, 5500)}


def test_gini(spark):
    of = lambda *xs: q.gini(spark.createDataFrame([(f"u{i}", float(x)) for i, x in enumerate(xs)], "user string, gpu_hours double")).first()["gini"]
    assert of(5) == 0.0
    assert of(1, 1, 1) == 0.0
    assert abs(of(0, 0, 0, 4) - 0.75) < 1e-12


def test_interval_hours_end_with_the_gap_before(spark):
    rows = spark.createDataFrame([("k", t, 2) for t in minutes(0, 5, 20)] + [("z", T0, 1)], "kind string, timestamp timestamp_ntz, n int")
    got = sorted((r["kind"], r["h"]) for r in rows.withColumn("h", w.interval_hours(rows, ("kind",), 0.25)).collect())
    assert got == [("k", 5 / 60), ("k", 0.25), ("k", 0.25), ("z", 0.25)]


def test_student_tail():
    assert abs(w.student_p(2.0, 10) - 0.07338803477074) < 1e-9
    assert abs(w.student_p(0.0, 5) - 1.0) < 1e-12


def test_idle_gaps_look_at_all_earlier_jobs(spark):
    rows = [("h", 0, 36000), ("h", 3600, 7200), ("h", 43200, 46800)]
    got = j.idle_gaps(spark.createDataFrame(rows, "StartdName string, JobStartDate bigint, CompletionDate bigint"), "h").collect()
    assert [r["hours"] for r in got] == [2.0]


def test_log_parsing_and_as_of_start(spark):
    text = "\n".join([
        "001 (7.0.0) 2024-01-01 00:00:00 Job executing on host: <1.1.1.1?alias=h1.pool&a=b>", "\tSlotName: slot1_2@h1.pool", "\tAvailableGPUs = { GPUs_GPU_ab GPUs_GPU_cd }",
        '\tGPUs_GPU_cd = [ DeviceName = "X" ]', '\tGPUs_GPU_ab = [ DeviceName = "Y" ]', "004 (7.0.0) 2024-01-01 01:00:00 Job was evicted. Code 3 Subcode 0",
    ])
    early = "004 (8.0.0) 2024-01-01 00:00:00 Job was evicted. Code 1 Subcode 0\n001 (8.0.0) 2024-01-01 00:10:00 Job executing on host: <1.1.1.1?alias=h2>"
    logs = spark.createDataFrame([("1_2_80_7_0.log", text), ("8_0.log", early), ("x.log", "")], "log string, text string")
    got = {r["log"]: r for r in lo.evicted_runs(logs).collect()}
    assert (got["1_2_80_7_0.log"]["device"], got["1_2_80_7_0.log"]["slot"], got["1_2_80_7_0.log"]["runtime"], got["1_2_80_7_0.log"]["code"]) == ("Y", "slot1_2@h1.pool", 3600, 3)
    assert (got["8_0.log"]["host"], got["8_0.log"]["gpu"], got["8_0.log"]["runtime"]) == ("h2", "Unknown", -600)
    assert {r["log"]: (r["gpus"], r["cluster"]) for r in lo.identity(logs).collect()} == {"1_2_80_7_0.log": ("1", 7), "8_0.log": (None, 8), "x.log": (None, None)}


def test_live_intervals_forget_and_reopen(spark, tmp_path):
    rows = spark.createDataFrame([("a", t) for t in minutes(0, 30, 60)] + [("b", T0)], "GlobalJobId string, seen timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("GlobalJobId string, seen timestamp").parquet(str(tmp_path / "in"))
    got = streams.drain(streams.live_intervals(stream), "live_intervals_test", str(tmp_path / "ck"), "update").collect()
    assert {r["GlobalJobId"]: r["last_seen"] - r["first_seen"] for r in got} == {"a": 3600, "b": 0}


def test_stream_sessions_equal_batch_intervals(spark, tmp_path):
    rows = spark.createDataFrame([("a", t) for t in minutes(0, 90, 181)] + [("z", t) for t in minutes(5000)], "GlobalJobId string, seen timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("GlobalJobId string, seen timestamp").parquet(str(tmp_path / "in"))
    got = streams.drain(streams.idle_intervals(stream), "sessions_test", str(tmp_path / "ck")).where("GlobalJobId = 'a'").orderBy("first_seen").collect()
    batch = q.merge_sightings(rows.where("GlobalJobId = 'a'").select("GlobalJobId", F.lit("o").alias("Owner"), F.lit(1.0).alias("RequestGPUs"), F.lit("p").alias("Project"), F.unix_timestamp("seen").alias("seen"))).orderBy("first_seen").collect()
    assert [(int(r["first_seen"].timestamp()), int(r["last_seen"].timestamp())) for r in got] == [(r["first_seen"], r["last_seen"]) for r in batch]
