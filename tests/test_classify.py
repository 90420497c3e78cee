"""Ranks, dedup, classes and allocation on small frames with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import allocation as a
from slotscope.operators import classify as c
from slotscope.schema import SLOTS

T0 = dt.datetime(2024, 1, 1, 10, 0)


def slot(name, gpu, state, project="", machine="m1", device="NVIDIA H200", at=T0, owner=None, reason=None, mb=143771):
    return {"Name": name, "AssignedGPUs": gpu, "State": state, "PrioritizedProjects": project, "Machine": machine, "GPUs_DeviceName": device, "timestamp": at, "RemoteOwner": owner, "PreventJobsReason": reason, "GPUs_GlobalMemoryMb": mb}


def frame(spark, rows):
    full = [{f.name: r.get(f.name) for f in SLOTS.fields} for r in rows]
    return spark.createDataFrame(full, SLOTS)


@pytest.mark.parametrize(
    ("backfill", "state", "prevented", "rank"),
    [
        (False, "Claimed", False, 6), (False, "Claimed", True, 6), (False, "Unclaimed", False, 5), (False, "Drained", False, 4), (True, "Claimed", False, 3),
        (False, "Unclaimed", True, 2), (False, "Drained", True, 2), (True, "Unclaimed", False, 1), (True, "Unclaimed", True, 1), (True, "Drained", False, 0),
    ],
)
def test_rank_table(spark, backfill, state, prevented, rank):
    row = spark.range(1).select(c.slot_rank(F.lit(backfill), F.lit(state), F.lit(prevented and state != "Claimed")).alias("r")).first()
    assert row["r"] == rank


def test_dedup_keeps_the_primary_of_a_conflict(spark):
    rows = [slot("slot1_1@m1", "G1", "Claimed"), slot("backfill2_1@m1", "G1", "Claimed"), slot("slot1_2@m1", None, "Claimed")]
    got = c.prepare(frame(spark, rows)).dedup.collect()
    assert [(r["AssignedGPUs"], r["Name"], r["rank"]) for r in got] == [("G1", "slot1_1@m1", 6)]


def test_exclusions_take_metacharacters_literally(spark):
    rows = [slot("slot1_1@a", f"G{i}", "Claimed", machine=m) for i, m in enumerate(["node.x", "nodeyx", "HOST(1)", "other", None])]
    raw = c.with_flags(frame(spark, rows), excluded=("node.x", "host(1)"))
    got = {r["Machine"]: r["excluded"] for r in raw.select("Machine", "excluded").collect()}
    assert got == {"node.x": True, "nodeyx": False, "HOST(1)": True, "other": False, None: False}


def test_project_flags_tell_null_from_empty(spark):
    rows = [slot("slot1_1@m1", "G1", "Claimed", project=p) for p in ("", None, "P1,P2")]
    got = c.with_flags(frame(spark, rows)).select("PrioritizedProjects", "prio", "shared").collect()
    assert {(r[0], r[1], r[2]) for r in got} == {("", False, True), (None, True, False), ("P1,P2", True, False)}


def test_whitespace_is_no_reason(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \t\n",), ("INF-1",)], "r string").select("r", d.reason_set(F.col("r")).alias("s")).collect()
    assert {r["r"]: r["s"] for r in rows} == {None: False, "": False, " \t\n": False, "INF-1": True}


def test_unclaimed_keeps_backfill_winners(spark):
    rows = [slot("slot1_1@m1", "G1", "Drained"), slot("backfill2_1@m1", "G2", "Claimed"), slot("slot1_3@m1", "G3", "Unclaimed"), slot("slot1_4@m1", "G4", "Claimed")]
    fr = c.prepare(frame(spark, rows))
    names = lambda s: sorted(r["AssignedGPUs"] for r in c.state_filter(fr, "Shared", s).collect())
    assert names("Unclaimed") == ["G2", "G3"]
    assert names("Claimed") == ["G4"]
    assert names("") == ["G1", "G3", "G4"]


def test_classes_by_ownership(spark):
    rows = [
        slot("slot1_1@m1", "G1", "Claimed", "P", "m1"), slot("slot1_1@m2", "G2", "Claimed", "P", "m2"), slot("slot1_1@m3", "G3", "Claimed", "", "m3"), slot("interactive1_1@m3", "G4", "Claimed", "", "m3"),
        slot("backfill1_1@m1", "G1", "Unclaimed", "", "m1"), slot("backfill1_1@m2", "G2", "Unclaimed", "", "m2"), slot("backfill1_1@m3", "G3", "Unclaimed", "", "m3"),
    ]
    fr = c.prepare(frame(spark, rows), owned=("m2",))
    got = {(r["class"], r["AssignedGPUs"]) for r in c.class_rows(fr).collect()}
    assert got == {("Priority-ResearcherOwned", "G1"), ("Priority-PoolOwned", "G2"), ("Shared", "G3"), ("Backfill-ResearcherOwned", "G1"), ("Backfill-PoolOwned", "G2")}
    assert [r["Machine"] for r in c.open_backfill(fr).collect()] == ["m3"]


def test_allocation_divides_by_all_window_buckets(spark):
    later = T0 + dt.timedelta(minutes=15)
    rows = [slot("slot1_1@m1", "G1", "Claimed"), slot("slot1_2@m1", "G2", "Drained"), slot("slot1_9@x", "G9", "Claimed", machine="x", at=later)]
    got = {r["device"]: r for r in a.by_device(c.prepare(frame(spark, rows), excluded=("x",))).collect()}
    h = got["NVIDIA H200"]
    assert (h["avg_claimed"], h["avg_drained"], h["avg_total_available"]) == (0.5, 0.5, 1.0)
    assert (h["allocation_usage_percent"], h["drained_percent"]) == (50.0, 50.0)


def test_claimed_wins_over_drained_in_a_bucket(spark):
    rows = [slot("slot1_1@m1", "G1", "Drained"), slot("slot1_1@m1", "G1", "Claimed", at=T0 + dt.timedelta(minutes=5))]
    r = a.pair_bucket_stats(c.class_rows(c.prepare(frame(spark, rows))), ("class",)).first()
    assert (r["claimed_sum"], r["drained_sum"], r["total_sum"], r["num_buckets"]) == (1, 0, 1, 1)


def test_empty_owner_counts_as_unknown(spark):
    rows = [slot("slot1_1@m1", "G1", "Claimed", owner=""), slot("slot1_2@m1", "G2", "Claimed", owner="Unknown"), slot("slot1_3@m1", "G3", "Claimed", owner="u@d")]
    got = {r["user"]: r["total"] for r in a.user_totals(c.class_rows(c.prepare(frame(spark, rows)))).collect()}
    assert got == {"Unknown": 2, "u@d": 1}


def test_memory_categories(spark):
    mb = [None, 0, 16384, 44 * 1024, 46068, 51 * 1024, 74 * 1024, 81920, 90 * 1024]
    rows = spark.createDataFrame([(m,) for m in mb], "m bigint").select(d.memory_category_mb(F.col("m")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["Unknown", "Unknown", "<48GB", "48GB", "48GB", "<48GB", "<48GB", "80GB", ">80GB"]


def test_empty_window(spark):
    fr = c.prepare(frame(spark, []))
    assert a.by_device(fr).count() == 0
    assert c.metadata(fr.raw).first()["total"] == 0


def test_states_are_complete_and_disjoint(spark):
    rows = [slot(f"slot1_{i}@m{i % 3}", f"G{i % 7}", s, at=T0 + dt.timedelta(minutes=5 * (i % 4))) for i, s in enumerate(["Claimed", "Unclaimed", "Drained", "Owner"] * 10)]
    fr = c.prepare(frame(spark, rows))
    assert fr.dedup.count() == fr.dedup.select("timestamp", "AssignedGPUs").distinct().count()
    for r in a.pair_bucket_stats(c.class_rows(fr), ("class", "Machine")).collect():
        assert r["claimed_sum"] + r["drained_sum"] <= r["total_sum"]
