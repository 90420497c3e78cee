"""Queries over all of their rows, once cut: against brute force, or their SQL."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql.streaming import StreamingQueryListener

from slotscope.operators import views
from slotscope.plans import feeds
from slotscope.plans import fixtures as x
from slotscope.plans import jobs as plans
from slotscope.streaming import streams

from tests.test_queries import DATA, QUERIES, SQL, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def same(spark, duck, name):  # noqa: F811
    """The query gives the rows of its SQL."""
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    rows = plain(result.fetchall(), names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == rows


def test_idle_gaps_of_all_jobs(spark):
    spans = sorted((r["JobStartDate"], r["CompletionDate"]) for r in x.jobs(spark, DATA).where(f"StartdName = '{plans.HOST}'").collect())
    gaps, until = [], spans[0][1]
    for start, end in spans[1:]:
        if start - until > 3600:
            gaps.append((until, start, round((start - until) / 3600, 6)))
        until = max(until, end)
    got = QUERIES["j18_idle_gaps"](spark, DATA).selectExpr("unix_timestamp(CAST(start AS TIMESTAMP)) AS s", "unix_timestamp(CAST(end AS TIMESTAMP)) AS e", "hours").collect()
    assert sorted(map(tuple, got)) == gaps


@pytest.mark.parametrize("name", ["l1_starts", "l2_evictions", "l3_identity", "l4_evicted_runs", "l5_succeeded", "l6_evicting_jobs", "l7_eviction_summary", "l8_mean_evictions", "l9_confidence_counts", "s11_log_files"])
def test_logs_of_all_orders(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_devices_never_claimed_in_a_day(spark, duck):  # noqa: F811
    for name in ("w14_never_claimed", "w14_never_claimed_summary"):
        same(spark, duck, name)


@pytest.mark.parametrize("name", ["j18_idle_gaps", "x2_x3_stream_buckets", "x4_stream_devices", "x5_stream_sessions"])
def test_to_the_end(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


@pytest.mark.parametrize("name", ["v9_nearest_snapshot", "v9_inactive_devices", "v9_active_jobs"])
def test_snapshot(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_snapshot_by_hand(spark):
    """Drained devices are not inactive, use on unclaimed rows doesn't count, an empty owner is an owner."""
    rows = [("g1", "Claimed", "u", "1.0", 0.5), ("g1", "Unclaimed", None, None, 0.9), ("g2", "Unclaimed", None, None, 0.7), ("g3", "Drained", None, None, None), ("g4", "Claimed", "", "2.0", None), ("g5", "Claimed", None, None, 0.3)]
    shot = spark.createDataFrame([(*r, "m", "") for r in rows], "AssignedGPUs string, State string, RemoteOwner string, GlobalJobId string, GPUsAverageUsage double, Machine string, PrioritizedProjects string")
    one = views.snapshot_summary(shot).first()
    assert (one["total"], one["active"], one["idle"], round(one["mean_use"], 6)) == (5, 2, 3, 40.0)
    assert [r["AssignedGPUs"] for r in views.inactive_devices(shot).collect()] == ["g2"]
    assert sorted((r["AssignedGPUs"], r["job"]) for r in views.active_jobs(shot).collect()) == [("g1", "1.0"), ("g4", "2.0")]


@pytest.mark.parametrize("name", ["x2_x3_stream_buckets", "x4_stream_devices"])
def test_streams_in_slices(spark, duck, name, monkeypatch):  # noqa: F811
    """A stream of many slices gives the rows of its SQL, and no batch holds the state of the whole table."""
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    monkeypatch.setattr(feeds, "SLICE_ROWS", rows // (5 * spark.sparkContext.defaultParallelism), raising=False)
    held = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            held.extend(s.numRowsTotal for s in event.progress.stateOperators)

        def onQueryTerminated(self, event):
            held.append(None)

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        same(spark, duck, name)
        until = time.time() + 20
        while held.count(None) < 5 and time.time() < until:
            time.sleep(0.2)  # events come after the fact
    finally:
        spark.streams.removeListener(listener)
    assert held.count(None) >= 4
    assert 0 < max(n for n in held if n is not None) < rows / 3
    assert spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory") == "2"


def test_winners_hold_the_first_of_the_kept_columns():
    with pytest.raises(ValueError, match="first of"):
        streams.winners(None, kept=("State",))
