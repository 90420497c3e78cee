"""As-of lookup, tolerant loads, monthly report, totals, pivots, histograms and log context by hand or brute force."""

from __future__ import annotations

import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from slotscope.operators import allocation, classify, logs, trends, views
from slotscope.operators.asof import as_of
from slotscope.schema import SLOTS
from slotscope.sources import snapshots

T0 = dt.datetime(2024, 1, 31, 23, 0)


def at(minutes: int) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def slots(spark, rows):
    """Rows of (Name, gpu, state, machine, project, device, time)."""
    return spark.createDataFrame(rows, "Name string, AssignedGPUs string, State string, Machine string, PrioritizedProjects string, GPUs_DeviceName string, timestamp timestamp_ntz")


@pytest.mark.parametrize("direction", ["backward", "nearest"])
@pytest.mark.parametrize("cell_hours", [0.5, 5.0, 720.0])
def test_as_of_across_cells(spark, direction, cell_hours):
    """Facts from cells before and after, ties in time, points without a time and null keys."""
    r = random.Random(7)
    facts = [(r.choice("ab"), at(r.randrange(3000)), i) for i in range(40)] + [("a", at(500), 98), ("a", at(500), 99), (None, at(5), 1), ("a", None, 2)]
    points = [(i, r.choice("abc"), at(r.randrange(-300, 3300))) for i in range(120)] + [(200, "a", at(500)), (201, None, at(6)), (202, "a", None)]
    got = as_of(spark.createDataFrame(points, "id int, k string, at timestamp_ntz").repartition(3), spark.createDataFrame(facts, "k string, since timestamp_ntz, v int"), "at", "since", ["v"], ["k"], direction, cell_hours)
    found = {x["id"]: (x["since"], x["v"]) for x in got.collect()}
    assert len(found) == len(points)
    for i, k, t in points:
        near = [(s, v) for kk, s, v in facts if k is not None and kk == k and s is not None and t is not None and (direction == "nearest" or s <= t)]
        key = (lambda f: (f[0], f[1])) if direction == "backward" else (lambda f: (-abs(f[0] - t), f[0], f[1]))
        assert found[i] == (max(near, key=key) if near else (None, None)), (i, k, t)


def test_as_of_without_keys_and_without_facts(spark):
    points = spark.createDataFrame([(1, at(10))], "id int, at timestamp_ntz")
    none = spark.createDataFrame([], "since timestamp_ntz, v int")
    assert [tuple(x) for x in as_of(points, none, "at", "since", ["v"]).collect()] == [(1, at(10), None, None)]
    assert as_of(points.limit(0), none, "at", "since", ["v"]).count() == 0
    with pytest.raises(ValueError, match="direction"):
        as_of(points, none, "at", "since", ["v"], direction="sideways")


def test_tolerant_load_of_empty_corrupt_missing_and_legacy_files(spark, tmp_path):
    rows = slots(spark, [("slot1_1@m", f"G{i}", "Claimed", "m", "", "D", at(i)) for i in range(5)])
    rows.coalesce(1).write.parquet(str(tmp_path / "good"))
    rows.limit(0).coalesce(1).write.parquet(str(tmp_path / "empty"))
    whole = next((tmp_path / "good").glob("*.parquet")).read_bytes()
    (tmp_path / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.parquet").write_bytes(b"not parquet")
    with sqlite3.connect(tmp_path / "old.db") as db:
        db.execute("CREATE TABLE gpu_state (timestamp TEXT, Name TEXT, AssignedGPUs TEXT, GPUs_GlobalMemoryMb INTEGER, other TEXT)")
        db.executemany("INSERT INTO gpu_state VALUES (?, 'slot1_9@old', 'G9', 81920, 'x')", [(str(at(i)),) for i in (-1, 1, 3, 90)])
        db.execute("INSERT INTO gpu_state VALUES ('no time', 'x', 'y', NULL, '')")
    (tmp_path / "bad.db").write_bytes(b"SQLite format 3\x00 but not really" * 50)
    specs = [str(tmp_path / n) for n in ("good", "empty", "cut.parquet", "text.parquet", "gone.parquet")] + [(str(tmp_path / n), "sqlite") for n in ("old.db", "bad.db")]
    got, warnings = snapshots.tolerant(spark, specs, at(1), at(3))
    assert got.columns == SLOTS.names
    assert sorted((x["AssignedGPUs"], x["timestamp"]) for x in got.collect()) == [("G1", at(1)), ("G2", at(2)), ("G3", at(3)), ("G9", at(1)), ("G9", at(3))]
    assert {x["GPUs_GlobalMemoryMb"] for x in got.where("AssignedGPUs = 'G9'").collect()} == {81920}
    said = {x["path"].rsplit("/", 1)[1]: x["reason"] for x in warnings.collect()}
    assert set(said) == {"cut.parquet", "text.parquet", "gone.parquet", "bad.db"} and all(said.values())
    # Without rows in the window a good file is still no fault.
    assert [x["path"].rsplit("/", 1)[1] for x in snapshots.tolerant(spark, specs[:2], at(900), at(901))[1].collect()] == []


def test_monthly_report_reads_its_month_once(spark, tmp_path):
    path = str(tmp_path / "slots")
    d = lambda month, day, h=0: dt.datetime(2024, month, day, h)
    rows = [("slot1_1@m", "G1", "Claimed", "m", "P", "NVIDIA H200", d(2, 3)), ("slot1_2@m", "G2", "Unclaimed", "m", "P", "NVIDIA A40", d(2, 3)), ("slot1_1@m", "G1", "Claimed", "m", "P", "NVIDIA H200", d(1, 9)), ("slot1_1@m", "G1", "Claimed", "m", "P", "NVIDIA H200", d(3, 9, 5)), ("slot1_1@m", "G1", "Unclaimed", "m", "P", "NVIDIA H200", d(3, 1))]
    snapshots.append(slots(spark, rows).withColumn("RemoteOwner", F.when(F.col("State") == "Claimed", "u@x")), path)
    assert snapshots.latest_stored(spark, path) == d(3, 9, 5)
    report = allocation.monthly_report(spark, path, [], [])
    try:
        assert (report.start, report.end, report.hours) == (d(2, 1), dt.datetime(2024, 2, 29, 23, 59, 59), 29 * 24)
        assert [(x["total"], x["start"], x["end"], x["buckets"]) for x in report.coverage.collect()] == [(3, d(2, 3), d(3, 1), 2)]
        assert [(x["class"], x["device"], x["avg_claimed"]) for x in report.devices.collect()] == [("Priority-ResearcherOwned", "NVIDIA H200", 0.5)]
        assert [(x["user"], x["gpu_hours"]) for x in report.users.collect()] == [("u@x", 29 * 24 / 2)]
        plan = report.table()._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "Relation [" not in plan.split("InMemoryRelation", 1)[0]
    finally:
        report.close()
    plan = snapshots.scan(spark, path, report.start, d(3, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan.replace("isnotnull(month#", "month") or "PartitionFilters: [" in plan and "month" in plan
    assert allocation.monthly_report(spark, path, [], [], end=d(1, 5)) is None


def test_monthly_report_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    snapshots.append(slots(spark, [("a", "G", "Claimed", "m", "", "D", None)]), path)
    assert allocation.monthly_report(spark, path, [], []) is None


def test_project_comes_from_the_primary_slot(spark):
    rows = [("slot1_1@m", "G1", "Unclaimed", "m", "P", "D", T0), ("backfill1@m", "G1", "Claimed", "m", None, "D", T0), ("backfill1@m", "G1", "Claimed", "m", None, "D", at(5)), ("BACKFILL2@m", "G2", "Claimed", "m", "Q", "D", T0), ("slot1_2@m", "G2", "Claimed", "m", "", "D", T0), ("slot1_3@m", None, "Claimed", "m", "P", "D", T0), ("slot1_4@m", "G2", "Claimed", "m", None, "D", T0)]
    got = trends.with_project(slots(spark, rows))
    assert got.columns[-2:] == ["project", "machine_category"] and got.count() == len(rows)
    assert {(x["Name"], x["timestamp"]): x["project"] for x in got.collect()} == {("slot1_1@m", T0): "P", ("backfill1@m", T0): "P", ("backfill1@m", at(5)): "", ("BACKFILL2@m", T0): "", ("slot1_2@m", T0): "", ("slot1_3@m", T0): "P", ("slot1_4@m", T0): ""}
    (one,) = trends.type_summary(slots(spark, rows), category=trends.RESEARCHER).collect()
    assert (one["total_gpus"], one["avg_backfill_available"]) == (1.0, 1.0)


def test_unused_devices_of_hosts(spark):
    rows = [("slot1_1@m", g, s, m, p, dev, T0) for g, s, m, p, dev in [("G1", "Unclaimed", "m", " P ", "NVIDIA H200"), ("G2", "Claimed", "m", "Q", "NVIDIA H200"), ("G3", "Drained", "m", "R", "L40S"), (" G4 ", None, "n", "", "L40S"), (" ", "Unclaimed", "n", "", "L40S"), ("G5", "Unclaimed", "n", "", None)]]
    devices = trends.never_claimed(slots(spark, rows))
    got = sorted((x["device"], x["Machine"], x["unused"], x["of"], x["projects"], x["gpus"]) for x in trends.never_claimed_hosts(devices).collect())
    assert got == [("L40S", "m", 1, 3, "R", "G3"), ("L40S", "n", 1, 1, "None (Open Capacity)", "G4"), ("NVIDIA H200", "m", 1, 3, "P", "G1")]
    sums = {(x["tier"], x["device"]): (x["gpus"], x["unused"], x["hosts"]) for x in trends.never_claimed_devices(devices).collect()}
    assert sums[None, None] == (4, 3, 2) and sums["Standard", "L40S"] == (2, 2, 2) and sums["Flagship", None] == (2, 1, 1)


def test_idle_machines_and_totals(spark):
    rows = [("slot1_1@a", "G1", "Unclaimed", "a", " P ", "X", T0), ("slot1_2@a", "G2", "Drained", "a", "Q", "Y", T0), ("backfill1@a", "G1", "Claimed", "a", None, "Y", at(60)), ("backfill2@a", "G1", "Claimed", "a", None, "Y", at(120)), ("backfill1@a", None, "Claimed", "a", None, None, at(180)),
            ("slot1_1@b", "G3", "Unclaimed", "b", "", "X", T0), ("slot1_1@c", "G4", "Claimed", "c", "", "X", T0), ("backfill1@d", "G5", "Unclaimed", "d", "", "X", T0)]
    full = slots(spark, rows)
    full = full.select(*[F.col(f.name) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SLOTS.fields])
    idle = allocation.idle_machines(classify.prepare(full))
    assert sorted(tuple(x) for x in idle.collect()) == [("a", "Y", 2, 5, "P,Q", 2 / 3), ("b", "X", 1, 1, "", 0.0)]
    totals = {(x["gpu_model"], x["project"]): (x["machines"], x["gpus_idle"]) for x in allocation.idle_totals(idle).collect()}
    assert totals == {(None, None): (2, 3), ("Y", None): (1, 2), ("X", None): (1, 1), (None, "P"): (1, 2), (None, "Q"): (1, 2), (None, "None"): (1, 1)}
    assert [tuple(x) for x in allocation.idle_totals(idle.limit(0)).collect()] == [(None, None, 0, 0)]


def test_histogram_edges_and_nulls(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 1.0, 2.0, 2.9999, 5.0, None, float("nan"), float("inf"))], "v double")
    got = [(x["bin"], x["lo"], x["hi"], x["n"]) for x in allocation.value_histogram(rows, "v", 4).orderBy("bin").collect()]
    assert got == [(1, 1.0, 2.0, 2), (2, 2.0, 3.0, 2), (3, 3.0, 4.0, 0), (4, 4.0, 5.0, 1)]
    one = allocation.value_histogram(rows.where("v = 5"), "v", 2).orderBy("bin").collect()
    assert [(x["lo"], x["hi"], x["n"]) for x in one] == [(4.5, 5.0, 0), (5.0, 5.5, 1)]
    assert allocation.value_histogram(rows.where("v is null"), "v").count() == 0


def test_user_pivot_has_bounded_columns(spark):
    series = spark.createDataFrame([(at(0), "ann", 3), (at(0), "bob", 5), (at(0), "cy", 4), (at(15), "ann", 5), (at(15), "cy", 1)], "bucket timestamp_ntz, user string, gpus bigint")
    wide = trends.open_user_pivot(series, 2).orderBy("bucket")
    assert wide.columns == ["bucket", "ann", "bob", "others"] and [tuple(x)[1:] for x in wide.collect()] == [(3, 5, 4), (5, 0, 1)]
    assert trends.open_user_pivot(series, 5, names=False).columns == ["bucket", "u1", "u2", "u3", "u4", "u5", "others"]
    peaks = trends.bucket_peaks(series)
    assert sorted(tuple(x) for x in peaks.collect()) == [(at(0), 5, "bob"), (at(15), 5, "ann")]
    assert [tuple(x) for x in trends.overall_peak(peaks).collect()] == [(5, at(0), "bob")]
    assert trends.overall_peak(peaks.limit(0)).count() == 0
    assert trends.open_user_pivot(series.limit(0), 3).columns == ["bucket", "others"]


def test_heatmap_fills_runs_of_missing_buckets(spark):
    rows = [("slot1_1@a", "G1", "Claimed", "a", "", "X", at(30)), ("slot1_1@a", "G1", "Unclaimed", "a", "", "X", at(90)), ("slot1_1@b", "G2", "Claimed", "b", "", None, at(0)), ("slot1_1@b", "G2", "Claimed", "b", "", None, at(60)), ("slot1_1@b", "G2", "Claimed", "b", "", None, at(300))]
    full = slots(spark, rows)
    full = full.select(*[F.col(f.name) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SLOTS.fields])
    got = {x["gpu"]: (x["device"], list(x["states"])) for x in views.heatmap(classify.prepare(full)).collect()}
    assert got == {"G1": ("X", [5, 3, 5, 1, 5]), "G2": ("Unknown", [3, 5, 3, 5, 3])}


def test_start_context_is_24_lines_and_may_pass_the_next_start(spark):
    start = lambda n: f"001 ({n}.0.0) 2024-01-01 00:00:0{n} Job executing on host: <1.2.3.4?alias=h{n}.x&y>"
    text = [start(1), *["noise"] * 23, "\tSlotName: slot1_1@h1", start(2), *["noise"] * 24, "\tSlotName: slot1_2@h2", start(3), start(4), "\tAvailableGPUs = { GPUs_GPU_ab, GPUs_GPU_cd }", '\tGPUs_GPU_cd = [ DeviceName = "other"; ]', "\tGPUs_GPU_ab = [ Memory = 1; ]", '\tGPUs_GPU_ab = [ DeviceName = "mine"; ]']
    rows = logs.starts(spark.createDataFrame([("l", "\n".join(text)), ("e", ""), ("n", None)], "log string, text string")).orderBy("no").collect()
    assert [(x["host"], x["slot"], x["gpu"], x["device"]) for x in rows] == [("h1.x", "slot1_1@h1", "Unknown", "Unknown"), ("h2.x", "Unknown", "Unknown", "Unknown"), ("h3.x", "Unknown", "ab", "mine"), ("h4.x", "Unknown", "ab", "mine")]


def test_evicting_jobs_against_all_pairs(spark):
    """Hosts that hold one another's names, short names, null and empty ones; nothing queued in time."""
    r = random.Random(3)
    hosts = ["node1.pool", "node11.pool", "NODE2", "Unknown", ".pool", "n"]
    names = ["node1.pool", "node11.pool", "xnode1.poolx", "node2.other", None, "", "N"]
    runs = [("log", i, at(r.randrange(600)), 1, r.choice(hosts), "slot1_1@x", "ab", "D", 5) for i in range(60)] + [("log", 99, at(5000), 1, "node1.pool", "Unknown", "Unknown", "D", 5)]
    epoch = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds())
    queue = [(i, 0, epoch(at(r.randrange(600))), r.choice(names), r.choice(["slot1_1@y", "slot2", None]), r.choice(["GPU-ab", "GPU-cd", None]), "u", "p") for i in range(150)]
    runs_df = spark.createDataFrame(runs, "log string, eviction int, at timestamp_ntz, code int, host string, slot string, gpu string, device string, runtime int")
    jobs_df = spark.createDataFrame(queue, "ClusterId int, ProcId int, QDate bigint, StartdName string, StartdSlot string, AssignedGPUs string, User string, ProjectName string")
    got = {x["eviction"]: (x["evicting_job"], x["confidence"]) for x in logs.evicting_jobs(runs_df, jobs_df).collect()}
    for _, i, t, _, host, slot, gpu, _, _ in runs:
        near = [q for q in queue if 0 <= epoch(t) - q[2] <= 1800]
        holds = lambda q, part: q[3] is not None and part.lower() in q[3].lower()
        kept = [q for q in near if holds(q, host)] or [q for q in near if holds(q, host.split(".")[0])]
        if slot != "Unknown":
            kept = [q for q in kept if q[4] and slot.split("@")[0].lower() in q[4].lower()] or kept
        if gpu != "Unknown":
            kept = [q for q in kept if q[5] == f"GPU-{gpu}"] or kept
        best = min(kept, key=lambda q: (epoch(t) - q[2], q[0]), default=None)
        assert got[i][0] == (None if best is None else f"{best[0]}.0"), (i, host)
        if best is None:
            assert got[i][1] == ("no_match" if near else "no_candidates")


def test_hosts_by_model(spark):
    rows = [("slot1_1@a", "G1", "Claimed", "a", "", "X", T0), ("slot1_2@a", None, "Unclaimed", "a", "", "Y", T0), ("slot1_2@a", None, None, "a", "", "Y", T0), ("slot1_1@b", "G2", "Claimed", "b", "", None, T0), ("slot1_2@b", "G3", "Claimed", "b", "", None, T0), ("slot1_1@c", "G4", "Claimed", "c", "", "X", T0)]
    hosts = views.host_list(slots(spark, rows), 2)
    assert sorted(tuple(x) for x in hosts.collect()) == [("a", 2, "Y", 3, 0.5), ("b", 2, "Unknown", 2, 1.0)]
    assert {tuple(x) for x in views.hosts_by_device(hosts).collect()} == {("Y", 1, 2, 0.5), ("Unknown", 1, 2, 1.0), (None, 2, 4, 0.75)}


def test_fitted_line_starts_at_the_first_value(spark):
    series = spark.createDataFrame([(dt.date(2024, 1, d), y) for d, y in ((1, None), (2, 1.0), (3, 3.0), (4, 5.0), (6, None))], "day date, v double")
    got = {x["day"].day: (x["fitted"], x["residual"]) for x in trends.fitted_line(series, "day", "v").collect()}
    assert got == {1: (-1.0, None), 2: (1.0, 0.0), 3: (3.0, 0.0), 4: (5.0, 0.0), 6: (9.0, None)}


@pytest.mark.parametrize("cells", [2, 256])
def test_gini_by_ranges_of_hours(spark, cells):
    from slotscope.operators import queue

    r = random.Random(4)
    hours = [r.choice([0.0, 0.25, 0.25, 1.0, r.randrange(4000) / 4]) for _ in range(500)]
    (got,) = queue.gini(spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(hours)], "user string, gpu_hours double"), cells).collect()
    n, total = len(hours), sum(hours)
    assert got["users"] == n and got["gini"] == pytest.approx(sum(abs(a - b) for a in hours for b in hours) / (2 * n * total))
    empty = spark.createDataFrame([], "user string, gpu_hours double")
    assert [tuple(x) for x in queue.gini(empty).collect()] == [(0.0, 0)]
    assert [tuple(x) for x in queue.gini(spark.createDataFrame([("a", 0.0), ("b", 0.0)], empty.schema)).collect()] == [(0.0, 2)]


def test_evicting_jobs_never_meet_pair_by_pair(spark):
    """900 evictions and 900 jobs of one machine in one half hour: no step makes rows in the product of both."""
    n = 900
    runs = spark.range(n).selectExpr("concat('log', id) AS log", "1 AS eviction", "TIMESTAMP_NTZ'2024-01-31 23:00:00' + make_dt_interval(0, 0, 25, CAST(id % 60 AS INT)) AS at", "1 AS code", "'h1.pool' AS host", "'slot1_1@h1' AS slot", "'ab' AS gpu", "'D' AS device", "5 AS runtime")
    jobs = spark.range(n).selectExpr("id AS ClusterId", "0 AS ProcId", "unix_timestamp(TIMESTAMP'2024-01-31 23:00:00') + id AS QDate", "'h1' AS StartdName", "concat('slot1_', id % 3, '@h1') AS StartdSlot", "concat('GPU-', if(id % 2 = 0, 'ab', 'cd')) AS AssignedGPUs", "'u' AS User", "'p' AS ProjectName")
    found = logs.evicting_jobs(runs, jobs)
    assert {(x["evicting_job"], x["confidence"], x["reason"]) for x in found.collect()} == {("898.0", "high", "exact_gpu_match,slot_match")}
    assert n <= _most_rows(found) < 5 * n


def _most_rows(df) -> int:
    """The most rows that an operator of the plan put out when ``df`` was collected."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        rows, kids, kind = node.metrics().get("numOutputRows"), node.children(), node.getClass().getSimpleName()
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        stage = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        todo += [stage] if stage is not None else [kids.apply(i) for i in range(kids.size())]
    return most


def test_confidence_counts_in_one_pass(spark):
    rows = [("low", "Host1"), ("low", "x"), ("high", "y"), ("no_match", None), ("low", "ahost1.b")]
    matches = spark.createDataFrame(rows, "confidence string, host string")
    assert [tuple(x) for x in logs.confidence_counts(matches, "HOST1").collect()] == [("low", 2, 5)]
    assert sorted(tuple(x) for x in logs.confidence_counts(matches).collect()) == [("high", 1, 5), ("low", 3, 5), ("no_match", 1, 5)]
    assert logs.confidence_counts(matches, "HOST1")._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
