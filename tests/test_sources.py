"""Storage, schema evolution, imports, configuration."""

from __future__ import annotations

import datetime as dt

from slotscope.sources import config, snapshots
from slotscope.schema import SLOTS

A, B = dt.datetime(2024, 1, 31, 23, 55), dt.datetime(2024, 2, 1, 0, 5)


def rows(spark, *times):
    return spark.createDataFrame([("slot1_1@m", "G1", "Claimed", t) for t in times], "Name string, AssignedGPUs string, State string, timestamp timestamp_ntz")


def test_months():
    assert snapshots.months(dt.datetime(2023, 12, 31), dt.datetime(2024, 2, 1)) == ["2023-12", "2024-01", "2024-02"]


def test_append_and_scan_across_months(spark, tmp_path):
    path = str(tmp_path / "slots")
    snapshots.append(rows(spark, A, B), path)
    snapshots.append(rows(spark, dt.datetime(2024, 3, 1)), path)
    got = snapshots.scan(spark, path, A, B).collect()
    assert sorted(r["timestamp"] for r in got) == [A, B]
    assert set(got[0].asDict()) == set(SLOTS.names)
    plan = snapshots.scan(spark, path, A, B)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan


def test_window_includes_both_ends_and_empty_is_empty(spark):
    t = dt.datetime(2024, 1, 2)
    data = rows(spark, t, t - dt.timedelta(hours=24), t - dt.timedelta(hours=25))
    assert snapshots.window(data).count() == 2
    assert snapshots.window(data.limit(0)).count() == 0


def test_files_with_other_columns(spark, tmp_path):
    rows(spark, A).select("State", "timestamp", "Name").write.parquet(str(tmp_path / "a"))
    rows(spark, B).write.parquet(str(tmp_path / "b"))
    both = spark.read.schema(SLOTS).parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    assert {r["timestamp"]: r["AssignedGPUs"] for r in both.collect()} == {A: None, B: "G1"}


def test_tolerant_load_names_bad_files(spark, tmp_path):
    folder = tmp_path / "t"
    rows(spark, A).coalesce(1).write.parquet(str(folder))
    good = next(str(p) for p in folder.iterdir() if p.name.endswith(".parquet"))
    bad = folder / "bad.parquet"
    bad.write_bytes(b"not parquet at all")
    data, warnings = snapshots.tolerant(spark, [good, str(bad)])
    assert data.count() == 1
    assert [r["path"].rsplit("/", 1)[1] for r in warnings.collect()] == ["bad.parquet"]


def test_tolerant_load_tells_namesakes_apart(spark, tmp_path):
    folder, other = tmp_path / "good files", tmp_path / "other"
    rows(spark, A).coalesce(1).write.parquet(str(folder))
    good = next(p for p in folder.iterdir() if p.name.endswith(".parquet"))
    other.mkdir()
    bad = other / good.name
    bad.write_bytes(b"not parquet at all")
    data, warnings = snapshots.tolerant(spark, [str(good), str(bad)])
    assert data.count() == 1
    assert [r["path"].split(":")[-1].replace("///", "/") for r in warnings.collect()] == [str(bad)]


def test_ingest_explodes_devices(spark):
    ads = spark.createDataFrame([("slot1_1@m", ["GPUs_GPU_aa"], "GPU-aa, GPU-bb"), ("backfill1@m", ["GPUs_GPU_cc", "GPUs_GPU_dd"], None), ("slot1_2@m", None, None)], "Name string, AvailableGPUs array<string>, AssignedGPUs string")
    got = sorted((r["Name"], r["AssignedGPUs"] or "") for r in snapshots.ingest(ads).collect())
    assert got == [("backfill1@m", "GPU-cc"), ("backfill1@m", "GPU-dd"), ("slot1_1@m", "GPU-aa"), ("slot1_1@m", "GPU-bb"), ("slot1_2@m", "")]


def test_configuration(spark, tmp_path):
    (tmp_path / "owned").write_text("h1\n\n  h2  \n")
    (tmp_path / "masked.yaml").write_text("excluded_hosts:\n  h1: reason one\n  h2: two\n")
    assert sorted(r["Machine"] for r in config.owned_hosts(spark, str(tmp_path / "owned")).collect()) == ["h1", "h2"]
    got = {r["pattern"]: r["reason"] for r in config.host_exclusions(spark, str(tmp_path / "masked.yaml"), "h2:mine,h3").collect()}
    assert got == {"h1": "reason one", "h2": "mine", "h3": ""}
