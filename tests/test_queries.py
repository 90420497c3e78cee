"""Registered queries against their SQL in DuckDB over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from slotscope.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: One or two of each family; the driver compares all of them at a larger scale.
CHOSEN = ["s1_window_scan", "r12_class_labels", "d2_dedup_winners", "d8_d9_state_filters", "a2_allocation_by_device", "a5_device_users", "a8_prevented_totals", "a13_usage_series", "a15_backfill_totals", "a15_backfill_totals_summary", "a16_monthly_summary", "v1_heatmap", "v2_category_counts", "w1_category_buckets", "w4_daily_hours", "w12_type_summary", "w13_snapshot_efficiency", "g2_drain_intervals", "p2_merged_intervals", "p5_pressure", "j3_wait_stats", "l6_evicting_jobs", "t2_cluster_summary", "u2_backfill_only", "x4_stream_devices",
          "s7_tolerant_load", "s8_configuration", "a7_idle_totals", "a10_prevented_average", "a12_allocation_five", "a16_monthly_report", "a17_category_totals", "a19_capability_histogram", "v5_hosts_by_device", "v9_snapshot_classes", "v9_nearest_times", "w7_fitted_line", "w12_type_summary_researcher", "w13_efficiency_by_category", "w14_unused_hosts", "w14_unused_devices", "w17_open_user_pivot", "w17_overall_peak", "p9_gini", "u1_backfill_by_project", "x1_stream_ingest", "x6_live_intervals"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(([value(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    result = duck.execute(SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(result.fetchall(), names)


def test_every_query_has_sql_but_the_known_ones():
    assert sorted(set(QUERIES) - set(SQL)) == ["w7_trend_significance"]
    assert not set(SQL) - set(QUERIES)
