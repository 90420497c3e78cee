"""Queries of the trends and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotscope.operators import allocation as a
from slotscope.operators import trends as w
from slotscope.plans import allocation as pa
from slotscope.plans import fixtures as x
from slotscope.plans.allocation import frames, rounded
from slotscope.sources import snapshots

START, END = "2024-01-02 00:00:00", "2024-01-08 12:00:00"
#: Hours are tried before and after this day.
SPLIT = "2024-01-05"


def _buckets(s, p):
    return w.category_buckets(x.slots(s, p), x.OWNED, x.EXCLUDED)


def _wide(s, p):
    return w.daily_wide(w.daily_hours(x.slots(s, p)))


_NEW = "GPUs_DeviceName IS NOT NULL AND GPUs_DeviceName != '' AND NOT regexp_matches(GPUs_DeviceName, 'GTX 1080|P100|Quadro|A30|A40')"
_CAT = f"""WITH {x.RAW_SQL}, r0 AS (SELECT *, CASE WHEN is_bf AND (owned OR NOT owned) THEN 'backfill' WHEN coalesce(PrioritizedProjects != '', false) THEN 'prioritized' WHEN PrioritizedProjects = '' THEN 'open_capacity' END AS category FROM raw WHERE NOT excluded AND {_NEW} AND AssignedGPUs IS NOT NULL),
r AS (SELECT * FROM r0 WHERE category IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, AssignedGPUs ORDER BY CASE WHEN State = 'Claimed' AND NOT is_bf THEN 3 WHEN State = 'Claimed' THEN 2 WHEN NOT is_bf THEN 1 ELSE 0 END DESC, {x.TIES_SQL}) AS rn FROM r) WHERE rn = 1),
t AS (SELECT bucket, category, count(DISTINCT AssignedGPUs) AS total_gpus, count(DISTINCT AssignedGPUs) FILTER (State = 'Claimed') AS own FROM r GROUP BY ALL),
h AS (SELECT bucket, category, count(DISTINCT AssignedGPUs) AS held FROM b WHERE category != 'backfill' AND State = 'Claimed' GROUP BY ALL),
cb AS (SELECT date_trunc('week', t.bucket)::TIMESTAMP AS week_start, t.bucket, t.category, total_gpus, CASE WHEN t.category = 'backfill' THEN own ELSE coalesce(held, 0) END AS claimed_gpus FROM t LEFT JOIN h ON h.bucket = t.bucket AND h.category = t.category)"""
_WEEK_COLS = ", ".join(
    f"round(coalesce(sum(claimed_gpus) FILTER (category = '{k}') / nullif(sum(total_gpus) FILTER (category = '{k}'), 0) * 100, 0), 6) AS {k}_pct, count(*) FILTER (category = '{k}') AS {k}_intervals, "
    f"round(coalesce(avg(total_gpus) FILTER (category = '{k}'), 0), 6) AS {k}_avg_total, round(coalesce(avg(claimed_gpus) FILTER (category = '{k}'), 0), 6) AS {k}_avg_claimed, round(coalesce(sum(claimed_gpus) FILTER (category = '{k}') * 0.25, 0)::DOUBLE, 6) AS {k}_gpu_hours"
    for k in w.CATEGORIES
)
_WEEKLY = f"{_CAT}, cw AS (SELECT week_start FROM cb GROUP BY 1 HAVING count(DISTINCT CAST(bucket AS DATE)) >= 7), wk AS (SELECT week_start, {_WEEK_COLS} FROM cb WHERE week_start IN (SELECT week_start FROM cw) GROUP BY week_start), ws AS (SELECT *, prioritized_gpu_hours + open_capacity_gpu_hours AS primary_gpu_hours, prioritized_gpu_hours + open_capacity_gpu_hours + backfill_gpu_hours AS total_gpu_hours FROM wk)"
_METRICS = ("prioritized_pct", "open_capacity_pct", "backfill_pct", "total_gpu_hours")
_W3 = f"""WITH {x.classes_sql()}, k AS (SELECT CASE WHEN class LIKE 'Priority%' THEN 'Prioritized (Primary)' WHEN class = 'Shared' THEN 'Open Capacity' ELSE 'Secondary (Backfill)' END AS category, bucket, AssignedGPUs, State FROM cls WHERE {_NEW} AND AssignedGPUs IS NOT NULL),
g AS (SELECT category, bucket, AssignedGPUs, bool_or(State = 'Claimed') AS c FROM k GROUP BY ALL), pb AS (SELECT category, bucket, count(*) AS t, count(*) FILTER (c) AS c FROM g GROUP BY ALL),
wk AS (SELECT category, date_trunc('week', bucket)::TIMESTAMP AS week_start, round(avg(c::DOUBLE / t * 100), 6) AS pct, round(sum(c) / count(*), 6) AS avg_claimed, round(sum(t) / count(*), 6) AS avg_total, count(*) AS intervals, count(DISTINCT CAST(bucket AS DATE)) AS n_days FROM pb GROUP BY 1, 2 HAVING count(DISTINCT CAST(bucket AS DATE)) >= 7)"""


def _hours(rows: str, by: str, single: str) -> str:
    e = "epoch(timestamp)"
    over = f"OVER (PARTITION BY {by} ORDER BY timestamp)"
    return f"SELECT *, coalesce((lead({e}) {over} - {e}) / 3600.0, ({e} - lag({e}) {over}) / 3600.0, {single}) AS h FROM {rows}"


_DAILY = f"""WITH {x.SLOTS_SQL}, n AS (SELECT CASE WHEN Name LIKE 'slot1_%' THEN 'primary' ELSE 'backfill' END AS kind, timestamp, strftime(timestamp, '%Y-%m') AS month, count(*) AS n FROM slots WHERE State = 'Claimed' AND (Name LIKE 'slot1_%' OR Name LIKE 'backfill2_%') GROUP BY ALL),
hh AS ({_hours('n', 'month, kind', '0.25')}), dd AS (SELECT CAST(timestamp AS DATE) AS day, kind, sum(n * h) AS gpu_hours, avg(n) AS avg_claimed, count(*) AS measurements FROM hh GROUP BY 1, 2),
wd0 AS (SELECT day, coalesce(max(gpu_hours) FILTER (kind = 'primary'), 0) AS primary_hours, coalesce(max(gpu_hours) FILTER (kind = 'backfill'), 0) AS backfill_hours, coalesce(max(avg_claimed) FILTER (kind = 'primary'), 0) AS primary_claimed, coalesce(max(avg_claimed) FILTER (kind = 'backfill'), 0) AS backfill_claimed FROM dd GROUP BY day),
wd AS (SELECT *, primary_hours + backfill_hours AS total_hours FROM wd0)"""
_IN = f"timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'"
_PERIOD = f"""WITH {x.SLOTS_SQL}, r AS (SELECT *, CASE WHEN coalesce(AssignedGPUs, '') = '' THEN 1 ELSE len(list_filter(string_split(AssignedGPUs, ','), lambda g: trim(g) != '')) END AS k,
  CASE WHEN Name LIKE 'backfill%' THEN 'backfill' WHEN Name LIKE 'slot%' OR Name LIKE 'interactive%' THEN CASE WHEN trim(coalesce(PrioritizedProjects, '')) != '' THEN 'prioritized' ELSE 'open_capacity' END END AS kind FROM slots WHERE {_IN} AND State = 'Claimed' AND GlobalJobId != ''),
l AS (SELECT *, 'total' AS category FROM r UNION ALL SELECT *, kind FROM r WHERE kind IS NOT NULL),
tt AS (SELECT DISTINCT timestamp, strftime(timestamp, '%Y-%m') AS m FROM r), th AS ({_hours('tt', 'm', '5.0 / 60')}),
pj AS (SELECT category, count(DISTINCT GlobalJobId) AS jobs FROM l GROUP BY 1),
ph AS (SELECT category, sum(n * h) AS gpu_hours, count(*) FILTER (n > 0) AS samples FROM (SELECT category, timestamp, sum(k) AS n FROM l GROUP BY ALL) JOIN th USING (timestamp) GROUP BY 1),
per AS (SELECT category, jobs, gpu_hours, samples FROM pj JOIN ph USING (category)),
ag AS (SELECT timestamp, strftime(timestamp, '%Y-%m') AS m, count(DISTINCT AssignedGPUs) AS n FROM slots WHERE {_IN} AND AssignedGPUs != '' GROUP BY 1, 2), ah AS ({_hours('ag', 'm', '5.0 / 60')}),
av AS (SELECT sum(n * h) AS available_hours FROM ah)"""


def _type_sql(by: str) -> str:
    return f"""WITH {x.RAW_SQL}, sn AS (SELECT {by}, timestamp, count(DISTINCT AssignedGPUs) FILTER (NOT is_bf) AS p, count(DISTINCT AssignedGPUs) FILTER (NOT is_bf AND State = 'Claimed' AND NOT regexp_matches(Name, '^slot\\d+@')) AS pc,
      count(DISTINCT AssignedGPUs) FILTER (is_bf) AS b, count(DISTINCT AssignedGPUs) FILTER (is_bf AND State = 'Claimed') AS bc FROM raw WHERE GPUs_DeviceName IS NOT NULL GROUP BY ALL)
      SELECT {by}, round(avg(p), 6) AS total_gpus, round(avg(pc), 6) AS avg_primary_allocated, round(avg(bc), 6) AS avg_backfill_allocated, round(avg(b), 6) AS avg_backfill_available,
      round(sum(b) FILTER (p > pc) / nullif(sum(p - pc) FILTER (p > pc), 0) * 100, 6) AS slot_creation_efficiency, round(CASE WHEN avg(p) > 0 THEN (avg(pc) + avg(bc)) / avg(p) * 100 ELSE 0 END, 6) AS allocated_pct FROM sn GROUP BY {by}"""


_EFF = f"""WITH {x.RAW_SQL}, sn AS (SELECT timestamp, count(DISTINCT AssignedGPUs) FILTER (NOT is_bf) - count(DISTINCT AssignedGPUs) FILTER (NOT is_bf AND State = 'Claimed' AND NOT regexp_matches(Name, '^slot\\d+@')) AS unused, count(DISTINCT AssignedGPUs) FILTER (is_bf) AS backfill FROM raw WHERE Machine = 'host5' GROUP BY 1),
ef AS (SELECT timestamp, unused, backfill, backfill / unused * 100 AS efficiency FROM sn WHERE unused > 0)"""
_NEVER = f"""WITH {x.IDLE_SQL}, nc AS (SELECT Machine, AssignedGPUs, arg_max(GPUs_DeviceName, timestamp) AS device, count(*) AS records, count(*) FILTER (State = 'Claimed') AS claimed,
  coalesce(list(DISTINCT trim(PrioritizedProjects)) FILTER (trim(coalesce(PrioritizedProjects, '')) != ''), []) AS ps FROM idle WHERE AssignedGPUs IS NOT NULL AND timestamp >= (SELECT max(timestamp) FROM slots) - INTERVAL 24 HOUR GROUP BY ALL),
nt AS (SELECT *, CASE WHEN regexp_matches(device, 'H100|H200|A100-SXM4-80GB|A100 80GB') THEN 'Flagship' ELSE 'Standard' END AS tier FROM nc)"""
_CATEGORY = f"""WITH {x.MIXED_SQL},
pp AS (SELECT timestamp AS t, AssignedGPUs AS g, max(coalesce(PrioritizedProjects, '')) AS p FROM mixed WHERE NOT regexp_matches(Name, '(?i)backfill') AND AssignedGPUs IS NOT NULL GROUP BY ALL),
ct AS (SELECT mixed.*, contains(Name, 'backfill') AS is_bf, CASE WHEN coalesce(p, PrioritizedProjects, '') = '' THEN 'Open Capacity' ELSE 'Researcher Owned' END AS machine_category,
  CASE WHEN coalesce(PrioritizedProjects, '') = '' THEN 'Open Capacity' ELSE 'Researcher Owned' END AS own_category FROM mixed LEFT JOIN pp ON timestamp = t AND AssignedGPUs = g)"""


def _type_category_sql(category: str) -> str:
    """The type summary over the devices of a machine category."""
    return _type_sql("GPUs_DeviceName").replace(f"WITH {x.RAW_SQL}", f"{_CATEGORY}, raw AS (SELECT * FROM ct WHERE machine_category = '{category}')", 1)


def _by_project_sql(category: str) -> str:
    return f"""{_CATEGORY}, sn AS (SELECT Machine, {category} AS machine_category, timestamp, count(DISTINCT AssignedGPUs) FILTER (NOT is_bf) AS p,
      count(DISTINCT AssignedGPUs) FILTER (NOT is_bf AND State = 'Claimed' AND NOT regexp_matches(Name, '^slot\\d+@')) AS pc, count(DISTINCT AssignedGPUs) FILTER (is_bf) AS b FROM ct GROUP BY ALL),
    ag AS (SELECT Machine, machine_category, count(*) AS intervals, count(*) FILTER (p > pc) AS with_unused, avg(p) AS ap, avg(pc) AS apc, avg(b) AS ab, coalesce(avg(p - pc) FILTER (p > pc), 0) AS au, coalesce(avg(b) FILTER (p > pc), 0) AS bu FROM sn GROUP BY ALL)
    SELECT Machine, machine_category, intervals, with_unused, round(ap, 6) AS avg_primary_available, round(apc, 6) AS avg_primary_claimed, round(ab, 6) AS avg_backfill_available, round(au, 6) AS avg_unused, round(bu, 6) AS avg_backfill_when_unused,
      round(CASE WHEN au > 0 THEN bu / au * 100 ELSE 0 END, 6) AS efficiency FROM ag"""


_CONC = f"WITH {x.SLOTS_SQL}, cc AS (SELECT time_bucket(INTERVAL '15 minutes', timestamp) AS bucket, RemoteOwner, count(DISTINCT GlobalJobId) AS jobs, count(*) AS gpu_rows, count(DISTINCT GPUs_DeviceName) AS kinds FROM slots WHERE State = 'Claimed' AND RemoteOwner != '' GROUP BY ALL)"
_OPEN = f"""WITH {x.RAW_SQL}, {pa.simple_sql('three_tier')}, sn AS (SELECT timestamp, split_part(RemoteOwner, '@', 1) AS user, count(DISTINCT AssignedGPUs) AS n FROM s WHERE State = 'Claimed' AND NOT is_bf AND coalesce(PrioritizedProjects, '') = '' AND RemoteOwner != '' GROUP BY ALL),
os AS (SELECT time_bucket(INTERVAL '15 minutes', timestamp) AS bucket, user, max(n) AS gpus FROM sn GROUP BY ALL)"""
_LIN = "regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, corr(y, t) AS r, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, count(*) AS n"


def _conc(s, p):
    rows = w.concurrency(x.slots(s, p))
    return rows.select("bucket", "RemoteOwner", "jobs", "gpu_rows", F.size("devices").cast("bigint").alias("kinds"))


def _never(s, p):
    return w.never_claimed(snapshots.window(x.idle_hosts(x.slots(s, p))))


_PEAKS = f"{_OPEN}, bp AS (SELECT bucket, gpus AS peak, user FROM os QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY gpus DESC, user) = 1)"

QUERIES = {
    "w1_category_buckets": _buckets,
    "w1_category_means": lambda s, p: rounded(w.category_means(_buckets(s, p))),
    "w2_weekly_summary": lambda s, p: rounded(w.weekly_summary(_buckets(s, p))),
    "w2_summary_of_weeks": lambda s, p: rounded(w.series_summary(w.weekly_summary(_buckets(s, p)), _METRICS)),
    "w3_weekly_allocation": lambda s, p: rounded(w.week_grid(w.weekly_allocation(frames(s, p)))),
    "w4_daily_hours": lambda s, p: rounded(w.daily_hours(x.slots(s, p))),
    "w5_monthly_hours": lambda s, p: rounded(w.monthly_hours(_wide(s, p))),
    "w6_weekly_hours": lambda s, p: rounded(w.weekly_hours(_wide(s, p))),
    "w7_linear_trend": lambda s, p: rounded(w.linear_trend(_wide(s, p), "day", "total_hours")),
    "w7_fitted_line": lambda s, p: rounded(w.fitted_line(_wide(s, p), "day", "total_hours")),
    "w7_trend_significance": lambda s, p: w.with_significance(w.linear_trend(_wide(s, p), "day", "total_hours")),
    "w8_moving_average": lambda s, p: rounded(w.moving_average(_wide(s, p), "day", "total_hours").select("day", "total_hours", "moving_average")),
    "w9_split_periods": lambda s, p: rounded(w.split_periods(_wide(s, p), SPLIT)),
    "w10_period_jobs": lambda s, p: rounded(w.period_jobs(x.slots(s, p), START, END)),
    "w11_period_efficiency": lambda s, p: rounded(w.period_efficiency(w.period_jobs(x.slots(s, p), START, END), w.available_hours(x.slots(s, p), START, END))),
    "w12_type_summary": lambda s, p: rounded(w.type_summary(x.slots(s, p))),
    "w12_type_summary_machines": lambda s, p: rounded(w.type_summary(x.slots(s, p), ("GPUs_DeviceName", "Machine"))),
    "w12_type_summary_open": lambda s, p: rounded(w.type_summary(x.mixed_projects(x.slots(s, p)), category=w.OPEN)),
    "w12_type_summary_researcher": lambda s, p: rounded(w.type_summary(x.mixed_projects(x.slots(s, p)), category=w.RESEARCHER)),
    "w13_efficiency_by_project": lambda s, p: rounded(w.efficiency_by_project(x.mixed_projects(x.slots(s, p)))),
    "w13_efficiency_by_category": lambda s, p: rounded(w.efficiency_by_project(x.mixed_projects(x.slots(s, p)), propagate=True)),
    "w13_snapshot_efficiency": lambda s, p: rounded(w.efficiency_summary(w.snapshot_efficiency(x.slots(s, p), "host5"))),
    "w13_top_efficiency": lambda s, p: rounded(w.snapshot_efficiency(x.slots(s, p), "host5").orderBy(F.desc("efficiency"), "timestamp").limit(10)),
    "w14_never_claimed": lambda s, p: _never(s, p).where("claimed = 0").select("Machine", "AssignedGPUs", "tier", "records"),
    "w14_never_claimed_summary": lambda s, p: rounded(w.never_claimed_summary(_never(s, p))),
    "w14_unused_hosts": lambda s, p: w.never_claimed_hosts(_never(s, p)),
    "w14_unused_devices": lambda s, p: w.never_claimed_devices(_never(s, p)),
    "w15_concurrency": _conc,
    "w16_top_users": lambda s, p: rounded(w.top_users(w.concurrency(x.slots(s, p)), "gpu_rows")),
    "w17_open_user_series": lambda s, p: w.open_user_series(x.slots(s, p)),
    "w17_open_user_peaks": lambda s, p: rounded(w.open_user_peaks(w.open_user_series(x.slots(s, p)))),
    "w17_open_user_pivot": lambda s, p: w.open_user_pivot(w.open_user_series(x.slots(s, p)), 5, names=False),
    "w17_bucket_peaks": lambda s, p: w.bucket_peaks(w.open_user_series(x.slots(s, p))),
    "w17_overall_peak": lambda s, p: w.overall_peak(w.bucket_peaks(w.open_user_series(x.slots(s, p)))),
    "w18_class_quartiles": lambda s, p: rounded(w.class_quartiles(a.usage_series(frames(s, p)), ("priority", "shared", "backfill"))),
    "w19_device_matrix": lambda s, p: rounded(w.device_matrix(a.by_device_three(frames(s, p)), a.THREE_CLASSES)),
}

ORACLE_SQL = {
    "w1_category_buckets": f"{_CAT} SELECT * FROM cb",
    "w1_category_means": f"{_CAT} SELECT category, round(avg(total_gpus), 6) AS avg_total, round(avg(claimed_gpus), 6) AS avg_claimed, round(avg(claimed_gpus::DOUBLE / total_gpus * 100), 6) AS avg_percent FROM cb GROUP BY category",
    "w2_weekly_summary": f"{_WEEKLY} SELECT * FROM ws",
    "w2_summary_of_weeks": f"{_WEEKLY} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({m}) AS average, min({m}) AS least, max({m}) AS most FROM ws HAVING count(*) > 0" for m in _METRICS),
    "w3_weekly_allocation": f"{_W3} SELECT g.week_start, k.category, pct, avg_claimed, avg_total, intervals, n_days FROM (SELECT unnest(generate_series((SELECT min(week_start) FROM wk), (SELECT max(week_start) FROM wk), INTERVAL 7 DAY)) AS week_start) g CROSS JOIN (SELECT DISTINCT category FROM wk) k LEFT JOIN wk ON wk.week_start = g.week_start AND wk.category = k.category",
    "w4_daily_hours": f"{_DAILY} SELECT CAST(day AS VARCHAR) AS day, kind, round(gpu_hours, 6) AS gpu_hours, round(avg_claimed, 6) AS avg_claimed, measurements FROM dd",
    "w5_monthly_hours": f"{_DAILY} SELECT strftime(day, '%Y-%m') AS month, round(sum(total_hours), 6) AS total_hours, round(sum(primary_hours), 6) AS primary_hours, round(sum(backfill_hours), 6) AS backfill_hours, count(*) AS days, round(sum(total_hours) / count(*), 6) AS avg_per_day FROM wd GROUP BY 1",
    "w6_weekly_hours": f"{_DAILY} SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week_start, round(sum(total_hours), 6) AS total_hours, round(sum(primary_hours), 6) AS primary_hours, round(sum(backfill_hours), 6) AS backfill_hours, round(avg(primary_claimed), 6) AS primary_claimed, round(avg(backfill_claimed), 6) AS backfill_claimed, count(*) AS days FROM wd GROUP BY 1 HAVING count(*) = 7",
    "w7_linear_trend": f"{_DAILY}, p AS (SELECT CAST(date_diff('day', (SELECT min(day) FROM wd), day) AS DOUBLE) AS t, total_hours AS y FROM wd), q AS (SELECT {_LIN} FROM p) SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(r * r, 6) AS r2, round(CASE WHEN n > 2 THEN sqrt(greatest((syy - slope * slope * sxx) / (n - 2), 0) / sxx) END, 6) AS std_err, round(slope * 30.44, 6) AS per_month, round(slope * 365.25, 6) AS per_year, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction, n FROM q",
    "w7_fitted_line": f"{_DAILY}, p AS (SELECT day, CAST(date_diff('day', (SELECT min(day) FROM wd), day) AS DOUBLE) AS t, total_hours AS y FROM wd), q AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM p) SELECT CAST(day AS VARCHAR) AS day, round(y, 6) AS total_hours, round(a + b * t, 6) AS fitted, round(y - (a + b * t), 6) AS residual FROM p, q",
    "w8_moving_average": f"{_DAILY} SELECT CAST(day AS VARCHAR) AS day, round(total_hours, 6) AS total_hours, round(avg(total_hours) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM wd",
    "w9_split_periods": f"{_DAILY} SELECT CASE WHEN day < DATE '{SPLIT}' THEN 'before' ELSE 'after' END AS period, round(sum(total_hours), 6) AS total, round(avg(total_hours), 6) AS mean, round(max(total_hours), 6) AS most, round(min(total_hours), 6) AS least, round(sum(primary_hours) / sum(total_hours) * 100, 6) AS primary_share, round(sum(backfill_hours) / sum(total_hours) * 100, 6) AS backfill_share FROM wd GROUP BY 1",
    "w10_period_jobs": f"{_PERIOD} SELECT category, jobs, round(gpu_hours, 6) AS gpu_hours, samples FROM per",
    "w11_period_efficiency": f"{_PERIOD}, z AS (SELECT jobs AS aj, gpu_hours AS ah FROM per WHERE category = 'total') SELECT category, round(jobs / aj * 100, 6) AS job_share, round(gpu_hours / ah * 100, 6) AS hour_share, round(ah / available_hours * 100, 6) AS efficiency FROM per, z, av WHERE category != 'total'",
    "w12_type_summary": _type_sql("GPUs_DeviceName"),
    "w12_type_summary_machines": _type_sql("GPUs_DeviceName, Machine"),
    "w12_type_summary_open": _type_category_sql("Open Capacity"),
    "w12_type_summary_researcher": _type_category_sql("Researcher Owned"),
    "w13_efficiency_by_project": _by_project_sql("own_category"),
    "w13_efficiency_by_category": _by_project_sql("machine_category"),
    "w13_snapshot_efficiency": f"{_EFF} SELECT count(*) AS snapshots, round(min(efficiency), 6) AS least, round(max(efficiency), 6) AS most, round(avg(efficiency), 6) AS mean, round(median(efficiency), 6) AS median, count(*) FILTER (efficiency > 100) AS over_100 FROM ef",
    "w13_top_efficiency": f"{_EFF} SELECT timestamp, unused, backfill, round(efficiency, 6) AS efficiency FROM ef ORDER BY ef.efficiency DESC, timestamp LIMIT 10",
    "w14_never_claimed": f"{_NEVER} SELECT Machine, AssignedGPUs, tier, records FROM nt WHERE claimed = 0",
    "w14_never_claimed_summary": f"{_NEVER} SELECT tier, count(*) AS gpus, count(*) FILTER (claimed = 0) AS unused, round((count(*) - count(*) FILTER (claimed = 0)) / count(*) * 100, 6) AS used_percent FROM nt GROUP BY ROLLUP (tier)",
    "w14_unused_hosts": f"""{_NEVER} SELECT tier, device, Machine, count(*) AS unused, (SELECT count(*) FROM nt z WHERE z.Machine = nt.Machine) AS "of",
        coalesce(nullif(array_to_string(list_sort(list_distinct(flatten(list(ps)))), ', '), ''), 'None (Open Capacity)') AS projects, string_agg(AssignedGPUs, ', ' ORDER BY AssignedGPUs) AS gpus FROM nt WHERE claimed = 0 GROUP BY tier, device, Machine""",
    "w14_unused_devices": f"{_NEVER} SELECT tier, device, count(*) AS gpus, count(*) FILTER (claimed = 0) AS unused, count(DISTINCT Machine) FILTER (claimed = 0) AS hosts FROM nt GROUP BY GROUPING SETS ((tier, device), (tier), ())",
    "w15_concurrency": f"{_CONC} SELECT * FROM cc",
    "w16_top_users": f"{_CONC} SELECT RemoteOwner, round(avg(gpu_rows), 6) AS mean, max(gpu_rows) AS most, count(*) AS windows FROM cc GROUP BY 1 ORDER BY avg(gpu_rows) DESC, 1 LIMIT 10",
    "w17_open_user_series": f"{_OPEN} SELECT * FROM os",
    "w17_open_user_peaks": f"{_OPEN}, f AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY gpus DESC, bucket) AS rn FROM os) SELECT user, max(gpus) AS peak, min(bucket) FILTER (rn = 1) AS at, round((sum(gpus) * 0.25)::DOUBLE, 6) AS gpu_hours FROM f GROUP BY user ORDER BY 2 DESC, 1 LIMIT 10",
    "w17_open_user_pivot": f"{_OPEN}, pk AS (SELECT user, row_number() OVER (ORDER BY max(gpus) DESC, user) AS rank FROM os GROUP BY user), tp AS (SELECT * FROM pk WHERE rank <= 5) SELECT bucket, "
    + ", ".join(f"coalesce(max(gpus) FILTER (rank = {i}), 0) AS u{i}" for i in range(1, 6))
    + ", coalesce(max(gpus) FILTER (rank IS NULL), 0) AS others FROM os LEFT JOIN tp USING (user) GROUP BY bucket",
    "w17_bucket_peaks": f"{_PEAKS} SELECT bucket, peak, user FROM bp",
    "w17_overall_peak": f"{_PEAKS} SELECT peak, bucket, user FROM bp ORDER BY peak DESC, bucket, user LIMIT 1",
    "w18_class_quartiles": f"WITH series AS ({pa._SERIES_SQL}) " + " UNION ALL ".join(f"SELECT '{k}' AS class, round(avg({k}_usage_percent), 4) AS mean_percent, round(avg({k}_claimed), 6) AS mean_claimed, round(avg({k}_total), 6) AS mean_total, round(quantile_cont({k}_usage_percent, 0.25), 4) AS q1, round(quantile_cont({k}_usage_percent, 0.5), 4) AS median, round(quantile_cont({k}_usage_percent, 0.75), 4) AS q3 FROM series" for k in ("priority", "shared", "backfill")),
    "w19_device_matrix": "SELECT device, " + ", ".join(f"coalesce(max(allocation_usage_percent) FILTER (class = '{k}'), 0) AS \"{k}\"" for k in a.THREE_CLASSES) + f" FROM ({pa.ORACLE_SQL['a14_by_device_three']}) GROUP BY device",
}
QUERIES["w18_class_quartiles"] = lambda s, p: w.class_quartiles(a.usage_series(frames(s, p)), ("priority", "shared", "backfill")).select("class", F.round("mean_percent", 4).alias("mean_percent"), F.round("mean_claimed", 6).alias("mean_claimed"), F.round("mean_total", 6).alias("mean_total"), *[F.round(q, 4).alias(q) for q in ("q1", "median", "q3")])
