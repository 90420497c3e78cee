"""Queries over job history and event logs, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from slotscope.functions import derive as d
from slotscope.operators import jobs as j
from slotscope.operators import logs as lo
from slotscope.plans import allocation as pa
from slotscope.plans import fixtures as x
from slotscope.plans.allocation import rounded

CAP = 48.0
BURST = 18
HOST = "host5"
NOW = 1706000000
PATTERNS = ("^sleep$", "^bash$", r"^python[0-9.]*$")
#: Commands by order priority.
COMMANDS = {"1": "/bin/sleep", "2": "/bin/bash", "3": "python3", "4": "/home/u/train.py", "5": "run.sh"}


def _waits(s, p):
    return j.clean_waits(x.jobs(s, p), CAP)


def _stats(s, p):
    return j.wait_stats(_waits(s, p))


def _open(s, p):
    return j.hourly_open_slots(x.slots(s, p))


def _corr(s, p):
    return j.rolling_correlation(_open(s, p), _stats(s, p))


def _info(s, p):
    cmd = d.lookup(F.substring("o_orderpriority", 1, 1), COMMANDS, F.lit("other"))
    return x.table(s, p, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("GlobalJobId"), cmd.alias("Cmd"), (((F.col("o_custkey") * 131) % 86400) / 3600).alias("runtime_hours"))


def _runs(s, p):
    return lo.evicted_runs(x.job_logs(s, p))


def _matches(s, p):
    return lo.evicting_jobs(_runs(s, p), x.jobs(s, p))


_W = f"WITH {x.JOBS_SQL}, wt AS (SELECT make_timestamp(QDate * 1000000) AS at, initialwaitduration / 3600 AS wait_h, Owner FROM jobs WHERE RequestGpus = 1 AND initialwaitduration >= 1 AND initialwaitduration / 3600 <= {CAP})"
_GRID = """gr AS (SELECT make_timestamp(s * 1000000) AS at FROM (SELECT unnest(range((SELECT CAST(floor(epoch(min(at)) / 1800) * 1800 AS BIGINT) FROM wt), (SELECT CAST(ceil(epoch(max(at)) / 1800) * 1800 AS BIGINT) FROM wt) + 1, 1800)) AS s)),
rm AS (SELECT g.at, CASE WHEN count(w.at) >= 5 THEN median(w.wait_h) END AS rolling_median, count(w.at) AS jobs FROM gr g LEFT JOIN wt w ON w.at >= g.at - INTERVAL 6 HOUR AND w.at < g.at GROUP BY g.at)"""
_BASE = """dm AS (SELECT date_trunc('day', at)::TIMESTAMP AS day, median(wait_h) AS daily_median FROM wt GROUP BY 1),
db AS (SELECT day, daily_median, CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(daily_median, 0.5) OVER w END AS baseline FROM dm WINDOW w AS (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""
_STATS = f"{_W}, {_GRID}, {_BASE}, sr AS (SELECT rm.at, rolling_median, baseline, rolling_median / baseline AS ratio FROM rm ASOF LEFT JOIN db ON rm.at >= db.day)"
_OPEN = f"""{x.RAW_SQL}, {pa.simple_sql('three_tier')}, sn AS (SELECT timestamp, count(DISTINCT AssignedGPUs) FILTER (State = 'Unclaimed') AS u, count(DISTINCT AssignedGPUs) FILTER (State = 'Claimed') AS c FROM s WHERE NOT is_bf AND coalesce(PrioritizedProjects, '') = '' GROUP BY 1),
oh AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, avg(u) AS open_unclaimed, avg(c) AS open_claimed, count(*) AS samples FROM sn GROUP BY 1)"""
_MIS = f"{_STATS}, {_OPEN}, th AS (SELECT avg(open_unclaimed) + stddev_samp(open_unclaimed) AS threshold FROM oh WHERE hour <= (SELECT min(hour) FROM oh) + INTERVAL 3 DAY), wh AS (SELECT date_trunc('hour', at)::TIMESTAMP AS hour, max(ratio) AS ratio FROM sr GROUP BY 1), mh AS (SELECT oh.hour, open_unclaimed, ratio, threshold FROM oh JOIN wh USING (hour), th WHERE open_unclaimed > threshold AND ratio > 1.05)"
_CORR = f"""{_STATS}, {_OPEN}, wm AS (SELECT date_trunc('hour', at)::TIMESTAMP AS hour, median(rolling_median) AS wait FROM sr GROUP BY 1), bo AS (SELECT coalesce(oh.hour, wm.hour) AS hour, open_unclaimed, wait FROM oh FULL JOIN wm ON oh.hour = wm.hour),
hg AS (SELECT unnest(generate_series((SELECT min(hour) FROM bo), (SELECT max(hour) FROM bo), INTERVAL 1 HOUR)) AS hour), fu AS (SELECT hg.hour, open_unclaimed, wait FROM hg LEFT JOIN bo ON bo.hour = hg.hour),
cr AS (SELECT hour, CASE WHEN count(CASE WHEN open_unclaimed IS NOT NULL AND wait IS NOT NULL THEN 1 END) OVER w >= 8 AND NOT isnan(corr(open_unclaimed, wait) OVER w) THEN corr(open_unclaimed, wait) OVER w END AS correlation FROM fu WINDOW w AS (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""
_J = f"WITH {x.JOBS_SQL}"
_H = "initialwaitduration / 3600"
_STAT_COLS = f"count(*) AS jobs, round(avg({_H}), 6) AS mean, round(median({_H}), 6) AS median, round(stddev_samp({_H}), 6) AS std, round(min({_H}), 6) AS least, round(max({_H}), 6) AS most, round(count(*) / (SELECT count(*) FROM jobs) * 100, 6) AS share"
_GAPS = f"{_J}, ru0 AS (SELECT JobStartDate AS s, max(CompletionDate) OVER (ORDER BY JobStartDate, CompletionDate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM jobs WHERE StartdName = '{HOST}'), gp AS (SELECT make_timestamp(u * 1000000) AS \"start\", make_timestamp(s * 1000000) AS \"end\", (s - u) / 3600 AS hours FROM ru0 WHERE (s - u) / 3600 > 1)"
_L = f"WITH {x.LOGS_SQL}"
_MATCH = f"""WITH {x.LOGS_SQL}, {x.JOBS_SQL}, pr AS (SELECT ru.*, j.ClusterId, j.ProcId, j.StartdSlot, j."User" AS ju, j.ProjectName AS jp, epoch(ru.at) - j.QDate AS diff, contains(lower(j.StartdName), lower(host)) AS h2, contains(lower(j.StartdName), split_part(host, '.', 1)) AS h1,
  contains(lower(j.StartdSlot), lower(split_part(slot, '@', 1))) AND slot != 'Unknown' AS sl, regexp_extract(j.AssignedGPUs, 'GPU-([a-f0-9]+)', 1) = gpu AND gpu != 'Unknown' AS gm FROM ru JOIN jobs j ON j.QDate <= epoch(ru.at) AND j.QDate >= epoch(ru.at) - 1800),
p1 AS (SELECT * FROM (SELECT *, bool_or(h2) OVER (PARTITION BY log, at) AS a2 FROM pr) WHERE CASE WHEN a2 THEN h2 ELSE h1 END), p2 AS (SELECT * FROM (SELECT *, bool_or(sl) OVER (PARTITION BY log, at) AS a3 FROM p1) WHERE NOT a3 OR sl),
p3 AS (SELECT * FROM (SELECT *, bool_or(gm) OVER (PARTITION BY log, at) AS a4 FROM p2) WHERE NOT a4 OR gm), p4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log, at ORDER BY diff, ClusterId, ProcId) AS rn FROM p3) WHERE rn = 1),
ma AS (SELECT ru.log, ru.at, ru.host, p4.ClusterId || '.' || p4.ProcId AS evicting_job, ju AS job_user, jp AS job_project,
  CASE WHEN rn IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.log = ru.log AND pr.at = ru.at) THEN 'no_match' ELSE 'no_candidates' END WHEN diff > 900 THEN 'low' WHEN p4.gpu != 'Unknown' AND gm THEN 'high' WHEN p4.gpu != 'Unknown' THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN rn IS NULL THEN '' ELSE concat_ws(',', CASE WHEN p4.gpu != 'Unknown' AND gm THEN 'exact_gpu_match' WHEN p4.gpu != 'Unknown' THEN 'host_time_match' ELSE 'host_time_only' END, CASE WHEN p4.slot != 'Unknown' AND contains(StartdSlot, split_part(p4.slot, '@', 1)) THEN 'slot_match' END, CASE WHEN diff <= 300 THEN 'close_time_match' END) END AS reason,
  round(diff / 60, 6) AS minutes FROM ru LEFT JOIN p4 ON p4.log = ru.log AND p4.at = ru.at)"""
_RUN_COLS = ("log", "at", "code", "host", "slot", "gpu", "device", "runtime")
_MATCH_COLS = ("log", "at", "host", "evicting_job", "job_user", "job_project", "confidence", "reason", "minutes")

QUERIES = {
    "j1_clean_waits": lambda s, p: rounded(_waits(s, p)),
    "j1_cleaning_counts": lambda s, p: j.cleaning_counts(x.jobs(s, p), CAP),
    "j2_rolling_medians": lambda s, p: rounded(j.rolling_medians(_waits(s, p))),
    "j3_baseline": lambda s, p: rounded(j.daily_baseline(_waits(s, p))),
    "j3_wait_stats": lambda s, p: rounded(_stats(s, p)),
    "j4_recent_history": lambda s, p: rounded(j.recent_against_history(_waits(s, p))),
    "j5_elevated_events": lambda s, p: rounded(j.elevated_events(_stats(s, p), ratio=1.1)),
    "j6_jobs_per_hour": lambda s, p: j.jobs_per_hour(_waits(s, p)),
    "j7_open_slots": lambda s, p: rounded(_open(s, p)),
    "j8_mismatch_hours": lambda s, p: rounded(j.mismatch_hours(_open(s, p), _stats(s, p), 3, 1.0, 1.05)),
    "j8_mismatch_events": lambda s, p: rounded(j.mismatch_events(j.mismatch_hours(_open(s, p), _stats(s, p), 3, 1.0, 1.05))),
    "j9_bursts": lambda s, p: j.bursts(x.jobs(s, p), BURST),
    "j10_rolling_correlation": lambda s, p: rounded(_corr(s, p), 5),
    "j11_positive_runs": lambda s, p: j.positive_runs(_corr(s, p)),
    "j12_day_mean": lambda s, p: rounded(j.day_mean(_open(s, p), "open_unclaimed")),
    "j13_wait_statistics": lambda s, p: rounded(j.wait_statistics(x.jobs(s, p))),
    "j14_wait_histogram": lambda s, p: j.wait_histogram(x.jobs(s, p)),
    "j15_waits_by_day": lambda s, p: rounded(j.waits_by_day(x.jobs(s, p))),
    "j16_host_hours": lambda s, p: j.host_hours(x.jobs(s, p), HOST),
    "j17_job_spans": lambda s, p: rounded(j.job_spans(x.jobs(s, p), HOST)),
    "j18_idle_gaps": lambda s, p: rounded(j.idle_gaps(x.jobs(s, p), HOST)),
    "j18_gap_summary": lambda s, p: rounded(j.gap_summary(j.idle_gaps(x.jobs(s, p), HOST, 0.0), x.jobs(s, p), HOST)),
    "j19_machine_months": lambda s, p: rounded(j.machine_months(x.jobs(s, p), HOST)),
    "j20_host_days": lambda s, p: rounded(j.host_days(x.jobs(s, p), NOW, host_part="HOST1")),
    "j21_suspicious_jobs": lambda s, p: rounded(j.suspicious_jobs(x.slots(s, p), _info(s, p), PATTERNS)),
    "r19_gpu_hex": lambda s, p: x.jobs(s, p).groupBy(d.gpu_hex(F.col("AssignedGPUs")).alias("hex")).agg(F.count(F.lit(1)).alias("n")),
    "r20_job_columns": lambda s, p: rounded(j.job_columns(x.jobs(s, p), ("host1", "host2"), ("Proj1", "Proj4"))),
    "r21_safe_numbers": lambda s, p: x.table(s, p, "orders").select("o_orderkey", d.safe_double(F.substring("o_orderpriority", 1, 1)).alias("a"), d.positive_or_null(F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))).alias("b"), d.safe_long(F.col("o_orderpriority"), -1).alias("c")),
    "r22_node_devices": lambda s, p: j.node_devices(x.jobs(s, p).select(F.col("StartdName").alias("node"), F.concat_ws(", ", "AssignedGPUs", F.lit("0"), F.col("Owner")).alias("detected"))),
    "l1_starts": lambda s, p: lo.starts(x.job_logs(s, p)).drop("no"),
    "l2_evictions": lambda s, p: lo.evictions(x.job_logs(s, p)).drop("no"),
    "l3_identity": lambda s, p: lo.identity(x.job_logs(s, p)),
    "l4_evicted_runs": lambda s, p: _runs(s, p).select(*_RUN_COLS),
    "l5_succeeded": lambda s, p: lo.succeeded(x.job_logs(s, p)),
    "l6_evicting_jobs": lambda s, p: rounded(_matches(s, p).select(*_MATCH_COLS)),
    "l7_eviction_summary": lambda s, p: lo.eviction_summary(_runs(s, p), lo.identity(x.job_logs(s, p))),
    "l8_mean_evictions": lambda s, p: rounded(lo.mean_evictions(_runs(s, p), lo.identity(x.job_logs(s, p)))),
    "l9_confidence_counts": lambda s, p: lo.confidence_counts(_matches(s, p), "HOST1"),
}

ORACLE_SQL = {
    "j1_clean_waits": f"{_W} SELECT at, round(wait_h, 6) AS wait_h, Owner FROM wt",
    "j1_cleaning_counts": f"{_W} SELECT (SELECT count(*) FROM wt) AS kept, (SELECT count(*) FROM jobs) - (SELECT count(*) FROM wt) AS dropped",
    "j2_rolling_medians": f"{_W}, {_GRID} SELECT at, round(rolling_median, 6) AS rolling_median, jobs FROM rm",
    "j3_baseline": f"{_W}, {_BASE} SELECT day, round(daily_median, 6) AS daily_median, round(baseline, 6) AS baseline FROM db",
    "j3_wait_stats": f"{_STATS} SELECT at, round(rolling_median, 6) AS rolling_median, round(baseline, 6) AS baseline, round(ratio, 6) AS ratio FROM sr",
    "j4_recent_history": f"{_W}, k AS (SELECT *, at > (SELECT max(at) FROM wt) - INTERVAL 7 DAY AS r FROM wt), o AS (SELECT quantile_cont(wait_h, 0.5) FILTER (r) AS recent_median, quantile_cont(wait_h, 0.9) FILTER (r) AS recent_p90, count(*) FILTER (r) AS recent_jobs, quantile_cont(wait_h, 0.5) FILTER (NOT r) AS history_median, quantile_cont(wait_h, 0.9) FILTER (NOT r) AS history_p90, count(*) FILTER (NOT r) AS history_jobs FROM k) SELECT round(recent_median, 6) AS recent_median, round(recent_p90, 6) AS recent_p90, recent_jobs, round(history_median, 6) AS history_median, round(history_p90, 6) AS history_p90, history_jobs, round(recent_median / history_median, 6) AS ratio FROM o",
    "j5_elevated_events": f"{_STATS}, nn AS (SELECT * FROM sr WHERE rolling_median IS NOT NULL AND ratio IS NOT NULL), pk AS (SELECT at, ratio, max(ratio) OVER w AS peak_ratio, max(rolling_median) OVER w AS peak_median FROM nn WINDOW w AS (ORDER BY at RANGE BETWEEN CURRENT ROW AND INTERVAL 6 HOUR FOLLOWING)), ev AS (SELECT *, at - lag(at) OVER (ORDER BY at) AS gap FROM pk WHERE ratio > 1.1) SELECT at, round(peak_ratio, 6) AS peak_ratio, round(peak_median, 6) AS peak_median FROM ev WHERE gap IS NULL OR gap > INTERVAL 6 HOUR",
    "j6_jobs_per_hour": f"{_W}, hc AS (SELECT date_trunc('hour', at)::TIMESTAMP AS hour, count(*) AS n FROM wt GROUP BY 1) SELECT g.hour, coalesce(n, 0) AS jobs FROM (SELECT unnest(generate_series((SELECT min(hour) FROM hc), (SELECT max(hour) FROM hc), INTERVAL 1 HOUR)) AS hour) g LEFT JOIN hc ON hc.hour = g.hour",
    "j7_open_slots": f"WITH {_OPEN} SELECT hour, round(open_unclaimed, 6) AS open_unclaimed, round(open_claimed, 6) AS open_claimed, samples FROM oh",
    "j8_mismatch_hours": f"{_MIS} SELECT hour, round(open_unclaimed, 6) AS open_unclaimed, round(ratio, 6) AS ratio, round(threshold, 6) AS threshold FROM mh",
    "j8_mismatch_events": f"{_MIS}, pk AS (SELECT hour, max(open_unclaimed) OVER w AS u, max(ratio) OVER w AS r, hour - lag(hour) OVER (ORDER BY hour) AS gap FROM mh WINDOW w AS (ORDER BY hour RANGE BETWEEN CURRENT ROW AND INTERVAL 6 HOUR FOLLOWING)) SELECT hour, round(u, 6) AS peak_unclaimed, round(r, 6) AS peak_ratio FROM pk WHERE gap IS NULL OR gap > INTERVAL 2 HOUR",
    "j9_bursts": f"{_J}, hj AS (SELECT date_trunc('hour', make_timestamp(QDate * 1000000))::TIMESTAMP AS hour, Owner, count(*) AS n FROM jobs GROUP BY 1, 2), hh AS (SELECT hour, CAST(sum(n) AS BIGINT) AS jobs FROM hj GROUP BY hour HAVING sum(n) > {BURST}), tp AS (SELECT hour, Owner AS owner FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY n DESC, Owner) AS rn FROM hj) WHERE rn = 1), ev AS (SELECT hh.hour, jobs, owner, hh.hour - lag(hh.hour) OVER (ORDER BY hh.hour) AS gap FROM hh JOIN tp ON tp.hour = hh.hour) SELECT hour, jobs, owner FROM ev WHERE gap IS NULL OR gap > INTERVAL 6 HOUR",
    "j10_rolling_correlation": f"{_CORR} SELECT hour, round(correlation, 5) AS correlation FROM cr",
    "j11_positive_runs": f"{_CORR}, ps AS (SELECT hour, coalesce(correlation > 0, false) AS pos FROM cr), nw AS (SELECT *, CAST(pos != lag(pos) OVER (ORDER BY hour) AS INTEGER) AS new FROM ps), rn AS (SELECT *, sum(coalesce(new, 1)) OVER (ORDER BY hour) AS run FROM nw), rr AS (SELECT run, pos, min(hour) AS s, max(hour) AS l FROM rn GROUP BY run, pos), nx AS (SELECT *, lead(s) OVER (ORDER BY s) AS nxt FROM rr), oo AS (SELECT s AS \"start\", coalesce(nxt, l) AS \"end\", CAST((epoch(coalesce(nxt, l)) - epoch(s)) / 3600 AS BIGINT) + CASE WHEN nxt IS NULL THEN 1 ELSE 0 END AS hours FROM nx WHERE pos) SELECT * FROM oo WHERE hours >= 4",
    "j12_day_mean": f"WITH {_OPEN} SELECT hour, round(CASE WHEN count(open_unclaimed) OVER w >= 6 THEN avg(open_unclaimed) OVER w END, 6) AS mean_24h FROM oh WINDOW w AS (ORDER BY hour RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW)",
    "j13_wait_statistics": f"{_J} SELECT RequestGpus, 'all' AS prioritized, {_STAT_COLS} FROM jobs GROUP BY RequestGpus UNION ALL SELECT RequestGpus, CAST(Prioritized AS VARCHAR) AS prioritized, {_STAT_COLS} FROM jobs GROUP BY RequestGpus, Prioritized",
    "j14_wait_histogram": f"{_J} SELECT Prioritized, RequestGpus, CAST(least(floor({_H}), 25) AS BIGINT) AS bin, count(*) AS jobs, count(*) FILTER ({_H} >= 24) AS over_24h FROM jobs GROUP BY ALL",
    "j15_waits_by_day": f"{_J} SELECT date_trunc('day', make_timestamp(JobStartDate * 1000000))::TIMESTAMP AS day, Prioritized, round(quantile_cont({_H}, 0.25), 6) AS q1, round(quantile_cont({_H}, 0.5), 6) AS median, round(quantile_cont({_H}, 0.75), 6) AS q3, round(avg({_H}), 6) AS mean, count(*) AS jobs FROM jobs GROUP BY 1, 2",
    "j16_host_hours": f"{_J} SELECT make_timestamp(h * 1000000) AS hour, sum(RequestGpus) AS gpus FROM (SELECT unnest(range((SELECT min(JobStartDate) // 3600 * 3600 FROM jobs), (SELECT max(CompletionDate) FROM jobs) + 1, 3600)) AS h), jobs WHERE StartdName = '{HOST}' AND JobStartDate <= h AND CompletionDate >= h GROUP BY 1",
    "j17_job_spans": f"{_J} SELECT AssignedGPUs AS gpu, make_timestamp(JobStartDate * 1000000) AS \"start\", round((CompletionDate - JobStartDate) / 3600, 6) AS hours FROM jobs WHERE StartdName = '{HOST}'",
    "j18_idle_gaps": _GAPS + ' SELECT "start", "end", round(hours, 6) AS hours FROM gp',
    "j18_gap_summary": _GAPS.replace("/ 3600 > 1)", "/ 3600 > 0)") + f" SELECT count(*) AS gaps, round(sum(hours), 6) AS total, round(avg(hours), 6) AS mean, round(min(hours), 6) AS least, round(max(hours), 6) AS most, (SELECT round((max(CompletionDate) - min(JobStartDate)) / 3600, 6) FROM jobs WHERE StartdName = '{HOST}') AS range_hours, round(sum(hours) / (SELECT (max(CompletionDate) - min(JobStartDate)) / 3600 FROM jobs WHERE StartdName = '{HOST}') * 100, 6) AS idle_percent FROM gp",
    "j19_machine_months": f"{_J} SELECT strftime(make_timestamp(JobStartDate * 1000000), '%Y-%m') AS month, count(*) AS jobs, round(sum(CompletionDate - JobStartDate) / 3600, 6) AS hours, round(sum(CompletionDate - JobStartDate) / 3600 / 720 * 100, 6) AS utilization FROM jobs WHERE StartdName = '{HOST}' GROUP BY 1",
    "j20_host_days": f"{_J}, k AS (SELECT StartdName AS host, CAST(floor(({NOW} - RecordTime) / 86400) + 1 AS BIGINT) AS back, RemoteWallClockTime AS w FROM jobs WHERE RecordTime <= {NOW} AND floor(({NOW} - RecordTime) / 86400) + 1 <= 7 AND contains(lower(StartdName), 'host1')) SELECT h.host, d.days_back, count(k.w) AS jobs, round(coalesce(sum(k.w), 0) / 3600, 6) AS wall_hours FROM (SELECT DISTINCT host FROM k) h CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS BIGINT) AS days_back) d LEFT JOIN k ON k.host = h.host AND k.back = d.days_back GROUP BY ALL",
    "j21_suspicious_jobs": f"WITH {x.RAW_SQL}, inf AS (SELECT o_orderkey || '.0' AS GlobalJobId, CASE substr(o_orderpriority, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items()) + " ELSE 'other' END AS Cmd, ((o_custkey * 131) % 86400) / 3600 AS runtime_hours FROM orders) SELECT r.GlobalJobId, Cmd, RemoteOwner, count(DISTINCT AssignedGPUs) AS gpus, round(max(runtime_hours), 6) AS runtime_hours FROM raw r JOIN inf ON inf.GlobalJobId = r.GlobalJobId WHERE State = 'Claimed' AND NOT is_bf AND shared AND runtime_hours >= 1 AND regexp_matches(regexp_extract(Cmd, '([^/]*)$', 1), '^sleep$|^bash$|^python[0-9.]*$') GROUP BY ALL",
    "r19_gpu_hex": f"{_J} SELECT regexp_extract(AssignedGPUs, 'GPU-([a-f0-9]+)', 1) AS hex, count(*) AS n FROM jobs GROUP BY 1",
    "r20_job_columns": f"{_J} SELECT ClusterId, round((JobStartDate - FirstjobmatchDate) / 3600, 6) AS waittime, CompletionDate - JobCurrentStartDate AS runtime, StartdName IN ('host1', 'host2') AND ProjectName IN ('Proj1', 'Proj4') AS prioritised FROM jobs",
    "r21_safe_numbers": "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS a, CASE WHEN -o_orderkey > 0 THEN CAST(-o_orderkey AS DOUBLE) END AS b, CAST(-1 AS BIGINT) AS c FROM orders",
    "r22_node_devices": f"{_J} SELECT DISTINCT StartdName AS node, unnest([AssignedGPUs, Owner]) AS gpu FROM jobs",
    "l1_starts": f"{_L} SELECT * FROM st",
    "l2_evictions": f"{_L} SELECT log, at, code FROM ru",
    "l3_identity": f"{_L} SELECT * FROM nm",
    "l4_evicted_runs": f"{_L} SELECT * FROM ru",
    "l5_succeeded": f"{_L} SELECT log, c % 4 != 0 AS succeeded FROM lg",
    "l6_evicting_jobs": f"{_MATCH} SELECT * FROM ma",
    "l7_eviction_summary": f"{_L} SELECT s.log, s.evictions, s.devices, gpus, sleep, capability, cluster, proc FROM (SELECT log, count(*) AS evictions, coalesce(string_agg(DISTINCT device, ', ') FILTER (device != 'Unknown'), 'Unknown') AS devices FROM ru GROUP BY log) s JOIN nm ON nm.log = s.log",
    "l8_mean_evictions": f"{_L} SELECT gpus, sleep, capability, round(avg(coalesce(n, 0)), 6) AS mean_evictions, count(*) AS jobs FROM nm LEFT JOIN (SELECT log, count(*) AS n FROM ru GROUP BY log) k ON k.log = nm.log WHERE gpus IS NOT NULL GROUP BY ALL",
    "l9_confidence_counts": f"{_MATCH} SELECT confidence, count(*) AS n, (SELECT count(*) FROM ma) AS total FROM ma WHERE contains(lower(host), 'host1') GROUP BY confidence",
}
# "at" needs quotes in this SQL
ORACLE_SQL = {k: re.sub(r'(?<!")\bat\b(?!")', '"at"', v) for k, v in ORACLE_SQL.items()}
