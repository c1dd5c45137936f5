"""Queries of run statistics and pair selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.operators import candles as cnd
from wickwork.operators import joins as jn
from wickwork.operators import runs as op
from wickwork.operators import universe as uni
from wickwork.queries.base import HOUR, query
from wickwork.queries.joins import _GAPS, END, PAIRS, START
from wickwork.sources import tables as src

_OK = "FROM runs WHERE status = 'completed' GROUP BY lane"
_STATS = f"SELECT lane, count(*) AS runs, min(wall_time_seconds) AS min_wall, median(wall_time_seconds) AS median_wall, max(wall_time_seconds) AS max_wall, min(peak_rss_bytes) AS min_peak, max(peak_rss_bytes) AS max_peak {_OK}"
query("run_stats", f"SELECT s.*, x.mean_wall FROM stats s JOIN (SELECT lane, round(sum(round(wall_time_seconds, 6)::DECIMAL(20,6))::DOUBLE / count(*), 4) AS mean_wall {_OK}) x USING (lane)", stats=_STATS)(lambda s, d: op.run_stats(src.run_records(s, d)).withColumn("mean_wall", F.round("mean_wall", 4)))
query("relative_spread", "SELECT lane, round(CASE WHEN median_wall = 0 THEN 0 ELSE (max_wall - min_wall) / median_wall END, 6) AS spread FROM stats", stats=_STATS)(lambda s, d: op.relative_spread(src.run_records(s, d)).withColumn("spread", F.round("spread", 6)))
query("determinism_check", "SELECT lane, count(DISTINCT h) AS hashes, count(DISTINCT h) = 1 AND count(*) = count(h) AS deterministic FROM (SELECT lane, CASE WHEN lane = 'error' AND arrival % 2 = 0 THEN 'other' WHEN lane = 'view' AND arrival % 50 = 0 THEN NULL ELSE result_sha256 END AS h FROM runs) GROUP BY lane")(
    lambda s, d: op.determinism_check(src.run_records(s, d).withColumn("result_sha256", F.when((F.col("lane") == "error") & (F.col("arrival") % 2 == 0), "other").when((F.col("lane") == "view") & (F.col("arrival") % 50 == 0), F.lit(None)).otherwise(F.col("result_sha256"))))
)
query("scope_gate", "SELECT arrival, pair_count >= 80 AND days >= 1825 AS representative FROM runs")(lambda s, d: op.scope_gate(src.run_records(s, d)).select("arrival", "representative"))
_GATE = "SELECT round(max(median_wall) FILTER (lane = 'click') / max(median_wall) FILTER (lane = 'view'), 6) AS speedup, max(max_peak) FILTER (lane = 'view') <= 1e9 AS memory_ok, true AS deterministic FROM stats"
query("speedup_gate", "SELECT *, coalesce(speedup >= 10, false) AS fast_enough, coalesce(speedup >= 10, false) AND coalesce(memory_ok, false) AS passed FROM gate", stats=_STATS, gate=_GATE)(lambda s, d: op.speedup_gate(src.run_records(s, d), "click", "view", 1e9).withColumn("speedup", F.round("speedup", 6)))
query("phase_profile", "SELECT v.phase, coalesce(n, 0) AS calls, coalesce(t, 0) AS total, coalesce(x, 0) AS longest, n IS NULL AS missing FROM (VALUES ('indicators'), ('callbacks'), ('trade_scans'), ('event_simulation')) v(phase) LEFT JOIN (SELECT phase, count(*) AS n, round(sum(round(wall_time_seconds, 6)::DECIMAL(20,6))::DOUBLE, 4) AS t, max(wall_time_seconds) AS x FROM runs WHERE phase <> 'event_simulation' GROUP BY phase) s ON v.phase = s.phase")(lambda s, d: op.phase_profile(src.run_records(s, d).where("phase <> 'event_simulation'")).withColumn("total", F.round("total", 4)))
query("batch_efficiency", "SELECT round(j, 4) AS job_seconds, c AS all_complete, round(j / 1000, 6) AS parallelism, round(j / 1000 / 64, 6) AS efficiency FROM (SELECT sum(round(wall_time_seconds, 6)::DECIMAL(20,6))::DOUBLE AS j, bool_and(status = 'completed') AS c FROM runs)")(
    lambda s, d: op.batch_efficiency(src.run_records(s, d), 1000.0, 64).select(F.round("job_seconds", 4).alias("job_seconds"), "all_complete", F.round("parallelism", 6).alias("parallelism"), F.round("efficiency", 6).alias("efficiency"))
)
query("outcome_samples", "SELECT lane, status, count(*) AS outcomes, string_agg(arrival, ',' ORDER BY arrival) FILTER (n <= 3) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY lane, status ORDER BY arrival) AS n FROM runs) GROUP BY ALL")(lambda s, d: op.outcome_samples(src.run_records(s, d), ["lane", "status"]))
query("pair_footprint", "SELECT pair, bytes, row_number() OVER (ORDER BY bytes DESC, pair DESC) = 1 AS is_largest FROM (SELECT lane AS pair, sum(floor(peak_rss_bytes)::BIGINT)::BIGINT AS bytes FROM runs GROUP BY lane)")(lambda s, d: op.pair_footprint(src.run_records(s, d).select(F.col("lane").alias("pair"), F.floor("peak_rss_bytes").alias("bytes"))))
query("append_run_records", "SELECT run_id, min_by(lane, arrival) AS lane, min_by(result_sha256, arrival) AS result_sha256, max_by(status, arrival) AS status, max_by(wall_time_seconds, arrival) AS wall_time_seconds, max(arrival) AS arrival, max_by(updated_at, arrival) AS updated_at FROM runs GROUP BY run_id")(
    lambda s, d: (lambda r: op.upsert_runs(r.where("arrival % 2 = 0"), r.where("arrival % 2 = 1")))(src.run_records(s, d).select("run_id", "lane", "result_sha256", "status", "wall_time_seconds", "arrival", "updated_at"))
)
query("list_runs", "SELECT run_id, updated_at FROM runs ORDER BY updated_at DESC, run_id LIMIT 50")(lambda s, d: op.list_runs(src.run_records(s, d).select("run_id", "updated_at"), 50))
query("read_profile_events", "SELECT arrival, CASE WHEN phase = 'unknown' THEN 'phase' WHEN wall_time_seconds - 50 < 0 THEN 'negative' WHEN 60 > wall_time_seconds - 50 THEN 'longest_above_total' WHEN arrival % 3 = 0 AND wall_time_seconds <> 50 THEN 'time_without_calls' END AS error FROM runs")(
    lambda s, d: op.profile_errors(src.run_records(s, d).select("arrival", "phase", (F.col("arrival") % 3).alias("calls"), (F.col("wall_time_seconds") - 50).alias("total"), F.lit(60.0).alias("longest"))).select("arrival", "error")
)
query("performance_report", "SELECT g.*, coalesce(speedup >= 10, false) AS fast_enough, coalesce(speedup >= 10, false) AND memory_ok AS passed, (SELECT round(max((max_wall - min_wall) / median_wall), 6) FROM stats WHERE lane IN ('click', 'view')) AS spread, (SELECT count(*) FROM runs WHERE pair_count >= 80 AND days >= 1825) AS representative_runs, false AS steady_runs FROM gate g", stats=_STATS, gate=_GATE)(
    lambda s, d: op.performance_report(src.run_records(s, d), "click", "view", 1e9).withColumns({"speedup": F.round("speedup", 6), "spread": F.round("spread", 6)}).withColumnRenamed("steady", "steady_runs")
)

_NAMES = [(0, "BTC/USDT"), (1, " ETH/USDT"), (2, "ADA/USDT:USDT"), (3, "XRP"), (4, "SOL/USDT"), (5, "SOL/USDT"), (6, "BTCUP/USDT")]
_NAMES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _NAMES) + ") v(\"order\", pair)"


def names(s, d):
    """Candidate names, with those of the customers' segments."""
    seg = src.table(s, d, "customer").select((F.lit(10) + F.col("c_custkey")).cast("int").alias("order"), F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")).alias("pair"))
    return s.createDataFrame(_NAMES, "order int, pair string").unionByName(seg)


_ALL = f'{_NAMES_SQL} UNION ALL SELECT (10 + c_custkey)::INT, c_mktsegment || \'/\' || c_custkey FROM customer'
query("validate_pairlist", 'SELECT "order", pair, CASE WHEN trim(pair) <> pair OR NOT regexp_full_match(pair, \'[^/\\s]+/[^/\\s]+\') THEN \'name\' WHEN contains(pair, \':\') THEN \'spot\' WHEN count(*) OVER (PARTITION BY pair) > 1 THEN \'duplicate\' END AS error FROM nm', nm=_ALL)(lambda s, d: uni.validate_pairlist(names(s, d)))
query("filter_blacklist", "SELECT \"order\", pair FROM nm WHERE NOT regexp_full_match(pair, '(.*UP/USDT)|(BUILDING/1.*)')", nm=_ALL)(lambda s, d: uni.filter_blacklist(names(s, d), [".*UP/USDT", "BUILDING/1.*"]))
query("blacklisted_pairs", "SELECT DISTINCT pair FROM nm WHERE regexp_full_match(pair, '(.*UP/USDT)|(BUILDING/1.*)')", nm=_ALL)(lambda s, d: uni.blacklisted_pairs(names(s, d), uni.filter_blacklist(names(s, d), [".*UP/USDT", "BUILDING/1.*"])))
_SEL = "SELECT \"order\", pair, concat_ws(',', CASE WHEN coalesce(start_missing, true) THEN 'start' END, CASE WHEN coalesce(end_missing, true) THEN 'end' END, CASE WHEN dup IS NULL OR dup > 0 THEN 'duplicates' END, CASE WHEN rev IS NULL OR rev > 0 THEN 'reversals' END, CASE WHEN gap IS NULL OR gap > 0 THEN 'gaps' END) AS reasons FROM (VALUES (0, 'click'), (1, 'view'), (2, 'purchase'), (3, 'error'), (4, 'signup'), (5, 'absent')) v(\"order\", pair) LEFT JOIN gaps USING (pair) LEFT JOIN ql USING (pair)"
_QL = "SELECT pair, count(*) FILTER (x = 0) AS dup, count(*) FILTER (x < 0) AS rev, count(*) FILTER (x > 36000000) AS gap FROM (SELECT pair, ts - lag(ts) OVER (PARTITION BY pair ORDER BY ts) AS x FROM candles) GROUP BY pair"
_SELECTED = 'SELECT "order", pair, reasons, reasons = \'\' AND sum((reasons = \'\')::INT) OVER (ORDER BY "order") <= 2 AS selected FROM sel'


def selection(s, d):
    cand = s.createDataFrame(list(enumerate(PAIRS)), "order int, pair string")
    return uni.select_universe(cand, jn.coverage_gaps(src.candles(s, d), PAIRS, HOUR, START, END, "strict"), cnd.quality(src.candles(s, d), 10 * HOUR, "ts"), 2)


_SEL = _SEL.replace("(VALUES (0, 'click'), (1, 'view'), (2, 'purchase'), (3, 'error'), (4, 'signup'), (5, 'absent'))", "(VALUES " + ", ".join(f"({k}, '{p}')" for k, p in enumerate(PAIRS)) + ")")
query("select_universe", "SELECT * FROM chosen", gaps=_GAPS, ql=_QL, sel=_SEL, chosen=_SELECTED)(selection)
query("release_selection_report", "SELECT coalesce(string_agg(pair, ',' ORDER BY pair) FILTER (selected), '') AS selected, coalesce(string_agg(pair, ',' ORDER BY pair) FILTER (reasons <> ''), '') AS rejected, 'click,error' AS blacklisted, count(*) AS candidates, 2 AS required, (SELECT '[' || string_agg('{\"pair\":\"' || pair || '\",\"duplicates\":' || dup || ',\"reversals\":' || rev || ',\"gaps\":' || gap || '}', ',' ORDER BY pair) || ']' FROM ql WHERE pair IN (SELECT pair FROM sel)) AS quality FROM chosen", gaps=_GAPS, ql=_QL, sel=_SEL, chosen=_SELECTED)(lambda s, d: uni.selection_report(selection(s, d), src.candles(s, d).select("pair").where("pair in ('click', 'error')").distinct(), cnd.quality(src.candles(s, d), 10 * HOUR, "ts"), 2))
query("feature_union", "SELECT DISTINCT unnest(string_split(o_orderpriority, '-')) AS feature FROM orders")(lambda s, d: uni.feature_union(src.table(s, d, "orders").select(F.col("o_orderkey").alias("rule"), F.split("o_orderpriority", "-").alias("features"))))


def _inventory(s, d, changed=False):
    """Files of the run records: all (None), those sealed, or those found later with changes."""
    r = src.run_records(s, d)
    h = F.when(F.lit(bool(changed)) & (F.col("arrival") % 97 == 5), "changed").otherwise(F.col("result_sha256"))
    b = F.floor("peak_rss_bytes") + F.when(F.lit(bool(changed)) & (F.col("arrival") % 101 == 3), 1).otherwise(0)
    out = r.select(F.concat(F.lit("f"), F.col("arrival").cast("string")).alias("path"), b.alias("bytes"), h.alias("sha256"), F.col("pair_count").cast("long").alias("rows"), F.col("updated_at").alias("first_ts"), F.col("updated_at").alias("last_ts"), "arrival")
    if changed is None:
        return out
    return out.where("arrival % 89 <> 1") if changed else out.where("arrival % 83 <> 2")


query("verify_inventory", "SELECT 'f' || arrival AS path, CASE WHEN arrival % 89 = 1 THEN 'missing' WHEN arrival % 83 = 2 THEN 'unsealed' WHEN arrival % 101 = 3 THEN 'size' ELSE 'hash' END AS reason FROM runs WHERE (arrival % 89 = 1 OR arrival % 83 = 2 OR arrival % 101 = 3 OR arrival % 97 = 5) AND NOT (arrival % 89 = 1 AND arrival % 83 = 2)")(lambda s, d: uni.verify_inventory(_inventory(s, d), _inventory(s, d, True)))
_LINES = "SELECT substr(sha256('f' || arrival), 1, 3) AS part, floor(peak_rss_bytes)::BIGINT AS b, concat_ws('|', 'f' || arrival, floor(peak_rss_bytes)::BIGINT, result_sha256, pair_count, updated_at, updated_at) AS l FROM runs"
_PARTS = "SELECT part, count(*) AS n, sum(b) AS b, sha256(string_agg(l, chr(10) ORDER BY l)) AS d FROM file_lines GROUP BY part"
query("dataset_digest", "SELECT sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)) AS digest FROM file_parts", file_lines=_LINES, file_parts=_PARTS)(lambda s, d: uni.dataset_digest(_inventory(s, d, None)))
