"""Queries of the candle operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.operators import candles as op
from wickwork.queries.base import DAY, HOUR, query
from wickwork.sources import tables as src

START, END = 1_704_672_000_000, 1_705_276_800_000  # 8 and 15 January 2024


def _ms(df, *names):
    return df.select(*names)


query("dedup_keep_last", "SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY pair, ts ORDER BY seq DESC) n FROM ticks) WHERE n = 1")(lambda s, d: op.dedup_keep_last(src.ticks(s, d)))
query("merge_duplicate_candles", "SELECT pair, ts, min_by(open, seq) AS open, max(high) AS high, min(low) AS low, max_by(close, seq) AS close, max(volume) AS volume FROM ticks GROUP BY ALL")(lambda s, d: op.merge_duplicates(src.ticks(s, d)))

_RESAMPLE = "SELECT pair, {b} AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume FROM cf GROUP BY 1, 2"
query("resample_candles_4h", _RESAMPLE.format(b="(ts // 14400000) * 14400000"))(lambda s, d: op.resample(src.full_candles(s, d), "4h"))
query("resample_candles_1w", _RESAMPLE.format(b="((ts - 432000000) // 604800000) * 604800000 + 432000000 + 518400000"))(lambda s, d: op.resample(src.full_candles(s, d), "1w"))
query("resample_candles_3d", "SELECT pair, f0 + ((ts - f0) // 259200000) * 259200000 AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume FROM (SELECT *, (min(ts) OVER (PARTITION BY pair) // 86400000) * 86400000 AS f0 FROM cf) GROUP BY 1, 2")(lambda s, d: op.resample(src.full_candles(s, d), "3d"))
query("fill_gaps", "SELECT * FROM cf")(lambda s, d: src.full_candles(s, d))
query(
    "clean_candles",
    "SELECT pair, ts, coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low, carried AS close, coalesce(volume, 0.0) AS volume FROM (SELECT g2.pair, g2.ts, h2.open, h2.high, h2.low, h2.volume, last_value(h2.close IGNORE NULLS) OVER (PARTITION BY g2.pair ORDER BY g2.ts ROWS UNBOUNDED PRECEDING) AS carried FROM g2 LEFT JOIN h2 USING (pair, ts))",
    merged="SELECT pair, ts, min_by(open, seq) AS open, max(high) AS high, min(low) AS low, max_by(close, seq) AS close, max(volume) AS volume FROM ticks GROUP BY pair, ts",
    h2="SELECT pair, (ts // 7200000) * 7200000 AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume FROM merged GROUP BY 1, 2",
    g2="SELECT pair, unnest(range(min(ts), max(ts) + 7200000, 7200000)) AS ts FROM h2 GROUP BY pair",
)(lambda s, d: op.clean_candles(src.ticks(s, d), "2h"))
query("filter_timerange", f"SELECT * FROM cf WHERE ts BETWEEN {START} AND {END}")(lambda s, d: op.filter_timerange(src.full_candles(s, d), START, END))
query("slice_half_open", f"SELECT * FROM cf WHERE ts >= {START} AND ts < {END}")(lambda s, d: op.slice_half_open(src.full_candles(s, d), START, END))
query("bound_startup_window", f"SELECT *, '1h' AS timeframe FROM cf WHERE ts BETWEEN {START} - 10 * {HOUR} AND {END} UNION ALL SELECT pair, ts, open, high, low, close, volume, '4h' FROM h4 WHERE ts BETWEEN {START} - 20 * {HOUR * 4} AND {END}", h4=_RESAMPLE.format(b="(ts // 14400000) * 14400000"))(
    lambda s, d: op.startup_windows(src.full_candles(s, d).withColumn("timeframe", F.lit("1h")).unionByName(op.resample(src.full_candles(s, d), "4h").withColumn("timeframe", F.lit("4h"))), {"1h": 10, "4h": 20}, START, END)
)
query("execution_window", f"SELECT pair, ts, open, high, low, close, volume, n <= head AS is_context FROM (SELECT *, h + greatest(0, 30 - h) + 1 AS head FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS n, count(*) OVER (PARTITION BY pair) AS c, count(*) FILTER (ts < {START}) OVER (PARTITION BY pair) AS h FROM cf WHERE ts <= {END})) WHERE n >= head - 30 AND c > head")(lambda s, d: op.execution_window(src.full_candles(s, d), START, END, 30))
query("validate_candles", "SELECT pair, min(row) AS row, min_by(code, row) AS code FROM (SELECT pair, row_number() OVER w - 1 AS row, CASE WHEN ts < 0 THEN 'negative_time' WHEN open <= 0 THEN 'open_not_positive' WHEN high < low THEN 'high_below_low' WHEN low <= 0 THEN 'low_not_positive' WHEN volume < 0 THEN 'negative_volume' WHEN lag(ts) OVER w >= ts THEN 'time_not_increasing' END AS code FROM ticks WINDOW w AS (PARTITION BY pair ORDER BY seq)) WHERE code IS NOT NULL GROUP BY pair")(lambda s, d: op.validate_candles(src.ticks(s, d), "seq"))
query("project_features", "SELECT pair, ts, open, high, low, close, volume, close - open AS body FROM cf")(lambda s, d: op.project_features(src.full_candles(s, d).withColumn("body", F.col("close") - F.col("open")).withColumn("unused", F.lit(1)), ["body", "close"]))
query("encode_nonfinite", "SELECT pair, ts, CASE WHEN volume = 0 AND close > open THEN '{\"$float\":\"inf\"}' WHEN volume = 0 AND close < open THEN '{\"$float\":\"-inf\"}' WHEN volume = 0 THEN '{\"$float\":\"nan\"}' ELSE printf('%.6f', (close - open) / volume) END AS encoded FROM cf")(
    lambda s, d: src.full_candles(s, d).withColumn("x", F.when(F.col("volume") != 0, (F.col("close") - F.col("open")) / F.col("volume")).when(F.col("close") > F.col("open"), float("inf")).when(F.col("close") < F.col("open"), float("-inf")).otherwise(float("nan"))).select("pair", "ts", op.encode_nonfinite("x").alias("encoded"))
)
_DIGITS = "SELECT pair, strftime(make_timestamp(ts * 1000), '%Y-%m') AS month, max(length(regexp_extract(printf('%.10f', price), '\\.([0-9]*[1-9])', 1)))::INT AS digits FROM (SELECT pair, ts, unnest([open, high, low, close]) AS price FROM cf) GROUP BY 1, 2"
query("monthly_price_digits", "SELECT *, round(pow(10.0::DOUBLE, -digits), 12) AS step FROM dig WHERE digits > 0", dig=_DIGITS)(lambda s, d: op.monthly_price_digits(src.full_candles(s, d)))
query("step_changes", "SELECT pair, month, digits, step FROM (SELECT *, lag(step) OVER (PARTITION BY pair ORDER BY month) AS b FROM (SELECT *, round(pow(10.0::DOUBLE, -digits), 12) AS step FROM dig WHERE digits > 0)) WHERE b IS NULL OR b <> step", dig=_DIGITS.replace("%Y-%m", "%Y-%m"))(lambda s, d: op.step_changes(op.monthly_price_digits(src.full_candles(s, d))))
query("candle_coverage", "SELECT pair, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM candles GROUP BY pair")(lambda s, d: op.coverage(src.candles(s, d)))
query("candle_quality", "SELECT pair, count(*) FILTER (gap = 0) AS duplicates, count(*) FILTER (gap < 0) AS reversals, count(*) FILTER (gap > 3600000) AS gaps, coalesce(sum(gap // 3600000 - 1) FILTER (gap > 3600000), 0)::BIGINT AS missing, coalesce(max(gap), 0)::BIGINT AS max_gap FROM (SELECT pair, ts - lag(ts) OVER (PARTITION BY pair ORDER BY seq) AS gap FROM ticks) GROUP BY pair")(lambda s, d: op.quality(src.ticks(s, d), HOUR))
query("interval_diff", "SELECT *, ts - lag(ts) OVER (PARTITION BY pair ORDER BY ts) AS gap_ms FROM candles")(lambda s, d: op.interval_diff(src.candles(s, d)))
query("previous_close", "SELECT *, lag(close) OVER (PARTITION BY pair ORDER BY ts) AS previous_close FROM cf")(lambda s, d: op.previous_close(src.full_candles(s, d)))
query("lookback_features", "SELECT pair, ts, lag(close, 1) OVER w AS c1, lag(volume, 3) OVER w AS v3, lag(close, 6) OVER w AS c6 FROM cf WINDOW w AS (PARTITION BY pair ORDER BY ts)")(lambda s, d: op.lookback(src.full_candles(s, d), ["close", "volume"]).select("pair", "ts", F.col("lag_1.close").alias("c1"), F.col("lag_3.volume").alias("v3"), F.col("lag_6.close").alias("c6")))
query("return_bound", "SELECT pair, bound, max(bound) OVER () >= 0.5 AS roi_reachable FROM (SELECT pair, round(max(high) / min(low) - 1, 6) AS bound FROM cf GROUP BY pair)")(lambda s, d: op.return_bound(src.full_candles(s, d), 0.5).withColumn("bound", F.round("bound", 6)))
query("event_loop_volume", f"SELECT count(DISTINCT ts) AS timestamps, count(*) AS pair_rows FROM cf WHERE ts >= {START}")(lambda s, d: op.event_loop_volume(src.full_candles(s, d), START))
query("row_slot", "SELECT *, ((row_number() OVER (PARTITION BY pair ORDER BY ts) - 1) % 7)::INT AS slot FROM cf")(lambda s, d: op.row_slot(src.full_candles(s, d), 7))
query("candle_pattern_entry", "SELECT pair, ts, open, high, low, close, volume, coalesce((pc > po AND close < open AND volume > 0)::INT, 0) AS enter_long FROM cfw")(lambda s, d: op.pattern_entry(src.full_candles(s, d)))
query("first_rule_match", "SELECT pair, ts, CASE WHEN volume = 0 THEN 0 WHEN close > open * 2 THEN 1 WHEN high > low THEN 2 END AS rule FROM cf")(lambda s, d: op.first_rule_match(src.full_candles(s, d), ["volume = 0", "close > open * 2", "high > low"]).select("pair", "ts", "rule"))
query("replay_prefix", f"SELECT * FROM cf WHERE ts <= {START}")(lambda s, d: op.replay_prefix(src.full_candles(s, d), START))
