"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.operators import candles as cnd
from wickwork.operators import joins as op
from wickwork.queries.base import DAY, HOUR, query
from wickwork.sources import tables as src

PAIRS = ["click", "view", "purchase", "error", "signup", "absent"]
_PAIRS = ", ".join(f"('{p}')" for p in PAIRS)
START, END = 1_704_153_600_000, 1_706_745_600_000
_H4 = "SELECT pair, (ts // 14400000) * 14400000 AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume FROM cf GROUP BY 1, 2"
TIERS = [("a", k, lo, hi, lev, rate, amount) for k, (lo, hi, lev, rate, amount) in enumerate([(0.0, 50_000.0, 20.0, 0.01, 0.0), (50_000.0, 250_000.0, 10.0, 0.02, 500.0), (250_000.0, 2_000_000.0, 4.0, 0.05, 8_000.0)])]
_TIERS = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {lo}::DOUBLE, {hi}::DOUBLE, {lev}::DOUBLE, {rate}::DOUBLE, {amount}::DOUBLE)" for _, k, lo, hi, lev, rate, amount in TIERS) + ") AS v(tier_no, min_notional, max_notional, max_leverage, maintenance_rate, maintenance_amount)"


def tiers(spark, sf_dir):
    """The same tiers for every pair."""
    rows = spark.createDataFrame([t[1:] for t in TIERS], "tier_no int, min_notional double, max_notional double, max_leverage double, maintenance_rate double, maintenance_amount double")
    pairs = src.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("pair")).distinct()
    return pairs.crossJoin(F.broadcast(rows))


_inf = lambda s, d: cnd.resample(src.full_candles(s, d), "4h").select("pair", "ts", "open", "close")
query("merge_informative", "SELECT cf.*, h4.ts AS ts_4h, h4.open AS open_4h, h4.close AS close_4h FROM cf LEFT JOIN h4 ON cf.pair = h4.pair AND cf.ts = h4.ts + 10800000", h4=_H4)(lambda s, d: op.merge_informative(src.full_candles(s, d), _inf(s, d), "1h", "4h"))
query("merge_informative_ffill", "SELECT m.* EXCLUDE (ts_4h, k), h.ts AS ts_4h, h.open AS open_4h, h.close AS close_4h FROM (SELECT cf.*, h4.ts AS ts_4h, max(h4.ts) OVER (PARTITION BY cf.pair ORDER BY cf.ts ROWS UNBOUNDED PRECEDING) AS k FROM cf LEFT JOIN h4 ON cf.pair = h4.pair AND cf.ts = h4.ts + 10800000) m LEFT JOIN h4 h ON m.pair = h.pair AND m.k = h.ts", h4=_H4)(lambda s, d: op.merge_informative(src.full_candles(s, d), _inf(s, d), "1h", "4h", ffill=True))
query("funding_events", "SELECT a.pair, a.ts, a.rate, b.open AS mark FROM fund a JOIN cf b USING (pair, ts)")(lambda s, d: op.funding_events(src.funding(s, d).select("pair", "ts", F.col("rate").alias("open")), src.full_candles(s, d)))
query("attach_funding", "SELECT cf.*, rate AS funding_rate, mark AS mark_price FROM cf LEFT JOIN fund USING (pair, ts)")(lambda s, d: op.attach_funding(src.full_candles(s, d), src.funding(s, d)))
_GAPS = f"SELECT v.pair, first_ts, last_ts, first_ts IS NULL OR first_ts > {START} AS start_missing, first_ts IS NULL OR last_ts + {HOUR} < {END} AS end_missing FROM (VALUES {_PAIRS}) v(pair) LEFT JOIN (SELECT pair, min(ts) AS first_ts, max(ts) AS last_ts FROM candles GROUP BY pair) h ON v.pair = h.pair"
query("coverage_gaps", "SELECT *, NOT (start_missing OR end_missing) AS accepted FROM gaps", gaps=_GAPS)(lambda s, d: op.coverage_gaps(src.candles(s, d), PAIRS, HOUR, START, END))
query("coverage_gaps_available", "SELECT *, NOT end_missing AS accepted FROM gaps", gaps=_GAPS)(lambda s, d: op.coverage_gaps(src.candles(s, d), PAIRS, HOUR, START, END, "available"))
_SHORT = f"SELECT v.pair, greatest(0, ceil((first_ts - ({START} - 40 * {HOUR})) / {HOUR}::DOUBLE))::BIGINT AS missing_candles FROM (VALUES {_PAIRS}) v(pair) LEFT JOIN (SELECT pair, min(ts) AS first_ts FROM candles GROUP BY pair) h ON v.pair = h.pair"
query("startup_shortfalls", "SELECT pair, CASE WHEN pair IN (SELECT pair FROM candles) THEN missing_candles END AS missing_candles FROM short", short=_SHORT)(lambda s, d: op.startup_shortfalls(src.candles(s, d), PAIRS, HOUR, START, 40))
query("needs_prepend", "SELECT coalesce(bool_or(start_missing OR coalesce(missing_candles, 0) > 0), false) AS needs_prepend FROM gaps JOIN short USING (pair) WHERE first_ts IS NOT NULL", gaps=_GAPS, short=_SHORT)(
    lambda s, d: op.needs_prepend(op.coverage_gaps(src.candles(s, d), PAIRS, HOUR, START, END), op.startup_shortfalls(src.candles(s, d), PAIRS, HOUR, START, 40), True)
)
query("append_frontier", f"SELECT coalesce(bool_or(b > a), false) AS advanced FROM (SELECT pair, max(ts) FILTER (ts < {START + 10 * DAY}) AS a, max(ts) AS b FROM candles GROUP BY pair) WHERE a + {HOUR} < {END}")(lambda s, d: op.frontier_advanced(src.candles(s, d).where(F.col("ts") < START + 10 * DAY), src.candles(s, d), HOUR, END))
_STEPS = f"SELECT pair, ts, step FROM (VALUES ('click', {START + DAY}, 0.01::DOUBLE), ('click', {START + 9 * DAY}, 0.001::DOUBLE), ('view', {START + 5 * DAY}, 0.5::DOUBLE)) v(pair, ts, step)"


def _steps(s):
    return s.createDataFrame([("click", START + DAY, 0.01), ("click", START + 9 * DAY, 0.001), ("view", START + 5 * DAY, 0.5)], "pair string, ts long, step double")


query("price_step_asof", "SELECT cf.pair, cf.ts, cf.close, coalesce(st.step, CASE WHEN cf.pair = 'view' THEN 0.25::DOUBLE END, 1.0::DOUBLE) AS step FROM cf ASOF LEFT JOIN st ON cf.pair = st.pair AND cf.ts >= st.ts", st=_STEPS)(
    lambda s, d: op.price_step_asof(src.full_candles(s, d).select("pair", "ts", "close"), _steps(s), s.createDataFrame([("view", 0.25)], "pair string, step double"), 1.0)
)
query("leverage_cap", "SELECT trade_id, (SELECT min_by(max_leverage, tier_no) FROM tr WHERE stake_amount <= max_notional / max_leverage) AS max_leverage FROM closed", tr=_TIERS)(lambda s, d: op.tier_cap(src.closed_trades(s, d).select("trade_id", "pair", F.col("stake_amount").alias("stake")), tiers(s, d)).select("trade_id", "max_leverage"))
query("maintenance_tier", "SELECT trade_id, (SELECT max_by(maintenance_rate, min_notional) FROM tr WHERE stake_amount >= min_notional) AS maintenance_rate, (SELECT max_by(maintenance_amount, min_notional) FROM tr WHERE stake_amount >= min_notional) AS maintenance_amount FROM closed", tr=_TIERS)(
    lambda s, d: op.maintenance_tier(src.closed_trades(s, d).select("trade_id", "pair", F.col("stake_amount").alias("stake")), tiers(s, d)).select("trade_id", "maintenance_rate", "maintenance_amount")
)
query("trade_extrema", "SELECT trade_id, min(low) AS min_rate, max(high) AS max_rate FROM ctr JOIN cf ON ctr.pair = cf.pair AND cf.ts BETWEEN open_ts AND close_ts GROUP BY trade_id")(lambda s, d: op.trade_extrema(src.candle_trades(s, d), src.full_candles(s, d)))
query("funding_by_trade", "SELECT trade_id, round(coalesce(sum(CASE WHEN is_short THEN 1 ELSE -1 END * rate * mark * amount), 0), 4) AS funding_fees, count(rate) AS events FROM ctr LEFT JOIN fund ON ctr.pair = fund.pair AND open_ts < ts AND ts <= close_ts GROUP BY trade_id")(
    lambda s, d: op.funding_by_trade(src.candle_trades(s, d), src.funding(s, d)).select("trade_id", (F.round("funding_fees", 4) + 0.0).alias("funding_fees"), "events")
)


def _two_fills(s, d):
    """Each candle trade with a second entry of half the amount three hours after the first, and an exit."""
    t = src.candle_trades(s, d)
    fill = lambda k, entry, amount, ts: F.struct(F.lit(k).alias("sequence"), F.lit(entry).alias("is_entry"), amount.alias("amount"), ts.alias("ts"))
    rows = F.array(fill(0, True, F.col("amount"), F.col("open_ts")), fill(1, True, F.col("amount") / 2, F.col("open_ts") + 3 * HOUR), fill(2, False, F.col("amount") * 1.5, F.col("close_ts")))
    return t.select("trade_id", F.explode(rows).alias("o")).select("trade_id", "o.*")


query(
    "funding_by_segment",
    "SELECT trade_id, 1::INT AS sequence, round(sum(CASE WHEN is_short THEN 1 ELSE -1 END * rate * mark * amount), 4) AS funding_fee FROM ctr JOIN fund ON ctr.pair = fund.pair AND open_ts < ts AND ts <= open_ts + 10800000 GROUP BY trade_id UNION ALL SELECT trade_id, 2::INT, round(sum(CASE WHEN is_short THEN 1 ELSE -1 END * rate * mark * amount * 1.5), 4) FROM ctr JOIN fund ON ctr.pair = fund.pair AND open_ts + 10800000 < ts AND ts <= close_ts GROUP BY trade_id",
)(lambda s, d: op.funding_by_segment(_two_fills(s, d), src.candle_trades(s, d), src.funding(s, d)).withColumn("funding_fee", F.round("funding_fee", 4) + 0.0))
_BARRIER = """
SELECT e.trade_id, e.pair, e.open_ts, e.open_rate, e.close_ts, e.amount, e.is_short, coalesce(x.ts, l.last_ts) AS exit_ts, coalesce(CASE x.code WHEN 0 THEN 'exit_signal' WHEN 1 THEN 'timeout' WHEN 2 THEN 'stop_loss' WHEN 3 THEN 'liquidation' END, 'force_exit') AS exit_reason, coalesce(CASE WHEN x.code <= 1 THEN x.open WHEN x.code = 2 THEN x.stop ELSE x.liq END, l.last_open) AS exit_rate
FROM ctr e LEFT JOIN hits x ON e.trade_id = x.trade_id AND x.n = 1 LEFT JOIN (SELECT pair, max(ts) AS last_ts, max_by(open, ts) AS last_open FROM sig GROUP BY pair) l ON e.pair = l.pair
"""
_HITS = """
SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY ts) AS n FROM (
  SELECT e.trade_id, e.stop, e.liq, s.ts, s.open, CASE WHEN (CASE WHEN is_short THEN exit_short ELSE exit_long END) = 1 THEN 0 WHEN s.ts >= open_ts + 86400000 THEN 1 WHEN CASE WHEN is_short THEN high >= stop ELSE low <= stop END THEN 2 WHEN CASE WHEN is_short THEN high >= liq ELSE low <= liq END THEN 3 END AS code
  FROM (SELECT *, CASE WHEN is_short THEN open_rate * (1 + 0.6::DOUBLE) ELSE open_rate * (1 - 0.6::DOUBLE) END AS stop, CASE WHEN is_short THEN open_rate * (1 + 0.9::DOUBLE) ELSE open_rate * (1 - 0.9::DOUBLE) END AS liq FROM ctr) e
  JOIN sig s ON e.pair = s.pair AND s.ts > e.open_ts) WHERE code IS NOT NULL
"""
query("first_barrier", _BARRIER, hits=_HITS)(lambda s, d: op.first_barrier(src.candle_trades(s, d), src.signals(s, d), 0.6, DAY, 0.9))
_LOCKED = "SELECT pair, ts FROM sig e WHERE enter_long = 1 AND EXISTS (SELECT 1 FROM lck l WHERE l.pair IN (e.pair, '*') AND l.lock_ts <= e.ts AND l.lock_end > e.ts)"
query("locked_entries", _LOCKED)(lambda s, d: op.locked_entries(src.signals(s, d).where("enter_long = 1"), src.candle_locks(s, d)))
query("with_reference_pair", "SELECT cf.*, b.close AS ref_close, b.volume AS ref_volume FROM cf LEFT JOIN cf b ON b.pair = 'view' AND cf.ts = b.ts")(lambda s, d: op.with_reference_pair(src.full_candles(s, d), "view", ["close", "volume"]))
