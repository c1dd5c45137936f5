"""Queries of the lock operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.operators import locks as op
from wickwork.operators.trades import closure_sequence
from wickwork.queries.base import DAY, query
from wickwork.sources import tables as src

BACK, HOLD = 30 * DAY, 7 * DAY
_TS = "SELECT *, row_number() OVER (ORDER BY close_ts, trade_id) - 1 AS sequence FROM closed"
_COOL = f"SELECT pair, '*' AS side, close_ts AS ts, close_ts + {HOLD} AS until, 'cooldown' AS reason, sequence, false AS is_global, 0 AS handler FROM tsq"
_LOSS = f"SELECT a.pair, a.sequence, a.close_ts, count(b.sequence) AS n, max(b.close_ts) AS latest FROM tsq a JOIN tsq b ON a.pair = b.pair AND b.sequence <= a.sequence AND b.close_ts > a.close_ts - {BACK} AND b.exit_reason IN ('stop_loss', 'liquidation') AND b.profit_ratio <> 0 AND b.profit_ratio < -0.2 GROUP BY ALL"
_STOP = f"SELECT pair, '*' AS side, close_ts AS ts, latest + {HOLD} AS until, 'stoploss_guard' AS reason, sequence, false AS is_global, 1 AS handler FROM losses WHERE n >= 3"
_LOW = f"SELECT pair, '*' AS side, close_ts AS ts, close_ts + {HOLD} AS until, 'low_profit' AS reason, sequence, false AS is_global, 2 AS handler FROM (SELECT a.pair, a.sequence, a.close_ts, count(*) AS n, sum(round(b.profit_ratio, 8)::DECIMAL(28,8)) AS total FROM tsq a JOIN tsq b ON a.pair = b.pair AND b.sequence <= a.sequence AND b.close_ts > a.close_ts - {BACK} GROUP BY ALL) WHERE n >= 3 AND total < -0.5"


def sequenced(s, d):
    return closure_sequence(src.closed_trades(s, d).select("trade_id", "pair", "is_short", "close_ts", "profit_abs", "profit_ratio", "exit_reason"))


query("cooldown_locks", "SELECT * FROM cool", tsq=_TS, cool=_COOL)(lambda s, d: op.cooldown_requests(sequenced(s, d), HOLD))
query("cooldown_locks_unlock_at", "SELECT pair, ts, CASE WHEN dd + 77400000 > ts THEN dd + 77400000 ELSE dd + 163800000 END AS until, sequence FROM (SELECT *, (ts // 86400000) * 86400000 AS dd FROM (SELECT pair, close_ts + 80000000 * (sequence % 2) AS ts, sequence FROM tsq))", tsq=_TS)(
    lambda s, d: op.cooldown_requests(sequenced(s, d).withColumn("close_ts", F.col("close_ts") + 80000000 * (F.col("sequence") % 2)), None, "21:30").select("pair", "ts", "until", "sequence")
)
query("stoploss_guard_locks", "SELECT * FROM stop", tsq=_TS, losses=_LOSS, stop=_STOP)(lambda s, d: op.stoploss_requests(sequenced(s, d), BACK, 3, HOLD, -0.2))
query("low_profit_locks", "SELECT * FROM low_profit", tsq=_TS, low_profit=_LOW)(lambda s, d: op.low_profit_requests(sequenced(s, d), BACK, 3, HOLD, -0.5))
# every look-back's curve point by point, from what was earned before it
_DDR = """SELECT sequence, close_ts, n, worst FROM (
  SELECT a.sequence, a.close_ts, count(*) AS n, list({v} ORDER BY b.sequence) AS v, any_value(a.before) AS before FROM
    (SELECT t.*, (SELECT coalesce(sum(round(p.profit_abs, 8)::DECIMAL(28,8)), 0)::DOUBLE FROM tsq p WHERE p.close_ts <= t.close_ts - {back}) AS before FROM tsq t) a
    JOIN tsq b ON b.sequence <= a.sequence AND b.close_ts > a.close_ts - {back} GROUP BY ALL),
  LATERAL (SELECT max({fall}) AS worst FROM (SELECT c, greatest({base}, max(c) OVER (ORDER BY i)) AS h FROM (SELECT i, {base} + sum(x) OVER (ORDER BY i) AS c FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i))))"""
_RATIOS, _EQUITY = _DDR.format(v="b.profit_ratio", back=BACK, fall="h - c", base="0.0::DOUBLE"), _DDR.format(v="b.profit_abs", back=BACK, fall="(h - c) / h", base="(5e6::DOUBLE + before)")
_DRAWN = "SELECT '*' AS pair, '*' AS side, close_ts AS ts, close_ts + {hold} AS until, 'max_drawdown' AS reason, sequence, true AS is_global, 3 AS handler FROM dr WHERE n >= 3 AND worst > {allowed}"
query("max_drawdown_locks", _DRAWN.format(hold=HOLD, allowed=1.7), tsq=_TS, dr=_RATIOS)(lambda s, d: op.drawdown_requests(sequenced(s, d), BACK, 3, HOLD, 1.7))
query("max_drawdown_locks_equity", _DRAWN.format(hold=HOLD, allowed=0.05), tsq=_TS, dr=_EQUITY)(lambda s, d: op.drawdown_requests(sequenced(s, d), BACK, 3, HOLD, 0.05, 5e6))
_EMIT = """SELECT pair, side, ts AS lock_ts, lock_end, reason, sequence FROM (
  SELECT r.*, max(r.lock_end) OVER (PARTITION BY pair ORDER BY sequence, handler ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM (SELECT *, (until // 86400000 + 1) * 86400000 AS lock_end FROM (SELECT * FROM cool UNION ALL SELECT * FROM stop UNION ALL SELECT * FROM low_profit)) r)
  WHERE earlier IS NULL OR earlier <= until"""
query("lock_emission", _EMIT, tsq=_TS, losses=_LOSS, cool=_COOL, stop=_STOP, low_profit=_LOW)(
    lambda s, d: (lambda t: op.emit_locks(op.cooldown_requests(t, HOLD).unionByName(op.stoploss_requests(t, BACK, 3, HOLD, -0.2)).unionByName(op.low_profit_requests(t, BACK, 3, HOLD, -0.5)), DAY))(sequenced(s, d))
)
query("lock_identity_count", "SELECT count(*) AS locks FROM (SELECT * FROM lck UNION SELECT pair, side, lock_ts, lock_end + 3600000 * ((lock_ts // 3600000) % 2), reason FROM lck)")(lambda s, d: op.lock_identity_count(src.candle_locks(s, d), src.candle_locks(s, d).withColumn("lock_end", F.col("lock_end") + 3_600_000 * (F.floor(F.col("lock_ts") / 3_600_000) % 2))))
query("lock_union", "SELECT * FROM lck UNION SELECT pair, 'long' AS side, lock_ts, lock_end, reason FROM lck WHERE pair = '*'")(lambda s, d: op.lock_identities(src.candle_locks(s, d), src.candle_locks(s, d).where("pair = '*'").withColumn("side", F.lit("long"))))
query("sort_locks", "SELECT pair, side, lock_ts, lock_end, reason FROM lck ORDER BY 3, 4, 1, 2, 5")(lambda s, d: op.sort_locks(src.candle_locks(s, d)))
