"""Queries of composed plans: preparation, strategies, surfaces, the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.operators import candles as cnd
from wickwork.operators import states
from wickwork.operators.trades import closure_sequence, wallet_state
from wickwork.functions.timeframes import duration_minutes, weekday
from wickwork.plans import strategies as op
from wickwork.plans.flagship import flagship
from wickwork.queries.base import DAY, HOUR, query
from wickwork.queries.candles import END, START
from wickwork.queries.trades import _EV, _RUN
from wickwork.sources import tables as src

_M = "SELECT pair, ts, min_by(open, seq) AS open, max(high) AS high, min(low) AS low, max_by(close, seq) AS close, max(volume) AS volume FROM ticks GROUP BY pair, ts"
_H = "SELECT pair, (ts // {n}) * {n} AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume FROM {m} GROUP BY 1, 2"
_GRID = "SELECT pair, unnest(range(min(ts), max(ts) + {n}, {n})) AS ts FROM {h} GROUP BY pair"
_FILL = "SELECT pair, ts, coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low, carried AS close, coalesce(volume, 0.0) AS volume FROM (SELECT a.pair, a.ts, b.open, b.high, b.low, b.volume, last_value(b.close IGNORE NULLS) OVER (PARTITION BY a.pair ORDER BY a.ts ROWS UNBOUNDED PRECEDING) AS carried FROM {g} a LEFT JOIN {h} b USING (pair, ts))"
_SIX = {"mrg": _M, "h6": _H.format(n=21600000, m="mrg"), "g6": _GRID.format(n=21600000, h="h6"), "c6": _FILL.format(g="g6", h="h6")}
_FLAG = {
    **_SIX,
    "w6": "SELECT *, coalesce((lag(close) OVER w > lag(open) OVER w AND close < open AND volume > 0)::INT, 0) AS en, (close > 2 * open)::INT AS ex FROM c6 WINDOW w AS (PARTITION BY pair ORDER BY ts)",
    "e6": "SELECT pair, ts AS open_ts, open AS open_rate FROM (SELECT *, lag(en) OVER (PARTITION BY pair ORDER BY ts) AS go FROM w6) WHERE go = 1",
    "x6": "SELECT *, row_number() OVER (PARTITION BY pair, open_ts ORDER BY ts) AS n FROM (SELECT e.*, s.ts, s.open, CASE WHEN ex = 1 THEN 0 WHEN s.ts >= open_ts + 172800000 THEN 1 WHEN low <= open_rate * (1 - 0.6::DOUBLE) THEN 2 END AS code FROM e6 e JOIN w6 s ON e.pair = s.pair AND s.ts > open_ts AND s.ts <= open_ts + 259200000) WHERE code IS NOT NULL",
    "r6": "SELECT e.pair, e.open_rate, coalesce(CASE x.code WHEN 0 THEN 'exit_signal' WHEN 1 THEN 'timeout' WHEN 2 THEN 'stop_loss' END, 'force_exit') AS exit_reason, coalesce(CASE WHEN x.code <= 1 THEN x.open WHEN x.code = 2 THEN e.open_rate * (1 - 0.6::DOUBLE) END, l.lo) AS exit_rate FROM e6 e LEFT JOIN x6 x ON e.pair = x.pair AND e.open_ts = x.open_ts AND x.n = 1 JOIN (SELECT pair, max_by(open, ts) AS lo FROM w6 GROUP BY pair) l ON e.pair = l.pair",
}
_MEAN = "round((sum(round({x}, 8)::DECIMAL(28,8))::DOUBLE / count(*)), {p})"
query("flagship", f"SELECT pair, exit_reason, count(*) AS trades, count(*) FILTER (exit_rate / open_rate - 1 > 0) AS wins, {_MEAN.format(x='exit_rate / open_rate - 1', p=4)} AS mean_ratio FROM r6 GROUP BY ALL", **_FLAG)(lambda s, d: flagship(s, d).withColumn("mean_ratio", F.round("mean_ratio", 4)))

# the range and its startup are cut before candles are cleaned, so gaps are filled from what is inside; the ticks of a pair with too late a start are left out
_CUT = "SELECT * FROM mrg WHERE ts BETWEEN {s} AND {e}"
_PREPARED = {
    "mrg": _M, "m1": _CUT.format(s=START - 20 * HOUR, e=END), "h1": _H.format(n=3600000, m="m1"), "g1": _GRID.format(n=3600000, h="h1"), "c1": _FILL.format(g="g1", h="h1"),
    "m6": _CUT.format(s=START - 120 * HOUR, e=END), "h6": _H.format(n=21600000, m="m6"), "g6": _GRID.format(n=21600000, h="h6"), "c6": _FILL.format(g="g6", h="h6"),
}
_RAW = f"SELECT pair, min(ts) AS first_ts, max(ts) AS last_ts FROM late GROUP BY pair"
_LATE = f"SELECT * FROM ticks WHERE pair <> 'view' OR ts >= {START} + 48 * {HOUR}"


def late(s, d):
    """Ticks of which one pair starts after the range does."""
    return src.ticks(s, d).where((F.col("pair") != "view") | (F.col("ts") >= START + 48 * HOUR))


def prepared(s, d):
    return op.prepare_candles(late(s, d), "1h", START, END, 20, {"6h": late(s, d)})


query("prepare_candles", "SELECT a.pair, a.ts, a.open, a.high, a.low, a.close, a.volume, i.close AS close_6h FROM c1 a LEFT JOIN c6 i ON a.pair = i.pair AND a.ts = i.ts + 18000000 WHERE a.pair <> 'view'", **_PREPARED)(lambda s, d: prepared(s, d)[0].select("pair", "ts", "open", "high", "low", "close", "volume", "close_6h"))
query("prepare_candles_coverage", f"SELECT pair, first_ts, last_ts, first_ts > {START} AS start_missing, last_ts + {HOUR} < {END} AS end_missing, first_ts <= {START} AND last_ts + {HOUR} >= {END} AS accepted, greatest(0, ceil((first_ts - ({START} - 20 * {HOUR})) / {HOUR}))::BIGINT AS missing_candles FROM raw", late=_LATE, raw=_RAW)(lambda s, d: prepared(s, d)[1])


def with_signals(candles):
    """A Column strategy: the pattern entry, and an exit on a doubled close."""
    return cnd.pattern_entry(candles).withColumn("exit_long", (F.col("close") > 2 * F.col("open")).cast("int"))


_STRAT = "SELECT pair, ts, open, high, low, close, volume, enter_long, exit_long FROM sig"
query("column_strategy", _STRAT)(lambda s, d: with_signals(src.full_candles(s, d)))
# one pair has 10 candles of history where 24 are asked for
_EXEC = f"SELECT *, h + greatest(0, 24 - h) + 1 AS head FROM (SELECT pair, ts, close, coalesce(lag(enter_long) OVER w, 0) AS exec_enter_long, coalesce(lag(exit_long) OVER w, 0) AS exec_exit_long, row_number() OVER w AS n, count(*) FILTER (ts < {START}) OVER (PARTITION BY pair) AS h FROM short WHERE ts <= {END} WINDOW w AS (PARTITION BY pair ORDER BY ts))"


def short_candles(s, d):
    return src.full_candles(s, d).where((F.col("pair") != "view") | (F.col("ts") >= START - 10 * HOUR))


_SHORT = "SELECT pair, ts, open, high, low, close, volume, coalesce((lag(close) OVER w > lag(open) OVER w AND close < open AND volume > 0)::INT, 0) AS enter_long, (close > 2 * open)::INT AS exit_long FROM (SELECT * FROM cf WHERE pair <> 'view' OR ts >= " + f"{START} - 10 * {HOUR}) WINDOW w AS (PARTITION BY pair ORDER BY ts)"
query("prepare_signals", "SELECT s.pair, s.ts, close, exec_enter_long, exec_exit_long, n <= head AS is_context, rate AS funding_rate, mark AS mark_price FROM ex s LEFT JOIN fund USING (pair, ts) WHERE n >= head - 24", short=_SHORT, ex=_EXEC)(
    lambda s, d: op.prepare_signals(short_candles(s, d), with_signals, START, END, src.funding(s, d), 24)[0].select("pair", "ts", "close", "exec_enter_long", "exec_exit_long", "is_context", "funding_rate", "mark_price")
)
query("prepare_signals_counts", "SELECT pair, count(*) AS rows, count(*) FILTER (exec_enter_long = 1) AS enter_long, 0::BIGINT AS enter_short, count(*) FILTER (exec_exit_long = 1) AS exit_long, 0::BIGINT AS exit_short FROM ex WHERE n > head GROUP BY pair", short=_SHORT, ex=_EXEC)(
    lambda s, d: op.prepare_signals(short_candles(s, d), with_signals, START, END, None, 24)[1]
)


class Pattern:
    """The same strategy on pandas frames."""

    def populate_indicators(self, frame, meta):
        return frame.assign(rose=(frame["close"].shift(1) > frame["open"].shift(1)))

    def populate_entry_trend(self, frame, meta):
        return frame.assign(enter_long=(frame["rose"] & (frame["close"] < frame["open"]) & (frame["volume"] > 0)).astype("int32"))

    def populate_exit_trend(self, frame, meta):
        return frame.assign(exit_long=(frame["close"] > 2 * frame["open"]).astype("int32")).drop(columns="rose")


_SCHEMA = "pair string, ts long, open double, high double, low double, close double, volume double, enter_long int, exit_long int"
query("grouped_strategy", _STRAT)(lambda s, d: op.grouped(src.full_candles(s, d), Pattern(), _SCHEMA))
query("grouped_strategy_multi", "SELECT s.*, h.close AS close_4h FROM (SELECT st.*, max(h4.ts) OVER (PARTITION BY st.pair ORDER BY st.ts ROWS UNBOUNDED PRECEDING) AS k FROM st LEFT JOIN h4 ON st.pair = h4.pair AND st.ts = h4.ts + 10800000) s LEFT JOIN h4 h ON s.pair = h.pair AND s.k = h.ts".replace("s.*", "s.* EXCLUDE (k)"), st=_STRAT, h4=_H.format(n=14400000, m="cf"))(
    lambda s, d: op.grouped_with_informative(src.full_candles(s, d), cnd.resample(src.full_candles(s, d), "4h").select("pair", "ts", "close"), "1h", "4h", Pattern(), _SCHEMA.replace("enter_long", "ts_4h long, close_4h double, enter_long")).select("pair", "ts", "open", "high", "low", "close", "volume", "close_4h", "enter_long", "exit_long")
)
query("validate_strategy_output", "SELECT pair, count(*) AS rows, 0::BIGINT AS not_ascending FROM sig GROUP BY pair")(lambda s, d: op.validate_output(with_signals(src.full_candles(s, d))))


def peeking(candles):
    """A strategy that looks one candle ahead."""
    return candles.withColumn("enter_long", F.coalesce((F.lead("close").over(cnd.by_time()) > F.col("close")).cast("int"), F.lit(0)))


query("scan_lookahead", f"SELECT {START}::BIGINT AS cutoff, pair || '@' || ts AS key, 'enter_long' AS field, '1' AS expected, '0' AS actual FROM (SELECT *, lead(close) OVER (PARTITION BY pair ORDER BY ts) AS nx FROM cf) WHERE ts = {START} AND nx > close")(
    lambda s, d: op.scan_lookahead(src.full_candles(s, d), peeking, [START], ["enter_long"]).withColumn("cutoff", F.col("cutoff").cast("long"))
)
_SWEEP = "SELECT {k}::INT AS position, '{name}' AS candidate, 'completed' AS status, NULL::VARCHAR AS error, count(*) AS trades, count(*) FILTER (r > 0) AS wins, " + _MEAN.format(x="r", p=4) + " AS mean_ratio FROM (SELECT CASE WHEN e.is_short THEN 1 - rate / open_rate ELSE rate / open_rate - 1 END AS r FROM (SELECT c.*, coalesce(x.rate, l.lo) AS rate FROM ctr c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY ts) AS n FROM (SELECT c.trade_id, s.ts, CASE WHEN NOT is_short AND exit_long = 1 OR s.ts >= open_ts + {to} THEN s.open WHEN CASE WHEN is_short THEN high >= open_rate * (1 + {st}::DOUBLE) ELSE low <= open_rate * (1 - {st}::DOUBLE) END THEN CASE WHEN is_short THEN open_rate * (1 + {st}::DOUBLE) ELSE open_rate * (1 - {st}::DOUBLE) END END AS rate FROM ctr c JOIN sig s ON c.pair = s.pair AND s.ts > open_ts AND s.ts <= open_ts + {to} + 86400000) WHERE rate IS NOT NULL) x ON c.trade_id = x.trade_id AND n = 1 JOIN (SELECT pair, max_by(open, ts) AS lo FROM sig GROUP BY pair) l ON c.pair = l.pair) e)"
_FAILED = " UNION ALL SELECT 2, 'no share', 'failed', 'stop', NULL, NULL, NULL"
_CAND = [("tight", 0.2, 6 * HOUR), ("wide", 0.8, DAY)]
query("candidate_sweep", " UNION ALL ".join(_SWEEP.format(k=k, name=n, st=st, to=to) for k, (n, st, to) in enumerate(_CAND)) + _FAILED)(lambda s, d: op.candidate_sweep(src.candle_trades(s, d), src.signals(s, d), [*_CAND, ("no share", -0.5, DAY)]))


def surface(s, d):
    """Trade surface rows: closing order, decimals as text, duration and weekday."""
    t = closure_sequence(src.closed_trades(s, d))
    return t.select("sequence", "trade_id", "pair", F.format_string("%.2f", "first_cost").alias("first_cost"), duration_minutes(F.col("open_ts"), F.col("close_ts")).alias("minutes"), weekday(F.col("open_ts")).alias("weekday"), "exit_reason")


query("result_to_surface", "SELECT row_number() OVER (ORDER BY close_ts, trade_id) - 1 AS sequence, trade_id, pair, printf('%.2f', first_cost) AS first_cost, (close_ts - open_ts) // 60000 AS minutes, (isodow(make_timestamp(open_ts * 1000)) - 1)::INT AS weekday, exit_reason FROM closed")(surface)
# both sides' states of every close; the engine's locks come in another order
_HELD = "SELECT *, CASE WHEN cl % 3 = 0 THEN ',\"locks\":[{\"pair\":\"*\",\"lock_timestamp_ms\":' || (ts - 5) || ',\"lock_end_timestamp_ms\":' || ts || ',\"side\":\"*\",\"active\":true},{\"pair\":\"a\",\"lock_timestamp_ms\":' || ts || ',\"lock_end_timestamp_ms\":' || (ts + 9) || ',\"reason\":\"r\",\"side\":\"long\",\"active\":true}]' ELSE '' END AS locks FROM run WHERE kind = 0"
_DOC = "'{\"quote_free\":\"' || cl || '.5\",\"base_balances\":[' || {bases} || '],\"open_trade_count\":' || op || ',\"realized_profit\":\"' || cl || '\",\"closed_trade_count\":' || cl || ',\"rejected_signals\":2,\"trade_id_counter\":' || (cl + op) || ',\"order_id_counter\":' || 2 * cl || locks || '}'"


def _held_locks(start: str, end: str):
    lock = lambda pair, side, a, b, reason: F.struct(F.lit(pair).alias("pair"), F.lit(side).alias("side"), a.alias(start), b.alias(end), F.lit(reason).cast("string").alias("reason"), F.lit(True).alias("active"))
    made = F.array(lock("a", "long", F.col("ts"), F.col("ts") + 9, "r"), lock("*", "*", F.col("ts") - 5, F.col("ts"), None))
    return F.when(F.col("closed_trades") % 3 == 0, made)


def _states(s, d):
    return wallet_state(src.closed_trades(s, d), 1e9).select("ts", F.col("trade_id").alias("of"), "closed_trades", F.col("open_trades").alias("open_trade_count"))


def reference_states(s, d, mode):
    n = F.col("closed_trades")
    wallets = F.create_map(F.lit("USDT"), n + 0.5, F.lit("XRP"), F.lit(0.0), F.lit("BTC"), F.lit(1.0), F.lit("ADA"), F.when(n % 2 == 0, 2.25).otherwise(0.0))
    rows = _states(s, d).withColumns({"wallets": wallets, "total_profit": n.cast("double"), "rejected_signals": F.lit(2), "trade_id": n + F.col("open_trade_count"), "order_id": n * 2, "locks": _held_locks("lock_timestamp", "lock_end_timestamp")})
    return states.project_reference_state(rows, "USDT", mode).select("ts", F.col("of").alias("trade_id"), "state")


def engine_states(s, d):
    n = F.col("closed_trades")
    free = lambda c, x: F.struct(F.lit(c).alias("currency"), x.alias("free"))
    rows = _states(s, d).withColumns({"quote_free": n + 0.5, "base_balances": F.array(free("ADA", F.when(n % 2 == 0, 2.25).otherwise(0.0)), free("BTC", F.lit(1.0))), "realized_profit": n.cast("double"), "closed_trade_count": n, "rejected_signals": F.lit(2), "trade_id_counter": n + F.col("open_trade_count"), "order_id_counter": n * 2, "locks": _held_locks("lock_timestamp_ms", "lock_end_timestamp_ms")})
    return states.project_engine_state(rows).select("ts", F.col("of").alias("trade_id"), "state")


_SPOT = "CASE WHEN cl % 2 = 0 THEN '{\"currency\":\"ADA\",\"free\":\"2.25\"},' ELSE '' END || '{\"currency\":\"BTC\",\"free\":\"1\"}'"
query("project_engine_state", "SELECT ts, trade_id, " + _DOC.replace("{bases}", _SPOT) + " AS state FROM held", ev=_EV, run=_RUN, held=_HELD)(engine_states)
query("project_reference_state", "SELECT ts, trade_id, " + _DOC.replace("{bases}", _SPOT) + " AS state FROM held", ev=_EV, run=_RUN, held=_HELD)(lambda s, d: reference_states(s, d, "spot"))
query("project_reference_state_futures", "SELECT ts, trade_id, " + _DOC.replace("{bases}", "''") + " AS state FROM held", ev=_EV, run=_RUN, held=_HELD)(lambda s, d: reference_states(s, d, "futures"))

# a strategy on chunks of 5 days of each pair with 2 hours of overlap gives what it gives on whole pairs
query("grouped_strategy_chunks", _STRAT)(lambda s, d: op.grouped(src.full_candles(s, d), Pattern(), _SCHEMA, lookback_ms=2 * HOUR, chunk_ms=5 * DAY))
