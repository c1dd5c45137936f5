"""Registry of queries, and the DuckDB twins of the derived tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000
DAY = 24 * HOUR

#: Derived tables by name, in the order in which they build on each other.
CTES = {
    "ticks": "SELECT event_type AS pair, (epoch_us(ts) // 3600000000) * 3600000 AS ts, event_id AS seq, value AS open, value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume FROM events",
    "candles": "SELECT pair, ts, min_by(open, seq) AS open, max(high) AS high, min(low) AS low, max_by(close, seq) AS close, sum(volume) AS volume FROM ticks GROUP BY pair, ts",
    "grid": "SELECT pair, unnest(range(min(ts), max(ts) + 3600000, 3600000)) AS ts FROM candles GROUP BY pair",
    "filled": "SELECT g.pair, g.ts, c.open, c.high, c.low, c.volume, last_value(c.close IGNORE NULLS) OVER (PARTITION BY g.pair ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS close FROM grid g LEFT JOIN candles c USING (pair, ts)",
    "cf": "SELECT pair, ts, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0.0) AS volume FROM filled",
    "cfw": "SELECT *, lag(close) OVER w AS pc, lag(open) OVER w AS po FROM cf WINDOW w AS (PARTITION BY pair ORDER BY ts)",
    "sig": "SELECT pair, ts, open, high, low, close, volume, coalesce((pc > po AND close < open AND volume > 0)::INT, 0) AS enter_long, (close > 2 * open)::INT AS exit_long, 0 AS enter_short, 0 AS exit_short, CASE WHEN pc > po AND close < open AND volume > 0 THEN CASE (ts // 3600000) % 4 WHEN 0 THEN '141 142' WHEN 1 THEN '121' WHEN 2 THEN '' END END AS enter_tag, NULL::VARCHAR AS exit_tag FROM cfw",
    "sigs": "SELECT *, coalesce(lag(enter_long) OVER (PARTITION BY pair ORDER BY ts), 0) AS go FROM sig",
    "ctr": "SELECT pair || '@' || ts AS trade_id, pair, ts AS open_ts, open AS open_rate, ts + (6 + (ts // 3600000) % 24 % 5) * 3600000 AS close_ts, 10.0::DOUBLE AS amount, (ts // 3600000) % 24 % 3 = 0 AS is_short FROM sigs WHERE go = 1",
    "lines": "SELECT *, epoch_us(l_shipdate) // 1000 AS ship, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS sequence FROM lineitem",
    "ords": "SELECT l_orderkey AS trade_id, sequence::INT AS sequence, (sequence = 0 OR l_returnflag <> 'R') AS is_entry, l_quantity AS amount, l_extendedprice / l_quantity AS price, l_extendedprice AS cost, ship AS ts, CASE WHEN sequence = 0 OR l_returnflag <> 'R' THEN 'grind_' || (l_linenumber % 5 + 1) || '_entry' ELSE CASE WHEN l_linenumber % 5 = 4 THEN 'derisk_level_1' ELSE 'grind_' || (l_linenumber % 5 + 1) || CASE WHEN l_linestatus = 'F' THEN '_exit' ELSE '_derisk' END END END AS tag FROM lines",
    "toe": "SELECT l_orderkey AS trade_id, sequence::INT AS sequence, true AS is_entry, l_quantity AS amount, l_extendedprice / l_quantity AS price, ship AS ts FROM lines",
    "tox": "SELECT trade_id, count(*)::INT AS sequence, false AS is_entry, sum(amount) AS amount, max_by(price, sequence) * 1.01::DOUBLE AS price, max(ts) + 86400000 AS ts FROM toe GROUP BY trade_id",
    "tord": "SELECT * FROM toe UNION ALL SELECT * FROM tox",
    "theads": "SELECT o_orderkey AS trade_id, c_mktsegment AS pair, o_orderkey % 4 = 0 AS is_short, (1 + o_orderkey % 3)::INT AS leverage, o_orderpriority AS entry_tag, CASE o_orderstatus WHEN 'F' THEN 'stop_loss' WHEN 'O' THEN 'liquidation' ELSE 'exit_signal' END AS exit_reason, 0.001::DOUBLE AS fee_open, 0.001::DOUBLE AS fee_close FROM orders JOIN customer ON o_custkey = c_custkey",
    "tsum": "SELECT trade_id, sum(amount) FILTER (is_entry) AS amount, sum(round(amount * price, 2)::DECIMAL(18,2)) FILTER (is_entry)::DOUBLE AS entry_value, min(ts) AS open_ts, max(ts) AS close_ts, max(price) FILTER (NOT is_entry) AS close_rate, count(*) FILTER (is_entry) AS entries, min_by(round(amount * price, 2), sequence) FILTER (is_entry) AS first_cost FROM tord GROUP BY trade_id",
    "tval": "SELECT *, entry_value / amount AS open_rate, CASE WHEN is_short THEN entry_value * (1 - fee_open) - amount * close_rate * (1 + fee_close) ELSE amount * close_rate * (1 - fee_close) - entry_value * (1 + fee_open) END AS profit, CASE WHEN is_short THEN entry_value * (1 - fee_open) ELSE entry_value * (1 + fee_open) END AS paid FROM tsum JOIN theads USING (trade_id)",
    "closed": "SELECT *, entry_value / leverage AS stake_amount, round(profit, 8) AS profit_abs, round(profit / paid * leverage, 8) AS profit_ratio FROM tval",
    "fund": "SELECT pair, ts, (close - open) / 1e4::DOUBLE AS rate, close AS mark FROM cf WHERE (ts // 3600000) % 24 % 8 = 0",
    "lck": "SELECT CASE WHEN pair = 'error' THEN '*' ELSE pair END AS pair, '*' AS side, ts AS lock_ts, ts + 43200000 AS lock_end, 'drop' AS reason FROM cf WHERE close < 0.2::DOUBLE * open",
    "runs": "SELECT event_id AS arrival, event_type AS lane, user_id AS run_id, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, value AS wall_time_seconds, value * 1e6::DOUBLE AS peak_rss_bytes, event_type AS result_sha256, epoch_us(ts) // 1000 AS updated_at, list_value('indicators', 'callbacks', 'trade_scans', 'event_simulation', 'unknown')[event_id % 5 + 1] AS phase, (20 + event_id % 100)::INT AS pair_count, (1000 + event_id % 2000)::INT AS days FROM events",
}


def steady(c: Column) -> Column:
    """A double to four places on a shifted grid, so that neither decimal ties nor the last bit of a sum decide."""
    return F.floor(c * 10_000 + 0.3717259) / 10_000


def _steady_sql(text: str) -> str:
    """steady(...) in SQL."""
    while (at := text.find("steady(")) >= 0:
        depth, end = 1, at + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}(floor(({text[at + 7 : end - 1]}) * 10000 + 0.3717259) / 10000){text[end:]}"
    return text


def sql(text: str, **more: str) -> str:
    """A query over the derived tables; only those that it needs are put in front. more: further derived tables."""
    text, every = _steady_sql(text), {**CTES, **{k: _steady_sql(v) for k, v in more.items()}}
    need, todo = set(), [text]
    while todo:
        for word in set(re.findall(r"\b\w+\b", todo.pop())):
            if word in every and word not in need:
                need.add(word)
                todo.append(every[word])
    parts = [f"{k} AS ({v})" for k, v in every.items() if k in need]
    return f"WITH {', '.join(parts)} {text}" if parts else text


def query(name: str, oracle: str | None = None, **more: str) -> Callable[[Query], Query]:
    """Register a query, with its DuckDB twin where SQL expresses it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **more)
        return f

    return add
