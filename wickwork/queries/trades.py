"""Queries of order and trade operators, and of trade economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.functions import economics as eco
from wickwork.functions.timeframes import duration_minutes, weekday
from wickwork.operators import trades as op
from wickwork.queries.base import query, steady
from wickwork.queries.joins import _TIERS, tiers
from wickwork.operators.joins import maintenance_tier
from wickwork.sources import tables as src

START = 1e9
hundreds = lambda df, *cs: df.withColumns({c: steady(F.col(c) / 100) for c in cs})  # noqa: E731  sums of a billion keep ten places
st = lambda df, *cs: df.withColumns({c: steady(F.col(c)) for c in cs})
r6 = lambda df, *cs: df.withColumns({c: F.round(c, 6) + 0.0 for c in cs})


SCALE = 4096.0
_scaled = lambda df, *cs: df.withColumns({c: F.col(c) / SCALE for c in cs})


def _halved(s, d):
    """The entries of closed trades, SCALE times as large and at steady prices, each followed by an exit of half of what is held then.

    With that scale halves of up to twenty entries still have nine places.
    """
    entries = src.trade_orders(s, d).where("is_entry").withColumns({"price": steady(F.col("price")), "amount": F.col("amount") * SCALE})
    held = F.sum(F.col("amount") * F.pow(F.lit(2.0), F.col("sequence"))).over(op.Window.partitionBy("trade_id").orderBy("sequence")) / F.pow(F.lit(2.0), F.col("sequence") + 1)
    both = F.array(F.struct((F.col("sequence") * 2).alias("sequence"), F.lit(True).alias("is_entry"), F.col("amount").alias("amount")), F.struct((F.col("sequence") * 2 + 1).alias("sequence"), F.lit(False).alias("is_entry"), F.col("held").alias("amount")))
    return entries.withColumn("held", held).select("trade_id", "price", F.explode(both).alias("o")).select("trade_id", "price", "o.*")


_HALVES = "SELECT trade_id, sum(amount * pow(2, sequence)) / pow(2, max(sequence) + 1) AS amount, sum(amount * p * pow(2, sequence)) / pow(2, max(sequence) + 1) AS stake, sum(amount * p) AS top FROM (SELECT *, steady(price) AS p FROM toe) GROUP BY trade_id"
query("position_state", "SELECT trade_id, amount, steady(stake / leverage) AS stake, steady(top / leverage) AS max_stake, steady(stake / amount) AS average, NULL::VARCHAR AS error FROM halves JOIN theads USING (trade_id)", halves=_HALVES)(lambda s, d: st(_scaled(op.position_state(_halved(s, d), src.trade_heads(s, d)), "amount", "stake", "max_stake"), "stake", "max_stake", "average"))
_GAIN = "SELECT trade_id, sequence, amount * pow(2, sequence) AS w, amount * p * pow(2, sequence) AS v, amount * p AS cost, p, sum(amount * pow(2, sequence)) OVER o / pow(2, sequence + 1) AS out, sum(amount * p * pow(2, sequence)) OVER o / pow(2, sequence + 1) AS worth FROM (SELECT *, steady(price) AS p FROM toe) WINDOW o AS (PARTITION BY trade_id ORDER BY sequence)"
# the same holdings, in market steps: amounts below a step of 0.5, averages to the nearest 0.25, stakes from what was before
query("position_state_steps", "SELECT trade_id, floor(amount * 2) / 2 AS amount, steady(stake / leverage) AS stake, floor(stake / amount * 4 + 0.5) / 4 AS average FROM (SELECT trade_id, amount * 4096 AS amount, stake * 4096 AS stake FROM halves) JOIN theads USING (trade_id)", halves=_HALVES)(
    lambda s, d: st(op.position_state(_halved(s, d), src.trade_heads(s, d), 0.5, 0.25), "stake").select("trade_id", "amount", "stake", "average")
)
# amounts of 1e-14 of what is above and prices 1e10 times as high: far beyond fixed decimals
query("position_state_extremes", "SELECT trade_id, steady(amount * 4096) AS amount, steady(stake / leverage / 4096) AS stake, error FROM (SELECT *, NULL::VARCHAR AS error FROM halves) JOIN theads USING (trade_id)", halves=_HALVES)(
    lambda s, d: op.position_state(_halved(s, d).withColumns({"amount": F.col("amount") * 2.0**-60, "price": F.col("price") * 2.0**36}), src.trade_heads(s, d)).select("trade_id", steady(F.col("amount") * 2.0**60).alias("amount"), steady(F.col("stake") * 2.0**0).alias("stake"), "error")
)
query("realized_profit_partial", "SELECT trade_id, steady(sum(CASE WHEN is_short THEN worth * (1 - fee_open) - out * p * (1 + fee_close) ELSE out * p * (1 - fee_close) - worth * (1 + fee_open) END)) AS profit, steady(sum(cost * CASE WHEN is_short THEN 1 - fee_open ELSE 1 + fee_open END)) AS entry_value FROM gain JOIN theads USING (trade_id) GROUP BY trade_id", gain=_GAIN)(lambda s, d: st(_scaled(op.realized_profit(_halved(s, d), src.trade_heads(s, d)).drop("error"), "profit", "entry_value"), "profit", "entry_value"))
query("realized_profit_spot", "SELECT trade_id, steady(amount * close_rate * (1 - fee_close) - entry_value * (1 + fee_open)) AS profit, steady(entry_value * (1 + fee_open)) AS entry_value FROM closed")(lambda s, d: st(op.realized_profit(src.trade_orders(s, d), src.trade_heads(s, d).withColumn("is_short", F.lit(False))).drop("error"), "profit", "entry_value"))
query("realized_profit_leveraged", "SELECT trade_id, steady(profit) AS profit, steady(paid) AS entry_value FROM closed")(lambda s, d: st(op.realized_profit(src.trade_orders(s, d), src.trade_heads(s, d)).drop("error"), "profit", "entry_value"))
query("closed_trade_ratio", "SELECT trade_id, round(profit / paid * leverage, 6) AS ratio FROM closed")(lambda s, d: op.realized_profit(src.trade_orders(s, d), src.trade_heads(s, d)).join(src.trade_heads(s, d), "trade_id").select("trade_id", (F.round(op.closed_ratio(F.col("profit"), F.col("entry_value"), F.col("leverage")), 6) + 0.0).alias("ratio")))
query("profit_snapshot", "SELECT trade_id, steady(-entry_value * 1.001 + amount * close_rate * 0.999) AS profit_stake, steady((-entry_value * 1.001 + amount * close_rate * 0.999) / (entry_value * 1.001)) AS ratio_total, steady((-entry_value * 1.001 + amount * close_rate * 0.999) / (amount * close_rate * 1.001)) AS ratio_current, steady((-entry_value * 1.001 + amount * close_rate * 0.999) / (first_cost * 1.001)) AS ratio_first FROM closed")(
    lambda s, d: st(st(op.profit_snapshot(src.trade_orders(s, d).where("is_entry"), src.closed_trades(s, d).select("trade_id", F.col("close_rate").alias("rate")), 0.001), "profit_stake"), "ratio_total", "ratio_current", "ratio_first")
)
query("current_profit_ratio", "SELECT trade_id, round(CASE WHEN leverage = 1 AND NOT is_short THEN close_rate * 0.999 / (open_rate * 1.001) - 1 WHEN is_short THEN (amount * open_rate * 0.999 - amount * close_rate * 1.001 + 5) / (amount * open_rate * 0.999) * leverage ELSE (amount * close_rate * 0.999 - amount * open_rate * 1.001 + 5) / (amount * open_rate * 1.001) * leverage END, 6) AS ratio FROM closed")(
    lambda s, d: src.closed_trades(s, d).select("trade_id", (F.round(op.current_profit_ratio(F.col("open_rate"), F.col("close_rate"), F.col("amount"), F.lit(0.001), F.col("leverage"), F.col("is_short"), F.lit(5.0)), 6) + 0.0).alias("ratio"))
)
_EV = "SELECT trade_id, open_ts AS ts, 1::INT AS kind, round(stake_amount, 8)::DECIMAL(28,8) AS tied, 0::DECIMAL(28,8) AS profit, 1 AS op, 0 AS cl FROM closed UNION ALL SELECT trade_id, close_ts, 0, -round(stake_amount, 8)::DECIMAL(28,8), round(profit_abs, 8)::DECIMAL(28,8), -1, 1 FROM closed"
_RUN = "SELECT ts, kind, trade_id, sum(tied) OVER w AS tied, sum(profit) OVER w AS profit, sum(op) OVER w AS op, sum(cl) OVER w AS cl FROM ev WINDOW w AS (ORDER BY ts, kind, trade_id ROWS UNBOUNDED PRECEDING)"
query("backtest_summary", "SELECT count(*) AS trades, round(sum(round(profit_abs, 8)), 2) AS total_profit, round(sum(entry_value + amount * close_rate), 2) AS volume, round(sum(round(profit_abs, 8)), 2) + 1e9::DOUBLE AS final_balance, (SELECT max(op)::BIGINT FROM run) AS max_open_trades, (SELECT count(*) FROM sigs WHERE go = 1) AS rejected_signals FROM closed", ev=_EV, run=_RUN)(
    lambda s, d: op.backtest_summary(src.closed_trades(s, d), START, src.candle_trades(s, d)).select("max_open_trades", "rejected_signals", "trades", F.round("total_profit", 2).alias("total_profit"), F.round("volume", 2).alias("volume"), (F.round("total_profit", 2) + START).alias("final_balance"))
)
query("order_reference_points", "SELECT trade_id, min_by(amount, sequence) FILTER (is_entry) AS first_amount, round(min_by(amount * price, sequence) FILTER (is_entry), 6) AS first_cost, max_by(price, sequence) FILTER (is_entry) AS last_entry_price, max_by(price, sequence) FILTER (NOT is_entry) AS last_exit_price, max_by(price, sequence) AS last_price, max_by(ts, sequence) AS last_ts FROM ords GROUP BY trade_id")(lambda s, d: r6(op.reference_points(src.tagged_orders(s, d)), "first_cost"))
query("fill_counts", "SELECT trade_id, count(*) FILTER (is_entry) AS entries, count(*) FILTER (NOT is_entry) AS exits FROM ords GROUP BY trade_id")(lambda s, d: op.fill_counts(src.tagged_orders(s, d)))
query("cumulative_position", "SELECT trade_id, sequence, sum(CASE WHEN is_entry THEN amount ELSE -amount END) OVER (PARTITION BY trade_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS position FROM ords")(lambda s, d: op.cumulative_position(src.tagged_orders(s, d)).select("trade_id", "sequence", "position"))
query("entries_since_exit", "SELECT trade_id, count(*) FILTER (is_entry AND sequence > coalesce(x, -1) AND sequence > f) AS entries_since_exit FROM (SELECT *, max(CASE WHEN NOT is_entry THEN sequence END) OVER (PARTITION BY trade_id) AS x, min(CASE WHEN is_entry THEN sequence END) OVER (PARTITION BY trade_id) AS f FROM ords) GROUP BY trade_id")(lambda s, d: op.entries_since_exit(src.tagged_orders(s, d)))
query("is_derisked", "SELECT trade_id, coalesce(bool_or(NOT is_entry AND tag = 'derisk_level_1'), false) OR sum(CASE WHEN is_entry THEN amount ELSE -amount END) < 0.95 * min_by(amount, sequence) FILTER (is_entry) AS is_derisked FROM ords GROUP BY trade_id")(lambda s, d: op.is_derisked(src.tagged_orders(s, d)))
_CL = "SELECT tg.*, max(CASE WHEN NOT is_entry THEN sequence END) OVER (PARTITION BY trade_id, level) AS x FROM (SELECT *, substr(tag, 7, 1)::INT AS level FROM ords WHERE tag LIKE 'grind%' AND (sequence > 0 OR NOT is_entry)) tg"
_CLUSTERS = "SELECT trade_id, level, count(*) FILTER (k) AS entries, coalesce(sum(amount) FILTER (k), 0)::DOUBLE AS amount, round(coalesce(sum(amount * price) FILTER (k), 0)::DOUBLE, 6) AS cost, coalesce(string_agg(sequence, ' ' ORDER BY sequence DESC) FILTER (k), '') AS ids, max_by(price, sequence) FILTER (k) AS latest_price, max_by(price, sequence) FILTER (NOT is_entry) AS exit_price FROM (SELECT *, is_entry AND sequence > coalesce(x, -1) AS k FROM cl) GROUP BY trade_id, level HAVING entries > 0 OR exit_price IS NOT NULL"
_texts = lambda c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))).alias(c)
query("open_cluster_state", "SELECT c.*, coalesce(d.derisked, false) AS derisked FROM clusters c LEFT JOIN (SELECT trade_id, bool_or(tag = 'derisk_level_1') AS derisked FROM ords WHERE NOT is_entry GROUP BY trade_id) d USING (trade_id)", cl=_CL, clusters=_CLUSTERS)(
    lambda s, d: r6(op.open_clusters(src.tagged_orders(s, d)), "cost").withColumn("ids", _texts("ids"))
)
_RENAME = {"legacy": ("gd", "dd"), "regular": ("g", "sg")}


def _renamed(s, d, scheme):
    """The tagged orders with the words of another tag scheme: derisk orders carry d1, and some entries a word outside the scheme."""
    entry, out = _RENAME[scheme]
    level = F.substring("tag", 7, 1)
    return src.tagged_orders(s, d).withColumn("tag", F.when(F.col("is_entry") & (F.col("sequence") % 5 == 3), "free").when(F.col("is_entry"), F.concat(F.lit(entry), level)).when(F.col("tag") == "derisk_level_1", "d1 7").otherwise(F.concat(F.lit(out), level)))


_WORDS = "SELECT *, CASE WHEN is_entry AND sequence % 5 = 3 THEN 'free' WHEN is_entry THEN '{entry}' || substr(tag, 7, 1) WHEN tag = 'derisk_level_1' THEN 'd1' ELSE '{out}' || substr(tag, 7, 1) END AS word FROM ords"
_LEVELLED = "SELECT *, max(CASE WHEN NOT is_entry THEN sequence END) OVER (PARTITION BY trade_id, level) AS x FROM (SELECT tg.*, unnest({levels})::INT AS level FROM tg WHERE sequence > 0 OR NOT is_entry)"
_LEGACY = {"tg": _WORDS.format(entry="gd", out="dd"), "cl": _LEVELLED.format(levels="CASE WHEN word = 'free' THEN [1] WHEN word = 'd1' THEN [] ELSE [substr(word, 3, 1)::INT] END"), "clusters": _CLUSTERS}
_REGULAR = {"tg": _WORDS.format(entry="g", out="sg"), "cl": _LEVELLED.format(levels="CASE WHEN word = 'free' THEN [0] WHEN word = 'd1' THEN [0, 1, 2, 3, 4, 5, 6] ELSE [right(word, 1)::INT] END"), "clusters": _CLUSTERS}
_PICK = ("trade_id", "level", "entries", "amount", "cost")
query("open_cluster_state_legacy", "SELECT trade_id, level, entries, amount, cost, ids, derisked FROM clusters JOIN (SELECT trade_id, bool_or(word = 'd1') AS derisked FROM tg GROUP BY trade_id) USING (trade_id)", **_LEGACY)(lambda s, d: r6(op.open_clusters(_renamed(s, d, "legacy"), "legacy"), "cost").select(*_PICK, _texts("ids"), "derisked"))
query("open_cluster_state_regular", "SELECT trade_id, level, entries, amount, cost, ids, derisked FROM clusters JOIN (SELECT trade_id, bool_or(NOT is_entry AND (word = 'd1' OR held < 0.95 * first)) AS derisked FROM (SELECT *, sum(CASE WHEN is_entry THEN amount ELSE -amount END) OVER (PARTITION BY trade_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS held, first_value(amount) OVER (PARTITION BY trade_id ORDER BY sequence) AS first FROM tg) GROUP BY trade_id) USING (trade_id)", **_REGULAR)(
    lambda s, d: r6(op.open_clusters(_renamed(s, d, "regular"), "regular"), "cost").select(*_PICK, _texts("ids"), "derisked")
)
query("cluster_profit", "SELECT trade_id, level, round(amount * 1500.0 * 0.999 - cost * 1.001, 6) AS profit_stake, round((1500.0 - cost / amount) / (cost / amount), 6) AS profit_rate, round((1500.0 - latest_price) / latest_price, 6) AS distance FROM clusters WHERE entries > 0", cl=_CL, clusters=_CLUSTERS)(
    lambda s, d: op.cluster_profit(op.open_clusters(src.tagged_orders(s, d)), F.lit(1500.0), 0.001).select("trade_id", "level", F.round("profit_stake", 6).alias("profit_stake"), F.round("profit_rate", 6).alias("profit_rate"), F.round("distance", 6).alias("distance"))
)
query("closure_sequence", "SELECT trade_id, close_ts, row_number() OVER (ORDER BY close_ts, exit_reason = 'force_exit', CASE WHEN exit_reason = 'force_exit' THEN -trade_id ELSE trade_id END) - 1 AS sequence FROM (SELECT trade_id, close_ts, CASE WHEN trade_id % 5 = 0 THEN 'force_exit' ELSE exit_reason END AS exit_reason FROM closed)")(
    lambda s, d: op.closure_sequence(src.closed_trades(s, d).select("trade_id", "close_ts", F.when(F.col("trade_id") % 5 == 0, "force_exit").otherwise(F.col("exit_reason")).alias("exit_reason"))).select("trade_id", "close_ts", "sequence")
)
_STATE = "steady((1000000000::DECIMAL(28,8) + profit - tied)::DOUBLE / 100) AS free, steady(tied::DOUBLE / 100) AS tied, op::BIGINT AS open_trades, steady(profit::DOUBLE / 100) AS realized, cl::BIGINT AS closed_trades FROM run"
query("equity_curve", f"SELECT ts, kind, trade_id, {_STATE}", ev=_EV, run=_RUN)(lambda s, d: hundreds(op.equity_curve(src.closed_trades(s, d), START), "free", "tied", "realized"))
query("wallet_state", f"SELECT ts, trade_id, {_STATE} WHERE kind = 0", ev=_EV, run=_RUN)(lambda s, d: hundreds(op.wallet_state(src.closed_trades(s, d), START), "free", "tied", "realized"))
query("max_concurrency", "SELECT max(op)::BIGINT AS max_open_trades FROM run", ev=_EV, run=_RUN)(lambda s, d: op.max_concurrency(src.closed_trades(s, d)))
_DD = "SELECT cum, greatest({s}, max(cum) OVER (ORDER BY close_ts, trade_id ROWS UNBOUNDED PRECEDING)) AS high FROM (SELECT close_ts, trade_id, {s} + (sum(round({v}, 8)::DECIMAL(28,8)) OVER (ORDER BY close_ts, trade_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS cum FROM closed)"
query("max_drawdown_ratios", "SELECT round(max(high - cum), 6) AS max_drawdown FROM dd", dd=_DD.format(s="0.0::DOUBLE", v="profit_ratio"))(lambda s, d: op.max_drawdown(src.closed_trades(s, d), "profit_ratio", 0.0, False))
query("max_drawdown_equity", "SELECT round(max((high - cum) / high), 6) AS max_drawdown FROM dd", dd=_DD.format(s="1e9::DOUBLE", v="profit_abs"))(lambda s, d: op.max_drawdown(src.closed_trades(s, d), "profit_abs", START, True))
_SETS = "SELECT 'tag_words' AS kind, unnest(string_split(entry_tag, ' ')) AS value FROM closed UNION SELECT 'compound_tags', entry_tag FROM closed WHERE contains(entry_tag, ' ') UNION SELECT 'exit_reasons', exit_reason FROM closed UNION SELECT 'sides', CASE WHEN is_short THEN 'short' ELSE 'long' END FROM closed UNION SELECT 'leverages', leverage::VARCHAR FROM closed"
_SETS += " UNION SELECT 'callbacks', CASE WHEN o_orderkey % 2 = 0 THEN 'custom_exit' ELSE 'adjust_trade_position' END FROM orders"


def _called(s, d):
    return src.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "custom_exit").otherwise("adjust_trade_position").alias("callback"))


query("coverage_sets", 'SELECT kind, string_agg(value, \',\' ORDER BY value) AS "values" FROM (SELECT DISTINCT * FROM sets WHERE value <> \'\') GROUP BY kind', sets=_SETS)(lambda s, d: op.coverage_sets(src.closed_trades(s, d), _called(s, d)))


def _observed(s, d):
    return op.coverage_sets(src.closed_trades(s, d)).select("kind", F.explode(F.split("values", ",")).alias("value"))


_NEED = [("sides", "short"), ("sides", "both"), ("leverages", "3"), ("leverages", "7"), ("exit_reasons", "force_exit"), ("exit_reasons", "stop_loss")]
_NEED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NEED) + ") v(kind, value)"
query("missing_coverage", "SELECT * FROM need EXCEPT SELECT * FROM sets", sets=_SETS, need=_NEED_SQL)(lambda s, d: op.missing_coverage(s.createDataFrame(_NEED, "kind string, value string"), _observed(s, d)))
query("required_minus_observed", 'SELECT kind, string_agg(value, \',\' ORDER BY value) AS missing FROM (SELECT * FROM need EXCEPT SELECT * FROM sets) GROUP BY kind', sets=_SETS, need=_NEED_SQL)(
    lambda s, d: s.createDataFrame(_NEED, "kind string, value string").groupBy("kind").agg(F.collect_set("value").alias("r")).join(_observed(s, d).groupBy("kind").agg(F.collect_set("value").alias("o")), "kind", "left").select("kind", F.array_join(F.array_sort(F.array_except("r", F.coalesce("o", F.array().cast("array<string>")))), ",").alias("missing")).where("missing <> ''")
)
_PATH = "SELECT trade_id, ts, CASE WHEN is_short THEN 1 - close / open_rate ELSE close / open_rate - 1 END AS profit FROM ctr JOIN cf ON ctr.pair = cf.pair AND ts BETWEEN open_ts AND close_ts"
query("cluster_running_max", "SELECT trade_id, ts, round(profit, 6) AS profit, round(greatest(0.0::DOUBLE, coalesce(max(profit) OVER (PARTITION BY trade_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS best FROM path", path=_PATH)(lambda s, d: r6(op.running_best(op.trade_path(src.candle_trades(s, d), src.full_candles(s, d))), "profit", "best"))
query("trailing_target", "SELECT trade_id, min(ts) AS exit_ts, round(min_by(profit, ts), 6) AS profit, round(min_by(best, ts), 6) AS best FROM (SELECT *, max(profit) OVER (PARTITION BY trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS best FROM path) WHERE profit < best - CASE WHEN best >= 0.5 THEN 0.1 WHEN best >= 0.1 THEN 0.05 END GROUP BY trade_id", path=_PATH)(
    lambda s, d: r6(op.trailing_exit(op.trade_path(src.candle_trades(s, d), src.full_candles(s, d)), [(0.1, 0.05), (0.5, 0.1)]), "profit", "best")
)

# trade economics
_c = F.col
query("quantize_step", "SELECT v, u / 10000 AS st, (k // u) * u / 10000 AS low, ((k + u - 1) // u) * u / 10000 AS high, ((2 * k + u) // (2 * u)) * u / 10000 AS near FROM (SELECT *, round(v * 10000)::BIGINT AS k FROM (SELECT DISTINCT round(l_extendedprice / 7, 4) AS v, unnest([100, 2500, 5000]) AS u FROM lineitem))")(
    lambda s, d: src.table(s, d, "lineitem").select(F.round(_c("l_extendedprice") / 7, 4).alias("v")).distinct().withColumn("st", F.explode(F.array(F.lit(0.01), F.lit(0.25), F.lit(0.5)))).select("v", "st", *[eco.quantize_step(_c("v"), _c("st"), how).alias(n) for how, n in (("floor", "low"), ("ceil", "high"), ("round", "near"))])
)
# ticks far below a billionth: values and steps of 1e-10, 1e-8 places
query("quantize_small_steps", "SELECT DISTINCT k, (k // 3) * 3 * 1.0::DOUBLE AS low, ((k + 2) // 3) * 3 * 1.0::DOUBLE AS high, ((2 * k + 3) // 6) * 3 * 1.0::DOUBLE AS near FROM (SELECT l_partkey * 7 AS k FROM lineitem)")(
    lambda s, d: src.table(s, d, "lineitem").select((_c("l_partkey") * 7).alias("k")).distinct().withColumn("v", F.concat(_c("k").cast("string"), F.lit("e-10")).cast("double")).select("k", *[F.round(eco.quantize_step(_c("v"), F.lit(3e-10), how) * 1e10, 3).alias(n) for how, n in (("floor", "low"), ("ceil", "high"), ("round", "near"))])
)
query("entry_sizing_small_rates", "SELECT DISTINCT k, (100000000000000 // nullif(k * 1000, 0))::DOUBLE AS amount FROM (SELECT l_partkey AS k FROM lineitem)")(
    lambda s, d: src.table(s, d, "lineitem").select(_c("l_partkey").alias("k")).distinct().select("k", eco.entry_amount(F.lit(50.0), F.lit(2.0), F.concat(_c("k").cast("string"), F.lit("e-9")).cast("double"), F.lit(1.0)).alias("amount"))
)
query("entry_sizing", "SELECT pair, ts, amount, steady(amount * open / 2) AS stake, steady(amount * open * 1.001) AS cost FROM (SELECT *, round(floor(round(100.0 * 2 / open / 0.001, 9)) * 0.001, 9) AS amount FROM cf)")(
    lambda s, d: src.full_candles(s, d).withColumn("amount", eco.entry_amount(F.lit(100.0), F.lit(2.0), _c("open"), F.lit(0.001))).select("pair", "ts", "amount", steady(eco.entry_stake(_c("amount"), _c("open"), F.lit(2.0))).alias("stake"), steady(eco.entry_cost(_c("amount"), _c("open"), F.lit(0.001))).alias("cost"))
)
query("min_stake", "SELECT pair, ts, round(greatest(5.0 * 1.05 / 0.9, 0.1 * open * 1.05) / 2, 6) AS least FROM cf")(lambda s, d: src.full_candles(s, d).select("pair", "ts", F.round(eco.min_stake(F.lit(5.0), F.lit(0.1), _c("open"), -0.1, 0.05, F.lit(2.0)), 6).alias("least")))
query("available_and_proposed_stake", "SELECT trade_id, round(a, 6) AS available, round(least((a + stake_amount) / 5, a), 6) AS unlimited, round(least(1e5, a), 6) AS fixed FROM (SELECT trade_id, stake_amount, greatest(least((stake_amount + 2e5) * 0.9 - stake_amount, 2e5), 0) AS a FROM closed)")(
    lambda s, d: src.closed_trades(s, d).withColumn("a", eco.available_stake(_c("stake_amount"), F.lit(2e5), 0.9)).select("trade_id", F.round("a", 6).alias("available"), F.round(eco.proposed_stake(_c("a"), _c("stake_amount"), F.lit(5), F.lit(None).cast("double")), 6).alias("unlimited"), F.round(eco.proposed_stake(_c("a"), _c("stake_amount"), F.lit(5), F.lit(1e5)), 6).alias("fixed"))
)
query("initial_stop", "SELECT pair, ts, round(ceil((open * (1 + -0.1::DOUBLE / 2))::VARCHAR::DECIMAL(38,18) * 100)::DOUBLE / 100, 6) AS long_stop, round(floor((open * (1 - -0.1::DOUBLE / 2))::VARCHAR::DECIMAL(38,18) * 100)::DOUBLE / 100, 6) AS short_stop FROM cf")(lambda s, d: src.full_candles(s, d).select("pair", "ts", *[F.round(eco.initial_stop(_c("open"), F.lit(-0.1), F.lit(2.0), F.lit(short), F.lit(0.01)), 6).alias(n) for short, n in ((False, "long_stop"), (True, "short_stop"))]))
query("adjusted_stop", "SELECT trade_id, CASE WHEN is_short THEN least(open_rate, close_rate) ELSE greatest(open_rate, close_rate) END AS stop FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.adjusted_stop(_c("open_rate"), _c("close_rate"), _c("is_short")).alias("stop")))
query("liquidation_price", "SELECT trade_id, steady(greatest(raw + 0.05 * (open_rate - raw), 0)) AS liquidation_price FROM (SELECT *, (stake_amount + extra - dd * amount * open_rate) / (amount * rate - dd * amount) AS raw FROM (SELECT trade_id, amount, is_short, round(stake_amount, 6) AS stake_amount, round(open_rate, 6) AS open_rate, CASE WHEN is_short THEN -1 ELSE 1 END AS dd, (SELECT max_by(maintenance_rate, min_notional) FROM tr WHERE stake_amount >= min_notional) AS rate, (SELECT max_by(maintenance_amount, min_notional) FROM tr WHERE stake_amount >= min_notional) AS extra FROM closed))", tr=_TIERS)(
    lambda s, d: maintenance_tier(src.closed_trades(s, d).select("trade_id", "pair", F.round("stake_amount", 6).alias("stake"), F.round("open_rate", 6).alias("open_rate"), "amount", "is_short"), tiers(s, d)).select("trade_id", steady(eco.liquidation_price(_c("open_rate"), _c("amount"), _c("stake"), _c("maintenance_rate"), _c("maintenance_amount"), _c("is_short"), 0.05)).alias("liquidation_price"))
)
query("rule_adjustment", "SELECT trade_id, CASE WHEN entries < 4 AND profit_ratio < 0 THEN round(first_cost * 0.5, 6) END AS added FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", F.round(eco.rule_adjustment(_c("entries"), 4, _c("profit_ratio"), 0.0, _c("first_cost"), 0.5), 6).alias("added")))
query("derisk_ladder", "SELECT trade_id, CASE WHEN leverage <> 1 AND profit_ratio < 0 THEN 1 WHEN leverage <> 2 AND profit_ratio < -0.1 THEN 2 WHEN profit_ratio < -0.3 THEN 3 END AS level FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.derisk_level(_c("profit_ratio"), F.array("leverage"), [0.0, -0.1, -0.3]).alias("level")))
query("threshold_stop", "SELECT trade_id, profit_abs < -(first_cost * 0.3 / leverage) AS stopped FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.threshold_stop(_c("profit_abs"), _c("first_cost"), 0.3, _c("leverage")).alias("stopped")))
query("indicator_stop", "SELECT pair, ts, coalesce(close / open - 1 < -0.1 AND close < high AND (high - close) / close < 0.010 AND low - close < 0 AND high > lag(high) OVER (PARTITION BY pair ORDER BY ts) AND high > low + 24, false) AS stopped FROM cf")(
    lambda s, d: src.full_candles(s, d).select("pair", "ts", F.coalesce(eco.indicator_stop(_c("close") / _c("open") - 1, F.lit(1.0), 0.1, _c("close"), _c("high"), _c("high"), F.lag("high").over(op.Window.partitionBy("pair").orderBy("ts")), _c("low"), _c("low") - _c("close")), F.lit(False)).alias("stopped"))
)
query("profit_bucket", "SELECT trade_id, CASE WHEN profit_ratio < 0.001 THEN NULL WHEN profit_ratio >= 0.12 THEN 12 ELSE (SELECT max(x)::INT FROM range(12) r(x) WHERE profit_ratio >= x / 100::DOUBLE) END AS bucket FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.profit_bucket(_c("profit_ratio")).alias("bucket")))
query("exit_reason", "SELECT trade_id, 'exit_' || CASE WHEN is_short THEN 'short' ELSE 'long' END || '_' || exit_reason || '_' || leverage || ' ( ' || entry_tag || ')' AS reason FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.exit_reason(F.when(_c("is_short"), "short").otherwise("long"), _c("exit_reason"), _c("leverage"), _c("entry_tag")).alias("reason")))
query("rebuy_filter", "SELECT pair, ts, volume > 0 AND low < 30 AND open < 30 AND high > 10 AND close > 10 AND close < high * 0.988 AS long_ok, volume > 0 AND low < 30 AND open < 30 AND high < 90 AND close < 90 AND close < high * 1.012 AS short_ok FROM cf")(
    lambda s, d: src.full_candles(s, d).select("pair", "ts", *[eco.rebuy_allowed(F.lit(short), _c("volume") > 0, _c("high"), _c("close"), _c("low"), _c("open"), _c("close"), _c("high")).alias(n) for short, n in ((False, "long_ok"), (True, "short_ok"))])
)
query("duration_and_weekday", "SELECT trade_id, (close_ts - open_ts) // 60000 AS minutes, (isodow(make_timestamp(open_ts * 1000)) - 1)::INT AS weekday FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", duration_minutes(_c("open_ts"), _c("close_ts")).alias("minutes"), weekday(_c("open_ts")).alias("weekday")))
query("base_currency", "SELECT trade_id, split_part(pair || '/USDT', '/', 1) AS base, CASE WHEN is_short THEN -amount ELSE amount END AS balance FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.base_currency(F.concat("pair", F.lit("/USDT"))).alias("base"), F.when(_c("is_short"), -_c("amount")).otherwise(_c("amount")).alias("balance")))
query("price_distance", "SELECT trade_id, sequence, CASE WHEN lag(price) OVER w > 0 THEN round((price - lag(price) OVER w) / lag(price) OVER w, 6) END AS distance FROM ords WINDOW w AS (PARTITION BY trade_id ORDER BY sequence)")(lambda s, d: src.tagged_orders(s, d).withColumn("p", F.lag("price").over(op.Window.partitionBy("trade_id").orderBy("sequence"))).select("trade_id", "sequence", F.round(eco.price_distance(_c("price"), _c("p")), 6).alias("distance")))
query("partial_exit_amount", "SELECT trade_id, CASE WHEN q < stake_amount AND x > 0 AND x < amount THEN x END AS amount FROM (SELECT *, 30000.0 AS q, round(floor(round(30000.0 * amount / stake_amount / 0.1, 9)) * 0.1, 12) AS x FROM closed)")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.partial_exit_amount(F.lit(30000.0), _c("amount"), _c("stake_amount"), F.lit(0.1)).alias("amount")))
query("partial_exit_request", "SELECT trade_id, CASE WHEN x > 20000 AND v > 20000 THEN steady(v / 100) END AS request FROM (SELECT *, x * leverage * (stake_amount / amount) / open_rate AS v FROM (SELECT *, CASE WHEN entry_value / leverage - 50000.0 < 20000.0 * 1.55 THEN amount * open_rate / leverage - 20000.0 * 1.55 ELSE 50000.0 END AS x FROM closed))")(
    lambda s, d: src.closed_trades(s, d).select("trade_id", steady(eco.partial_exit_request(F.lit(50000.0), _c("entry_value"), F.lit(20000.0), _c("amount"), _c("stake_amount"), _c("leverage"), _c("open_rate")) / 100).alias("request"))
)
query("scale_stakes", "SELECT trade_id, round(first_cost * 0.2 * kk, 6) AS first, round(first_cost * 0.4 * kk, 6) AS second FROM (SELECT *, greatest(1.0, 10000.0 / (first_cost * 0.2)) AS kk FROM closed)")(lambda s, d: src.closed_trades(s, d).withColumn("l", eco.scale_stakes(F.array(_c("first_cost") * 0.2, _c("first_cost") * 0.4), F.lit(10000.0))).select("trade_id", F.round(_c("l")[0], 6).alias("first"), F.round(_c("l")[1], 6).alias("second")))
_LADDER = {"rsi_3": "high", "rsi_3_15m": "high", "rsi_14": "low", "aroon_up": "low", "close": "close", "ema_20": "open", "willr": "low", "stoch": "high", "band": "open", "rsi_3_1h": "low", "rsi_3_4h": "low", "roc_1d": "volume", "btc_rsi_4h": "low"}
_FOUR = "p < -0.04 AND high > 5 AND high > 10 AND low < 35 AND close < open * 0.985 OR p < -0.06 AND volume = 1 AND low < 30 AND close < open * 0.980"
_HIGH = "high > 99 OR low > 70 OR low > -0.1 OR high > 95 OR close > open * 1.01 OR high > 90 AND low < 50 OR high > 80 AND low < 20 AND low < 20 AND volume > -10 AND low < 35"
query("ladder_rules", f"SELECT pair, ts, CASE WHEN lv <= 3 THEN sg WHEN lv = 4 THEN sg OR {_FOUR} ELSE sg OR volume > 1 AND p < -0.06 AND high > 20 AND low < 50 END AS enter, p >= 0.02 + 0.002 AND ({_HIGH}) AS leave FROM (SELECT *, close / open - 1 AS p, (ts // 3600000) % 5 + 1 AS lv, high > 2 * low AND close > open AS sg FROM cf WHERE volume > 0)")(
    lambda s, d: (lambda c, x: c.select("pair", "ts", eco.ladder_entry(_c("lv"), (_c("high") > 2 * _c("low")) & (_c("close") > _c("open")), _c("p"), _c("volume") > 1, _c("volume") == 1, x).alias("enter"), eco.ladder_exit(_c("p"), 0.02, 0.002, x).alias("leave")))(
        src.full_candles(s, d).where("volume > 0").withColumn("p", _c("close") / _c("open") - 1).withColumn("lv", F.floor(_c("ts") / 3_600_000) % 5 + 1), {k: _c(v) for k, v in _LADDER.items()}
    )
)
query("tag_with_ids", "SELECT trade_id, 'g ' || string_agg(sequence, ' ' ORDER BY sequence DESC) AS tag FROM ords GROUP BY trade_id")(lambda s, d: src.tagged_orders(s, d).groupBy("trade_id").agg(F.collect_list("sequence").alias("i")).select("trade_id", eco.tag_with_ids("g", _c("i")).alias("tag")))
query("order_side", "SELECT trade_id, sequence, CASE WHEN (trade_id % 4 = 0) <> is_entry THEN 'buy' ELSE 'sell' END AS side FROM ords")(lambda s, d: src.tagged_orders(s, d).select("trade_id", "sequence", eco.order_side(_c("trade_id") % 4 == 0, _c("is_entry")).alias("side")))
