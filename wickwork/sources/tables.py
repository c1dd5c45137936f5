"""Candles, signals, orders, trades, funding, locks and run records derived from the benchmark tables.

Each function reads the parquet tables below sf_dir. The shapes are those the operators expect of real data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.functions.timeframes import DAY_MS, UNIT_MS, floor_to, to_ms
from wickwork.operators.candles import fill_gaps

HOUR = UNIT_MS["h"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR) -> DataFrame:
    """Every event as a candle of its own, so that candles repeat: pair, ts, seq, OHLCV."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select(F.col("event_type").alias("pair"), floor_to(to_ms(ev, "ts"), bucket_ms).alias("ts"), F.col("event_id").alias("seq"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1.0).alias("volume"))


def candles(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR) -> DataFrame:
    """Candles with gaps: pair, ts, OHLCV."""
    t = ticks(spark, sf_dir, bucket_ms)
    return t.groupBy("pair", "ts").agg(F.min_by("open", "seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "seq").alias("close"), F.sum("volume").alias("volume"))


def full_candles(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR) -> DataFrame:
    """Candles on the whole grid of each pair."""
    return fill_gaps(candles(spark, sf_dir, bucket_ms), bucket_ms)


def signals(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR) -> DataFrame:
    """Full candles with entry and exit flags and tags."""
    c = full_candles(spark, sf_dir, bucket_ms)
    line = Window.partitionBy("pair").orderBy("ts")
    c = c.withColumn("enter_long", ((F.lag("close").over(line) > F.lag("open").over(line)) & (F.col("close") < F.col("open")) & (F.col("volume") > 0)))
    hour = F.pmod(F.floor(F.col("ts") / HOUR), F.lit(4))
    tag = F.when(hour == 0, "141 142").when(hour == 1, "121").when(hour == 2, "")
    return c.select("*", F.coalesce(F.col("enter_long"), F.lit(False)).cast("int").alias("e"), (F.col("close") > 2 * F.col("open")).cast("int").alias("exit_long")).select(
        "pair", "ts", "open", "high", "low", "close", "volume", F.col("e").alias("enter_long"), "exit_long", F.lit(0).alias("enter_short"), F.lit(0).alias("exit_short"),
        F.when(F.col("e") == 1, tag).alias("enter_tag"), F.lit(None).cast("string").alias("exit_tag"),
    )


def candle_trades(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR) -> DataFrame:
    """Trades laid on candles: one for each entry signal, opened on the next candle."""
    g = signals(spark, sf_dir, bucket_ms)
    line = Window.partitionBy("pair").orderBy("ts")
    opened = g.withColumn("go", F.lag("enter_long", 1, 0).over(line)).where("go = 1")
    hour = F.pmod(F.floor(F.col("ts") / HOUR), F.lit(24))
    return opened.select(F.concat_ws("@", "pair", "ts").alias("trade_id"), "pair", F.col("ts").alias("open_ts"), F.col("open").alias("open_rate"), (F.col("ts") + (6 + hour % 5) * HOUR).cast("long").alias("close_ts"), F.lit(10.0).alias("amount"), (hour % 3 == 0).alias("is_short"))


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("ship", to_ms(table(spark, sf_dir, "lineitem"), "l_shipdate"))
    line = Window.partitionBy("l_orderkey").orderBy("ship", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.withColumn("sequence", F.row_number().over(line) - 1)


def tagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of open trades: trade_id, sequence, is_entry, amount, price, cost, ts, tag."""
    li = _ordered_lines(spark, sf_dir)
    entry = (F.col("sequence") == 0) | (F.col("l_returnflag") != "R")
    level = F.col("l_linenumber") % 5 + 1
    leave = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("grind_"), level, F.lit("_exit"))).otherwise(F.concat(F.lit("grind_"), level, F.lit("_derisk")))
    leave = F.when(level == 5, "derisk_level_1").otherwise(leave)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(F.col("l_orderkey").alias("trade_id"), "sequence", entry.alias("is_entry"), F.col("l_quantity").alias("amount"), price.alias("price"), F.col("l_extendedprice").alias("cost"), F.col("ship").alias("ts"), F.when(entry, F.concat(F.lit("grind_"), level, F.lit("_entry"))).otherwise(leave).alias("tag"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an entry of its trade."""
    return _ordered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("trade_id"), "sequence", F.lit(True).alias("is_entry"), F.col("l_quantity").alias("amount"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("ship").alias("ts"))


def trade_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of closed trades: every line an entry, then one exit of the whole amount a day after the last at 1.01 times its price."""
    li = _entries(spark, sf_dir)
    end = li.groupBy("trade_id").agg(F.count("*").cast("int").alias("sequence"), F.sum("amount").alias("amount"), (F.max_by("price", "sequence") * 1.01).alias("price"), (F.max("ts") + DAY_MS).alias("ts"))
    return li.unionByName(end.withColumn("is_entry", F.lit(False)))


def trade_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, pair, is_short, leverage, entry_tag, exit_reason, fee_open, fee_close of closed trades."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    reason = F.when(F.col("o_orderstatus") == "F", "stop_loss").when(F.col("o_orderstatus") == "O", "liquidation").otherwise("exit_signal")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("trade_id"), F.col("c_mktsegment").alias("pair"), (F.col("o_orderkey") % 4 == 0).alias("is_short"), (1 + F.col("o_orderkey") % 3).cast("int").alias("leverage"),
        F.col("o_orderpriority").alias("entry_tag"), reason.alias("exit_reason"), F.lit(0.001).alias("fee_open"), F.lit(0.001).alias("fee_close"),
    )


def closed_trades(spark: SparkSession, sf_dir: str, orders: bool = False) -> DataFrame:
    """One row a closed trade with amount, entry value, rates, times and profit; profit_abs and profit_ratio rounded to 8 places. orders: adds the list of its orders, as trade_orders has them.

    Sums come from a trade's lines, which are put in order and added up where one shuffle leaves them; the exit's values follow from them.
    """
    lines = _entries(spark, sf_dir)
    cents = F.round(F.col("amount") * F.col("price"), 2).cast("decimal(18,2)")  # sums of money are exact, whatever the partitioning
    listed = [F.array_sort(F.collect_list(F.struct("sequence", "is_entry", "amount", "price", "ts"))).alias("orders")] if orders else []
    sums = lines.groupBy("trade_id").agg(
        F.sum("amount").alias("amount"), F.sum(cents).cast("double").alias("entry_value"), F.min("ts").alias("open_ts"), (F.max("ts") + DAY_MS).alias("close_ts"),
        (F.max_by("price", "sequence") * 1.01).alias("close_rate"), F.count("*").alias("entries"), F.min_by(cents.cast("double"), "sequence").alias("first_cost"), *listed,
    )
    if orders:
        left = F.struct(F.col("entries").cast("int").alias("sequence"), F.lit(False).alias("is_entry"), "amount", F.col("close_rate").alias("price"), F.col("close_ts").alias("ts"))
        sums = sums.withColumn("orders", F.concat("orders", F.array(left)))
    t = sums.join(trade_heads(spark, sf_dir), "trade_id").withColumn("open_rate", F.col("entry_value") / F.col("amount"))
    paid, got = F.col("entry_value") * (1 + F.col("fee_open")), F.col("amount") * F.col("close_rate") * (1 - F.col("fee_close"))
    paid_s, got_s = F.col("entry_value") * (1 - F.col("fee_open")), F.col("amount") * F.col("close_rate") * (1 + F.col("fee_close"))
    profit = F.when(F.col("is_short"), paid_s - got_s).otherwise(got - paid)
    base = F.when(F.col("is_short"), paid_s).otherwise(paid)
    return t.withColumn("stake_amount", F.col("entry_value") / F.col("leverage")).withColumn("profit_abs", F.round(profit, 8)).withColumn("profit_ratio", F.round(profit / base * F.col("leverage"), 8))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding events every eight hours: pair, ts, rate, mark."""
    c = full_candles(spark, sf_dir)
    return c.where(F.pmod(F.floor(F.col("ts") / HOUR), F.lit(24)) % 8 == 0).select("pair", "ts", ((F.col("close") - F.col("open")) / 1e4).alias("rate"), F.col("close").alias("mark"))


def candle_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks after sharp falls: pair, side, lock_ts, lock_end, reason."""
    c = full_candles(spark, sf_dir).where(F.col("close") < 0.2 * F.col("open"))
    return c.select(F.when(F.col("pair") == "error", "*").otherwise(F.col("pair")).alias("pair"), F.lit("*").alias("side"), F.col("ts").alias("lock_ts"), (F.col("ts") + 12 * HOUR).alias("lock_end"), F.lit("drop").alias("reason"))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run records."""
    ev = table(spark, sf_dir, "events")
    phases = ["indicators", "callbacks", "trade_scans", "event_simulation", "unknown"]
    phase = F.element_at(F.array(*map(F.lit, phases)), (F.col("event_id") % 5 + 1).cast("int"))
    return ev.select(
        F.col("event_id").alias("arrival"), F.col("event_type").alias("lane"), F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 11 == 0, "failed").otherwise("completed").alias("status"), F.col("value").alias("wall_time_seconds"), (F.col("value") * 1e6).alias("peak_rss_bytes"),
        F.col("event_type").alias("result_sha256"), to_ms(ev, "ts").alias("updated_at"), phase.alias("phase"), (20 + F.col("event_id") % 100).cast("int").alias("pair_count"), (1000 + F.col("event_id") % 2000).cast("int").alias("days"),
    )
