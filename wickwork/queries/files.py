"""Queries of sources and sinks: tables are written as files in the shared folder and read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.operators.trades import closure_sequence
from wickwork.queries.base import HOUR, query
from wickwork.queries.candles import END, START
from wickwork.session import scratch, stored
from wickwork.sources import exports as ex
from wickwork.sources import files as op
from wickwork.sources import tables as src


def _dated(df):
    return df.withColumn("date", F.timestamp_millis("ts")).drop("ts")


def read_candles(s, d):
    path = scratch(s, "candles")
    # files of a pair are in order of their names, which number the ranges of seq
    _dated(src.ticks(s, d)).withColumn("timeframe", F.lit("1h")).repartitionByRange("seq").sortWithinPartitions("pair", "timeframe", "seq").drop("seq").write.partitionBy("pair", "timeframe").parquet(path)
    return op.read_candles(s, path).select("pair", "timeframe", "ts", "open", "close", "volume")


query("read_candles", "SELECT pair, '1h' AS timeframe, ts, open, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY pair, ts ORDER BY seq DESC) AS n FROM ticks) WHERE n = 1")(read_candles)


def _uri(path):
    """A path of the shared folder as pyarrow takes it."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path if "://" in path else f"file://{path}"


def read_feather(s, d):
    """Candles of each pair as one feather file, written and read on the executors."""
    import pyarrow as pa
    import pyarrow.compute
    import pyarrow.fs

    root = scratch(s, "feather")
    base = _uri(root)

    def write(batches):
        """Rows in order of pair and seq, batch by batch."""
        fs, name = pyarrow.fs.FileSystem.from_uri(base)
        fs.create_dir(name)
        pair = out = file = None
        rows = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for p in table["pair"].unique().to_pylist():
                part = table.filter(pa.compute.equal(table["pair"], p))
                part = part.select(list(op.CANDLE_COLUMNS)).combine_chunks()
                if p != pair:
                    if out:
                        out.close()
                        file.close()
                    pair, file = p, fs.open_output_stream(f"{name}/{p}_USDT-1h.feather")
                    out = pa.ipc.new_file(file, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                out.write_table(part)
                rows += len(part)
        if out:
            out.close()
            file.close()
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    _dated(src.ticks(s, d)).repartition("pair").sortWithinPartitions("pair", "seq").mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return op.read_candles(s, root, "feather").select("pair", "timeframe", "ts", "open", "close", "volume")


query("read_candles_feather", "SELECT pair || '/USDT' AS pair, '1h' AS timeframe, ts, open, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY pair, ts ORDER BY seq DESC) AS n FROM ticks) WHERE n = 1")(read_feather)
query("candle_file_catalog", "SELECT path, CASE WHEN o % 7 = 2 THEN NULL ELSE 'A' || o || '/USDT' END AS pair, CASE WHEN o % 7 = 2 THEN NULL ELSE '5m' END AS timeframe, CASE WHEN o % 3 = 0 AND o % 7 <> 2 THEN 'futures' ELSE 'spot' END AS mode, CASE WHEN o % 7 = 2 THEN NULL WHEN o % 2 = 0 THEN 'feather' ELSE 'parquet' END AS kind, CASE WHEN o % 7 = 2 THEN 'name' END AS error FROM (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 7 = 2 THEN 'x/readme' || o_orderkey || '.txt' ELSE 'x/A' || o_orderkey || '_USDT-5m' || CASE WHEN o_orderkey % 3 = 0 THEN '-futures' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '.feather' ELSE '.parquet' END END AS path FROM orders WHERE o_orderkey % 11 <> 0)")(
    lambda s, d: op.candle_file_catalog(src.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("x/A"), "o_orderkey", F.lit("_USDT-1h-funding_rate.feather"))).when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit("x/readme"), "o_orderkey", F.lit(".txt"))).otherwise(F.concat(F.lit("x/A"), "o_orderkey", F.lit("_USDT-5m"), F.when(F.col("o_orderkey") % 3 == 0, "-futures").otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, ".feather").otherwise(".parquet"))).alias("path")))
)
query("write_compact_candles", f"SELECT pair, '1h' AS timeframe, count(*) AS rows_before, count(*) FILTER (ts BETWEEN {START} - 24 * {HOUR} AND {END}) AS rows_after FROM cf GROUP BY pair")(lambda s, d: op.write_compact_candles(src.full_candles(s, d).withColumn("timeframe", F.lit("1h")), {"1h": 24}, START, END, scratch(s, "compact")))


def signal_vectors(s, d):
    path = scratch(s, "vectors")
    src.signals(s, d).withColumn("body", F.col("close") - F.col("open")).drop("exit_tag", "enter_short", "exit_short").write.parquet(path)
    return op.read_signal_vectors(s, path, ["body"])


query("read_signal_vectors", "SELECT pair, ts, open, high, low, close, volume, enter_long, exit_long, close - open AS body, enter_tag, NULL::VARCHAR AS exit_tag FROM sig")(signal_vectors)


def _surface_parts(s, d):
    t = src.closed_trades(s, d).select("trade_id", "pair", "open_ts", "close_ts", F.col("entries").alias("n"))
    o = src.trade_orders(s, d).select("trade_id", "sequence", "is_entry", F.col("amount").cast("long").alias("amount"))
    return t, o


query("write_trade_surface", "SELECT trade_id, '{\"trade_id\":' || trade_id || ',\"pair\":\"' || pair || '\",\"open_ts\":' || open_ts || ',\"close_ts\":' || close_ts || ',\"n\":' || entries || ',\"orders\":[' || l || ']}' AS surface FROM closed JOIN (SELECT trade_id, string_agg('{\"sequence\":' || sequence || ',\"is_entry\":' || is_entry || ',\"amount\":' || amount::BIGINT || '}', ',' ORDER BY sequence) AS l FROM tord GROUP BY trade_id) USING (trade_id)")(lambda s, d: op.write_trade_surface(*_surface_parts(s, d), scratch(s, "surface")))


TRADES_A_FILE = 10_000


def exports(s, d):
    """Closed trades as exports of one leverage and at most TRADES_A_FILE trades each, with numbers as JSON numbers."""
    order = lambda o: F.struct(o["sequence"].alias("sequence"), o["is_entry"].alias("ft_is_entry"), o["amount"].alias("amount"), o["price"].alias("safe_price"), o["ts"].alias("order_filled_timestamp"), F.lit("").alias("ft_order_tag"))
    t = src.closed_trades(s, d, orders=True).withColumn("orders", F.transform("orders", order))
    row = F.struct("trade_id", "pair", "is_short", "leverage", F.col("open_ts").alias("open_timestamp"), F.col("close_ts").alias("close_timestamp"), "amount", F.col("entry_tag").alias("buy_tag"), "exit_reason", "orders")
    path = scratch(s, "export")
    files = t.groupBy("leverage", F.floor(F.col("trade_id") / TRADES_A_FILE).alias("part")).agg(F.array_sort(F.collect_list(row)).alias("trades"))
    # one export a file: files of a task are told apart by the folder of their part
    files.select("leverage", "part", F.to_json(F.struct(F.struct(F.struct("trades").alias("S")).alias("strategy"))).alias("value")).write.partitionBy("leverage", "part").option("compression", "gzip").text(path)
    return ex.read_backtest_export(s, path, "S")[0]


def _numbered_orders(trades, orders):
    """Orders of each export numbered by trade and sequence, with their trade's leverage. A trade stands before its orders, so neither table is copied to join them."""
    none = lambda c: F.lit(None).cast(dict(orders.dtypes)[c]).alias(c)
    of = ["is_entry", "amount", "ts"]
    heads = trades.select("path", F.col("sequence").alias("trade"), F.lit(-1).alias("sequence"), F.col("leverage").cast("int").alias("leverage"), *map(none, of))
    rows = heads.unionByName(orders.select("path", "trade", "sequence", F.lit(None).cast("int").alias("leverage"), *of))
    place, trade = Window.partitionBy("path").orderBy("trade", "sequence"), Window.partitionBy("path", "trade").orderBy("sequence")
    rows = rows.withColumn("n", F.count(F.when(F.col("sequence") >= 0, 1)).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("leverage", F.first("leverage").over(trade))
    return rows.where("sequence >= 0").select("n", "leverage", *of)


_NORM = "SELECT row_number() OVER (PARTITION BY leverage, trade_id // 10000 ORDER BY trade_id) - 1 AS sequence, leverage::VARCHAR AS leverage, pair, is_short, open_ts, close_ts, amount::BIGINT::VARCHAR AS amount, entry_tag, exit_reason FROM closed"
query("normalize_trades", _NORM.replace(" - 1 AS sequence", "::INT - 1 AS sequence"))(lambda s, d: ex.normalize_trades(exports(s, d))[0].where("error is null").select("sequence", "leverage", "pair", "is_short", "open_ts", "close_ts", "amount", "entry_tag", "exit_reason"))
query("read_backtest_export", "SELECT 'S' AS strategy, count(*) AS trades FROM closed GROUP BY leverage, trade_id // 10000")(lambda s, d: exports(s, d).where("section = 'trades'").groupBy("path", "strategy").agg(F.count("*").alias("trades")).drop("path"))
query("normalize_orders", "SELECT row_number() OVER (PARTITION BY leverage, trade_id // 10000 ORDER BY trade_id, sequence) AS n, leverage, is_entry, amount::BIGINT::VARCHAR AS amount, ts FROM tord JOIN (SELECT trade_id, leverage FROM theads) USING (trade_id)")(
    lambda s, d: _numbered_orders(*ex.normalize_trades(exports(s, d))[:2])
)


def _joined_file(s, parts, folder, name):
    """One file of the text of all gzip parts in the order of their names, copied by a task in pieces."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.fs

    parts, folder = (_uri(x) for x in (parts, folder))

    def copy(batches):
        for _ in batches:
            fs, source = pyarrow.fs.FileSystem.from_uri(parts)
            target = pyarrow.fs.FileSystem.from_uri(folder)[1]
            fs.create_dir(target)
            files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(source)) if f.base_name.startswith("part-"))
            size = 0
            with fs.open_output_stream(f"{target}/{name}") as out:
                for f in files:
                    with fs.open_input_stream(f, compression="gzip") as part:
                        while piece := part.read(16 << 20):
                            size += out.write(piece)
            yield pd.DataFrame({"bytes": [size]})

    s.range(0, 1, 1, 1).mapInPandas(copy, "bytes long").collect()


def one_export(s, d):
    """All closed trades as one export of version 2, a single JSON object of one line with braces and quotes inside its texts, and locks."""
    t = stored(src.closed_trades(s, d).select("trade_id", "pair", "is_short", "open_ts", "close_ts", "amount", "exit_reason"), "closed")  # asked for the ends and for the rows
    row = F.struct("trade_id", "pair", "is_short", F.col("open_ts").alias("open_timestamp"), F.col("close_ts").alias("close_timestamp"), "amount", F.concat(F.lit('a "}{" b\\'), "pair").alias("enter_tag"), "exit_reason", F.array(F.struct(F.lit(True).alias("ft_is_entry"), "amount")).alias("orders"), F.lit(60).alias("trade_duration"), F.lit(False).alias("is_open"), F.lit(1).alias("weekday"))
    lock = F.struct(F.col("lock_ts").alias("lock_timestamp"), F.col("lock_end").alias("lock_end_timestamp"), "pair", "side", F.lit("x } y").alias("reason"), F.lit(True).alias("active"))
    counts = [F.lit(k).alias(c) for k, c in enumerate(ex._COUNTS) if c != "total_trades"]
    locks = src.candle_locks(s, d).select(lock.alias("lock"))
    # one row: how many, and the first of each list, which has no comma before it
    ends = t.agg(F.count("*").alias("total_trades"), F.min("trade_id").alias("_trade")).crossJoin(locks.agg(F.min("lock").alias("_lock")))
    inside = lambda *cols: F.regexp_replace(F.to_json(F.struct(*cols)), r"^\{|\}$", "")
    head = [F.lit(c).alias(c) for c in ("5m", "1-2")]
    before = F.concat(F.lit('{"strategy":{"S":{'), inside(F.lit("spot").alias("trading_mode"), head[0].alias("timeframe"), "total_trades", F.array(F.struct(F.lit("}").alias("key"))).alias("results_per_pair")), F.lit(',"locks":['))
    after = F.concat(F.lit("],"), inside(head[1].alias("timerange"), F.lit(1000.5).alias("starting_balance"), *[F.lit(2.25).alias(c) for c in ex._BALANCES[1:]], *counts), F.lit('}},"strategy_comparison":[{"key":"S"}]}'))
    far, near = F.lit(0).cast("long"), F.lit("")
    comma = lambda first: F.when(first, "").otherwise(",")
    part = lambda df, kind, a, b, c, value: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"), value.alias("value"))
    lines = part(ends, 0, far, far, near, before)
    lines = lines.unionByName(part(locks.crossJoin(F.broadcast(ends)), 1, F.col("lock.lock_timestamp"), F.col("lock.lock_end_timestamp"), F.concat_ws("\u0001", "lock.pair", "lock.side"), F.concat(comma(F.col("lock") == F.col("_lock")), F.to_json("lock"))))
    lines = lines.unionByName(part(ends, 2, far, far, near, F.lit('],"trades":[')))
    lines = lines.unionByName(part(t.crossJoin(F.broadcast(ends)), 3, F.col("trade_id").cast("long"), far, near, F.concat(comma(F.col("trade_id") == F.col("_trade")), F.to_json(row))))
    lines = lines.unionByName(part(ends, 4, far, far, near, after))
    path = scratch(s, "one-export")
    in_order = lines.repartitionByRange(64, "kind", "a", "b", "c").sortWithinPartitions("kind", "a", "b", "c")
    in_order.select("value").write.option("lineSep", " ").option("compression", "gzip").text(f"{path}-parts")
    _joined_file(s, f"{path}-parts", path, "export.json")
    return ex.read_backtest_export(s, path)


_TAG = "'a \"}{\" b\\' || pair"
query("normalize_trades_v2", f"SELECT (row_number() OVER (ORDER BY trade_id) - 1)::INT AS sequence, pair, is_short, open_ts, close_ts, amount::BIGINT::VARCHAR AS amount, {_TAG} AS entry_tag, exit_reason, 60 AS duration_minutes, false AS is_open, 1 AS weekday FROM closed")(
    lambda s, d: ex.normalize_trades(one_export(s, d)[0], 2)[0].where("error is null").select("sequence", "pair", "is_short", "open_ts", "close_ts", "amount", "entry_tag", "exit_reason", "duration_minutes", "is_open", "weekday")
)
query("normalize_locks", "SELECT pair, side, lock_ts, lock_end, 'x } y' AS reason, true AS active FROM lck")(lambda s, d: ex.normalize_trades(one_export(s, d)[0], 2)[2].drop("path", "strategy", "sequence"))
query("normalize_summary", "SELECT 'S' AS strategy, 'spot' AS trading_mode, '5m' AS timeframe, '1-2' AS timerange, '1000.5' AS starting_balance, '2.25' AS total_volume, count(*) AS total_trades, 7::BIGINT AS max_open_trades, 2 AS version, NULL::VARCHAR AS error FROM closed")(
    lambda s, d: ex.normalize_summary(one_export(s, d)[1]).select("strategy", "trading_mode", "timeframe", "timerange", "starting_balance", "total_volume", "total_trades", "max_open_trades", "version", "error")
)


def written_surface(s, d):
    """The manifest and the lines of a surface of all closed trades; every third trade's amount has a zero too much."""
    t = src.closed_trades(s, d).select("trade_id", "pair", "close_ts", "exit_reason", F.concat(F.col("amount").cast("long").cast("string"), F.when(F.col("trade_id") % 3 == 0, ".50").otherwise("")).alias("amount"))
    o = src.trade_orders(s, d).select(F.col("trade_id").alias("trade"), "sequence", F.col("amount").cast("long").alias("size"))
    path = scratch(s, "surface")
    t = stored(ex.with_orders(t, o, "trade_id"), "trades", "zstd")  # orders are listed and joined once, by the key that they come with
    trades = closure_sequence(t).drop("exit_reason")
    trades = trades.select(*[c for c in trades.columns if c != "orders"], "orders")
    summary = t.agg(F.count("*").alias("total_trades"))
    return ex.write_surface(summary, src.candle_locks(s, d), trades, None, path, ["amount"]), ex.read_surface(s, path)


query("write_surface", "SELECT 'summary' AS kind, 1::BIGINT AS lines, 0::BIGINT AS errors UNION ALL SELECT 'lock', count(*), 0 FROM lck UNION ALL SELECT 'trade', count(*), count(*) FILTER (trade_id % 3 = 0) FROM closed")(lambda s, d: written_surface(s, d)[0].drop("digest"))
query("read_surface", "SELECT (row_number() OVER (ORDER BY close_ts, trade_id) - 1) AS sequence, trade_id, pair, n AS orders FROM closed JOIN (SELECT trade_id, count(*) AS n FROM tord GROUP BY trade_id) USING (trade_id)")(
    lambda s, d: written_surface(s, d)[1].where("kind = 'trade'").select(F.from_json("value", "sequence long, trade_id long, pair string, orders array<struct<sequence:int>>").alias("t")).select("t.sequence", "t.trade_id", "t.pair", F.size("t.orders").cast("long").alias("orders"))
)


def state_events(s, d):
    path = scratch(s, "events")
    t = src.closed_trades(s, d)
    t.select(F.to_json(F.struct(F.col("trade_id").alias("sequence"), F.col("close_ts").alias("ts"), F.lit("close").alias("phase"), "pair", F.lit("exit").alias("callback"), F.struct(F.col("amount").cast("decimal(18,9)").alias("quote_free")).alias("state"))).alias("value")).write.text(path)
    return op.read_state_events(s, path)


query("read_state_events", "SELECT trade_id AS sequence, close_ts AS ts, 'close' AS phase, pair, 'exit' AS callback, '{\"quote_free\":' || printf('%.9f', amount) || '}' AS state FROM closed")(state_events)


def _markets(s, d):
    path = scratch(s, "markets")
    k = F.col("c_custkey")
    tier = lambda lo, hi, lev, rate, amt, cum: F.struct(lo.alias("minNotional"), hi.alias("maxNotional"), lev.alias("maxLeverage"), F.lit(rate).alias("maintenanceMarginRate"), amt.alias("maintAmt"), F.struct(cum.alias("cum")).alias("info"))
    none = F.lit(None).cast("double")
    tiers = F.array(tier(F.lit(0.0), k * 1000.0, F.lit(20.0), 0.01, F.lit(0.0), none), tier(k * 1000.0, k * 9000.0, F.lit(5.0), 0.05, none, k * 1.0))
    m = F.struct(F.struct(F.lit(3).alias("amount"), F.lit(2).alias("price")).alias("precision"), F.struct(F.struct(F.lit(0.001).alias("min")).alias("amount"), F.struct(F.lit(5.0).alias("min")).alias("cost"), F.struct(F.lit(20.0).alias("max")).alias("leverage")).alias("limits"), F.lit(0.001).alias("taker"), tiers.alias("tiers"))
    src.table(s, d, "customer").select(F.to_json(F.create_map(F.concat(F.lit("P"), k, F.lit("/USDT")), m)).alias("value")).write.text(path)
    # one market record a line here; a file of many records is read whole
    lines = s.read.text(path)
    whole = scratch(s, "market-files")
    inner = F.transform(F.collect_list("value"), lambda v: F.regexp_replace(v, r"^\{|\}$", ""))
    files = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(16)).alias("file")).agg(F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")).alias("value"))
    files.write.partitionBy("file").text(whole)
    return op.read_markets(s, whole, decimal_places=True)


query("read_markets", "SELECT 'P' || c_custkey || '/USDT' AS pair, 0.001::DOUBLE AS amount_step, 0.01::DOUBLE AS price_step, 0.001::DOUBLE AS amount_min, 5.0::DOUBLE AS cost_min, 20.0::DOUBLE AS leverage_max, 0.001::DOUBLE AS taker FROM customer")(lambda s, d: _markets(s, d)[0])
query("read_market_tiers", "SELECT 'P' || c_custkey || '/USDT' AS pair, unnest([0, 1]) AS tier_no, unnest([0.0, c_custkey * 1000.0])::DOUBLE AS min_notional, unnest([20.0, 5.0])::DOUBLE AS max_leverage, unnest([0.0, c_custkey])::DOUBLE AS maintenance_amount FROM customer")(lambda s, d: _markets(s, d)[1].select("pair", "tier_no", "min_notional", "max_leverage", "maintenance_amount"))


def inventory(s, d):
    path = scratch(s, "inventory")
    src.full_candles(s, d).repartition("pair").write.partitionBy("pair").parquet(path)
    return op.file_inventory(s, path)


query("file_inventory", "SELECT count(*)::BIGINT AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM cf GROUP BY pair")(lambda s, d: inventory(s, d).select("rows", "first_ts", "last_ts"))


def profile_lines(s, d):
    path = scratch(s, "profile")
    r = src.run_records(s, d)
    line = F.to_json(F.struct("arrival", "phase", F.lit(1).alias("calls"), F.col("wall_time_seconds").alias("total"), F.col("wall_time_seconds").alias("longest")))
    r.select(F.when(F.col("arrival") % 13 == 0, F.concat(F.lit("{bad"), F.col("arrival").cast("string"))).otherwise(line).alias("value")).write.text(path)
    return op.read_profile_lines(s, path)


query("read_profile_lines", "SELECT CASE WHEN arrival % 13 <> 0 THEN arrival END AS arrival, CASE WHEN arrival % 13 <> 0 THEN phase END AS phase, CASE WHEN arrival % 13 = 0 THEN 'json' END AS error FROM runs")(lambda s, d: profile_lines(s, d).select("arrival", "phase", "error"))
