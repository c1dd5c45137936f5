"""Orders and closed trades: positions, profits, tag state, equity.

Orders are (trade_id, sequence, is_entry, amount, price, ts, tag); a trade's orders are few, so ordered folds run over one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.operators.replay import order_arrays, position_state, realized_profit  # noqa: F401
from wickwork.session import stored

MONEY = "decimal(38,18)"
LEVELS = 5


# Words of the order tags. An entry belongs to a level by its whole tag, an exit by its first word.
_GRINDS = ["g1", "g2", "g3", "g4", "g5", "g6"]
_STOPPED = ["sg1", "sg2", "sg3", "sg4", "sg5", "sg6"]
_DEEP = ["gd2", "gd3", "gd4", "gd5", "gd6"]
_DEEP_EXITS = ["dd2", "dd3", "dd4", "dd5", "dd6"]
_MANUAL = ["gm0", "gmd0"]
DERISK_TAGS = ("d", "d1", "derisk_level_1", "derisk_level_2", "derisk_level_3")


def closed_ratio(profit: Column, entry_value: Column, leverage: Column) -> Column:
    """Profit by entry value times leverage, 0 without an entry value."""
    return F.when(entry_value == 0, 0.0).otherwise(profit / entry_value * leverage)


def profit_snapshot(orders: DataFrame, rates: DataFrame, fee: float) -> DataFrame:
    """Mark-to-market of open orders: profit_stake, and its ratios to the total, the current and the first stake; NULL ratios where one of them is 0.

    rates: trade_id, rate.
    """
    value = F.col("amount") * F.col("price")
    flows = orders.groupBy("trade_id").agg(
        F.sum(F.when(F.col("is_entry"), -value * (1 + fee)).otherwise(value * (1 - fee))).alias("flow"), F.sum(F.when(F.col("is_entry"), value * (1 + fee)).otherwise(0.0)).alias("total_stake"),
        F.sum(F.when(F.col("is_entry"), F.col("amount")).otherwise(-F.col("amount"))).alias("held"), F.min_by(F.when(F.col("is_entry"), value * (1 + fee)), F.when(F.col("is_entry"), F.col("sequence"))).alias("first_stake"),
    ).join(rates, "trade_id")
    worth = F.col("held") * F.col("rate") * (1 - fee)
    out = flows.withColumn("profit_stake", F.col("flow") + worth).withColumn("current_stake", F.col("held") * F.col("rate") * (1 + fee))
    some = (F.col("total_stake") != 0) & (F.col("current_stake") != 0) & (F.col("first_stake") != 0)
    return out.select("trade_id", "profit_stake", *[F.when(some, F.col("profit_stake") / F.col(c)).alias(f"ratio_{c.split('_')[0]}") for c in ("total_stake", "current_stake", "first_stake")])


def current_profit_ratio(open_rate: Column, rate: Column, amount: Column, fee: Column, leverage: Column, is_short: Column, funding: Column) -> Column:
    """Unrealized ratio; an unleveraged long by its proceeds, else gross less fees plus funding over the fee-adjusted stake."""
    spot = rate * (1 - fee) / (open_rate * (1 + fee)) - 1
    opened = amount * open_rate * F.when(is_short, 1 - fee).otherwise(1 + fee)
    closed = amount * rate * F.when(is_short, 1 + fee).otherwise(1 - fee)
    gain = F.when(is_short, opened - closed).otherwise(closed - opened) + funding
    return F.when((leverage == 1) & ~is_short, spot).otherwise(gain / opened * leverage)


def backtest_summary(trades: DataFrame, start: float, rejected: DataFrame | None = None) -> DataFrame:
    """One row: trades, total profit, final balance, volume, the most trades open at once, and the entry signals that were rejected (rows of `rejected`, 0 without it).

    Money is summed as decimals, so the result does not depend on partitioning.
    """
    money = lambda c: F.sum(F.round(c, 8).cast("decimal(28,8)")).cast("double")
    out = trades.agg(F.count("*").alias("trades"), F.coalesce(money("profit_abs"), F.lit(0.0)).alias("total_profit"), F.coalesce(money(F.col("entry_value") + F.col("amount") * F.col("close_rate")), F.lit(0.0)).alias("volume"))
    turned = trades.sparkSession.range(1).select(F.lit(0).cast("long").alias("rejected_signals")) if rejected is None else rejected.agg(F.count("*").alias("rejected_signals"))
    return out.withColumn("final_balance", F.col("total_profit") + start).crossJoin(max_concurrency(trades)).crossJoin(turned)  # one row each


def summary_by_pair(trades: DataFrame) -> DataFrame:
    """Trades, wins and mean ratio of profit (long: rise, short: fall) by pair and reason, from open_rate and exit_rate."""
    ratio = F.when(F.col("is_short"), 1 - F.col("exit_rate") / F.col("open_rate")).otherwise(F.col("exit_rate") / F.col("open_rate") - 1)
    return trades.withColumn("_r", ratio).groupBy("pair", "exit_reason").agg(F.count("*").alias("trades"), F.count_if(F.col("_r") > 0).alias("wins"), F.round(F.avg(F.round("_r", 8).cast("decimal(28,8)")).cast("double"), 6).alias("mean_ratio"))


def reference_points(orders: DataFrame) -> DataFrame:
    """Of each trade: first entry's amount and cost; prices of the latest entry and exit; the latest order's price and time."""
    at = lambda c, keep: F.max_by(c, F.when(keep, F.col("sequence")))
    entry = F.col("is_entry")
    first = lambda c: F.min_by(c, F.when(entry, F.col("sequence")))
    return orders.groupBy("trade_id").agg(
        first("amount").alias("first_amount"), first(F.col("amount") * F.col("price")).alias("first_cost"), at("price", entry).alias("last_entry_price"),
        at("price", ~entry).alias("last_exit_price"), F.max_by("price", "sequence").alias("last_price"), F.max_by("ts", "sequence").alias("last_ts"),
    )


def fill_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("trade_id").agg(F.count_if("is_entry").alias("entries"), F.count_if(~F.col("is_entry")).alias("exits"))


def cumulative_position(orders: DataFrame) -> DataFrame:
    """Running signed amount of each trade."""
    signed = F.when(F.col("is_entry"), F.col("amount")).otherwise(-F.col("amount"))
    line = Window.partitionBy("trade_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return orders.withColumn("position", F.sum(signed).over(line))


def entries_since_exit(orders: DataFrame) -> DataFrame:
    """Entries after the latest exit of each trade, the first entry left out."""
    of = Window.partitionBy("trade_id")
    marked = orders.withColumn("_exit", F.max(F.when(~F.col("is_entry"), F.col("sequence"))).over(of)).withColumn("_first", F.min(F.when(F.col("is_entry"), F.col("sequence"))).over(of))
    since = F.col("is_entry") & (F.col("sequence") > F.coalesce("_exit", F.lit(-1))) & (F.col("sequence") > F.col("_first"))
    return marked.groupBy("trade_id").agg(F.count_if(since).alias("entries_since_exit"))


def is_derisked(orders: DataFrame, tags: tuple[str, ...] = DERISK_TAGS) -> DataFrame:
    """Whether an exit's first tag word is a derisk tag, or less than 95 % of the first entry is left."""
    word = F.split_part("tag", F.lit(" "), F.lit(1))
    signed = F.when(F.col("is_entry"), F.col("amount")).otherwise(-F.col("amount"))
    out = orders.groupBy("trade_id").agg(F.bool_or(~F.col("is_entry") & word.isin(list(tags))).alias("_tag"), F.sum(signed).alias("_held"), F.min_by("amount", F.when(F.col("is_entry"), F.col("sequence"))).alias("_first"))
    return out.select("trade_id", (F.coalesce("_tag", F.lit(False)) | (F.col("_held") < 0.95 * F.col("_first"))).alias("is_derisked"))


#: entries, exits: level by word; closing: exit words that close every level; other: the level of entries and exits whose words are in none
#: of these lists nor in entry_out or exit_out (None: such orders have no level); derisk: exit words of a derisked trade.
SCHEMES = {
    "grind": {
        "levels": range(1, LEVELS + 1), "entries": {f"grind_{k}_entry": k for k in range(1, LEVELS + 1)}, "exits": {f"grind_{k}_{x}": k for k in range(1, LEVELS + 1) for x in ("exit", "derisk")},
        "closing": ["derisk_global"], "other": None, "entry_out": [], "exit_out": [], "derisk": ["derisk_level_1", "derisk_level_2", "derisk_level_3"],
    },
    "legacy": {
        "levels": range(1, 9), "entries": {f"gd{k}": k for k in range(2, 7)} | {"dl1": 7, "dl2": 8}, "exits": {f"{x}{k}": k for k in range(2, 7) for x in ("gd", "dd")} | {"dl1": 7, "ddl1": 7, "dl2": 8, "ddl2": 8},
        "closing": ["p", "r", "d", "dd0", "partial_exit", "force_exit", ""], "other": 1, "entry_out": ["r", "d1", "gdr", *_GRINDS, *_STOPPED, *_MANUAL], "exit_out": ["d1", "gdr", *_GRINDS, *_STOPPED, *_MANUAL], "derisk": ["d1"],
    },
    "regular": {
        "levels": range(0, 7), "entries": {f"g{k}": k for k in range(1, 7)}, "exits": {f"{x}{k}": k for k in range(1, 7) for x in ("g", "sg")},
        "closing": ["d", "d1", "dd0", "dd1", "ddl1", "ddl2", *_DEEP_EXITS], "other": 0, "entry_out": [*_STOPPED, "dl1", "dl2", "gd1", *_DEEP, *_MANUAL], "exit_out": ["p", "dl1", "dl2", "gd1", *_DEEP, *_MANUAL], "derisk": ["d", "d1", "dd0", "dd1", "ddl1", "ddl2", *_DEEP_EXITS],
    },
}


def _levels(scheme: str, is_entry: Column, tag: Column, head: Column) -> Column:
    """Levels that an order adds to (entry) or closes (exit)."""
    s = SCHEMES[scheme]
    one = lambda k: F.array(F.lit(k))
    none = F.array().cast("array<int>")
    rest = none if s["other"] is None else one(s["other"])

    def by_word(word: Column, table: dict[str, int], out: list[str]) -> Column:
        found = F.when(word.isin(out), none).otherwise(rest) if out else rest
        for w, k in table.items():
            found = F.when(word == w, one(k)).otherwise(found)
        return found

    closing = F.when(head.isin(s["closing"]), F.array(*map(F.lit, s["levels"]))).otherwise(by_word(head, s["exits"], s["exit_out"]))
    return F.when(is_entry, by_word(tag, s["entries"], s["entry_out"])).otherwise(closing)


def open_clusters(orders: DataFrame, scheme: str = "grind") -> DataFrame:
    """Per trade and level: entries still open after the newest exit that closes the level. The first order of a trade never counts.

    Columns: trade_id, level, entries, amount, cost, ids (sequence, newest first), latest_price, exit_price, and derisked: whether an exit's first word says so or, in the
    regular scheme, less than 95 % of the first entry was left after some exit.
    """
    of = Window.partitionBy("trade_id")
    tag = F.coalesce("tag", F.lit(""))
    own = orders.withColumn("_head", F.split_part(tag, F.lit(" "), F.lit(1))).withColumn("_first", F.min("sequence").over(of))
    levels = F.when(F.col("is_entry") & (F.col("sequence") == F.col("_first")), F.array().cast("array<int>")).otherwise(_levels(scheme, F.col("is_entry"), tag, F.col("_head")))
    hit = own.withColumn("level", F.explode(levels))
    last = F.max(F.when(~F.col("is_entry"), F.col("sequence"))).over(Window.partitionBy("trade_id", "level"))
    marked = hit.withColumn("_last", last).withColumn("_open", F.col("is_entry") & (F.col("sequence") > F.coalesce("_last", F.lit(-1))))
    value = F.col("amount") * F.col("price")
    keep = lambda c: F.when(F.col("_open"), c)
    out = marked.groupBy("trade_id", "level").agg(
        F.count_if("_open").alias("entries"), F.coalesce(F.sum(keep(F.col("amount"))), F.lit(0.0)).alias("amount"), F.coalesce(F.sum(keep(value)), F.lit(0.0)).alias("cost"),
        F.sort_array(F.collect_list(keep(F.col("sequence"))), asc=False).alias("ids"), F.max_by("price", keep(F.col("sequence"))).alias("latest_price"), F.max_by("price", F.when(~F.col("is_entry"), F.col("sequence"))).alias("exit_price"),
    )
    said = ~F.col("is_entry") & F.col("_head").isin(SCHEMES[scheme]["derisk"])
    if scheme == "regular":
        held = F.sum(F.when(F.col("is_entry"), F.col("amount")).otherwise(-F.col("amount"))).over(of.orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))
        first = F.min_by("amount", F.when(F.col("is_entry"), F.col("sequence"))).over(of)
        own = own.withColumn("_held", held).withColumn("_amount", first)
        said = said | (~F.col("is_entry") & (F.col("_held") < 0.95 * F.col("_amount")))
    derisk = own.groupBy("trade_id").agg(F.bool_or(said).alias("derisked"))
    return out.where("entries > 0 or exit_price is not null").join(derisk, "trade_id", "left").withColumn("derisked", F.coalesce("derisked", F.lit(False)))


def cluster_profit(clusters: DataFrame, rate: Column, fee: float) -> DataFrame:
    """profit_stake, profit_rate to the mean price and distance to the latest entry of each open cluster."""
    mean = F.col("cost") / F.col("amount")
    c = clusters.where("entries > 0").withColumn("_rate", rate)
    return c.select("trade_id", "level", (F.col("amount") * F.col("_rate") * (1 - fee) - F.col("cost") * (1 + fee)).alias("profit_stake"), ((F.col("_rate") - mean) / mean).alias("profit_rate"), ((F.col("_rate") - F.col("latest_price")) / F.col("latest_price")).alias("distance"))


def closure_sequence(trades: DataFrame) -> DataFrame:
    """Number trades in the order of closing; at one time forced closes come last, newest trade first. Needs close_ts, exit_reason, trade_id.

    Days are counted first, so only one day's trades are put in order in one task. Trades are stored, as they are asked for the days and for the rows.
    """
    trades = stored(trades, "closing", "zstd")
    forced = F.col("exit_reason") == "force_exit"
    order = Window.partitionBy("_day").orderBy("close_ts", forced, F.when(forced, -F.col("trade_id")).otherwise(F.col("trade_id")))
    rows = trades.withColumn("_day", F.floor(F.col("close_ts") / 86_400_000)).withColumn("_n", F.row_number().over(order))
    days = rows.groupBy("_day").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(days.select("_day", "_before"), "_day").withColumn("sequence", (F.col("_n") + F.col("_before") - 1).cast("long")).drop("_day", "_n", "_before")


def _daily_prefix(events: DataFrame, sums: list[str], order: list) -> DataFrame:
    """Running totals of the columns over all events in order (first by ts): day totals first, then inside each day."""
    rows = events.withColumn("_day", F.floor(F.col("ts") / 86_400_000))
    days = rows.groupBy("_day").agg(*[F.sum(c).alias(f"_d_{c}") for c in sums])
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", *[F.coalesce(F.sum(f"_d_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums}).join(days, "_day")
    exact = {c for c, kind in events.dtypes if kind.startswith("decimal")}
    whole = lambda c: F.col(c).cast("decimal(28,8)") if c[3:].lstrip("_") in exact else F.col(c)  # noqa: E731  sums of decimals widen at the cost of places
    return out.withColumns({f"run_{c}": whole(f"run_{c}") + whole(f"_b_{c}") for c in sums}).drop("_day", *[f"_b_{c}" for c in sums])


def wallet_events(trades: DataFrame) -> DataFrame:
    """Two events a trade: opening ties its stake, closing frees it and adds the profit. Money as decimals of 8 places."""
    dec = lambda c: F.round(c, 8).cast("decimal(28,8)")
    stake, profit = dec(F.col("stake_amount")), dec(F.col("profit_abs"))
    zero = F.lit(0).cast("decimal(28,8)")
    each = F.array(
        F.struct(F.col("open_ts").alias("ts"), F.lit(1).alias("kind"), stake.alias("tied"), zero.alias("profit"), F.lit(1).alias("open"), F.lit(0).alias("closed")),
        F.struct(F.col("close_ts").alias("ts"), F.lit(0).alias("kind"), (-stake).cast("decimal(28,8)").alias("tied"), profit.alias("profit"), F.lit(-1).alias("open"), F.lit(1).alias("closed")),
    )
    return trades.select("trade_id", F.explode(each).alias("e")).select("trade_id", "e.*")


def equity_curve(trades: DataFrame, start: float) -> DataFrame:
    """After each event: free balance, tied stake, open trades, realized profit and closed trades. At one time closes come before opens, then by trade."""
    trades = stored(trades.select("trade_id", "open_ts", "close_ts", "stake_amount", "profit_abs"), "wallet", "zstd")  # asked for days and for rows
    run = _daily_prefix(wallet_events(trades), ["tied", "profit", "open", "closed"], ["ts", "kind", "trade_id"])
    free = F.lit(start).cast("decimal(28,8)") + F.col("run_profit") - F.col("run_tied")
    return run.select("ts", "kind", "trade_id", free.cast("double").alias("free"), F.col("run_tied").cast("double").alias("tied"), F.col("run_open").cast("long").alias("open_trades"), F.col("run_profit").cast("double").alias("realized"), F.col("run_closed").cast("long").alias("closed_trades"))


def wallet_state(trades: DataFrame, start: float) -> DataFrame:
    """equity_curve at closing events."""
    return equity_curve(trades, start).where("kind = 0").drop("kind")


def max_concurrency(trades: DataFrame) -> DataFrame:
    """Largest number of trades open at once."""
    run = _daily_prefix(wallet_events(trades).select("trade_id", "ts", "kind", "open"), ["open"], ["ts", "kind", "trade_id"])
    return run.agg(F.coalesce(F.max("run_open"), F.lit(0)).cast("long").alias("max_open_trades"))


def max_drawdown(trades: DataFrame, value: str, start: float, relative: bool) -> DataFrame:
    """Largest fall of start plus the running sum of value below its earlier high, in closing order; relative to the high if asked.

    Running sums and highs go in two levels over days.
    """
    rows = trades.select("trade_id", F.col("close_ts").alias("ts"), F.round(value, 8).cast("decimal(28,8)").alias("v"))
    run = _daily_prefix(rows, ["v"], ["ts", "trade_id"]).withColumn("_day", F.floor(F.col("ts") / 86_400_000)).withColumn("cum", F.lit(start) + F.col("run_v").cast("double"))
    high = run.groupBy("_day").agg(F.max("cum").alias("_h"))
    high = high.select("_day", F.coalesce(F.max("_h").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(start)).alias("_hb"))
    inside = Window.partitionBy("_day").orderBy("ts", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    out = run.withColumn("_in", F.max("cum").over(inside)).join(high, "_day").withColumn("_high", F.greatest("_in", "_hb", F.lit(start)))
    fall = F.col("_high") - F.col("cum")
    return out.agg(F.coalesce(F.round(F.max(F.when(F.col("_high") != 0, fall / F.col("_high")) if relative else fall), 6), F.lit(0.0)).alias("max_drawdown"))


def coverage_sets(trades: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row a kind: the sorted distinct tag words, compound tags, exit reasons, sides and leverages of trades, and the callbacks of events (callback) if they are given."""
    words = F.filter(F.split(F.coalesce("entry_tag", F.lit("")), r"\s+"), lambda w: w != "")
    kinds = {
        "tag_words": words, "compound_tags": F.when(F.size(words) > 1, F.array(F.col("entry_tag"))).otherwise(F.array().cast("array<string>")), "exit_reasons": F.array("exit_reason"),
        "sides": F.array(F.when(F.col("is_short"), "short").otherwise("long")), "leverages": F.array(F.col("leverage").cast("string")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("values")) for k, v in kinds.items()]))
    flat = trades.select(each.alias("k")).select("k.kind", F.explode("k.values").alias("value"))
    if events is not None:
        flat = flat.unionByName(events.where("callback <> ''").select(F.lit("callbacks").alias("kind"), F.col("callback").alias("value")))
    flat = flat.where("value is not null").distinct()
    return flat.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values"))


def missing_coverage(required: DataFrame, observed: DataFrame) -> DataFrame:
    """Required (kind, value) rows that were not observed."""
    return required.join(observed, ["kind", "value"], "left_anti")


def running_best(path: DataFrame, value: str = "profit") -> DataFrame:
    """best: the largest value of the rows before, 0 at least, per (trade_id, level if present)."""
    keys = [c for c in ("trade_id", "level") if c in path.columns]
    line = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return path.withColumn("best", F.greatest(F.lit(0.0), F.coalesce(F.max(value).over(line), F.lit(0.0))))


def trade_path(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Profit ratio of each trade at each candle of its life: trade_id, ts, profit."""
    from wickwork.operators.joins import _bucketed, _exploded

    hit = _exploded(trades, "open_ts", "close_ts").join(_bucketed(candles).select("pair", "_bucket", "ts", "close"), ["pair", "_bucket"]).where("ts between open_ts and close_ts")
    ratio = F.when(F.col("is_short"), 1 - F.col("close") / F.col("open_rate")).otherwise(F.col("close") / F.col("open_rate") - 1)
    return hit.select("trade_id", "ts", ratio.alias("profit"))


def trailing_exit(path: DataFrame, deltas: list[tuple[float, float]]) -> DataFrame:
    """First time at which profit falls below its best so far by more than the delta of the best's bucket. deltas: (least best, delta), rising."""
    line = Window.partitionBy("trade_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    best = path.withColumn("best", F.max("profit").over(line))
    delta = F.lit(None).cast("double")
    for least, d in deltas:
        delta = F.when(F.col("best") >= least, d).otherwise(delta)
    hit = best.where(F.col("profit") < F.col("best") - delta)
    return hit.groupBy("trade_id").agg(F.min("ts").alias("exit_ts"), F.min_by("profit", "ts").alias("profit"), F.min_by("best", "ts").alias("best"))
