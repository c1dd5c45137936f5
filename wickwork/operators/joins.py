"""Joins of candles, signals, funding, trades and locks.

Range joins cut the interval into buckets of BUCKET_MS, explode the interval over them and join on (pair, bucket), so they
are hash joins and never a product of the sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.functions.economics import quantize_step
from wickwork.functions.timeframes import DAY_MS, timeframe_ms
from wickwork.operators.candles import by_time
from wickwork.session import stored

BUCKET_MS = DAY_MS


def merge_informative(base: DataFrame, informative: DataFrame, timeframe: str, coarser: str, ffill: bool = False) -> DataFrame:
    """Columns of a coarser timeframe, suffixed `_<timeframe>`, on the base candle that closes when theirs does.

    With ffill the last matched row is carried as a whole: a NULL inside it stays, and coarser rows without a base candle are never used.
    """
    fine, coarse = timeframe_ms(timeframe), timeframe_ms(coarser)
    if coarse < fine:
        raise ValueError("the informative timeframe is finer than the base")
    names = [c for c in informative.columns if c != "pair"]
    row = informative.select(F.col("pair").alias("_pair"), (F.col("ts") + (coarse - fine)).alias("_key"), F.struct(*[F.col(c).alias(f"{c}_{coarser}") for c in names]).alias("_row"))
    # by names of their own: both sides may stem from one table
    joined = base.join(row, (F.col("pair") == F.col("_pair")) & (F.col("ts") == F.col("_key")), "left").drop("_pair", "_key")
    if ffill:
        joined = joined.withColumn("_row", F.last("_row", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return joined.select(*base.columns, "_row.*")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a one-to-one join needs this to be empty."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def funding_events(rates: DataFrame, marks: DataFrame, check: bool = True) -> DataFrame:
    """Funding rate and mark price of identical times: pair, ts, rate, mark. Repeated keys are an error when checked."""
    if check and (repeated_keys(rates, ["pair", "ts"]).limit(1).count() or repeated_keys(marks, ["pair", "ts"]).limit(1).count()):
        raise ValueError("funding or mark candles repeat a time")
    return rates.select("pair", "ts", F.col("open").alias("rate")).join(marks.select("pair", "ts", F.col("open").alias("mark")), ["pair", "ts"])


def attach_funding(candles: DataFrame, events: DataFrame) -> DataFrame:
    """funding_rate and mark_price on candles of exactly the event's time; nothing is filled."""
    return candles.join(events.select("pair", "ts", F.col("rate").alias("funding_rate"), F.col("mark").alias("mark_price")), ["pair", "ts"], "left")


def coverage_gaps(candles: DataFrame, pairs: list[str], size_ms: int, start: int, end: int, policy: str = "strict") -> DataFrame:
    """Each requested pair with what is missing of start..end; `available` forgives a late start."""
    spark = candles.sparkSession
    wanted = spark.createDataFrame([(p,) for p in pairs], "pair string")
    have = candles.groupBy("pair").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    out = wanted.join(have, "pair", "left")
    none = F.col("first_ts").isNull()
    late, early = none | (F.col("first_ts") > start), none | (F.col("last_ts") + size_ms < end)
    ok = ~early if policy == "available" else ~(late | early)
    return out.withColumn("start_missing", late).withColumn("end_missing", early).withColumn("accepted", ok)


def startup_shortfalls(candles: DataFrame, pairs: list[str], size_ms: int, start: int, startup: int) -> DataFrame:
    """Missing history candles before start of each requested pair, NULL without data."""
    wanted = candles.sparkSession.createDataFrame([(p,) for p in pairs], "pair string")
    first = candles.groupBy("pair").agg(F.min("ts").alias("first_ts"))
    need = start - startup * size_ms
    short = F.when(F.col("first_ts").isNotNull(), F.greatest(F.lit(0), F.ceil((F.col("first_ts") - need) / size_ms)))
    return wanted.join(first, "pair", "left").select("pair", short.cast("long").alias("missing_candles"))


def needs_prepend(gaps: DataFrame, shortfalls: DataFrame, strict: bool) -> DataFrame:
    """One row: whether some existing series starts too late. Pairs without any data do not count."""
    both = gaps.where("first_ts is not null").join(shortfalls, "pair", "left")
    late = F.col("start_missing") if strict else F.lit(False)
    return both.agg(F.coalesce(F.bool_or(late | (F.coalesce("missing_candles", F.lit(0)) > 0)), F.lit(False)).alias("needs_prepend"))


def frontier_advanced(before: DataFrame, after: DataFrame, size_ms: int, end: int) -> DataFrame:
    """One row: whether any series that does not reach the end has a later last candle than before."""
    b = before.groupBy("pair").agg(F.max("ts").alias("was"))
    a = after.groupBy("pair").agg(F.max("ts").alias("is"))
    joined = b.join(a, "pair", "left").where(F.col("was") + size_ms < end)
    return joined.agg(F.coalesce(F.bool_or(F.col("is") > F.col("was")), F.lit(False)).alias("advanced"))


def price_step_asof(df: DataFrame, steps: DataFrame, defaults: DataFrame, default: float) -> DataFrame:
    """step in force at each row: the pair's latest change at or before ts, else the pair's default, else the global one.

    Changes and rows are one stream per pair and carried forward, so no join by range is needed; at equal times the change comes first.
    """
    rows = df.withColumn("_kind", F.lit(1)).withColumn("_step", F.lit(None).cast("double"))
    changes = steps.select("pair", "ts", F.lit(0).alias("_kind"), F.col("step").cast("double").alias("_step"))
    line = Window.partitionBy("pair").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.unionByName(changes, allowMissingColumns=True).withColumn("_step", F.last("_step", ignorenulls=True).over(line)).where("_kind = 1")
    own = defaults.select("pair", F.col("step").cast("double").alias("_own"))
    return carried.join(own, "pair", "left").withColumn("step", F.coalesce("_step", "_own", F.lit(default))).drop("_kind", "_step", "_own")


def _exploded(df: DataFrame, start: str, end: str) -> DataFrame:
    day = lambda c: F.floor(F.col(c) / BUCKET_MS)
    return df.withColumn("_bucket", F.explode(F.when(F.col(end) >= F.col(start), F.sequence(day(start), day(end)))))


def _bucketed(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(ts) / BUCKET_MS))


def trade_extrema(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """min_rate and max_rate of the candles from open to close of each trade, both ends included."""
    c = _bucketed(candles).select("pair", "_bucket", "ts", "low", "high")
    hit = _exploded(trades, "open_ts", "close_ts").join(c, ["pair", "_bucket"]).where("ts between open_ts and close_ts")
    return hit.groupBy("trade_id").agg(F.min("low").alias("min_rate"), F.max("high").alias("max_rate"))


def funding_by_trade(trades: DataFrame, events: DataFrame) -> DataFrame:
    """Funding of each trade with one amount over its life: events after the open up to the close; a long pays a positive rate, a short earns it."""
    e = _bucketed(events).select("pair", "_bucket", "ts", "rate", "mark")
    hit = _exploded(trades, "open_ts", "close_ts").join(e, ["pair", "_bucket"]).where("open_ts < ts and ts <= close_ts")
    sign = F.when(F.col("is_short"), 1.0).otherwise(-1.0)
    sums = hit.groupBy("trade_id").agg(F.sum(sign * F.col("rate") * F.col("mark") * F.col("amount")).alias("funding_fees"), F.count("*").alias("events"))
    return trades.join(sums, "trade_id", "left").withColumns({"funding_fees": F.coalesce("funding_fees", F.lit(0.0)), "events": F.coalesce("events", F.lit(0).cast("long"))})


def funding_by_segment(orders: DataFrame, trades: DataFrame, events: DataFrame) -> DataFrame:
    """Funding between the fills of each trade: (trade_id, sequence) is the fill at whose end the funding has been earned.

    orders: trade_id, sequence, is_entry, amount, ts. An event at the time of a fill is earned with the amount before it.
    """
    line = Window.partitionBy("trade_id").orderBy("sequence")
    signed = F.when(F.col("is_entry"), F.col("amount")).otherwise(-F.col("amount"))
    seg = orders.withColumn("held", F.sum(signed).over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("since", F.lag("ts").over(line)).where("since is not null")
    seg = seg.select("trade_id", "sequence", "held", "since", F.col("ts").alias("until")).join(trades.select("trade_id", "pair", "is_short"), "trade_id")
    e = _bucketed(events).select("pair", "_bucket", F.col("ts").alias("at"), "rate", "mark")
    hit = _exploded(seg, "since", "until").join(e, ["pair", "_bucket"]).where("since < at and at <= until")
    sign = F.when(F.col("is_short"), 1.0).otherwise(-1.0)
    return hit.groupBy("trade_id", "sequence").agg(F.sum(sign * F.col("rate") * F.col("mark") * F.col("held")).alias("funding_fee"))


#: Candles, or blocks, that make one block of the next level.
RADIX = 16


def candle_blocks(candles: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """(pair, level, block, low, high) of blocks of RADIX^level candles by position `pos`, and the number of levels that a pair of `longest` candles needs."""
    level = candles.select("pair", F.col("pos").alias("block"), "low", "high")
    out, levels = level.withColumn("level", F.lit(0)), 1
    while RADIX**levels <= longest:
        level = level.groupBy("pair", F.floor(F.col("block") / RADIX).alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        out, levels = out.unionByName(level.withColumn("level", F.lit(levels))), levels + 1
    return out, levels


def _cover(first: Column, end: Column, levels: int) -> Column:
    """Blocks (level, block, at) that make up the positions from first to before end, some 2 * RADIX of each level at most."""
    low = [F.ceil(first / RADIX**k).cast("long") for k in range(levels)]
    high = [F.floor(end / RADIX**k).cast("long") for k in range(levels)]

    def some(k: int, start: Column, stop: Column) -> Column:
        blocks = F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(blocks, lambda b: F.struct((b * RADIX**k).alias("at"), F.lit(k).alias("level"), b.alias("block")))

    parts = [some(levels - 1, low[-1], high[-1])]
    for k in range(levels - 1):  # what the next level covers is left to it
        inner = low[k + 1] < high[k + 1]
        parts += [some(k, low[k], F.when(inner, low[k + 1] * RADIX).otherwise(high[k])), some(k, F.when(inner, high[k + 1] * RADIX).otherwise(high[k]), high[k])]
    return F.flatten(F.array(*parts))


def first_passages(asks: DataFrame, blocks: DataFrame, levels: int, keys: list[str]) -> DataFrame:
    """(keys, pos): the first candle from position first to before end that reaches the barrier: low at or below it (long) or high at or above it (short).

    The range is covered by few blocks; of the first that reaches the barrier only its children are looked at, level by level, so the cost is the logarithm of the range.
    asks: keys, pair, is_short, barrier, first, end.
    """
    reached = F.when(F.col("is_short"), F.col("high") >= F.col("barrier")).otherwise(F.col("low") <= F.col("barrier"))
    about = F.struct("pair", "is_short", "barrier")

    def first_of(rows: DataFrame) -> DataFrame:
        """The first block of each ask that reaches its barrier."""
        best = F.min_by(F.struct("level", "block", about.alias("a")), "at").alias("x")
        return rows.join(blocks, ["pair", "level", "block"]).where(reached).groupBy(*keys).agg(best).select(*keys, "x.a.*", "x.level", "x.block")

    found = first_of(asks.where("end > first").select(*keys, "pair", "is_short", "barrier", F.explode(_cover(F.col("first"), F.col("end"), levels)).alias("b")).select(*keys, "pair", "is_short", "barrier", "b.*"))
    for k in range(levels - 1, 0, -1):
        children = F.explode(F.sequence(F.col("block") * RADIX, F.col("block") * RADIX + RADIX - 1))
        below = found.where(F.col("level") == k).select(*keys, "pair", "is_short", "barrier", F.lit(k - 1).alias("level"), children.alias("block"))
        found = found.where(F.col("level") < k).unionByName(first_of(below.withColumn("at", F.col("block"))).select(*found.columns))
    return found.select(*keys, F.col("block").alias("pos"))


def first_exits(asks: DataFrame, candles: DataFrame, keys: list[str]) -> DataFrame:
    """Adds exit_ts, exit_reason and exit_rate to asks: keys, pair, open_ts, is_short, _stop, _liq (or NULL), _due; rules as in first_barrier.

    Signals and timeouts are one stream per pair that carries the next candle back; barriers are first passages over blocks of candles. So nothing is joined by range, and asks may be
    many for one entry: all of them share the candles and blocks of one scan.
    """
    line = Window.partitionBy("pair").orderBy("ts")
    ahead = line.rowsBetween(0, Window.unboundedFollowing)
    bars = candles.select("pair", "ts", "open", "low", "high", "exit_long", "exit_short").withColumn("pos", F.row_number().over(line).cast("long") - 1)
    mark = lambda c: F.first(F.when(F.col(c) == 1, F.struct("pos", "ts", "open")), ignorenulls=True).over(ahead)
    bars = stored(bars.withColumns({"_long": mark("exit_long"), "_short": mark("exit_short")}), "bars")
    longest = bars.agg(F.max("pos")).first()[0]
    if longest is None:
        none = F.lit(None)
        return asks.select("*", none.cast("long").alias("exit_ts"), F.lit("force_exit").alias("exit_reason"), none.cast("double").alias("exit_rate"))
    blocks, levels = candle_blocks(bars, longest + 1)
    # the first candle after the open (behind candles of the same time) and the first at or after the due time (before them)
    bar = F.struct("pos", "ts", "open", "_long", "_short")
    own = F.struct(*[F.col(k).alias(k) for k in keys])
    stream = bars.select("pair", F.col("ts").alias("_at"), F.lit(1).alias("_kind"), bar.alias("_bar"), F.lit(None).cast(asks.select(own.alias("o")).schema["o"].dataType).alias("_own"))
    times = F.explode(F.array(F.struct(F.col("open_ts").alias("_at"), F.lit(2).alias("_kind")), F.struct(F.col("_due").alias("_at"), F.lit(0).alias("_kind"))))
    marks = asks.select("pair", times.alias("t"), own.alias("_own")).select("pair", "t.*", F.lit(None).cast(stream.schema["_bar"].dataType).alias("_bar"), "_own")
    onward = Window.partitionBy("pair").orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    seen = stream.unionByName(marks).withColumn("_next", F.first("_bar", ignorenulls=True).over(onward)).where("_kind <> 1")
    at = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_next")))
    begun = seen.groupBy("_own").agg(at(2).alias("_from"), at(0).alias("_late")).select("_own.*", "_from", "_late")
    rows = asks.join(begun, keys)
    signal = F.when(F.col("is_short"), F.col("_from._short")).otherwise(F.col("_from._long"))
    rows = rows.withColumn("_signal", signal)
    never = F.lit(longest + 1)
    until = F.least(F.coalesce("_signal.pos", never), F.coalesce("_late.pos", never))
    nearer = F.when(F.col("is_short"), F.least("_stop", "_liq")).otherwise(F.greatest("_stop", "_liq"))
    rows = stored(rows.withColumns({"first": F.col("_from.pos"), "end": until, "barrier": nearer}), "asks")
    hits = first_passages(rows.where("first is not null"), blocks, levels, keys).withColumnRenamed("pos", "_hit")
    hits = rows.select(*keys, "pair").join(hits, keys).join(bars.select("pair", F.col("pos").alias("_hit"), F.struct("ts", "low", "high").alias("_at")), ["pair", "_hit"]).drop("pair", "_hit")
    last = bars.groupBy("pair").agg(F.max("ts").alias("_last_ts"), F.max_by("open", "ts").alias("_last_open"))
    out = rows.join(hits, keys, "left").join(last, "pair", "left")
    stopped = F.when(F.col("is_short"), F.col("_at.high") >= F.col("_stop")).otherwise(F.col("_at.low") <= F.col("_stop"))
    by_signal = F.col("_signal.pos") <= F.coalesce("_late.pos", never)
    reason = F.when(F.col("_at").isNotNull(), F.when(stopped, "stop_loss").otherwise("liquidation")).when(by_signal, "exit_signal").when(F.col("_late").isNotNull(), "timeout").otherwise("force_exit")
    when = {"stop_loss": ("_at.ts", "_stop"), "liquidation": ("_at.ts", "_liq"), "exit_signal": ("_signal.ts", "_signal.open"), "timeout": ("_late.ts", "_late.open")}
    pick = lambda k, other: reduce(lambda c, x: c.when(F.col("exit_reason") == x[0], F.col(x[1][k])), when.items(), F).otherwise(F.col(other))
    out = out.withColumn("exit_reason", reason)
    return out.select(*asks.columns, pick(0, "_last_ts").alias("exit_ts"), "exit_reason", pick(1, "_last_open").alias("exit_rate"))


def barrier_asks(entries: DataFrame, stop: Column, timeout_ms: Column, liquidation: Column | None = None, step: float | None = None) -> DataFrame:
    """Adds _stop, _liq and _due: barriers at shares of the open rate, rounded up (long) or down (short) to step, and the time at which an entry is due."""
    side = lambda a, b: F.when(F.col("is_short"), b).otherwise(a)
    raw = lambda share: side(F.col("open_rate") * (1 - share), F.col("open_rate") * (1 + share))
    tick = lambda c: c if step is None else side(quantize_step(c, F.lit(step), "ceil"), quantize_step(c, F.lit(step), "floor"))
    burnt = tick(raw(liquidation)) if liquidation is not None else F.lit(None).cast("double")
    return entries.withColumns({"_stop": tick(raw(stop)), "_liq": burnt, "_due": F.greatest(F.col("open_ts") + timeout_ms, F.col("open_ts") + 1)})


def first_barrier(entries: DataFrame, candles: DataFrame, stop: float, timeout_ms: int, liquidation: float | None = None, step: float | None = None) -> DataFrame:
    """The first exit of each entry: trade_id, exit_ts, exit_reason, exit_rate.

    entries: trade_id, pair, open_ts, open_rate, is_short; candles need exit_long and exit_short. Within one candle the order is signal, timeout,
    stop, liquidation. The first two fill at the open, the others at the barrier, rounded up (long) or down (short) to step. An entry that nothing hits is
    closed at the open of the pair's last candle. The timeout falls on the first candle at or after it, however long the pair has none.
    """
    asks = barrier_asks(entries, F.lit(stop), F.lit(timeout_ms), None if liquidation is None else F.lit(liquidation), step)
    return first_exits(asks, candles, ["trade_id"]).drop("_stop", "_liq", "_due")


def locked_entries(signals: DataFrame, locks: DataFrame, side: str = "long") -> DataFrame:
    """Signal rows (pair, ts) inside a lock (lock_ts <= ts < lock_end) of the pair or `*`, on the same side or `*`."""
    entry = _bucketed(signals.select("pair", "ts"))
    cut = _exploded(locks.where(F.col("side").isin(side, "*")).withColumn("_to", F.col("lock_end") - 1), "lock_ts", "_to").select(F.col("pair").alias("_pair"), "_bucket", "lock_ts", "lock_end")
    inside = (F.col("lock_ts") <= F.col("ts")) & (F.col("lock_end") > F.col("ts"))
    own = entry.join(cut.where("_pair <> '*'"), (entry["pair"] == F.col("_pair")) & (entry["_bucket"] == cut["_bucket"]) & inside, "left_semi")
    any_pair = entry.join(cut.where("_pair = '*'"), (entry["_bucket"] == cut["_bucket"]) & inside, "left_semi")
    return own.union(any_pair).select("pair", "ts").distinct()


def with_reference_pair(df: DataFrame, reference: str, columns: list[str]) -> DataFrame:
    """Columns of the reference pair's candle of the same time, prefixed ref_."""
    ref = df.where(F.col("pair") == reference).select("ts", *[F.col(c).alias(f"ref_{c}") for c in columns])
    return df.join(ref, "ts", "left")


def _with_tiers(df: DataFrame, tiers: DataFrame, order: str) -> DataFrame:
    """The tiers of each row's pair as one array _tiers, by `order`: rows stay as they are, repeated ones too."""
    row = F.struct(order, *[c for c in tiers.columns if c not in ("pair", order)])
    return df.join(tiers.groupBy("pair").agg(F.array_sort(F.collect_list(row)).alias("_tiers")), "pair", "left")


def tier_cap(df: DataFrame, tiers: DataFrame, stake: str = "stake") -> DataFrame:
    """max_leverage: that of the first tier with stake <= max_notional / max_leverage; NULL if none. tiers: pair, tier_no, min_notional, max_notional, max_leverage."""
    fits = F.filter("_tiers", lambda t: F.col(stake) <= t["max_notional"] / t["max_leverage"])
    return _with_tiers(df, tiers, "tier_no").select(*df.columns, F.get(fits, 0)["max_leverage"].alias("max_leverage"))


def maintenance_tier(df: DataFrame, tiers: DataFrame, stake: str = "stake") -> DataFrame:
    """maintenance_rate and maintenance_amount of the last tier with stake >= min_notional."""
    fits = F.filter("_tiers", lambda t: F.col(stake) >= t["min_notional"])
    found = _with_tiers(df, tiers, "min_notional").withColumn("_t", F.try_element_at(fits, F.lit(-1)))
    return found.select(*df.columns, F.col("_t.maintenance_rate").alias("maintenance_rate"), F.col("_t.maintenance_amount").alias("maintenance_amount"))
