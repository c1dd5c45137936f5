"""Pair locks from closed trades.

Trades: trade_id, sequence (closing order), pair, is_short, close_ts, profit_abs, profit_ratio, exit_reason. A rule sees what was closed before the trade that triggers it
and that trade itself, not later trades of the same time, so look-back joins compare sequences and times on day buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.functions.timeframes import DAY_MS
from wickwork.session import stored

REQUEST = ("pair", "side", "ts", "until", "reason", "sequence", "is_global", "handler")


def _request(rows: DataFrame, pair: Column, side: Column, until: Column, reason: str, is_global: bool, handler: int) -> DataFrame:
    return rows.select(pair.alias("pair"), side.alias("side"), F.col("close_ts").alias("ts"), until.alias("until"), F.lit(reason).alias("reason"), "sequence", F.lit(is_global).alias("is_global"), F.lit(handler).alias("handler"))


def lock_end(until_from: Column, duration_ms: int | None, unlock_at: str | None = None) -> Column:
    """Duration after an instant, or the next HH:MM (UTC) after it."""
    if unlock_at is None:
        return until_from + duration_ms
    hour, minute = map(int, unlock_at.split(":"))
    today = until_from - F.pmod(until_from, F.lit(DAY_MS)) + (hour * 60 + minute) * 60_000
    return F.when(today > until_from, today).otherwise(today + DAY_MS)


def cooldown_requests(trades: DataFrame, duration_ms: int | None, unlock_at: str | None = None, handler: int = 0) -> DataFrame:
    """Every close locks its pair on both sides."""
    return _request(trades, F.col("pair"), F.lit("*"), lock_end(F.col("close_ts"), duration_ms, unlock_at), "cooldown", False, handler)


#: Closes a block of `emit_locks` holds.
BLOCK = 10_000


def _running(rows: DataFrame, keys: list[str], block: Column | None, order: list, sums: dict[str, Column], highs: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and maxima of each key: totals by block first, then inside each block. Blocks must rise with the order.

    No window holds more than a block's rows, or one row a block, so neither a key with very many rows nor all rows as one key end up in one task. The rows are evaluated
    twice. Without a block there is one window a key, which suits keys by pair. Sums of decimals keep eight places.
    """
    highs = highs or {}
    made = [*[(k, F.sum, c) for k, c in sums.items()], *[(k, F.max, c) for k, c in highs.items()]]
    kinds = dict(rows.select(*[c.alias(k) for k, c in sums.items()]).dtypes)
    exact = lambda k: F.coalesce(k, F.lit(0)).cast("decimal(28,8)" if kinds[k.lstrip("_")].startswith("decimal") else kinds[k.lstrip("_")])
    if block is None:
        of = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({k: f(c).over(of) for k, f, c in made}).withColumns({k: exact(k) for k in sums})
    out = rows.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = out.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b")).agg(*[f(c).alias(f"_{k}") for k, f, c in made])
    before = totals.select(*[f"_k_{k}" for k in keys], "_b", *[f(f"_{k}").over(earlier).alias(f"_{k}") for k, f, _ in made])
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = out.withColumns({k: f(c).over(inside) for k, f, c in made}).join(before, same, "left")
    both = both.withColumns({k: exact(k) + exact(f"_{k}") for k in sums} | {k: F.greatest(k, f"_{k}") for k in highs})
    return both.select(*rows.columns, *sums, *highs)


def _day(c: str, keys: list[str]) -> Column | None:
    """Days as blocks of what is not told apart by pair."""
    return None if "pair" in keys else F.floor(F.col(c) / DAY_MS)


def running_lookback(trades: DataFrame, lookback_ms: int, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Sums, over each trade's look-back, of measures by key, as running totals up to its sequence less those before the look-back.

    A look-back holds what closed strictly after its start: a question stands in the stream of closes there, after closes of the same time, and adds nothing to the totals.
    So no pair of trades is formed and the cost does not grow with the length of the look-back.
    """
    run = _running(trades.withColumns({f"_v_{k}": v for k, v in measures.items()}), keys, _day("close_ts", keys), ["sequence"], {f"r_{k}": F.col(f"_v_{k}") for k in measures})
    closes = run.select(*keys, F.col("close_ts").alias("_at"), F.lit(0).alias("_kind"), F.col("sequence").alias("_seq"), *[f"_v_{k}" for k in measures])
    asks = run.drop(*[f"_v_{k}" for k in measures]).withColumn("_at", F.col("close_ts") - lookback_ms).withColumn("_kind", F.lit(1)).withColumn("_seq", F.col("sequence"))
    both = asks.unionByName(closes, allowMissingColumns=True)
    carried = _running(both, keys, _day("_at", keys), ["_at", "_kind", "_seq"], {f"b_{k}": F.col(f"_v_{k}") for k in measures}).where("_kind = 1")
    return carried.select(*trades.columns, *[(F.col(f"r_{k}") - F.col(f"b_{k}")).alias(k) for k in measures])


def stoploss_requests(trades: DataFrame, lookback_ms: int, limit: int, duration_ms: int, required: float = 0.0, per_pair: bool = True, per_side: bool = False, handler: int = 1) -> DataFrame:
    """At least `limit` stop or liquidation losses in the look-back lock the pair or, if not per_pair, all pairs; the lock runs from the latest of these losses."""
    loss = F.col("exit_reason").isin("stop_loss", "trailing_stop_loss", "stoploss_on_exchange", "liquidation") & (F.col("profit_ratio") != 0) & (F.col("profit_ratio") < required)
    keys = [*["pair"] * per_pair, *["is_short"] * per_side]
    counted = running_lookback(trades, lookback_ms, keys, {"losses": loss.cast("long")})
    hit = _running(counted, keys, _day("close_ts", keys), ["sequence"], {}, {"latest": F.when(loss, F.col("close_ts"))}).where(F.col("losses") >= limit)
    side = F.when(F.col("is_short"), "short").otherwise("long") if per_side else F.lit("*")
    return _request(hit, F.col("pair") if per_pair else F.lit("*"), side, F.col("latest") + duration_ms, "stoploss_guard", not per_pair, handler)


def low_profit_requests(trades: DataFrame, lookback_ms: int, limit: int, duration_ms: int, required: float = 0.0, per_side: bool = False, handler: int = 2) -> DataFrame:
    """At least `limit` trades of the pair in the look-back, counted before the side filter, with a summed ratio below `required`."""
    ratio = F.round("profit_ratio", 8).cast("decimal(28,8)")
    counted = running_lookback(trades, lookback_ms, ["pair"], {"closed": F.lit(1).cast("long")})
    summed = running_lookback(trades, lookback_ms, ["pair", *["is_short"] * per_side], {"total": ratio}).select("sequence", "total")
    hit = counted.join(summed, "sequence").where((F.col("closed") >= limit) & (F.col("total") < required))
    side = F.when(F.col("is_short"), "short").otherwise("long") if per_side else F.lit("*")
    return _request(hit, F.col("pair"), side, F.col("close_ts") + duration_ms, "low_profit", False, handler)


#: Positions of a block of the curve, and blocks that make one of the next level.
BLOCK_POSITIONS, RADIX = 32, 4


def _fall(high: Column, low: Column, relative: bool) -> Column:
    """How far a curve falls from a high to a later low, at least 0."""
    if not relative:
        return F.greatest(high - low, F.lit(0.0))
    return F.when(high > 0, F.greatest((high - low) / high, F.lit(0.0))).when((high == 0) & (low < 0), F.lit(float("inf"))).otherwise(F.lit(0.0))


def _merged(parts: Column, relative: bool) -> Column:
    """high, low and worst fall of stretches of a curve in order (structs at, high, low, worst)."""

    def add(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["high"], x["high"]).alias("high"), F.least(s["low"], x["low"]).alias("low"), F.greatest(s["worst"], x["worst"], _fall(s["high"], x["low"], relative)).alias("worst"))

    empty = F.struct(F.lit(float("-inf")).alias("high"), F.lit(float("inf")).alias("low"), F.lit(0.0).alias("worst"))
    return F.aggregate(F.array_sort(parts), empty, add)


def worst_falls(points: DataFrame, spans: DataFrame, relative: bool) -> DataFrame:
    """Adds to spans (first, last, ...) the worst fall of the curve points (pos from 0 without gaps, value) between positions first and last, both included.

    The curve is cut into blocks of BLOCK_POSITIONS, and those are summed up in blocks of RADIX, RADIX^2, ... of them (high, low and worst fall). A span is the end of a block, whole blocks and the
    start of a block; what lies between two blocks is asked once for all spans that end in them, and covered by some 2 * RADIX blocks of each level at most. So a span whose neighbours begin and end
    near it costs two rows of the joins. spans need a column `id` of their own.
    """
    count = points.count()
    empty = F.struct(F.lit(float("-inf")).alias("high"), F.lit(float("inf")).alias("low"), F.lit(0.0).alias("worst"))

    def values_of(values: Column) -> Column:
        """high, low and worst fall of values in order."""

        def add(s: Column, v: Column) -> Column:
            return F.struct(F.greatest(s["high"], v).alias("high"), F.least(s["low"], v).alias("low"), F.greatest(s["worst"], _fall(F.greatest(s["high"], v), v, relative)).alias("worst"))

        return F.aggregate(values, empty, add)

    def joined(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(a["high"], b["high"]).alias("high"), F.least(a["low"], b["low"]).alias("low"), F.greatest(a["worst"], b["worst"], _fall(a["high"], b["low"], relative)).alias("worst"))

    block_of = lambda c: F.floor(F.col(c) / BLOCK_POSITIONS)
    cut = points.groupBy(block_of("pos").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("v"))
    cut = stored(cut.select("block", "v", values_of(F.col("v")).alias("m")), "curve-blocks")
    level = cut.select("block", "m.*")
    blocks, size, levels = level.withColumn("level", F.lit(0)), BLOCK_POSITIONS, 1
    while size * RADIX <= count:
        part = F.collect_list(F.struct(F.col("block").alias("at"), "high", "low", "worst"))
        level = stored(level.groupBy(F.floor(F.col("block") / RADIX).alias("block")).agg(_merged(part, relative).alias("m")).select("block", "m.*"), "curve-level")
        blocks, size, levels = blocks.unionByName(level.withColumn("level", F.lit(levels))), size * RADIX, levels + 1
    # what lies between: blocks _a + 1 to _b - 1
    spans_at = spans.withColumns({"_a": block_of("first"), "_b": block_of("last")})
    low = [F.ceil((F.col("_a") + 1) / RADIX**k).cast("long") for k in range(levels)]
    high = [F.floor(F.col("_b") / RADIX**k).cast("long") for k in range(levels)]

    def cover(k: int, start: Column, end: Column) -> Column:
        """Blocks of level k from start to before end."""
        some = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(some, lambda b: F.struct(F.lit(k).alias("level"), b.alias("block"), (b * RADIX**k).alias("at")))

    parts = []
    for k in range(levels):
        if k + 1 == levels:
            parts.append(cover(k, low[k], high[k]))
        else:  # what the next level covers is left to it
            inner = low[k + 1] < high[k + 1]
            parts += [cover(k, low[k], F.when(inner, low[k + 1] * RADIX).otherwise(high[k])), cover(k, F.when(inner, high[k + 1] * RADIX).otherwise(high[k]), high[k])]
    between = spans_at.where(F.col("_b") > F.col("_a") + 1).select("_a", "_b").distinct()
    asked = between.select("_a", "_b", F.explode(F.flatten(F.array(*parts))).alias("b")).select("_a", "_b", "b.*")
    between = asked.join(blocks, ["level", "block"]).groupBy("_a", "_b").agg(_merged(F.collect_list(F.struct("at", "high", "low", "worst")), relative).alias("_middle"))
    # the end of the first block, or all of a span inside one block
    head = spans_at.join(cut.select(F.col("block").alias("_a"), "v"), "_a")
    begin = (F.col("first") - F.col("_a") * BLOCK_POSITIONS).cast("int")
    size_of = F.when(F.col("_a") == F.col("_b"), (F.col("last") - F.col("first") + 1).cast("int")).otherwise(F.lit(BLOCK_POSITIONS))
    head = head.withColumn("_head", values_of(F.slice("v", begin + 1, size_of))).drop("v")
    both = head.join(between, ["_a", "_b"], "left").join(cut.select(F.col("block").alias("_b"), "v"), "_b")
    tail = values_of(F.slice("v", 1, (F.col("last") - F.col("_b") * BLOCK_POSITIONS + 1).cast("int")))
    both = both.withColumn("_tail", F.when(F.col("_a") == F.col("_b"), empty).otherwise(tail))
    whole = joined(joined(F.col("_head"), F.coalesce("_middle", empty)), F.col("_tail"))
    return both.withColumn("worst", whole["worst"]).select(*spans.columns, "worst")


def drawdown_requests(trades: DataFrame, lookback_ms: int, limit: int, duration_ms: int, allowed: float, start: float | None = None, handler: int = 3) -> DataFrame:
    """A drawdown of the look-back's trades above `allowed` locks all pairs; of summed ratios, or with `start` of the equity, relative to its high.

    The look-back begins at what was earned before it. Sums are exact to 8 places, so a look-back is a span of one curve over all trades (see worst_falls). Relative to a high, `allowed` must be below 1.
    """
    if start is not None and not allowed < 1:
        raise ValueError("a drawdown of the equity is a share of its high: allowed must be below 1")
    value = F.round("profit_ratio" if start is None else "profit_abs", 8).cast("decimal(28,8)")
    # each running total asks its rows twice and those before it again, so they are stored
    trades = stored(trades.select("close_ts", "sequence", value.alias("_value")), "closes")
    run = stored(_running(trades, [], _day("close_ts", []), ["sequence"], {"place": F.lit(1).cast("long"), "curve": F.col("_value")}), "curve")
    rows = stored(running_lookback(run, lookback_ms, [], {"closed": F.lit(1).cast("long")}), "lookbacks")
    base = float(start or 0.0)
    points = rows.select(F.col("place").alias("pos"), (F.col("curve").cast("double") + base).alias("value"))
    points = points.unionByName(trades.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit(base).alias("value")))
    spans = rows.where(F.col("closed") >= limit).select(F.col("place").alias("id"), (F.col("place") - F.col("closed")).alias("first"), F.col("place").alias("last"), "close_ts", "sequence")
    hit = worst_falls(points, spans, start is not None).where(F.col("worst") > allowed)
    return _request(hit, F.lit("*"), F.lit("*"), F.col("close_ts") + duration_ms, "max_drawdown", True, handler)


def emit_locks(requests: DataFrame, size_ms: int) -> DataFrame:
    """Locks that take effect: pair, side, lock_ts, lock_end, reason, sequence.

    The end is rounded up to the next candle, one more if it is on a boundary. A request is left out if a scope that covers it already ends later than its `until`. What
    ended later was emitted or was itself covered by something later still, so a running maximum over all earlier requests decides.
    """
    rows = stored(requests.select(*REQUEST), "requests").withColumn("lock_end", (F.floor(F.col("until") / size_ms) + 1) * size_ms)  # asked four times below
    order = [F.col("sequence"), F.col("is_global"), F.col("handler"), F.col("pair"), F.col("side")]
    # every request asks the scopes that cover it; every request also marks its own scope
    marks = rows.select(*REQUEST, "lock_end", F.col("pair").alias("s_pair"), F.col("side").alias("s_side"), F.lit(1).alias("is_mark"))
    pairs = F.when(F.col("pair") == "*", F.array(F.lit("*"))).otherwise(F.array("pair", F.lit("*")))
    sides = F.when(F.col("side") == "*", F.array(F.lit("*"))).otherwise(F.array("side", F.lit("*")))
    asks = rows.withColumn("s_pair", F.explode(pairs)).withColumn("s_side", F.explode(sides)).select(*REQUEST, "lock_end", "s_pair", "s_side", F.lit(0).alias("is_mark"))
    # an ask stands before its own mark and adds nothing, so the maximum up to it is that of earlier requests
    seen = _running(marks.unionByName(asks), ["s_pair", "s_side"], F.floor(F.col("sequence") / BLOCK), [*order, "is_mark"], {}, {"seen": F.when(F.col("is_mark") == 1, F.col("lock_end"))}).where("is_mark = 0")
    free = seen.groupBy(*REQUEST, "lock_end").agg(F.max("seen").alias("seen")).where(F.col("seen").isNull() | (F.col("seen") <= F.col("until")))
    return free.select("pair", "side", F.col("ts").alias("lock_ts"), "lock_end", "reason", "sequence")


def lock_identities(surface: DataFrame, state: DataFrame) -> DataFrame:
    """Distinct locks of two sources."""
    names = ["pair", "side", "lock_ts", "lock_end", "reason"]
    return surface.select(*names).unionByName(state.select(*names)).distinct()


def lock_identity_count(surface: DataFrame, state: DataFrame) -> DataFrame:
    return lock_identities(surface, state).agg(F.count("*").alias("locks"))


def sort_locks(locks: DataFrame) -> DataFrame:
    """Canonical order: start, end, pair, side, reason."""
    return locks.orderBy("lock_ts", "lock_end", "pair", "side", "reason")
