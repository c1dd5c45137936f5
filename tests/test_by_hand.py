"""Small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from wickwork.functions import economics as eco
from wickwork.functions import scalars
from wickwork.functions.timeframes import parse_timerange, timeframe_ms
from wickwork.operators import candles, compare, joins, locks, runs, signals, trades, universe
from wickwork.plans import strategies
from wickwork.sources import exports, files

H = 3_600_000


def candle_rows(spark, rows):
    return spark.createDataFrame([(p, t * H, float(o), float(h), float(lo), float(c), float(v)) for p, t, o, h, lo, c, v in rows], "pair string, ts long, open double, high double, low double, close double, volume double")


def one(df):
    return df.collect()[0].asDict()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_timeframes():
    assert timeframe_ms("5m") == 300_000 and timeframe_ms("1M") == 30 * 86_400_000
    with pytest.raises(ValueError):
        timeframe_ms("5x")
    assert parse_timerange("20240101-20240102") == (1_704_067_200_000, 1_704_153_600_000)
    assert parse_timerange("1704067200-") == (1_704_067_200_000, None)
    with pytest.raises(ValueError):
        parse_timerange("20240102-20240101")


def test_duplicates_and_gap(spark):
    rows = [("a", 0, 1, 2, 1, 2, 5, 0), ("a", 0, 9, 9, 1, 3, 4, 1), ("a", 2, 5, 6, 4, 5, 1, 2)]
    df = spark.createDataFrame([(p, t * H, float(o), float(h), float(lo), float(c), float(v), s) for p, t, o, h, lo, c, v, s in rows], "pair string, ts long, open double, high double, low double, close double, volume double, seq long")
    out = [tuple(r) for r in candles.clean_candles(df, "1h").orderBy("ts").collect()]
    assert out == [("a", 0, 1.0, 9.0, 1.0, 3.0, 5.0), ("a", H, 3.0, 3.0, 3.0, 3.0, 0.0), ("a", 2 * H, 5.0, 6.0, 4.0, 5.0, 1.0)]
    assert one(candles.quality(df, H)) == {"pair": "a", "duplicates": 1, "reversals": 0, "gaps": 1, "missing": 1, "max_gap": 2 * H}
    assert one(candles.dedup_keep_last(df).where("ts = 0"))["close"] == 3.0


def test_empty_candles(spark):
    empty = candle_rows(spark, []).withColumn("seq", F.lit(0).cast("long"))
    assert candles.clean_candles(empty, "1h").count() == 0
    assert candles.validate_candles(empty).count() == 0
    assert joins.coverage_gaps(empty, ["a"], H, 0, H).first()["accepted"] is False
    assert trades.max_concurrency(spark.createDataFrame([], "trade_id long, open_ts long, close_ts long, stake_amount double, profit_abs double")).first()[0] == 0


def test_validation(spark):
    df = candle_rows(spark, [("a", 0, 1, 2, 1, 1, 0), ("a", 1, 1, 1, 2, 1, 0), ("b", 0, 1, 2, 1, 1, -1), ("c", 0, math.nan, 2, 1, 1, 1)])
    found = {r["pair"]: (r["row"], r["code"]) for r in candles.validate_candles(df).collect()}
    assert found == {"a": (1, "high_below_low"), "b": (0, "negative_volume"), "c": (0, "not_finite")}
    funded = df.withColumn("funding_rate", F.lit(0.1)).withColumn("mark_price", F.lit(None).cast("double"))
    assert {r["code"] for r in candles.validate_candles(funded.where("pair = 'a'")).collect()} == {"half_funding"}


def test_price_digits(spark):
    df = candle_rows(spark, [("a", 0, 1.25, 2, 1, 1, 0), ("a", 24 * 40, 1.5, 2, 1, 1, 0), ("a", 24 * 70, 7, 7, 7, 7, 0)])
    monthly = candles.monthly_price_digits(df)
    assert [(r["month"], r["digits"]) for r in monthly.orderBy("month").collect()] == [("1970-01", 2), ("1970-02", 1)]
    assert candles.step_changes(monthly).count() == 2


def test_shift_and_tags(spark):
    df = candle_rows(spark, [("a", k, 1, 1, 1, 1, 1) for k in range(3)]).withColumn("enter_long", F.when(F.col("ts") == 0, 1.0).otherwise(float("nan"))).withColumn("enter_tag", F.when(F.col("ts") == 0, "x").otherwise(signals.EMPTY_MARKER))
    out = [(r["exec_enter_long"], r["exec_enter_tag"], r["exec_exit_short"]) for r in signals.shift_signals(df).orderBy("ts").collect()]
    assert out == [(0, None, 0), (1, "x", 0), (0, None, 0)]
    scope = [(r["supported"], r["unknown_words"]) for r in signals.tag_scope(spark.createDataFrame([("1 2",), ("1 9",), ("",), (None,)], "enter_tag string"), ["1", "2"]).collect()]
    assert scope == [(True, ""), (False, "9"), (False, ""), (False, "")]


def test_informative_row_is_carried_whole(spark):
    base = candle_rows(spark, [("a", k, 1, 1, 1, 1, 1) for k in range(6)])
    coarse = spark.createDataFrame([("a", 0, 10.0, 1.0), ("a", 2 * H, None, 2.0)], "pair string, ts long, rsi double, ema double")
    out = joins.merge_informative(base, coarse, "1h", "2h", ffill=True).orderBy("ts").select("rsi_2h", "ema_2h").collect()
    assert [tuple(r) for r in out] == [(None, None), (10.0, 1.0), (10.0, 1.0), (None, 2.0), (None, 2.0), (None, 2.0)]
    with pytest.raises(ValueError):
        joins.merge_informative(base, coarse, "2h", "1h")


def test_first_barrier_priority(spark):
    c = candle_rows(spark, [("a", 0, 100, 100, 100, 100, 1), ("a", 1, 100, 101, 80, 90, 1), ("a", 2, 95, 95, 95, 95, 1)]).withColumn("exit_long", (F.col("ts") == H).cast("int")).withColumn("exit_short", F.lit(0))
    e = spark.createDataFrame([("t", "a", 0, 100.0, False), ("s", "a", 0, 100.0, True), ("late", "a", 2 * H, 95.0, False)], "trade_id string, pair string, open_ts long, open_rate double, is_short boolean")
    out = {r["trade_id"]: (r["exit_ts"], r["exit_reason"], r["exit_rate"]) for r in joins.first_barrier(e, c, 0.1, 10 * H).collect()}
    assert out == {"t": (H, "exit_signal", 100.0), "s": (2 * H, "force_exit", 95.0), "late": (2 * H, "force_exit", 95.0)}
    stopped = {r["trade_id"]: (r["exit_reason"], r["exit_rate"]) for r in joins.first_barrier(e, c.withColumn("exit_long", F.lit(0)), 0.1, 10 * H).collect()}
    assert stopped["t"] == ("stop_loss", 90.0)


def orders(spark, rows):
    return spark.createDataFrame([(1, k, e, float(a), float(p), k * H, t) for k, (e, a, p, t) in enumerate(rows)], "trade_id long, sequence int, is_entry boolean, amount double, price double, ts long, tag string")


def test_partial_exit_profit(spark):
    o = orders(spark, [(True, 2, 100, ""), (False, 1, 110, ""), (True, 1, 130, ""), (False, 2, 120, "")])
    heads = spark.createDataFrame([(1, False, 0.001, 0.001)], "trade_id long, is_short boolean, fee_open double, fee_close double")
    out = one(trades.realized_profit(o, heads))
    first = 110 * 0.999 - 100 * 1.001
    second = 2 * 120 * 0.999 - 2 * 115 * 1.001
    assert out["profit"] == pytest.approx(round(first, 8) + round(second, 8))
    assert out["entry_value"] == pytest.approx((200 + 130) * 1.001)
    state = one(trades.position_state(o.where("sequence < 3")))
    assert (state["amount"], state["average"], state["stake"], state["max_stake"], state["error"]) == (2.0, 115.0, 230.0, 330.0, None)  # entries add up, exits do not lower the top


def test_orders_that_cannot_be_filled(spark):
    heads = spark.createDataFrame([(1, False, 0.0, 0.0, 2.0)], "trade_id long, is_short boolean, fee_open double, fee_close double, leverage double")
    for bad, code in (((True, 0, 100, ""), "amount"), ((True, 1, -5, ""), "price"), ((False, 3, 100, ""), "holding")):
        o = orders(spark, [(True, 2, 100, ""), bad, (False, 1, 120, "")])
        state, profit = one(trades.position_state(o, heads)), one(trades.realized_profit(o, heads))
        assert (state["amount"], state["stake"], state["max_stake"], state["error"]) == (2.0, 100.0, 100.0, code)
        assert (profit["profit"], profit["error"]) == (0.0, code)
    stepped = one(trades.position_state(orders(spark, [(True, 1.27, 100.26, "")]), heads, 0.1, 0.5))
    assert (stepped["amount"], stepped["average"]) == (1.2, 100.5)  # steps come last: the average is that of the order
    assert stepped["stake"] == pytest.approx(1.27 * 100.26 / 2, abs=1e-12)


def test_steps_come_once_after_all_orders(spark):
    two = one(trades.position_state(orders(spark, [(True, 0.6, 10, ""), (True, 0.6, 10, "")]), amount_step=1.0))
    assert (two["amount"], two["average"], two["stake"]) == (1.0, 10.0, 12.0)
    four = one(trades.position_state(orders(spark, [(True, 1, 100.1, ""), (True, 1, 100.2, ""), (True, 1, 100.62, ""), (True, 1, 100.8, "")]), price_step=0.5))
    assert (four["average"], round(four["stake"], 9)) == (100.5, 401.72)


def test_replay_of_any_size(spark):
    """Amounts from 1e-18 to 1e15 and beyond, exact; what is closed has no state; what is not finite is an error."""
    for size in (1e-18, 1e-10, 1e12, 1e15, 1e200):
        s = one(trades.position_state(orders(spark, [(True, 3 * size, 2.5, ""), (False, size, 7.0, ""), (True, size, 2.5, "")])))
        assert (s["error"], s["average"]) == (None, 2.5) and s["amount"] == pytest.approx(3 * size, rel=1e-15) and s["max_stake"] == pytest.approx(10 * size, rel=1e-15)
    closed = one(trades.position_state(orders(spark, [(True, 1e-9, 3.0, ""), (False, 1e-9, 4.0, "")])))
    assert (closed["amount"], closed["stake"], closed["average"], closed["error"]) == (None, None, None, "closed")
    bad = one(trades.position_state(orders(spark, [(True, float("nan"), 3.0, "")])))
    assert bad["error"] == "amount"
    heads = spark.createDataFrame([(1, False, 0.001, 0.001)], "trade_id long, is_short boolean, fee_open double, fee_close double")
    tiny = one(trades.realized_profit(orders(spark, [(True, 1e12, 1e-9, ""), (False, 1e12, 3e-9, "")]), heads))
    assert tiny["profit"] == pytest.approx(3000 * 0.999 - 1000 * 1.001, abs=1e-8)


def test_small_ticks(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    f = lambda x: F.lit(float(x))
    assert v(eco.quantize_step(f(1.23e-7), f(1e-10), "floor")) == 1.23e-7
    for x, step, how, want in ((8.45, 0.01, "floor", 8.45), (0.4599999999999991, 0.01, "floor", 0.45), (0.044361, 0.0001, "ceil", 0.0444), (20.56249, 0.0001, "round", 20.5625), (100.0000000003, 1, "ceil", 101.0), (5e15, 0.5, "ceil", 5e15), (-0.25, 0.1, "floor", -0.3), (3.3, 0, "floor", 3.3)):
        assert v(eco.quantize_step(f(x), f(step), how)) == want
    assert v(eco.entry_amount(f(100), f(1), f(1.23456789e-6), f(1))) == 81_000_000.0
    assert v(eco.entry_amount(f(100), f(1), f(5e-10), f(1))) == 2e11
    assert v(eco.partial_exit_amount(f(1e-7), f(5e-7), f(2e-7), f(1e-10))) == 2.5e-7
    assert v(eco.entry_amount(f(100), f(1), f(0), f(1))) is None


def test_timeout_after_a_hole(spark):
    """The pair has no candle for three days after the timeout; the first one after the hole closes the trade."""
    c = candle_rows(spark, [("a", 0, 100, 100, 100, 100, 1), ("a", 1, 100, 101, 99, 100, 1), ("a", 96, 97, 98, 96, 97, 1), ("a", 99, 50, 50, 50, 50, 1)]).withColumns({"exit_long": F.lit(0), "exit_short": F.lit(0)})
    e = spark.createDataFrame([("t", "a", 0, 100.0, False)], "trade_id string, pair string, open_ts long, open_rate double, is_short boolean")
    out = one(joins.first_barrier(e, c, 0.5, 10 * H))
    assert (out["exit_ts"], out["exit_reason"], out["exit_rate"]) == (96 * H, "timeout", 97.0)


def test_repeated_rows_keep_their_tiers(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", None), ("c", 5.0)], "pair string, stake double")
    tiers = spark.createDataFrame([("a", 0, 0.0, 100.0, 20.0, 0.01, 0.0), ("a", 1, 100.0, 900.0, 5.0, 0.05, 1.0), ("b", 0, 0.0, 100.0, 3.0, 0.02, 0.0)], "pair string, tier_no int, min_notional double, max_notional double, max_leverage double, maintenance_rate double, maintenance_amount double")
    assert sorted((r["pair"], r["max_leverage"]) for r in joins.tier_cap(df, tiers).collect()) == [("a", 20.0), ("a", 20.0), ("b", None), ("c", None)]
    assert sorted((r["pair"], r["maintenance_rate"]) for r in joins.maintenance_tier(df, tiers).collect()) == [("a", 0.01), ("a", 0.01), ("b", None), ("c", None)]


def test_signal_digest_of_many_rows(spark):
    df = spark.range(200_000).select(F.lit("a").alias("pair"), F.col("id").alias("ts"), F.lit(1).alias("enter_long"), *[F.lit(0).alias(c) for c in ("enter_short", "exit_long", "exit_short")], F.lit(None).cast("string").alias("enter_tag"), F.lit(None).cast("string").alias("exit_tag"))
    out = one(signals.signal_rows(df))
    assert out["signal_rows"] == 200_000 and 0 <= out["digest"] < 1 << 48


def test_canonical_decimals_keep_every_digit(spark):
    texts = {"0.1234567890123456781": "0.1234567890123456781", "123456789012345678901": "123456789012345678901", "1e30": "1" + "0" * 30, "-0.0": "0", "-12.50": "-12.5", "1.5e-3": "0.0015", ".5": "0.5", "007.": "7", "nan": None, "": None, "-1e2": "-100", "12345e-2": "123.45"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["c"] for r in df.withColumn("c", compare.canonical_decimal(F.col("t"))).collect()} == texts


def test_a_present_null_tag_wins(spark, tmp_path):
    import json

    row = {"pair": "A/B", "is_short": False, "open_timestamp": 1, "close_timestamp": 2, "amount": 1, "orders": []}
    made = [row | {"enter_tag": None, "buy_tag": "old"}, row | {"buy_tag": "old"}, row | {"enter_tag": "new", "buy_tag": "old"}]
    (tmp_path / "x.json").write_text(json.dumps({"strategy": {"S": {"trades": made, "locks": []}}}))
    t = exports.normalize_trades(exports.read_backtest_export(spark, str(tmp_path))[0])[0].orderBy("sequence").collect()
    assert [r["entry_tag"] for r in t] == [None, "old", "new"]


def test_leveraged_funding_goes_to_the_next_exit(spark):
    o = orders(spark, [(True, 2, 100, ""), (False, 1, 90, ""), (False, 1, 80, "")])
    heads = spark.createDataFrame([(1, True, 0.0, 0.0)], "trade_id long, is_short boolean, fee_open double, fee_close double")
    funding = spark.createDataFrame([(1, 1, 0.5), (1, 2, -0.25)], "trade_id long, sequence int, funding_fee double")
    assert one(trades.realized_profit(o, heads, funding))["profit"] == pytest.approx(10 + 0.5 + 20 - 0.25)


def test_stop_example():
    """A long of 0.00106 at 93740, stopped 0.5 % lower, with fees of 0.1 % on both sides."""
    amount, opened, closed, fee = 0.00106, 93740, 93271.3, 0.001
    paid = amount * opened * (1 + fee)
    profit = amount * closed * (1 - fee) - paid
    assert round(profit, 8) == -0.69505398 and profit / paid == pytest.approx(-0.006988012, abs=1e-9)


def test_open_clusters(spark):
    o = orders(spark, [(True, 1, 10, "grind_1_entry"), (True, 1, 9, "grind_1_entry"), (False, 1, 11, "grind_1_exit 1"), (True, 2, 8, "grind_1_entry"), (True, 3, 7, "grind_2_entry")])
    out = {r["level"]: (r["entries"], r["amount"], r["cost"], r["ids"], r["exit_price"]) for r in trades.open_clusters(o).collect()}
    assert out == {1: (1, 2.0, 16.0, [3], 11.0), 2: (1, 3.0, 21.0, [4], None)}


def test_lock_emission(spark):
    t = spark.createDataFrame([(1, 0, "a", False, 10, -1.0, -0.1, "stop_loss"), (2, 1, "a", False, 20, -1.0, -0.1, "stop_loss"), (3, 2, "b", False, 20, 1.0, 0.1, "roi")], "trade_id long, sequence long, pair string, is_short boolean, close_ts long, profit_abs double, profit_ratio double, exit_reason string")
    cool = locks.emit_locks(locks.cooldown_requests(t, 100), 60)
    # the end of the first lock, 120, is not past the second request's until, 120, so both are emitted; ends on a boundary get one candle more
    assert sorted((r["pair"], r["lock_end"]) for r in cool.collect()) == [("a", 120), ("a", 180), ("b", 180)]
    guard = locks.stoploss_requests(t, 15, 2, 100, per_pair=False)
    assert [(r["pair"], r["until"], r["sequence"]) for r in guard.orderBy("sequence").collect()] == [("*", 120, 1), ("*", 120, 2)]


def test_lock_emission_against_sequential_rule(spark, monkeypatch):
    import random

    monkeypatch.setattr(locks, "BLOCK", 16)  # many blocks, so that what earlier blocks hold is carried
    rng = random.Random(5)
    rows, active, want = [], [], []
    for k in range(300):
        is_global = rng.random() < 0.2
        r = ("*" if is_global else rng.choice("ab"), rng.choice(["*", "long", "short"]), k, k + rng.randint(1, 40), "r", k, is_global, 0)
        rows.append(r)
        pairs, sides = {r[0], "*"}, {r[1], "*"}
        if not any(p in pairs and s in sides and e > r[3] for p, s, e in active):
            end = (r[3] // 10 + 1) * 10
            active.append((r[0], r[1], end))
            want.append((r[5], end))
    df = spark.createDataFrame(rows, "pair string, side string, ts long, until long, reason string, sequence long, is_global boolean, handler int")
    assert sorted((r["sequence"], r["lock_end"]) for r in locks.emit_locks(df, 10).collect()) == want


def test_guard_over_all_pairs_against_brute_force(spark):
    import random

    rng, day = random.Random(8), 86_400_000
    times = sorted(rng.randrange(6 * day) for _ in range(150))
    rows = [(k, k, rng.choice(["a", "b", None]), rng.random() < 0.5, t, -1.0, rng.choice([-0.5, 0.1]), rng.choice(["stop_loss", "roi"])) for k, t in enumerate(times)]
    t = spark.createDataFrame(rows, "trade_id long, sequence long, pair string, is_short boolean, close_ts long, profit_abs double, profit_ratio double, exit_reason string")
    for per_pair in (False, True):
        want = []
        for r in rows:
            lost = [x[4] for x in rows if x[1] <= r[1] and x[4] >= r[4] - 2 * day and x[7] == "stop_loss" and x[6] < 0 and (x[2] == r[2] or not per_pair)]
            if len(lost) >= 3:
                want.append((r[1], max(lost) + 100))
        got = locks.stoploss_requests(t, 2 * day, 3, 100, per_pair=per_pair)
        assert sorted((r["sequence"], r["until"]) for r in got.collect()) == want and want


def test_economics(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(eco.quantize_step(lit(0.29), lit(0.1), "floor")) == 0.2 and v(eco.quantize_step(lit(0.21), lit(0.1), "ceil")) == 0.3 and v(eco.quantize_step(lit(0.25), lit(0.1), "round")) == 0.3
    assert v(eco.quantize_step(lit(0.3), lit(0.1), "ceil")) == 0.3
    assert v(eco.available_stake(lit(50.0), lit(100.0), 0.5)) == 25.0
    assert v(eco.proposed_stake(lit(80.0), lit(20.0), lit(5), lit(None).cast("double"))) == 20.0
    assert v(eco.profit_bucket(lit(0.0005))) is None and v(eco.profit_bucket(lit(0.005))) == 0 and v(eco.profit_bucket(lit(0.07))) == 7 and v(eco.profit_bucket(lit(0.5))) == 12
    assert v(eco.order_side(lit(True), lit(True))) == "sell" and v(eco.order_side(lit(False), lit(True))) == "buy"
    assert v(eco.partial_exit_request(lit(90.0), lit(100.0), lit(20.0), lit(1.0), lit(100.0), lit(1.0), lit(100.0))) == 69.0
    assert v(eco.partial_exit_amount(lit(200.0), lit(1.0), lit(100.0), lit(0.1))) is None
    assert v(eco.tag_with_ids("gd1", F.array(lit(1), lit(3), lit(2)))) == "gd1 3 2 1"


def test_scalars(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(scalars.modulo(lit(-7), lit(3))) == 2 and v(scalars.floor_divide(lit(-7), lit(2))) == -4 and v(scalars.modulo(lit(1), lit(0))) is None
    assert v(scalars.item(F.array(lit(1), lit(2)), lit(-1))) == 2 and v(scalars.item(F.array(lit(1)), lit(4))) is None
    assert tuple(v(scalars.partition(lit("a=b=c"), "="))) == ("a", "=", "b=c")
    canonical = lambda t: v(compare.canonical_decimal(lit(t)))
    assert [canonical(t) for t in ("1.50", "-0.0", "1e3", "0.00000001", "nan", "12")] == ["1.5", "0", "1000", "0.00000001", None, "12"]
    ts = v(scalars.canonical_timestamp(lit(1_704_067_200_000), lit("2024-01-01 00:00:00")))
    assert ts["ts"] == 1_704_067_200_000 and ts["error"] is None
    assert v(scalars.canonical_timestamp(lit(1), lit("2024-01-01T00:00:00Z")))["error"] == "disagree"
    assert v(scalars.protection_timing(lit(None).cast("int"), lit(None).cast("int"), lit(None).cast("string"), 300_000))["duration_ms"] == 3_600_000


def test_first_difference(spark):
    a = spark.createDataFrame([(0, "x", 1.0), (1, "y", 2.0), (2, None, 3.0)], "sequence long, pair string, amount double")
    b = spark.createDataFrame([(0, "x", 1.0), (1, "y", 2.0), (2, "z", 4.0)], "sequence long, pair string, amount double")
    assert one(compare.surface_diff(a, b)) == {"path": "$.trades[2].pair", "expected": "null", "actual": "z", "expected_type": "NoneType", "actual_type": "str", "reason": "type"}
    assert compare.surface_diff(a, a).count() == 0
    short = one(compare.surface_diff(a, a.where("sequence < 1")))
    assert (short["path"], short["expected"], short["actual"], short["reason"]) == ("$.trades.length", "3", "1", "length")
    assert one(compare.surface_diff(a.where("sequence < 2"), b))["reason"] == "length"
    assert one(compare.surface_diff(a, b.where("sequence < 2")))["path"] == "$.trades.length"
    assert one(compare.confirmation_report(a, a))["equal"] is True
    # another type of an equal value, a column that one side lacks
    assert one(compare.surface_diff(a, a.withColumn("amount", F.col("amount").cast("string"))))["reason"] == "type"
    extra = one(compare.surface_diff(a, a.withColumn("more", F.lit(1))))
    assert (extra["path"], extra["reason"]) == ("$.trades[0].more", "unexpected")
    assert one(compare.surface_diff(a, a.drop("pair")))["reason"] == "missing"
    assert one(compare.confirmation_report(a, a.withColumn("more", F.lit(1))))["equal"] is False


def walked(a, b, path=""):
    """All differences of two JSON values in the order of a reader."""
    if type(a) is not type(b):
        return [(path, "type")]
    if isinstance(a, dict):
        out = []
        for k in a:
            out += walked(a[k], b[k], f"{path}.{k}") if k in b else [(f"{path}.{k}", "missing")]
        return out + [(f"{path}.{k}", "unexpected") for k in b if k not in a]
    if isinstance(a, list):
        out = [d for i, (x, y) in enumerate(zip(a, b)) for d in walked(x, y, f"{path}[{i}]")]
        return out + [(f"{path}.length", "length")] * (len(a) != len(b))
    return [(path, "value")] * (a != b)


def test_differences_at_every_depth(spark):
    import json
    import random

    rng = random.Random(4)

    def value(depth):
        kind = rng.choice("idlsfnb" if depth else "d")
        if kind == "d" and depth < 4:
            return {k: value(depth + 1) for k in rng.sample("zyxab", rng.randint(0, 4))}
        if kind == "l" and depth < 4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {"i": rng.randint(0, 2), "s": rng.choice("ab"), "f": rng.choice([1.0, 2.5]), "n": None, "b": True}.get(kind, 0)

    def changed(x):
        if rng.random() < 0.15:
            return value(1)
        if isinstance(x, dict):
            items = [(k, changed(v)) for k, v in x.items() if rng.random() > 0.1]
            rng.shuffle(items)
            return dict(items) | ({"new": 1} if rng.random() < 0.1 else {})
        return [changed(v) for v in x] if isinstance(x, list) else x

    pairs = [(k, a, changed(a)) for k, a in enumerate(value(0) for _ in range(120))]
    rows = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in pairs], "key long, expected string, actual string")
    found = compare.document_differences(rows).orderBy("key", "ord").collect()
    for k, a, b in pairs:
        assert [(r["path"], r["reason"]) for r in found if r["key"] == k] == walked(a, b)


def test_event_streams(spark):
    e = spark.createDataFrame([(k, k, "p", "a", "c", f'{{"wallet":{{"free":"{1000 - k}"}}}}') for k in range(4)], "sequence long, ts long, phase string, pair string, callback string, state string")
    a = compare.hashed_events(e)
    b = compare.hashed_events(e.withColumn("state", F.when(F.col("sequence") >= 2, F.lit('{"wallet":{"free":"9"}}')).otherwise(F.col("state"))))
    assert compare.trace_diff(a, a).count() == 0
    assert one(compare.trace_diff(a, b)) == {"sequence": 2, "path": "$.state.wallet.free", "expected": "998", "actual": "9", "reason": "value"}
    assert one(compare.trace_diff(a.drop("state"), b.drop("state")))["path"] == "$.event_hash"
    short = one(compare.trace_diff(a, a.where("sequence < 3")))
    assert (short["sequence"], short["path"], short["expected"], short["actual"]) == (3, "$.events.length", "4", "3")
    assert one(compare.trace_diff(a, a.withColumn("phase", F.lit("q"))))["path"] == "$.event_key.phase"
    assert one(compare.trace_diff(a, b, {"mode": "spot"}, {"mode": "futures"}))["path"] == "$.header.mode"
    assert compare.trace_diff(a, a, {"mode": "spot"}, {"mode": "spot"}).count() == 0


def test_mismatch_report(spark):
    a = spark.createDataFrame([(k, "x", 10 * k) for k in range(3)], "sequence long, pair string, close_ts long")
    c = spark.createDataFrame([(p, t) for t in range(0, 60, 5) for p in ("x", "y")], "pair string, ts long")
    b = a.withColumn("close_ts", F.when(F.col("sequence") == 1, F.lit(15)).otherwise(F.col("close_ts")))
    r = one(compare.mismatch_report(a, b, c))
    assert (r["cutoff"], r["replay_candles"], r["replay_pairs"]) == (15, 8, 2)
    assert (r["expected_fragment"], r["actual_fragment"]) == ('{"pair":"x","close_ts":10}', '{"pair":"x","close_ts":15}')
    gone = one(compare.mismatch_report(a, a.where("sequence < 2"), c))
    assert (gone["cutoff"], gone["path"], gone["actual_fragment"]) == (20, "$.trades.length", '{"missing":true}')
    same = one(compare.mismatch_report(a, a, c))
    assert (same["cutoff"], same["expected_fragment"], same["equal"]) == (55, None, True)
    event = spark.createDataFrame([(5,)], "ts long")
    assert one(compare.mismatch_report(a, b, c, state_difference=event))["cutoff"] == 5


def test_events(spark):
    e = spark.createDataFrame([(0, 1, "p", "a", "c", "{}"), (1, 2, "p", "a", "c", "{}")], "sequence long, ts long, phase string, pair string, callback string, state string")
    h = compare.hashed_events(e)
    assert compare.validate_events(h, 2).count() == 0
    assert one(compare.validate_events(h, 3)) == {"sequence": 2, "code": "count"}
    assert one(compare.validate_events(h.where("sequence = 1")))["code"] == "sequence"


def test_profile_and_names(spark):
    p = spark.createDataFrame([("indicators", 1, 2.0, 1.0), ("x", 1, 1.0, 1.0), ("callbacks", 1, 1.0, 2.0), ("callbacks", 0, 1.0, 0.0), ("callbacks", -1, 1.0, 0.0)], "phase string, calls long, total double, longest double")
    assert [r["error"] for r in runs.profile_errors(p).collect()] == [None, "phase", "longest_above_total", "time_without_calls", "negative"]
    with pytest.raises(ValueError):
        runs.list_runs(p, 0)
    n = spark.createDataFrame([("A/B",), ("A",), ("A/B:C",), ("C/D",), ("C/D",)], "pair string")
    assert sorted((r["pair"], r["error"] or "") for r in universe.validate_pairlist(n).collect()) == [("A", "name"), ("A/B", ""), ("A/B:C", "spot"), ("C/D", "duplicate"), ("C/D", "duplicate")]


def test_lookahead_scan_finds_nothing_in_a_sound_strategy(spark):
    df = candle_rows(spark, [("a", k, 1 + k % 3, 5, 1, 2 - k % 2, 1) for k in range(20)])
    assert strategies.scan_lookahead(df, candles.pattern_entry, [5 * H, 11 * H], ["enter_long"]).count() == 0


def test_export_in_a_zip(spark, tmp_path):
    import zipfile

    body = '{"strategy": {"S": {"trades": [{"pair": "A/B", "is_short": false, "open_timestamp": 1, "close_timestamp": 2, "amount": 1.50, "buy_tag": "t", "exit_reason": "roi", "orders": []}], "locks": []}}}'
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.json", body)
        z.writestr("r_config.json", "{}")
    t, o, k = exports.normalize_trades(exports.read_backtest_export(spark, str(tmp_path))[0])
    row = one(t)
    assert (row["amount"], row["entry_tag"], row["is_short"], row["error"]) == ("1.5", "t", False, None)
    assert o.count() == 0 and k.count() == 0


def test_dataset_digest_of_no_files_and_in_any_order(spark):
    from wickwork.operators.universe import dataset_digest

    kind = "path string, bytes long, sha256 string, rows long, first_ts long, last_ts long"
    rows = [("b", 2, "y", None, None, None), ("a", 1, "x", 5, 1, 9), ("a", 1, "x", 5, 1, 9)]
    first, second = (one(dataset_digest(spark.createDataFrame(x, kind))) for x in (rows, rows[::-1]))
    assert first == second and (first["files"], first["bytes"]) == (3, 4)
    assert one(dataset_digest(spark.createDataFrame([], kind)))["files"] == 0
    assert one(dataset_digest(spark.createDataFrame(rows[:2], kind)))["digest"] != first["digest"]


def closed(spark, rows):
    """rows: (pair, is_short, close day, profit_abs, profit_ratio, exit_reason), in closing order."""
    kind = "trade_id long, pair string, is_short boolean, close_ts long, profit_abs double, profit_ratio double, exit_reason string, sequence long"
    return spark.createDataFrame([(k, p, sh, int(day * 24 * H), float(a), float(r), e, k) for k, (p, sh, day, a, r, e) in enumerate(rows)], kind)


def test_a_lookback_begins_after_its_cutoff(spark):
    t = closed(spark, [("a", False, 0, -1, -0.5, "stop_loss"), ("a", False, 10, -1, -0.5, "stop_loss")])
    day = 24 * H
    seen = locks.running_lookback(t, 10 * day, ["pair"], {"n": F.lit(1).cast("long")}).select("sequence", "n").collect()
    assert sorted(tuple(r) for r in seen) == [(0, 1), (1, 1)]
    assert locks.stoploss_requests(t, 10 * day, 2, H).count() == 0 and locks.stoploss_requests(t, 10 * day + 1, 2, H).count() == 1
    assert locks.low_profit_requests(t, 10 * day, 2, H).count() == 0 and locks.low_profit_requests(t, 10 * day + 1, 2, H).count() == 1
    assert locks.drawdown_requests(t, 10 * day, 2, H, 0.6).count() == 0 and locks.drawdown_requests(t, 10 * day + 1, 2, H, 0.6).count() == 1
    with pytest.raises(ValueError):
        locks.drawdown_requests(t, day, 1, H, 1.0, 100.0)


def test_losses_of_a_stoploss_guard(spark):
    """Stops on the exchange count; a trade without a ratio does not, whatever it lost."""
    t = closed(spark, [("a", False, 0, -1, -0.5, "stoploss_on_exchange"), ("a", False, 1, 0, -0.5, "liquidation"), ("a", False, 2, -1, 0, "stop_loss"), ("a", False, 3, -1, -0.5, "exit_signal")])
    assert one(locks.stoploss_requests(t, 24 * H * 30, 2, H).where("sequence = 1"))["until"] == 25 * H
    assert locks.stoploss_requests(t, 24 * H * 30, 3, H).count() == 0


@pytest.mark.parametrize("start", [None, 20.0, 0.0])
def test_drawdown_of_lookbacks_by_blocks(spark, start):
    import random

    rng = random.Random(5)
    rows = sorted(((rng.choice("ab"), False, rng.randint(0, 60) / 2, rng.choice([-3, -1, 0, 2, 4]), rng.choice([-0.3, -0.1, 0.2]), "x") for _ in range(180)), key=lambda r: r[2])
    back, limit, allowed = 24 * H * 4, 3, 0.35 if start is None else 0.1
    want = set()
    for i, r in enumerate(rows):
        now = int(r[2] * 24 * H)
        inside = [q for q in rows[: i + 1] if now - back < int(q[2] * 24 * H)]
        base = 0.0 if start is None else start + sum(q[3] for q in rows if int(q[2] * 24 * H) <= now - back)
        total, high, worst = 0.0, 0.0, 0.0
        for q in inside:
            total += q[4] if start is None else q[3]
            high = max(high, total)
            top = base + high
            fall = high - total if start is None else (top - (base + total)) / top if top else (float("inf") if base + total < 0 else 0.0)
            worst = max(worst, round(fall, 9))
        if len(inside) >= limit and worst > allowed:
            want.add(i)
    got = {r["sequence"] for r in locks.drawdown_requests(closed(spark, rows), back, limit, H, allowed, start).collect()}
    assert got == want and (got or start == 0.0)


def test_blocks_of_a_span_are_few(spark):
    """Some 2 * RADIX blocks a level and span, not one row for every trade of a look-back."""
    n = 3000
    points = spark.range(n + 1).select(F.col("id").alias("pos"), F.sin("id").alias("value"))
    spans = spark.range(1, n + 1).select("id", F.greatest(F.col("id") - 2000, F.lit(0)).alias("first"), F.col("id").alias("last"))
    out = locks.worst_falls(points, spans, False)
    joined = [r for r in out.where("id > 2500").collect()]
    assert len(joined) == 500 and all(1.99 < r["worst"] <= 2 for r in joined)
    metrics = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in metrics and "Join Inner" in metrics


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_barrier_against_a_walk(spark, seed):
    """Long ranges over several levels of blocks, holes, ties of signal, timeout and barriers, pairs without candles."""
    import random

    rng = random.Random(seed)
    bars, price = [], {"a": 100.0, "b": 100.0}
    for p in "ab":
        for k in range(700):
            if rng.random() < 0.1:
                continue
            price[p] = max(1.0, price[p] * (1 + rng.uniform(-0.02, 0.02)))
            o = round(price[p], 2)
            bars.append((p, k * H, o, o * 1.01, o * 0.99, o, 1.0, int(rng.random() < 0.004), int(rng.random() < 0.004)))
    entries = []
    for i in range(150):
        p, k = rng.choice("abc"), rng.randint(-3, 705)
        rate = next((b[2] for b in bars if b[0] == p and b[1] >= k * H), 100.0)
        entries.append((f"t{i}", p, k * H, rate, rng.random() < 0.5))
    stop, timeout, liq = [(0.05, 90 * H, None), (0.3, 10_000 * H, 0.2), (0.1, 0, 0.05)][seed - 1]
    want = {}
    for t, p, open_ts, rate, short in entries:
        mine = [b for b in bars if b[0] == p]
        found = None
        at = lambda share: rate * (1 + share) if short else rate * (1 - share)
        for b in mine:
            if b[1] > open_ts:
                hit = lambda share: share is not None and (b[3] >= at(share) if short else b[4] <= at(share))
                if b[8 if short else 7]:
                    found = (b[1], "exit_signal", b[2])
                elif b[1] >= max(open_ts + timeout, open_ts + 1):
                    found = (b[1], "timeout", b[2])
                elif hit(stop):
                    found = (b[1], "stop_loss", at(stop))
                elif hit(liq):
                    found = (b[1], "liquidation", at(liq))
            if found:
                break
        want[t] = found or ((mine[-1][1], "force_exit", mine[-1][2]) if mine else (None, "force_exit", None))
    c = spark.createDataFrame(bars, "pair string, ts long, open double, high double, low double, close double, volume double, exit_long int, exit_short int")
    e = spark.createDataFrame(entries, "trade_id string, pair string, open_ts long, open_rate double, is_short boolean")
    got = {r["trade_id"]: (r["exit_ts"], r["exit_reason"], r["exit_rate"]) for r in joins.first_barrier(e, c, stop, timeout, liq).collect()}
    assert got == want
    if seed == 1:  # the sweep agrees, keeps the order and reports what cannot run
        rows = strategies.candidate_sweep(e.where("pair <> 'c'"), c, [("x", stop, timeout), ("bad", 0.0, 1), ("worse", None, 1), ("late", 0.2, -1), ("y", 0.2, 10 * H)]).collect()
        assert [(r["candidate"], r["status"], r["error"]) for r in rows] == [("x", "completed", None), ("bad", "failed", "stop"), ("worse", "failed", "stop"), ("late", "failed", "timeout"), ("y", "completed", None)]
        sides = {t: (rate, short) for t, p, _, rate, short in entries if p != "c"}
        gains = [1 - want[t][2] / r if short else want[t][2] / r - 1 for t, (r, short) in sides.items()]
        assert (rows[0]["trades"], rows[0]["wins"]) == (len(sides), sum(g > 0 for g in gains)) and rows[0]["mean_ratio"] == pytest.approx(sum(gains) / len(gains), abs=2e-4)
        assert rows[1]["trades"] is None


def test_barriers_without_candles(spark):
    c = spark.createDataFrame([], "pair string, ts long, open double, high double, low double, close double, volume double, exit_long int, exit_short int")
    e = spark.createDataFrame([("t", "a", 0, 100.0, False)], "trade_id string, pair string, open_ts long, open_rate double, is_short boolean")
    assert one(joins.first_barrier(e, c, 0.1, H))["exit_reason"] == "force_exit"


def test_execution_window_keeps_its_head_as_context(spark):
    """The row on which the range starts cannot act on a signal; it and the startup rows before it are context."""

    def run(n, start, end, startup):
        df = spark.createDataFrame([("a", k) for k in range(n)], "pair string, ts long")
        return [(r["ts"], r["is_context"]) for r in candles.execution_window(df, start, end, startup).orderBy("ts").collect()]

    assert run(3, 1, 2, 0) == [(1, True), (2, False)]
    assert run(5, 3, 4, 3) == [(0, True), (1, True), (2, True), (3, True), (4, False)]
    assert run(5, 1, 4, 2) == [(0, True), (1, True), (2, True), (3, False), (4, False)]  # one row of history short: the range loses a row
    assert run(5, 1, 2, 9) == [] and run(5, 4, 4, 0) == [] and run(5, 9, 12, 0) == []
    with pytest.raises(ValueError):
        run(3, 2, 1, 0)


def test_signals_before_the_first_executable_row_are_not_counted(spark):
    c = candle_rows(spark, [("a", k, 1, 1, 1, 1, 1) for k in range(5)])
    strategy = lambda df: df.withColumn("enter_long", F.col("ts").isin(0, 3 * H).cast("int"))
    rows, counts = strategies.prepare_signals(c, strategy, 3 * H, 4 * H, None, 3)
    assert [(r["ts"] // H, r["is_context"], r["exec_enter_long"]) for r in rows.orderBy("ts").collect()] == [(0, True, 0), (1, True, 1), (2, True, 0), (3, True, 0), (4, False, 1)]
    assert (one(counts)["rows"], one(counts)["enter_long"]) == (1, 1)


def test_prepared_candles_and_their_coverage(spark):
    c = candle_rows(spark, [("a", k, 1, 1, 1, 1, 1) for k in range(0, 12)] + [("b", k, 1, 1, 1, 1, 1) for k in range(8, 12)] + [("c", k, 1, 1, 1, 1, 1) for k in range(0, 6)]).withColumn("seq", F.col("ts"))
    out, coverage = strategies.prepare_candles(c, "1h", 4 * H, 11 * H, 3, {"2h": c}, ["a", "b", "c", "d"])
    assert {r["pair"]: (r["accepted"], r["missing_candles"]) for r in coverage.collect()} == {"a": (True, 0), "b": (False, 7), "c": (False, 0), "d": (False, None)}
    assert sorted((r["pair"], r["ts"] // H) for r in out.collect()) == [("a", k) for k in range(1, 12)]
    some, _ = strategies.prepare_candles(c, "1h", 4 * H, 11 * H, 3, None, ["a", "b"], "available")
    assert {r["pair"] for r in some.collect()} == {"a", "b"}


def export_document(rng, trades):
    """A result of version 2 whose texts hold braces, quotes and backslashes."""
    text = lambda: "".join(rng.choice(['a', '}', '{', '"', "\\", "]", ",", ":", "é", "\n"]) for _ in range(rng.randint(1, 12)))
    made = [
        {"pair": f"A{k}/B", "is_short": k % 2 == 1, "open_timestamp": k, "close_timestamp": k + 1, "amount": 1.5, "enter_tag": text(), "exit_reason": "roi", "nested": {"x": {"y": text()}}, "trade_duration": 1, "is_open": False, "weekday": 6,
         "orders": [{"ft_is_entry": True, "amount": 2, "tag": text()} for _ in range(rng.randint(0, 3))]} for k in range(trades)
    ]
    locks = [{"pair": "*", "side": "*", "lock_timestamp": k, "lock_end_timestamp": k + 5, "reason": text(), "active": True} for k in range(4)]
    counts = {c: 1 for c in exports._COUNTS}
    return {"trading_mode": "spot", "config": {"a": {"b": "}"}}, "trades": made, "empty": [], "per_pair": [{"key": text()}], "timeframe": "5m", "locks": locks, "timerange": "1-2", **{c: 1.25 for c in exports._BALANCES}, **counts}


@pytest.mark.parametrize("shape", ["map", "flat", "zip"])
def test_exports_in_many_pieces(spark, tmp_path, shape):
    """Files are cut anywhere, and every text and number comes back as it is in the file."""
    import json
    import random
    import zipfile

    rng = random.Random(6)
    result = export_document(rng, 90)
    document = result | {"strategy_name": "F"} if shape == "flat" else {"metadata": {"x": "{"}, "strategy": {"S": result, "T": result | {"trades": result["trades"][:3], "locks": []}}, "strategy_comparison": [{"key": "S", "trades": 3}]}
    body = json.dumps(document, indent=2 if shape == "flat" else None, ensure_ascii=shape != "flat")
    if shape == "zip":
        with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
            z.writestr("r.json", body)
    else:
        (tmp_path / "r.json").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records, heads = exports.read_backtest_export(spark, str(tmp_path))
        found = records.collect()
        summary = {r["strategy"]: r for r in exports.normalize_summary(heads).collect()}
        t, o, k = exports.normalize_trades(records, 2)
        t, o, k = t.where("error is null").collect(), o.collect(), k.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {"F": result} if shape == "flat" else {"S": result, "T": result | {"trades": result["trades"][:3], "locks": []}}
    for name, r in want.items():
        for section in ("trades", "locks", "per_pair"):
            rows = sorted((x["sequence"], json.loads(x["record"])) for x in found if x["strategy"] == name and x["section"] == section)
            assert rows == list(enumerate(r[section]))
        assert (summary[name]["version"], summary[name]["error"], summary[name]["starting_balance"], summary[name]["timerange"]) == (2, None, "1.25", "1-2")
        mine = sorted((x["sequence"], x["entry_tag"]) for x in t if x["strategy"] == name)
        assert mine == [(i, x["enter_tag"]) for i, x in enumerate(r["trades"])]
        assert sum(x["strategy"] == name for x in o) == sum(len(x["orders"]) for x in r["trades"]) and sum(x["strategy"] == name for x in k) == len(r["locks"])
    assert {x["section"] for x in found} == {"trades", "locks", "per_pair"}


def test_version_one_has_no_summary(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"strategy": {"S": {"trades": [{"pair": "A/B", "is_short": false, "open_date": "2024-01-01 00:00:00", "close_timestamp": 1704067260000, "amount": 0.10, "sell_reason": "roi", "orders": []}, {"pair": "", "amount": 1}]}}}')
    records, heads = exports.read_backtest_export(spark, str(tmp_path))
    t = exports.normalize_trades(records)[0].orderBy("sequence").collect()
    assert (t[0]["open_ts"], t[0]["amount"], t[0]["exit_reason"], t[0]["error"], t[1]["error"]) == (1_704_067_200_000, "0.1", "roi", None, "pair")
    assert exports.normalize_trades(records, 2)[0].where("error = 'duration'").count() == 1
    assert all(r["version"] == 1 and r["error"] is None for r in exports.normalize_summary(heads).collect())
    with pytest.raises(ValueError):
        exports.normalize_trades(records, 3)


def test_written_surface_in_order(spark, tmp_path):
    t = spark.createDataFrame([(1, "b", "1.50"), (0, "a", "0.12345678")], "sequence long, pair string, amount string")
    o = spark.createDataFrame([(0, 1, 5), (0, 0, 4)], "trade long, sequence int, size int")
    k = spark.createDataFrame([("z", "*", 5, 9, "r"), ("a", "*", 5, 9, "r"), ("b", "*", 1, 9, None)], "pair string, side string, lock_ts long, lock_end long, reason string")
    path = str(tmp_path / "s")
    manifest = {r["kind"]: (r["lines"], r["errors"]) for r in exports.write_surface(spark.createDataFrame([(2,)], "total_trades long"), k, t, o, path, ["amount"]).collect()}
    assert manifest == {"summary": (1, 0), "lock": (3, 0), "trade": (2, 1)}
    lines = [(r["kind"], r["value"]) for r in exports.read_surface(spark, path).collect()]
    assert [x for x, _ in lines] == ["summary", "lock", "lock", "lock", "trade", "trade"] and '"pair":"b"' in lines[1][1] and '"pair":"a"' in lines[2][1]
    assert lines[4][1] == '{"sequence":0,"pair":"a","amount":"0.12345678","orders":[{"sequence":0,"size":4},{"sequence":1,"size":5}]}'
    import glob

    part = next(f for f in glob.glob(f"{path}/lines/part-*") if open(f).read())
    with open(part, "a") as f:
        f.write('{"kind":"trade","value":"{}"}\n')
    for crc in glob.glob(f"{path}/lines/.part-*.crc"):
        __import__("os").remove(crc)
    with pytest.raises(ValueError):
        exports.read_surface(spark, path)


def test_written_surface_from_listed_orders(spark, tmp_path):
    """Orders listed by the trade's own id give the lines that orders by sequence give; a trade without orders has an empty list."""
    t = spark.createDataFrame([(11, 1, "b"), (12, 0, "a"), (13, 2, "c")], "trade_id long, sequence long, pair string")
    o = spark.createDataFrame([(11, 1, 5), (11, 0, 4), (12, 0, 6)], "trade long, sequence int, size int")
    k = spark.createDataFrame([], "pair string, side string, lock_ts long, lock_end long, reason string")
    n = spark.createDataFrame([(3,)], "total_trades long")
    by_place = o.join(t.select(F.col("trade_id").alias("trade"), F.col("sequence").alias("at")), "trade").select(F.col("at").alias("trade"), "sequence", "size")
    exports.write_surface(n, k, t, by_place, str(tmp_path / "a"), [])
    exports.write_surface(n, k, exports.with_orders(t, o, "trade_id"), None, str(tmp_path / "b"), [])
    a, b = ([tuple(r) for r in exports.read_surface(spark, str(tmp_path / x)).collect()] for x in "ab")
    assert a == b and b[1][1].endswith('"orders":[{"sequence":0,"size":6}]}') and b[3][1].endswith('"orders":[]}')


def test_return_bound_of_a_lowest_price_of_zero(spark):
    df = candle_rows(spark, [("a", 0, 1, 3, 0, 2, 1), ("b", 0, 0, 0, 0, 0, 1), ("c", 0, 2, 3, 2, 2, 1)])
    out = {r["pair"]: (r["bound"], r["roi_reachable"]) for r in candles.return_bound(df, 0.6).collect()}
    assert out["a"] == (math.inf, True) and math.isnan(out["b"][0]) and out["c"] == (0.5, True)


def test_encode_nonfinite_rounds_the_exact_value(spark):
    """Ties go to the even digit, and what is a tie only in its shortest text is none."""
    df = spark.createDataFrame([(-0.3028125,), (0.0696875,), (0.0000005,), (float("inf"),), (None,), (1e20,)], "x double")
    assert [r[0] for r in df.select(candles.encode_nonfinite("x")).collect()] == ["-0.302812", "0.069687", "0.000000", '{"$float":"inf"}', None, "100000000000000000000.000000"]


def test_export_stores_its_text_once(spark, tmp_path, monkeypatch):
    """A scalar with braces inside its text is whole, and no table but that of the records holds the file's text."""
    import json

    kept = {}
    monkeypatch.setattr(exports, "stored", lambda df, label, *more: kept.setdefault(label, df.localCheckpoint()))
    trades = [{"pair": "A/B", "enter_tag": "x}" * 50, "orders": [{"amount": k}]} for k in range(40)]
    (tmp_path / "x.json").write_text(json.dumps({"strategy": {"S": {"note": "a}, {b", "trades": trades, "timeframe": "5m"}}}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        records, heads = exports.read_backtest_export(spark, str(tmp_path))
        found = sorted((r["sequence"], json.loads(r["record"])) for r in records.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == list(enumerate(trades)) and heads.first()["fields"] == {"note": "a}, {b", "timeframe": "5m"}
    assert [k for k, df in kept.items() if "text" in df.columns] == ["pieces"]


def test_drawdown_asks_its_trades_a_few_times(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(locks, "stored", lambda df, label, *more: (kept.append(df._jdf.queryExecution().optimizedPlan().toString()), df.localCheckpoint())[1])
    t = spark.createDataFrame([(k, k * H, "a", 0.1 - k % 3 * 0.1, False, "roi", 1.0) for k in range(300)], "sequence long, close_ts long, pair string, profit_ratio double, is_short boolean, exit_reason string, profit_abs double")
    assert locks.drawdown_requests(t, 50 * H, 3, H, 0.15).count() > 0
    assert kept and max(p.count("LogicalRDD") for p in kept) <= 4


def test_canonical_decimal_reads_its_text_once(spark):
    texts = ["-0.000", "+1", "5.", "-.5", "1e-3", "00012.3400", "1.5E3", " 12 ", "", "1e", "--1", "abc", None, "-000.0100e1", "1\n"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select(compare.canonical_decimal(F.concat(F.col("x"), F.lit(""))).alias("y"))
    assert [r[0] for r in df.collect()] == ["0", "1", "5", "-0.5", "0.001", "12.34", "1500", "12", None, None, None, None, None, "-0.1", "1"]
    big = spark.range(3).select(compare.canonical_decimal(F.concat(F.col("id").cast("string"), F.lit(".50"))).alias("y"))
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(big._jdf.queryExecution(), "codegen")
    assert 1 <= code.count(".matcher(") <= 2


def test_canonical_decimals_of_an_array_read_each_text_once(spark):
    import json

    from wickwork.operators import states

    texts = ["-0.000", "+1", "5.", "-.5", "1e-3", "00012.3400", "1.5E3", " 12 ", "", "1e", "--1", "abc", None, "-000.0100e1", "1\n", ".", "1e400", "-1E-12", "123456789012345678901234567890.5000"]
    df = spark.createDataFrame([(texts,)], "x array<string>")
    each = df.select(F.explode("x").alias("x")).select(compare.canonical_decimal(F.col("x")))
    assert df.select(compare.canonical_decimals(F.col("x"))).first()[0] == [r[0] for r in each.collect()]
    assert df.select(compare.canonical_decimals(F.lit(None).cast("array<string>"))).first()[0] is None
    raw = spark.createDataFrame([({"USDT": 1.5, "BTC": 2.25, "ADA": 1e-9, "XRP": 0.0}, [])], "wallets map<string,double>, locks array<struct<pair:string,lock_timestamp:long,lock_end_timestamp:long,reason:string,side:string,active:boolean>>")
    raw = raw.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("open_trade_count", "total_profit", "closed_trades", "rejected_signals", "trade_id", "order_id"))])
    out = states.project_reference_state(raw, "USDT")
    assert json.loads(out.first()["state"])["base_balances"] == [{"currency": "ADA", "free": "0.000000001"}, {"currency": "BTC", "free": "2.25"}] and out.columns == [*raw.columns, "state"]
    # functions of elements evaluate a pattern as often as they name it; projections evaluate it once
    patterns = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    plain = patterns(df.select(F.explode("x").alias("x")).select(compare.canonical_decimal(F.col("x")).alias("y")))
    assert patterns(df.select(compare.canonical_decimals(F.col("x")).alias("y"))) == 1 and patterns(out) == plain + 1  # the profit is a constant here


def test_engine_balances_read_each_text_once(spark):
    import json

    from wickwork.operators import states

    row = (1.5, [("B", 1e-9), ("A", 2.25), ("C", 0.0)], 3.0, [])
    raw = spark.createDataFrame([row], "quote_free double, base_balances array<struct<currency:string,free:double>>, realized_profit double, locks array<struct<pair:string,lock_timestamp_ms:long,lock_end_timestamp_ms:long,reason:string,side:string,active:boolean>>")
    raw = raw.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("open_trade_count", "closed_trade_count", "rejected_signals", "trade_id_counter", "order_id_counter"))])
    out = {mode: states.project_engine_state(raw, mode) for mode in ("spot", "futures")}
    assert json.loads(out["spot"].first()["state"])["base_balances"] == [{"currency": "B", "free": "0.000000001"}, {"currency": "A", "free": "2.25"}]
    assert json.loads(out["futures"].first()["state"])["base_balances"] == []
    patterns = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert patterns(out["spot"]) == 2 * patterns(raw.select(compare.canonical_decimal(F.col("quote_free").cast("string")).alias("y"))) + 1


def test_equity_curve_asks_its_trades_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(trades, "stored", lambda df, label, *more: (kept.append(label), df.localCheckpoint())[1], raising=False)
    t = spark.createDataFrame([(k, k * H, k * H + 3 * H, 10.0, 1.0) for k in range(50)], "trade_id long, open_ts long, close_ts long, stake_amount double, profit_abs double")
    rows = trades.wallet_state(t, 100.0).orderBy("ts").collect()
    assert [(r["closed_trades"], r["realized"]) for r in rows] == [(k + 1, k + 1.0) for k in range(50)]
    assert kept == ["wallet"]


def test_surface_rules_ask_their_trades_once(spark, monkeypatch):
    from wickwork.queries import compare as queries

    kept = []
    monkeypatch.setattr(compare, "stored", lambda df, label, *more: (kept.append((label, df.columns)), df.localCheckpoint())[1])
    monkeypatch.setattr(trades, "stored", lambda df, label, *more: (kept.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("lineitem.parquet") <= 1)), df.localCheckpoint())[1], raising=False)
    rows = [(0, 1, 2, "1.50"), (1, 3, 2, "1"), (3, 1, 2, "1"), (3, 1, 2, "1"), (5, 1, 2, "1")]
    found = compare.validate_surface(spark.createDataFrame(rows, "sequence long, open_ts long, close_ts long, text string"), ["text"]).collect()
    assert sorted(map(tuple, found)) == [(0, "decimal"), (1, "time"), (3, "sequence"), (5, "sequence")] and kept == [("checked", ["sequence", "_code"])]
    plan = queries.expected(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and kept[1:] == [("closing", True)]


def test_exponents_are_never_cast_from_empty_text(spark):
    texts = ["5", "1.50", "12e3", "12E-3", "1e+0007", "-7e-0", "1e", "e1", None, "9e9999"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    found = [r[0] for r in df.select(compare.canonical_decimal(F.col("x"))).collect()]
    assert found[:9] == ["5", "1.5", "12000", "0.012", "10000000", "-7", None, None, None] and found[9] == "9" + "0" * 9999
    power = df.select(F.array(compare.canonical_decimal(F.col("x"))).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(concat(0, " in power and "cast(substring(" not in power


def test_errors_of_trades_evaluate_no_decimal(spark, monkeypatch):
    monkeypatch.setattr(exports, "stored", lambda df, label, *more: df.localCheckpoint())
    whole = '"pair":"A","open_timestamp":1,"close_timestamp":2,"exit_reason":"x","is_short":false'
    texts = [f"{{{whole}{a}}}" for a in ("", ',"amount":null', ',"amount":"1e"', ',"amount":" 1.50\\n"', ',"amount":2')]
    records = spark.createDataFrame([("p", "S", "trades", k, t) for k, t in enumerate(texts)], "path string, strategy string, section string, sequence int, record string")
    out = exports.normalize_trades(records)[0]
    assert [(r["amount"], r["error"]) for r in out.orderBy("sequence").collect()] == [(None, "amount"), (None, "amount"), (None, "amount"), ("1.5", None), ("2", None)]
    plan = out.where("error is null").select("pair")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 1


def test_numbered_orders_copy_no_table(spark, monkeypatch, tmp_path):
    from wickwork.queries import QUERIES
    from wickwork.queries import files as queries

    monkeypatch.setattr(queries, "scratch", lambda s, label: str(tmp_path / label))
    out = QUERIES["normalize_orders"](spark, "/root/testdata/sf0.001")
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter", "Window", "Sort"):
        node = node.children().head()
    assert node.nodeName() == "Union"  # a join with the trades would be one by broadcast, as their columns are small in files
    assert {f.name[-4:] for f in (tmp_path / "export").rglob("part-*")} == {"t.gz"}
    made = queries._numbered_orders(
        spark.createDataFrame([("x", 0, "2"), ("x", 1, None), ("y", 0, "3")], "path string, sequence int, leverage string"),
        spark.createDataFrame([("x", 1, 0, True, "5", 7), ("x", 0, 1, False, "1", 9), ("x", 0, 0, True, "1", 8), ("y", 0, 0, None, None, None)], "path string, trade int, sequence int, is_entry boolean, amount string, ts long"),
    )
    assert sorted(map(tuple, made.collect()), key=str) == [(1, 2, True, "1", 8), (1, 3, None, None, None), (2, 2, False, "1", 9), (3, None, True, "5", 7)]


def test_exports_packed_by_gzip(spark, tmp_path):
    import gzip
    import json

    trades = [{"pair": "A/B", "enter_tag": "x}", "orders": [{"amount": k}]} for k in range(40)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json.gz").write_bytes(gzip.compress(json.dumps({"strategy": {"S": {"trades": trades, "timeframe": "5m"}}}).encode()))
    (tmp_path / "y.json").write_text(json.dumps({"strategy": {"S": {"trades": trades[:3]}}}))
    records, _ = exports.read_backtest_export(spark, str(tmp_path))
    found = sorted((r["path"][-1], r["sequence"], json.loads(r["record"])["orders"][0]["amount"]) for r in records.collect())
    assert found == [("n", k, k) for k in range(3)] + [("z", k, k) for k in range(40)]


def test_candle_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from wickwork.queries import files as queries

    monkeypatch.setattr(queries, "scratch", lambda s, label: str(tmp_path / label))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        queries.read_candles(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len({f.name[:10] for f in (tmp_path / "candles").rglob("part-*.parquet")}) > 1


def test_feather_files_are_read_by_batch(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather

    when = [1_704_067_200_000 + k % 4 * H for k in range(10)]
    t = pa.table({"date": pa.array(when, pa.timestamp("ms", "UTC")), **{c: [float(k) for k in range(10)] for c in files.CANDLE_COLUMNS[1:]}})
    pyarrow.feather.write_feather(t, str(tmp_path / "A_B-1h.feather"), chunksize=3)
    out = files.read_candles(spark, str(tmp_path), "feather").select("pair", "open").collect()
    assert sorted(r["open"] for r in out) == [6.0, 7.0, 8.0, 9.0] and {r["pair"] for r in out} == {"A/B"}
    assert [len(x) for x in files._feather_parts(pa.py_buffer((tmp_path / "A_B-1h.feather").read_bytes()))] == [3, 3, 3, 1]
