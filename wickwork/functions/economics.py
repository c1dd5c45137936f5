"""Trade economics as Column functions: ticks, stakes, stops, leverage, liquidation, adjustments."""

from __future__ import annotations

import math
from decimal import Context, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Places of exact steps: doubles from LARGE on have no more than 18 in their shortest text, smaller ones no more than 29 down to 1e-12.
LARGE, SMALL_KIND, LARGE_KIND = 1e6, "decimal(36,29)", "decimal(36,18)"


def quantize_step(value: Column, step: Column, how: str) -> Column:
    """Exact multiple of step below (floor), above (ceil) or nearest (round, half away from zero) a value, from the shortest text of both; the value itself unless the step is above 0.

    Steps have 18 places beside values from a million on, else 29.
    """

    def within(kind: str) -> Column:
        v, s = value.cast("string").try_cast(kind), step.cast("string").try_cast(kind)
        rest = v % s
        none, two = F.lit(0).cast(kind), rest + rest
        up, down = {"floor": (F.lit(False), rest < 0), "ceil": (rest > 0, F.lit(False)), "round": (two >= s, two <= -s)}[how]
        return (v - rest + F.when(up, s).when(down, -s).otherwise(none)).cast("double")

    return F.when(step > 0, F.when((F.abs(value) < LARGE) & (step < LARGE), within(SMALL_KIND)).otherwise(within(LARGE_KIND))).otherwise(value)


def exact_quotient(a: Column, b: Column, c: Column) -> Column:
    """a * b / c of doubles, exact to 18 places and turned into a double once, at any size; NULL for a divisor of 0."""
    return _quotient(a.cast("double"), b.cast("double"), c.cast("double"))


@F.pandas_udf(DoubleType())
def _quotient(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """Products and quotients of doubles of any size are beyond Spark's decimals."""
    exact = lambda x: Decimal(repr(x)) if math.isfinite(x) else None

    def one(x: Decimal | None, y: Decimal | None, z: Decimal | None) -> float | None:
        if x is None or y is None or not z:
            return None
        whole, rest = divmod(x * y, z)
        return float(whole + (rest.scaleb(18) // z).scaleb(-18))

    with localcontext(Context(prec=700)):
        return pd.Series([one(exact(x), exact(y), exact(z)) for x, y, z in zip(a.tolist(), b.tolist(), c.tolist())], dtype="float64")


def entry_amount(stake: Column, leverage: Column, rate: Column, step: Column) -> Column:
    """Amount that a stake buys, in whole steps."""
    return quantize_step(exact_quotient(stake, leverage, rate), step, "floor")


def entry_stake(amount: Column, rate: Column, leverage: Column) -> Column:
    return amount * rate / leverage


def entry_cost(amount: Column, rate: Column, fee: Column) -> Column:
    return amount * rate * (1 + fee)


def min_stake(cost_min: Column, amount_min: Column, rate: Column, stop: float, reserve: float, leverage: Column, explicit: Column | None = None) -> Column:
    """Smallest stake of an entry: the larger of the cost and amount limits with their reserves, by leverage. An explicit minimum wins."""
    keep = 1.0 + reserve
    factor = min(max(keep / (1 - abs(stop)), 1.0), 1.5) if abs(stop) < 1 else 1.5
    found = F.greatest(cost_min * factor, amount_min * rate * keep) / leverage
    return found if explicit is None else F.coalesce(explicit, found)


def available_stake(tied: Column, free: Column, ratio: float) -> Column:
    return F.greatest(F.least((tied + free) * ratio - tied, free), F.lit(0.0))


def proposed_stake(available: Column, tied: Column, slots: Column, fixed: Column) -> Column:
    """A NULL fixed stake is unlimited: an equal share for each slot, capped at what is available."""
    return F.when(fixed.isNull(), F.least((available + tied) / slots, available)).otherwise(F.least(fixed, available))


def initial_stop(rate: Column, stop: Column, leverage: Column, is_short: Column, step: Column) -> Column:
    """Stop price: for a long rounded up, for a short rounded down. stop is negative for a loss."""
    share = stop.cast("double") / leverage.cast("double")
    return F.when(is_short, quantize_step(rate * (1 - share), step, "floor")).otherwise(quantize_step(rate * (1 + share), step, "ceil"))


def adjusted_stop(current: Column, candidate: Column, is_short: Column) -> Column:
    """A stop never loosens."""
    return F.when(is_short, F.least(current, candidate)).otherwise(F.greatest(current, candidate))


def liquidation_price(open_rate: Column, amount: Column, stake: Column, rate: Column, extra: Column, is_short: Column, buffer: float) -> Column:
    """Price at which maintenance margin is reached, moved toward the entry by the buffer, 0 at least."""
    d = F.when(is_short, -1.0).otherwise(1.0)
    raw = (stake + extra - d * amount * open_rate) / (amount * rate - d * amount)
    return F.greatest(raw + buffer * (open_rate - raw), F.lit(0.0))


def rule_adjustment(count: Column, most: int, profit: Column, threshold: float, first_cost: Column, ratio: float) -> Column:
    """Amount of an added entry, NULL if the rule does not apply."""
    return F.when((count < most) & (profit < threshold), first_cost * ratio)


def derisk_level(profit: Column, used: Column, thresholds: list[float]) -> Column:
    """First level, from 1, that is not in the array used and whose loss threshold is passed."""
    out = F.lit(None).cast("int")
    for k, t in reversed(list(enumerate(thresholds, 1))):
        out = F.when(~F.array_contains(used, k) & (profit < t), k).otherwise(out)
    return out


def threshold_stop(profit: Column, cost: Column, threshold: float, leverage: Column) -> Column:
    return profit < -(cost * threshold / leverage)


def indicator_stop(profit: Column, cost: Column, threshold: float, close: Column, ema: Column, rsi: Column, before: Column, hourly: Column, cmf: Column) -> Column:
    """Loss beyond the threshold's share of the entry cost, the close less than 1 % under its average, RSI rising and 24 above the hourly one, money flow negative."""
    near = (close < ema) & ((ema - close) / close < 0.010)
    return (profit < -(cost * threshold)) & near & (cmf < 0.0) & (rsi > before) & (rsi > hourly + 24.0)


def profit_bucket(ratio: Column) -> Column:
    """NULL below 0.1 %, then whole percent 0 to 11, and 12 above."""
    out = F.when(ratio >= 0.12, 12)
    for k in range(11, 0, -1):
        out = out.when(ratio >= k / 100, k)
    return out.when(ratio >= 0.001, 0)


def exit_reason(mode: Column, name: Column, bucket: Column, tag: Column) -> Column:
    """exit_<mode>_<name>_<bucket>, followed by the entry tag in brackets where there is one."""
    head = F.concat(F.lit("exit_"), mode, F.lit("_"), name, F.lit("_"), bucket.cast("string"))
    return F.concat(head, F.lit(" ( "), F.coalesce(tag, F.lit("")), F.lit(")"))


def rebuy_allowed(is_short: Column, protections: Column, rsi: Column, rsi_15m: Column, aroon: Column, aroon_15m: Column, close: Column, ema: Column) -> Column:
    """Side-dependent entry thresholds: RSI not at its extreme, a weak Aroon of the side, and the close beyond 1.2 % of its average."""
    weak = protections & (aroon < 30.0) & (aroon_15m < 30.0)
    return F.when(is_short, weak & (rsi < 90.0) & (rsi_15m < 90.0) & (close < ema * 1.012)).otherwise(weak & (rsi > 10.0) & (rsi_15m > 10.0) & (close < ema * 0.988))


def base_currency(pair: Column) -> Column:
    return F.substring_index(pair, "/", 1)


def price_distance(rate: Column, reference: Column) -> Column:
    return F.when(reference > 0, (rate - reference) / reference)


def partial_exit_amount(requested: Column, amount: Column, stake: Column, step: Column) -> Column:
    """Amount of an exit worth `requested` stake in whole steps; NULL unless it leaves something and is something."""
    out = quantize_step(exact_quotient(requested, amount, stake), step, "floor")
    return F.when((requested < stake) & (out > 0) & (out < amount), out)


def partial_exit_request(requested: Column, current: Column, least: Column, amount: Column, stake: Column, leverage: Column, rate: Column) -> Column:
    """Stake of a partial exit that keeps 1.55 times the minimum: less is taken out if the rest would fall below. NULL if the exit or its stake is at most the minimum."""
    rest = current / leverage - requested
    out = F.when(rest < least * 1.55, amount * rate / leverage - least * 1.55).otherwise(requested)
    value = out * leverage * (stake / amount) / rate
    return F.when((out > least) & (value > least), value)


def scale_stakes(ladder: Column, least: Column) -> Column:
    """Raise all rungs by the factor that lifts the first one to the minimum."""
    k = F.greatest(F.lit(1.0), least / F.element_at(ladder, 1))
    return F.transform(ladder, lambda x: x * k)


def ladder_entry(level: Column, signal: Column, distance: Column, derisked: Column, empty: Column, x: dict[str, Column]) -> Column:
    """Whether a rung may be bought. Rungs 1 to 3 need the signal; rung 4 also takes a fall of 4 % with weak momentum, or of 6 % when no rung is held
    (empty); rung 5 also takes a fall of 6 % of a derisked trade. x: rsi_3, rsi_3_15m, rsi_14, aroon_up, close, ema_20."""
    fourth = (distance < -0.04) & (x["rsi_3"] > 5.0) & (x["rsi_3_15m"] > 10.0) & (x["rsi_14"] < 35.0) & (x["close"] < x["ema_20"] * 0.985)
    fourth = fourth | (distance < -0.06) & empty & (x["rsi_14"] < 30.0) & (x["close"] < x["ema_20"] * 0.980)
    fifth = derisked & (distance < -0.06) & (x["rsi_3"] > 10.0) & (x["rsi_3_15m"] > 20.0) & (x["aroon_up"] < 50.0)
    return F.when(level <= 3, signal).when(level == 4, signal | fourth).otherwise(signal | fifth)


def ladder_exit(profit_rate: Column, threshold: float, fees: float, x: dict[str, Column]) -> Column:
    """Whether a rung may be sold: profit past the threshold and fees, and momentum at its height. x: rsi_3, rsi_14, willr, stoch, close, band, rsi_3_1h, rsi_3_4h, roc_1d, btc_rsi_4h."""
    high = (x["rsi_3"] > 99.0) | (x["rsi_14"] > 70.0) | (x["willr"] > -0.1) | (x["stoch"] > 95.0) | (x["close"] > x["band"] * 1.01) | (x["rsi_3"] > 90.0) & (x["rsi_14"] < 50.0)
    fading = (x["rsi_3"] > 80.0) & (x["rsi_3_1h"] < 20.0) & (x["rsi_3_4h"] < 20.0) & (x["roc_1d"] > -10.0) & (x["btc_rsi_4h"] < 35.0)
    return (profit_rate >= threshold + fees) & (high | fading)


def tag_with_ids(prefix: str, ids: Column) -> Column:
    """The prefix and ids, newest first."""
    return F.concat_ws(" ", F.lit(prefix), F.transform(F.sort_array(ids, asc=False), lambda x: x.cast("string")))


def order_side(is_short: Column, is_entry: Column) -> Column:
    return F.when(is_short != is_entry, "buy").otherwise("sell")


def round8(x: Column) -> Column:
    """Half away from zero, 8 places."""
    return F.round(x, 8)


def half_even9(x: Column) -> Column:
    return F.bround(x, 9)
