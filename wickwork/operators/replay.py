"""Exact replay of order logs: what a trade holds, and what its exits earned.

Orders replay in decimals without a bound on size, which no Spark type offers, so a task folds its trades one by one in Python's decimals: sums and products are exact, the
average of a holding is cut to 18 places, and market steps are applied once, to the final amount and average.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, Inexact, InvalidOperation, localcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of the usual context; where a result needs more, it is worked out again with the larger one.
DIGITS, MORE_DIGITS = 120, 3000
PLACE_18 = Decimal(1).scaleb(-18)


def exact(x: float | None) -> Decimal | None:
    """A double by its shortest text; None for NULL, NaN and infinite."""
    return None if x is None or x != x or x in (float("inf"), float("-inf")) else Decimal(repr(x))


def in_steps(x: float, step: float | None, nearest: bool) -> float:
    """Whole steps of a double: below, or nearest (half up). Without a step the double itself."""
    if not step or step <= 0:
        return x
    v, s = exact(x), exact(step)
    units, rest = divmod(v, s)
    return float(s * (units + (1 if nearest and rest + rest >= s else 0)))


def cut_quotient(a: Decimal, b: Decimal) -> Decimal:
    """a / b without what is beyond 18 places."""
    whole, rest = divmod(a, b)
    return whole + (rest.scaleb(18) // b) * PLACE_18


class _Holding:
    """Amount, cost at the average entry, all entries' cost and average of the orders so far."""

    def __init__(self):
        self.amount = self.cost = self.entries = self.average = Decimal(0)

    def error(self, is_entry: bool, amount: Decimal | None, price: Decimal | None) -> str | None:
        if amount is None or amount <= 0:
            return "amount"
        if price is None or price <= 0:
            return "price"
        return "holding" if not is_entry and amount > self.amount else None

    def fill(self, is_entry: bool, amount: Decimal, price: Decimal) -> None:
        if is_entry:
            self.amount, self.cost, self.entries = self.amount + amount, self.cost + amount * price, self.entries + amount * price
            self.average = cut_quotient(self.cost, self.amount)
        else:
            self.amount, self.cost = self.amount - amount, self.cost - amount * self.average


def _position(orders: list, leverage: float, amount_step: float | None, price_step: float | None) -> tuple:
    held, error = _Holding(), None
    for is_entry, amount, price in orders:
        a, p = exact(amount), exact(price)
        error = held.error(is_entry, a, p)
        if error:
            break
        held.fill(is_entry, a, p)
    if held.amount <= 0 or held.cost <= 0:
        return None, None, None, None, error or "closed"
    with localcontext(Context(prec=40)):
        average = float(held.cost / held.amount)
    return in_steps(float(held.amount), amount_step, False), float(held.cost) / leverage, float(held.entries) / leverage, in_steps(average, price_step, True), error


def _round8(x: float) -> float:
    """Half away from zero, on the double that is 1e8 times as large."""
    from math import floor

    y = abs(x) * 1e8
    whole = floor(y)
    return (1.0 if x >= 0 else -1.0) * (whole + (y - whole >= 0.5)) / 1e8


def _profit(orders: list, is_short: bool, fee_open: float, fee_close: float) -> tuple:
    held, error, profit, entered, funding = _Holding(), None, 0.0, 0.0, 0.0
    into, out = exact(1 - fee_open if is_short else 1 + fee_open), exact(1 + fee_close if is_short else 1 - fee_close)
    for is_entry, amount, price, fee in orders:
        a, p = exact(amount), exact(price)
        error = held.error(is_entry, a, p)
        if error:
            break
        funding += fee or 0.0
        if is_entry:
            entered += float(a * p * into)
        else:
            paid, got = float(a * exact(float(held.average)) * into), float(a * p * out)
            profit += _round8((paid - got if is_short else got - paid) + funding)
            funding = 0.0
        held.fill(is_entry, a, p)
    return profit, entered, error


def _exactly(fold, *args) -> tuple:
    """A fold with every sum and product exact."""
    for digits in (DIGITS, MORE_DIGITS):
        try:
            with localcontext(Context(prec=digits, traps=[Inexact, InvalidOperation])):
                return fold(*args)
        except (Inexact, InvalidOperation):
            continue
    return fold(*args)


def _lists(column: pa.ListArray, names: list[str]) -> Iterator[list]:
    """Each row's array of structs as tuples of these fields."""
    flat, at = column.flatten(), column.offsets.to_pylist()
    values = list(zip(*[flat.field(n).to_pylist() for n in names]))
    first = at[0] if at else 0
    for start, end in zip(at, at[1:]):
        yield values[start - first : end - first]


def _folded(rows: DataFrame, fold, names: list[str], arguments: list[str], schema: str) -> DataFrame:
    """fold(orders as tuples of names, *arguments) of each row (trade_id, orders, arguments...)."""
    out = T.StructType([rows.schema["trade_id"], *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            given = [b.column(b.schema.get_field_index(n)).to_pylist() for n in arguments]
            made = [_exactly(fold, o, *x) for o, x in zip(_lists(b.column(1), names), zip(*given) if given else [()] * b.num_rows)]
            kinds = {"double": pa.float64(), "string": pa.string()}
            cells = [pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(zip(*made), out.fields[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cells], out.names)

    return rows.select("trade_id", "orders", *arguments).mapInArrow(run, out)


def order_arrays(orders: DataFrame, *columns: str) -> DataFrame:
    """One row a trade with its orders as a sorted array of structs, over as many tasks as a shuffle has: what folds them costs more than its bytes show."""
    row = F.struct("sequence", *[c for c in columns if c != "sequence"])
    tasks = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.repartition(tasks, "trade_id").groupBy("trade_id").agg(F.array_sort(F.collect_list(row)).alias("orders"))


def position_state(orders: DataFrame, heads: DataFrame | None = None, amount_step: float | None = None, price_step: float | None = None) -> DataFrame:
    """amount, stake (at the weighted entry), max_stake and average of what each trade holds after all its orders, and the error of the first order that cannot be filled.

    An entry adds its cost by leverage to max_stake, which an exit never lowers; an exit takes its amount at the average, which it leaves as it is. With amount_step the final amount is cut to whole
    steps, with price_step the final average is rounded to whole steps (half up); stakes come from the amounts before. heads: trade_id, leverage (1 if it is not given).
    error: `amount` or `price` that is not above 0, NULL or not finite, `holding` for an exit of more than is held, `closed` (with NULL figures) if nothing is held, NULL for a sound log; orders from the
    first bad one on do not count.
    """
    rows = order_arrays(orders, "is_entry", "amount", "price")
    rows = rows.join(heads.select("trade_id", F.col("leverage").cast("double").alias("_by")), "trade_id") if heads is not None else rows.withColumn("_by", F.lit(1.0))
    return _folded(rows, lambda o, by: _position(o, by, amount_step, price_step), ["is_entry", "amount", "price"], ["_by"], "amount double, stake double, max_stake double, average double, error string")


def realized_profit(orders: DataFrame, heads: DataFrame, funding: DataFrame | None = None) -> DataFrame:
    """profit (each exit against the average entry with fees, rounded to 8 places, summed) and entry_value of each trade.

    heads: trade_id, is_short, fee_open, fee_close. funding: (trade_id, sequence, funding_fee) earned up to an order; it is kept until the next exit takes it.
    Values of an order are exact products of its figures, turned into doubles once. error and what it does are those of position_state(), without `closed`.
    """
    o = orders.select("trade_id", "sequence", "is_entry", "amount", "price")
    o = o.join(funding.select("trade_id", "sequence", F.col("funding_fee").cast("double").alias("funding")), ["trade_id", "sequence"], "left") if funding is not None else o.withColumn("funding", F.lit(0.0))
    rows = order_arrays(o, "is_entry", "amount", "price", "funding").join(heads.select("trade_id", "is_short", *[F.col(c).cast("double").alias(c) for c in ("fee_open", "fee_close")]), "trade_id")
    return _folded(rows, _profit, ["is_entry", "amount", "price", "funding"], ["is_short", "fee_open", "fee_close"], "profit double, entry_value double, error string")

