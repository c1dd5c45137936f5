"""Projection of both sides' states to one document form, so that event streams can be compared field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.operators.compare import canonical_decimal, canonical_decimals

#: Places of a quote balance in futures, where both sides carry noise of the last bits.
FUTURES_PLACES = 9
LOCK = ("pair", "lock_timestamp_ms", "lock_end_timestamp_ms", "reason", "side", "active")


def _quote(c: Column, mode: str) -> Column:
    """A balance as a canonical decimal; in futures rounded half even."""
    if mode not in ("spot", "futures"):
        raise ValueError(f"no trading mode {mode}")
    text = c.cast("string")
    return canonical_decimal(text if mode == "spot" else F.bround(text.cast(f"decimal(38,{FUTURES_PLACES + 9})"), FUTURES_PLACES).cast("string"))


def sorted_locks(locks: Column, start: str, end: str) -> Column:
    """Lock structs (pair, <start>, <end>, reason, side, active) in canonical order: start, end, pair, side, reason; NULL if there is none."""
    key = lambda k: F.struct(k[start].cast("long").alias("a"), k[end].cast("long").alias("b"), k["pair"].alias("c"), k["side"].alias("d"), F.coalesce(k["reason"], F.lit("")).alias("e"), k["reason"].alias("r"), k["active"].alias("f"))
    plain = lambda s: F.struct(s["c"].alias("pair"), s["a"].alias("lock_timestamp_ms"), s["b"].alias("lock_end_timestamp_ms"), s["r"].alias("reason"), s["d"].alias("side"), s["f"].alias("active"))
    return F.when(F.size(F.coalesce(locks, F.array())) > 0, F.transform(F.array_sort(F.transform(locks, key)), plain))


def _document(events: DataFrame, quote: Column, bases: Column, profit: Column, counts: dict[str, Column], locks: Column, mode: str) -> DataFrame:
    """bases: an array of structs (currency, free), free as text."""
    events = events.withColumn("_bases", bases if mode == "spot" else F.array().cast("array<struct<currency:string,free:string>>"))
    balances = F.zip_with("_bases", canonical_decimals(F.col("_bases")["free"]), lambda b, free: F.struct(b["currency"].alias("currency"), free.alias("free")))
    fields = [_quote(quote, mode).alias("quote_free"), balances.alias("base_balances"), counts["open_trade_count"].alias("open_trade_count"), canonical_decimal(profit.cast("string")).alias("realized_profit")]
    fields += [counts[c].alias(c) for c in ("closed_trade_count", "rejected_signals", "trade_id_counter", "order_id_counter")]
    return events.withColumn("state", F.to_json(F.struct(*fields, locks.alias("locks")))).drop("_bases")


def project_reference_state(events: DataFrame, quote: str, mode: str = "spot") -> DataFrame:
    """Adds state, a JSON document, to raw states: wallets (map of currency to free amount), open_trade_count, total_profit, closed_trades, rejected_signals, trade_id, order_id, locks.

    quote_free is the quote currency's balance (0 without one), base_balances the others that are not 0, by name; both canonical decimals. In futures there are no base balances. locks are in canonical
    order and left out when there is none. Locks: pair, lock_timestamp, lock_end_timestamp, reason, side, active.
    """
    others = F.map_entries(F.map_filter("wallets", lambda k, v: (k != quote) & (v != 0)))
    bases = F.transform(F.array_sort(others), lambda e: F.struct(e["key"].alias("currency"), e["value"].cast("string").alias("free")))
    counts = {"open_trade_count": F.col("open_trade_count"), "closed_trade_count": F.col("closed_trades"), "rejected_signals": F.col("rejected_signals"), "trade_id_counter": F.col("trade_id"), "order_id_counter": F.col("order_id")}
    return _document(events, F.coalesce(F.col("wallets")[quote], F.lit(0)), bases, F.col("total_profit"), counts, sorted_locks(F.col("locks"), "lock_timestamp", "lock_end_timestamp"), mode)


def project_engine_state(events: DataFrame, mode: str = "spot") -> DataFrame:
    """Adds state, the same document, to rows with quote_free, base_balances (structs currency, free), open_trade_count, realized_profit, closed_trade_count, rejected_signals, trade_id_counter,
    order_id_counter and locks (pair, lock_timestamp_ms, lock_end_timestamp_ms, reason, side, active)."""
    kept = F.filter("base_balances", lambda b: b["free"] != 0)
    bases = F.transform(kept, lambda b: F.struct(b["currency"].alias("currency"), b["free"].cast("string").alias("free")))
    counts = {c: F.col(c) for c in ("open_trade_count", "closed_trade_count", "rejected_signals", "trade_id_counter", "order_id_counter")}
    return _document(events, F.col("quote_free"), bases, F.col("realized_profit"), counts, sorted_locks(F.col("locks"), "lock_timestamp_ms", "lock_end_timestamp_ms"), mode)
