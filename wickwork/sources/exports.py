"""Backtest exports: one JSON object a file, of any size, taken apart by many tasks.

Spark's text reader splits a file at closing braces, whatever its lines. A first scan counts quotes and braces of every file block, once as if it began inside a string and once as if not, so running
totals over one row a block tell how each block really begins. A second scan then cuts the records out of every block; only what crosses blocks is put together by a shuffle, and no text is stored
but the records. Numbers stay the text that the file holds.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.functions.scalars import canonical_timestamp
from wickwork.operators.compare import canonical_decimal, is_decimal
from wickwork.session import stored

#: Bytes of an unpacked ZIP that are one block.
BLOCK_BYTES = 16 << 20
#: Nested objects of a record: with a map of strategies, {strategy: {name: {trades: [record]}}}, or {trades: [record]}.
DEEP, FLAT = 4, 2
#: A string's inside.
_INSIDE = r'(?:[^"\\]++|\\.)*+'
#: What stands before a list's first record, before the object of a strategy, and the map of strategies.
_LIST, _OBJECT, _MAP = (re.compile(x.encode(), re.S) for x in (rf'"({_INSIDE})"\s*:\s*\[\s*$', rf'"({_INSIDE})"\s*:\s*$', r'"strategy"\s*:\s*\{'))
#: Kinds of pieces of a block: its totals, a record, a part of a record that crosses blocks, text beside the records.
TOTALS, RECORD, PART, BESIDE = range(4)


def _unzipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The one export of each ZIP, streamed in fragments."""
    for pdf in batches:
        for name, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                inside = [x for x in z.namelist() if x.lower().endswith(".json") and not x.endswith(("_config.json", ".meta.json"))]
                if len(inside) != 1:
                    raise ValueError(f"{name} holds {len(inside)} exports")
                with z.open(inside[0]) as f:
                    rest, block = b"", 0
                    while piece := f.read(BLOCK_BYTES):
                        *whole, rest = (rest + piece).split(b"}")
                        yield pd.DataFrame({"path": name, "block": block, "text": [x.decode("utf-8") for x in whole]})
                        block += 1


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, text): fragments of all files, each without the closing brace behind it; those of a block are together in a task and in order."""
    files = spark.read.format("text").option("recursiveFileLookup", "true").option("lineSep", "}").option("pathGlobFilter", "*.{json,txt}{,.gz}").load(path)
    plain = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return plain.unionByName(packed.mapInPandas(_unzipped, "path string, block long, text string"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], dict, bytes]]:
    """((path, block), other columns, text) of what stands together in a batch, with its closing braces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(n) for n in batch.schema.names}
        of, block = cols["path"].dictionary_encode().indices.to_numpy(), cols["block"].to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), cols["text"].slice(i, j - i).cast(pa.binary())), b"}")[0].as_py() + b"}"
            yield (cols["path"][i].as_py(), int(block[i])), {n: c[i].as_py() for n, c in cols.items() if n not in ("path", "block", "text")}, text


def _braces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of braces, 1 or -1 for those that open or close, whether the number of quotes before is odd, and whether that of all quotes is."""
    if b"\\" in text:
        text = re.sub(rb"\\.", b"__", text, flags=re.S)
    b = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((b == 34) | (b == 123) | (b == 125))
    kind = b[at]
    quote = kind == 34
    odd = np.cumsum(quote) & 1
    return at[~quote], np.where(kind[~quote] == 123, 1, -1), odd[~quote], int(odd[-1]) if len(odd) else 0


_TOTALS = "path string, block long, odd long, rise_0 long, rise_1 long, map_0 long, map_1 long"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: whether its quotes are odd, and as if it began outside (0) or inside (1) a string how much deeper it ends and how deep, from its start, a map of strategies begins."""
    found: dict = {}
    for key, _, text in _stretches(batches):
        t = found.setdefault(key, [0, 0, 0, None, None])
        at, sign, odd, all_odd = _braces(text)
        maps = np.searchsorted(at, [m.end() - 1 for m in _MAP.finditer(text)])
        for h in (0, 1):
            seen = (odd ^ t[0] ^ h) == 0
            depth = t[1 + h] + np.cumsum(sign * seen)
            for k in maps:
                if seen[k]:
                    before = int(depth[k]) - 1
                    t[3 + h] = before if t[3 + h] is None else min(before, t[3 + h])
            t[1 + h] = int(depth[-1]) if len(depth) else t[1 + h]
        t[0] ^= all_odd
    names = [x.split()[0] for x in _TOTALS.split(", ")]
    types = [pa.string(), *[pa.int64()] * 6]
    rows = [(*k, *t) for k, t in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class _Cutter:
    """Cuts a block's text, given in order, into pieces. A section or strategy of None is the one that the block began with."""

    def __init__(self, within: bool, depth: int, at: int):
        self.inside, self.depth, self.at = int(within), depth, at
        self.section = self.strategy = None
        self.count, self.order = 0, 0
        self.buffer: list[bytes] = []  # text since the last place below
        self.whole = False  # the buffer's record began in this block
        self.border = True  # the text beside the records began before this block
        self.pieces: list[tuple] = []

    def _add(self, kind: int, no: int, text: bytes | None = None) -> None:
        self.pieces.append((kind, no, self.section, self.strategy, text))

    def _beside(self, text: bytes, border: bool) -> None:
        """Commas between records are left out."""
        if text and (border or b'"' in text):
            self.order += 1
            self._add(BESIDE, self.order, text)

    def cut(self, text: bytes) -> None:
        places, sign, odd, all_odd = _braces(text)
        seen = (odd ^ self.inside) == 0
        places, sign = places[seen], sign[seen]
        after = self.depth + np.cumsum(sign)
        high = np.maximum(after, after - sign)  # the brace is between this depth and the one above
        marks = np.flatnonzero((high == self.at) | (high == self.at - 1))
        start = 0
        for place, opens, upper in zip(places[marks].tolist(), (sign[marks] == 1).tolist(), (high[marks] == self.at).tolist()):
            end = place if opens or not upper else place + 1
            piece = text[start:end]
            if self.buffer:
                piece, self.buffer = b"".join([*self.buffer, piece]), []
            start = end
            if upper and opens:
                last = piece.rstrip()[-1:]
                if last == b":":
                    self.section = ""
                elif last == b"[" and (m := _LIST.search(piece)):
                    self.section = m[1].decode("utf-8", "replace")
                self._beside(piece, self.border)
                self.count, self.whole, self.border = self.count + 1, True, False
            elif upper:
                self._add(RECORD if self.whole else PART, self.count, piece)
                self.border = False
            elif opens:
                if self.at == DEEP and (m := _OBJECT.search(piece)):
                    self.strategy = m[1].decode("utf-8", "replace")
                start, self.border = place + 1, False
            else:
                self._beside(piece, self.border)
                self.border = False
        self.buffer.append(text[start:])
        self.depth = int(after[-1]) if len(after) else self.depth
        self.inside ^= all_odd

    def end(self) -> list[tuple]:
        rest = b"".join(self.buffer)
        if self.depth >= self.at and rest:
            self._add(PART, self.count, rest)
        elif self.depth == self.at - 1:
            self._beside(rest, True)
        self._add(TOTALS, self.count)
        return self.taken()

    def taken(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


_PIECES = "path string, block long, kind int, no long, section string, strategy string, text binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks' pieces."""

    def table(key: tuple[str, int], pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces)) if pieces else [()] * 5
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()))]
        n = len(pieces)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), *made], names=[x.split()[0] for x in _PIECES.split(", ")])

    key = cutter = None
    for now, state, text in _stretches(batches):
        if now != key:
            if cutter:
                yield table(key, cutter.end())
            key, cutter = now, _Cutter(state["within"], state["depth"], state["at"])
        cutter.cut(text)
        yield table(key, cutter.taken())
    if cutter:
        yield table(key, cutter.end())


def read_backtest_export(spark: SparkSession, path: str, strategy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, heads) of exports, JSON files or ZIP files that hold one JSON export, at any depth below path.

    records: path, strategy, section (the list's name, as trades or locks), sequence in the list from 0, record (JSON text). heads: path, strategy, fields: the scalars beside the lists as a map of
    text. An export has a map of strategies, of which only the named one is kept if a name is given, or is one result without a name (`unknown`, or its strategy_name).
    """
    fragments = _fragments(spark, path)
    blocks = stored(fragments.mapInArrow(_totals, _TOTALS), "totals")  # one row a block, so windows by file are small
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier_sum = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    blocks = blocks.withColumn("within", earlier_sum("odd") % 2 == 1)
    blocks = blocks.withColumn("depth", earlier_sum(F.when(F.col("within"), F.col("rise_1")).otherwise(F.col("rise_0"))))
    mapped = F.coalesce(F.col("depth") + F.when(F.col("within"), F.col("map_1")).otherwise(F.col("map_0")) <= 1, F.lit(False))
    deep = F.max(mapped).over(Window.partitionBy("path"))
    states = blocks.select("path", "block", "within", "depth", F.when(deep, DEEP).otherwise(FLAT).alias("at"))
    pieces = stored(fragments.join(F.broadcast(states), ["path", "block"]).mapInArrow(_cut, _PIECES), "pieces", "zstd")
    carry = lambda c: F.last(c, ignorenulls=True).over(earlier)
    totals = pieces.where(F.col("kind") == TOTALS).select(F.col("path").alias("_p"), F.col("block").alias("_b"), earlier_sum("no").alias("_no"), carry("section").alias("_section"), carry("strategy").alias("_strategy"))
    rows = pieces.where(F.col("kind") != TOTALS).join(F.broadcast(totals), (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b")))
    rows = rows.select("path", "block", "kind", "no", (F.col("no") + F.col("_no")).alias("record_no"), F.coalesce("section", "_section").alias("section"), F.coalesce("strategy", "_strategy").alias("strategy"), F.col("text").cast("string").alias("text"))
    of, listed = ["path", "strategy", "section", "record_no"], F.col("section") != ""
    together = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda p: p["text"]), "")
    parts = rows.where((F.col("kind") == PART) & listed).groupBy(*of).agg(together("block").alias("record"))
    whole = rows.where((F.col("kind") == RECORD) & listed).select(*of, F.col("text").alias("record")).unionByName(parts)
    first = rows.where(F.col("kind").isin(RECORD, PART) & listed).groupBy(F.col("path").alias("_p"), F.col("strategy").alias("_s"), F.col("section").alias("_c")).agg(F.min("record_no").alias("_first"))
    same = (F.col("path") == F.col("_p")) & F.col("strategy").eqNullSafe(F.col("_s")) & (F.col("section") == F.col("_c"))
    records = whole.join(F.broadcast(first), same).select("path", "strategy", "section", (F.col("record_no") - F.col("_first")).cast("int").alias("sequence"), "record")  # one row a list

    scalar = rf'"({_INSIDE})"\s*:\s*("{_INSIDE}"|[^\s",\[\]{{}}:]++)'
    beside = rows.where(F.col("kind") == BESIDE).groupBy("path", "strategy").agg(together("block", "no").alias("text"))
    pairs = beside.select("path", "strategy", F.posexplode(F.regexp_extract_all("text", F.lit(f"({scalar})"), F.lit(1))).alias("no", "pair"))
    split = lambda k: F.regexp_extract("pair", f"^{scalar}$", k)
    value = F.when(split(2) != "null", F.regexp_replace(split(2), '^"|"$', ""))
    once = pairs.groupBy("path", "strategy", split(1).alias("key")).agg(F.min_by(F.struct(value.alias("value")), "no").alias("v"))
    heads = once.groupBy("path", "strategy").agg(F.map_from_entries(F.collect_list(F.struct("key", "v.value"))).alias("fields"))
    titles = heads.where("strategy is null").select(F.col("path").alias("_p"), F.try_element_at("fields", F.lit("strategy_name")).alias("_t"))
    titled = lambda df: df.join(titles, F.col("path") == F.col("_p"), "left").withColumn("strategy", F.coalesce("strategy", "_t", F.lit("unknown"))).drop("_p", "_t")
    records, heads = titled(records), titled(heads)
    return (records, heads) if strategy is None else (records.where(F.col("strategy") == strategy), heads.where(F.col("strategy") == strategy))


def _named(m: str, *names: str) -> Column:
    """The value of the first of these names that the object has, null or not."""
    out = F.when(F.map_contains_key(m, names[0]), F.col(m)[names[0]])
    for n in names[1:]:
        out = out.when(F.map_contains_key(m, n), F.col(m)[n])
    return out


def _text(*names: str, m: str = "m") -> Column:
    return F.nullif(_named(m, *names), F.lit(""))


def _number(*names: str, m: str = "m") -> Column:
    return canonical_decimal(_named(m, *names))


def _time(stamps: tuple[str, ...], dates: tuple[str, ...], m: str = "m") -> Column:
    return canonical_timestamp(_named(m, *stamps).try_cast("long"), _named(m, *dates))


# The fields of an export's trades, orders and results, older names behind newer ones.
_DECIMALS = {
    "open_rate": ("open_rate",), "close_rate": ("close_rate",), "amount": ("amount",), "stake_amount": ("stake_amount",), "max_stake_amount": ("max_stake_amount",), "leverage": ("leverage",), "fee_open": ("fee_open",),
    "fee_open_cost": ("fee_open_cost",), "fee_close": ("fee_close",), "fee_close_cost": ("fee_close_cost",), "funding_fees": ("funding_fees",), "profit_abs": ("profit_abs",), "profit_ratio": ("profit_ratio",),
    "liquidation_price": ("liquidation_price",), "initial_stop_loss": ("initial_stop_loss_abs", "initial_stop_loss"), "stop_loss": ("stop_loss_abs", "stop_loss"),
}
_DECIMALS_V2 = {"minimum_rate": ("min_rate",), "maximum_rate": ("max_rate",), "initial_stop_loss_ratio": ("initial_stop_loss_ratio",), "stop_loss_ratio": ("stop_loss_ratio",)}
_CONTEXT = ("trading_mode", "margin_mode", "timeframe", "timeframe_detail", "timerange")
_BALANCES = ("starting_balance", "final_balance", "profit_total_abs", "total_volume")
_COUNTS = ("total_trades", "rejected_signals", "timedout_entry_orders", "timedout_exit_orders", "canceled_trade_entries", "canceled_entry_orders", "replaced_entry_orders", "max_open_trades")


def normalize_trades(records: DataFrame, version: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, orders, locks) of records with canonical decimals, aliases resolved and an error code for rows out of range.

    Version 2 adds duration_minutes, is_open, minimum_rate, maximum_rate, initial_stop_loss_ratio, stop_loss_ratio and weekday to trades, and asks for them. error names the first of a trade's rules
    that is broken: pair, time, order (of open and close), amount, exit_reason, is_short; in version 2 also duration, is_open, weekday.
    """
    if version not in (1, 2):
        raise ValueError(f"no surface version {version}")
    m = records.withColumn("m", F.from_json("record", "map<string,string>"))
    t = m.where("section = 'trades'")
    opened, closed = _time(("open_timestamp",), ("open_date", "open_date_utc")), _time(("close_timestamp",), ("close_date", "close_date_utc"))
    flag = lambda *names, m="m": F.when(F.lower(_named(m, *names)).isin("true", "false"), F.lower(_named(m, *names)) == "true")
    whole = lambda n: F.when(_named("m", n).rlike(r"^\d+$"), _named("m", n).try_cast("int"))
    t = t.withColumns({"_open": opened, "_close": closed, "_pair": _text("pair"), "_short": flag("is_short"), "_reason": _text("exit_reason", "sell_reason")})
    # names are resolved once, before the patterns of decimals ask for them
    named = _DECIMALS | (_DECIMALS_V2 if version == 2 else {})
    t = t.withColumns({"_fee_open_currency": _text("fee_open_currency"), "_fee_close_currency": _text("fee_close_currency"), "_tag": _text("enter_tag", "buy_tag")})
    more = {"_duration": whole("trade_duration"), "_is_open": flag("is_open"), "_weekday": whole("weekday")} if version == 2 else {}
    # the record itself is not stored again
    t = stored(t.withColumns(more).select("path", "strategy", "sequence", "_open", "_close", "_pair", "_short", "_reason", "_fee_open_currency", "_fee_close_currency", "_tag", *more, *[_named("m", *n).alias(f"_d_{c}") for c, n in named.items()]), "named")
    decimal = lambda c: canonical_decimal(F.col(f"_d_{c}")).alias(c)
    trades = t.select(
        "path", "strategy", "sequence", F.col("_pair").alias("pair"), F.col("_short").alias("is_short"), F.col("_open.ts").alias("open_ts"), F.col("_close.ts").alias("close_ts"), *[decimal(c) for c in _DECIMALS],
        F.col("_fee_open_currency").alias("fee_open_currency"), F.col("_fee_close_currency").alias("fee_close_currency"), F.col("_tag").alias("entry_tag"), F.col("_reason").alias("exit_reason"),
        *([] if version == 1 else [F.col("_duration").alias("duration_minutes"), F.col("_is_open").alias("is_open"), *[decimal(c) for c in _DECIMALS_V2], F.col("_weekday").alias("weekday")]),
        F.coalesce("_open.error", "_close.error").alias("_time"), is_decimal(F.col("_d_amount")).alias("_sound"),
    )
    error = F.when(F.col("pair").isNull(), "pair").when(F.col("open_ts").isNull() | F.col("close_ts").isNull() | F.col("_time").isNotNull(), "time").when(F.col("close_ts") < F.col("open_ts"), "order")
    # not by the amount itself: below a condition the steps of a canonical decimal are evaluated again and again
    error = error.when(~F.coalesce("_sound", F.lit(False)), "amount").when(F.col("exit_reason").isNull(), "exit_reason").when(F.col("is_short").isNull(), "is_short")
    if version == 2:
        error = error.when(F.col("duration_minutes").isNull(), "duration").when(F.col("is_open").isNull(), "is_open").when(F.col("weekday").isNull() | (F.col("weekday") > 6), "weekday")
    trades = trades.withColumn("error", error).drop("_time", "_sound")
    o = m.where("section = 'trades'").select("path", "strategy", F.col("sequence").alias("trade"), F.posexplode(F.from_json(F.col("m")["orders"], "array<map<string,string>>")).alias("sequence", "o"))
    side = F.lower(_named("o", "ft_order_side", "side"))
    filled = _time(("order_filled_timestamp", "filled_timestamp"), ("order_filled_date", "filled_date"), "o")
    orders = o.select(
        "path", "strategy", "trade", "sequence", F.when(side.isin("buy", "sell"), side).alias("side"), flag("ft_is_entry", "is_entry", m="o").alias("is_entry"), _number("amount", "filled", m="o").alias("amount"),
        _number("safe_price", "average", "price", m="o").alias("price"), _number("cost", m="o").alias("cost"), filled["ts"].alias("ts"), _text("order_tag", "ft_order_tag", "tag", m="o").alias("tag"),
    )
    locks = m.where("section = 'locks'").select(
        "path", "strategy", "sequence", _text("pair").alias("pair"), _text("side").alias("side"), _named("m", "lock_timestamp").try_cast("long").alias("lock_ts"), _named("m", "lock_end_timestamp").try_cast("long").alias("lock_end"),
        _text("reason").alias("reason"), flag("active").alias("active"),
    )
    return trades, orders, locks


def normalize_summary(heads: DataFrame) -> DataFrame:
    """One row an export and strategy: context (trading and margin mode, timeframes, range), balances as canonical decimals, counts, and the first that is missing or out of range as error.

    version is 2 for a result that has all of these, 1 for one that has none of the balances.
    """
    f = heads.withColumn("m", F.col("fields"))
    out = f.select("path", "strategy", *[_text(c).alias(c) for c in _CONTEXT], *[_number(c).alias(c) for c in _BALANCES], *[F.when(_named("m", c).rlike(r"^\d+$"), _named("m", c).try_cast("long")).alias(c) for c in _COUNTS])
    error = F.when(~F.coalesce(F.col("trading_mode").isin("spot", "futures"), F.lit(False)), "trading_mode")
    for c in ("timeframe", "timerange", *_BALANCES, *_COUNTS):
        error = error.when(F.col(c).isNull(), c)
    bare = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in _BALANCES])
    return out.withColumn("version", F.when(bare, 1).otherwise(2)).withColumn("error", F.when(F.col("version") == 2, error))


#: Kinds of lines of a written surface, in order.
KINDS = ("summary", "lock", "trade")
#: Lines of one written part.
PART_LINES = 1_000_000


def with_orders(trades: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """Adds the column orders to trades: the list of a trade's orders in sequence, empty if it has none. orders: trade (the trade's `key`), sequence and what else an order has."""
    o = orders.groupBy(F.col("trade").alias("_trade")).agg(F.array_sort(F.collect_list(F.struct("sequence", *[c for c in orders.columns if c not in ("trade", "sequence")]))).alias("orders"))
    return trades.join(o, F.col(key) == F.col("_trade"), "left").drop("_trade").withColumn("orders", F.coalesce("orders", F.array()))


def write_surface(summary: DataFrame, locks: DataFrame, trades: DataFrame, orders: DataFrame | None, path: str, decimals: list[str]) -> DataFrame:
    """Write a surface as JSON lines, the summary first, then locks by their canonical order, then trades by sequence, each with its orders, and a manifest; returns the manifest as read back.

    Lines are in global order over the parts, of some PART_LINES each, so no part grows with the surface. Manifest: kind, lines, digest (the exclusive or of the lines' hashes), and errors: lines whose
    `decimals` are no canonical decimals. trades have sequence, orders trade (a sequence of trades) and sequence; without orders, trades have their list already (with_orders).
    """
    spark = trades.sparkSession
    rows = trades if orders is None else with_orders(trades, orders, "sequence")
    line = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    none, far = F.lit(None).cast("string"), F.lit(0).cast("long")
    wrong = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & ~canonical_decimal(F.col(c)).eqNullSafe(F.col(c)) for c in decimals if c in trades.columns], F.lit(False))
    parts = [
        summary.select(F.lit(0).alias("kind"), far.alias("a"), far.alias("b"), none.alias("c"), F.lit(False).alias("wrong"), line(summary).alias("value")),
        locks.select(F.lit(1).alias("kind"), F.col("lock_ts").alias("a"), F.col("lock_end").alias("b"), F.concat_ws("\u0001", "pair", "side", "reason").alias("c"), F.lit(False).alias("wrong"), line(locks).alias("value")),
        rows.select(F.lit(2).alias("kind"), F.col("sequence").cast("long").alias("a"), far.alias("b"), none.alias("c"), wrong.alias("wrong"), line(rows).alias("value")),
    ]
    every = stored(reduce(DataFrame.unionByName, parts), "lines", "zstd")
    name = lambda c: F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col(c) + 1)
    count = every.count()
    ordered = every.repartitionByRange(max(1, -(-count // PART_LINES)), "kind", "a", "b", "c").sortWithinPartitions("kind", "a", "b", "c")
    ordered.select(F.to_json(F.struct(name("kind").alias("kind"), "value")).alias("value")).write.text(f"{path}/lines")
    manifest = every.groupBy("kind").agg(F.count("*").alias("lines"), F.bit_xor(F.xxhash64("value")).alias("digest"), F.count_if("wrong").alias("errors"))
    manifest.select(name("kind").alias("kind"), "lines", "digest", "errors").coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema("kind string, lines long, digest long, errors long").json(f"{path}/manifest")


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value) of a written surface; ends with an error if its lines are not those of its manifest."""
    lines = spark.read.schema("kind string, value string").json(f"{path}/lines")
    manifest = spark.read.schema("kind string, lines long, digest long, errors long").json(f"{path}/manifest")
    seen = lines.groupBy("kind").agg(F.count("*").alias("lines"), F.bit_xor(F.xxhash64("value")).alias("digest"))
    if seen.exceptAll(manifest.select("kind", "lines", "digest")).limit(1).count() or manifest.count() != seen.count():
        raise ValueError(f"{path}: the lines are not those of the manifest")
    return lines
