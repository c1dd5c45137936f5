"""Files: candle sets, exports, state events, markets, signal vectors, trade surfaces, inventories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.feather
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.functions.timeframes import to_ms
from wickwork.operators.candles import dedup_keep_last, startup_windows

CANDLE_COLUMNS = ("date", "open", "high", "low", "close", "volume")
#: Fixed value: the shape of a candle file's name.
FILE_NAME = r"([^/]+?)-([0-9]+[smhdwM])(-spot|-futures)?\.(feather|parquet)$"
#: Name parts of side inputs that are no candle files.
SIDE_INPUTS = ("funding_rate", "-mark", "-index", "premiumIndex")


def pair_of_file(path: Column) -> Column:
    """BASE/QUOTE of a file name BASE_QUOTE-timeframe; a third part is the settle currency."""
    stem = F.regexp_extract(path, FILE_NAME, 1)
    parts = F.split(stem, "_")
    name = F.concat(parts[0], F.lit("/"), F.try_element_at(parts, F.lit(2)))
    return F.when(F.size(parts) == 2, name).when(F.size(parts) == 3, F.concat(name, F.lit(":"), F.try_element_at(parts, F.lit(3))))


def candle_file_catalog(paths: DataFrame) -> DataFrame:
    """path -> pair, timeframe, mode, kind and error. Side inputs are left out; files that share pair, timeframe and mode are an error.

    kind is feather or parquet; error is `name` for a file that is no candle file, `repeated` for one of several.
    """
    side = F.lit(False)
    for part in SIDE_INPUTS:
        side = side | F.col("path").contains(part)
    mode = F.regexp_extract("path", FILE_NAME, 3)
    named = paths.where(~side).select(
        "path", pair_of_file(F.col("path")).alias("pair"), F.nullif(F.regexp_extract("path", FILE_NAME, 2), F.lit("")).alias("timeframe"),
        F.when(mode == "-futures", "futures").otherwise("spot").alias("mode"), F.nullif(F.regexp_extract("path", FILE_NAME, 4), F.lit("")).alias("kind"),
    )
    copies = F.count("*").over(Window.partitionBy("pair", "timeframe", "mode"))
    bad = F.col("pair").isNull() | F.col("timeframe").isNull()
    return named.withColumn("error", F.when(bad, "name").when(copies > 1, "repeated"))


def _required(df: DataFrame) -> DataFrame:
    missing = [c for c in CANDLE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"candle files lack {', '.join(missing)}")
    return df


def read_candles(spark: SparkSession, root: str, kind: str = "parquet") -> DataFrame:
    """Candles below root: pair, timeframe, ts, OHLCV, seq; sorted input is not needed, the last of repeated times is kept.

    Parquet files may be partitioned by pair and timeframe, or be named BASE_QUOTE-timeframe. Feather files are read on the executors, one file a task at a time.
    """
    if kind == "parquet":
        df = _required(spark.read.option("recursiveFileLookup", "false").parquet(root))
        if "pair" not in df.columns:
            name = F.col("_metadata.file_path")
            df = df.withColumns({"pair": pair_of_file(name), "timeframe": F.regexp_extract(name, FILE_NAME, 2)})
        order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        rows = df.withColumns({"ts": to_ms(df, "date"), "seq": order})
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").option("recursiveFileLookup", "true").load(root)
        rows = files.select("path", "content").mapInArrow(_feather_rows, "pair string, timeframe string, ts long, open double, high double, low double, close double, volume double, seq long")
        return dedup_keep_last(rows)
    return dedup_keep_last(rows.select("pair", "timeframe", "ts", "open", "high", "low", "close", "volume", "seq"))


def _feather_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            name = re.search(FILE_NAME, path.as_py())
            if not name:
                continue
            parts = name[1].split("_")
            seen = 0
            for frame in _feather_parts(content.as_buffer()):
                when = pd.to_datetime(frame["date"], utc=True)
                out = pd.DataFrame({"pair": "/".join(parts[:2]) + "".join(f":{p}" for p in parts[2:]), "timeframe": name[2], "ts": (when - pd.Timestamp(0, tz="UTC")) // pd.Timedelta("1ms")})
                for c in CANDLE_COLUMNS[1:]:
                    out[c] = frame[c].astype("float64")
                out["seq"] = range(seen, seen + len(out))
                seen += len(out)
                yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()


def _feather_parts(content: pa.Buffer) -> Iterator[pd.DataFrame]:
    """A file's batches, each as a frame; files of the first version have one."""
    names = list(CANDLE_COLUMNS)
    if content[:6].to_pybytes() != b"ARROW1":
        yield pyarrow.feather.read_table(pa.BufferReader(content), columns=names).to_pandas()
        return
    with pa.ipc.open_file(pa.BufferReader(content)) as f:
        for k in range(f.num_record_batches):
            yield f.get_batch(k).select(names).to_pandas()


def write_compact_candles(df: DataFrame, timeframes: dict[str, int], start: int, end: int, path: str) -> DataFrame:
    """Write the candles that a run needs, partitioned by pair and timeframe; rows before and after by pair and timeframe. df: candles with timeframe."""
    kept = startup_windows(df, timeframes, start, end)
    kept.repartition("pair", "timeframe").write.partitionBy("pair", "timeframe").parquet(path)
    before = df.groupBy("pair", "timeframe").agg(F.count("*").alias("rows_before"))
    after = df.sparkSession.read.parquet(path).groupBy("pair", "timeframe").agg(F.count("*").alias("rows_after"))
    return before.join(after, ["pair", "timeframe"], "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0).cast("long")))


def read_signal_vectors(spark: SparkSession, path: str, features: list[str], can_short: bool = False, funding: bool = False) -> DataFrame:
    """Only the columns that the flags ask for; tags that are absent are NULL, and a missing required column is an error."""
    df = spark.read.parquet(path)
    need = ["pair", "ts", "open", "high", "low", "close", "volume", "enter_long", "exit_long", *["enter_short", "exit_short"] * can_short, *["funding_rate", "mark_price"] * funding, *features]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"signal vectors lack {', '.join(missing)}")
    tags = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("enter_tag", "exit_tag")]
    return df.select(*need, *tags)


def write_trade_surface(trades: DataFrame, orders: DataFrame, path: str) -> DataFrame:
    """Write one JSON line a trade with its orders in sequence, and read the lines back: trade_id, surface.

    trades and orders share trade_id; a trade's orders are few.
    """
    o = orders.groupBy("trade_id").agg(F.array_sort(F.collect_list(F.struct("sequence", *[c for c in orders.columns if c not in ("trade_id", "sequence")]))).alias("orders"))
    rows = trades.join(o, "trade_id", "left").withColumn("orders", F.coalesce("orders", F.array()))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return trades.sparkSession.read.text(path).select(F.get_json_object("value", "$.trade_id").cast("long").alias("trade_id"), F.col("value").alias("surface"))


def read_state_events(spark: SparkSession, path: str) -> DataFrame:
    """State events of JSON lines with every number as the text that the file holds."""
    key = "sequence long, ts long, phase string, pair string, callback string, state string"
    return spark.read.schema(key).option("primitivesAsString", "true").json(path)


_TIER = "array<struct<minNotional:string,maxNotional:string,maxLeverage:string,maintenanceMarginRate:string,maintAmt:string,info:struct<cum:string>>>"
MARKETS = f"map<string,struct<precision:struct<amount:string,price:string>,limits:struct<amount:struct<min:string>,cost:struct<min:string>,leverage:struct<max:string>>,taker:string,tiers:{_TIER}>>"


def read_markets(spark: SparkSession, path: str, decimal_places: bool = False) -> tuple[DataFrame, DataFrame]:
    """(markets, tiers) of JSON files that map pairs to market records. With decimal_places precisions are numbers of digits; a missing maintenance amount falls back to info.cum."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MARKETS)).alias("pair", "m"))
    step = lambda c: F.pow(F.lit(10.0), -F.col(c).cast("double")) if decimal_places else F.col(c).cast("double")
    markets = m.select(
        "pair", step("m.precision.amount").alias("amount_step"), step("m.precision.price").alias("price_step"), F.col("m.limits.amount.min").cast("double").alias("amount_min"),
        F.col("m.limits.cost.min").cast("double").alias("cost_min"), F.col("m.limits.leverage.max").cast("double").alias("leverage_max"), F.col("m.taker").cast("double").alias("taker"),
    )
    t = m.select("pair", F.posexplode("m.tiers").alias("tier_no", "t"))
    num = lambda c: F.col(f"t.{c}").cast("double")
    tiers = t.select("pair", "tier_no", num("minNotional").alias("min_notional"), num("maxNotional").alias("max_notional"), num("maxLeverage").alias("max_leverage"), num("maintenanceMarginRate").alias("maintenance_rate"), F.coalesce(num("maintAmt"), num("info.cum")).alias("maintenance_amount"))
    return markets, tiers


def file_inventory(spark: SparkSession, root: str, kind: str = "parquet", time: str = "ts") -> DataFrame:
    """path (without scheme), bytes, sha256, rows, first_ts, last_ts of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(root)
    name = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    sums = files.select(name("path").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    data = spark.read.option("recursiveFileLookup", "true").parquet(root)
    rows = data.groupBy(name(F.col("_metadata.file_path")).alias("path")).agg(F.count("*").alias("rows"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    return sums.join(rows, "path", "left")


def read_profile_lines(spark: SparkSession, path: str) -> DataFrame:
    """Profile events of JSON lines; a line that cannot be parsed has NULL fields and the error `json`."""
    schema = "arrival long, phase string, calls long, total double, longest double, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("error", F.when(F.col("_bad").isNotNull(), "json")).drop("_bad")
