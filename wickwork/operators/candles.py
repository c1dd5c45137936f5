"""Candle operators: pair, ts (UTC epoch milliseconds), open, high, low, close, volume.

Windows run per pair, so their tasks grow with one pair's history and not with the number of pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from wickwork.functions.timeframes import DAY_MS, UNIT_MS, floor_to, timeframe_ms

PRICES = ("open", "high", "low", "close")


def by_time(*order: str, by: str = "pair") -> Window:
    return Window.partitionBy(by).orderBy(*(order or ("ts",)))


def dedup_keep_last(df: DataFrame) -> DataFrame:
    """The last row in file order (seq) of each (pair, ts)."""
    last = Window.partitionBy("pair", "ts").orderBy(F.desc("seq"))
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def merge_duplicates(df: DataFrame) -> DataFrame:
    """One candle per (pair, ts): first open, highest high, lowest low, last close, largest volume; NULLs are passed over."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return df.groupBy("pair", "ts").agg(first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.max("volume").alias("volume"))


def resample_origin(size_ms: int, first: Column) -> Column:
    """Where buckets are counted from: midnight of each pair's first day; weeks end on Monday, so their origin is a Tuesday's midnight."""
    if size_ms % UNIT_MS["w"] == 0:
        return F.lit(5 * DAY_MS)
    return floor_to(first, DAY_MS)


def resample(df: DataFrame, timeframe: str) -> DataFrame:
    """Buckets of a coarser timeframe: first open, max high, min low, last close, summed volume; ts is the bucket's start.

    Weekly buckets run from Tuesday to Monday and are named by that Monday.
    """
    size = timeframe_ms(timeframe)
    weekly = size % UNIT_MS["w"] == 0
    if weekly or DAY_MS % size == 0:  # the same grid for every first day
        start = floor_to(F.col("ts"), size, 5 * DAY_MS if weekly else 0)
        frame = df
    else:
        first = df.groupBy("pair").agg(F.min("ts").alias("_first"))
        frame = df.join(first, "pair")
        start = floor_to(F.col("ts"), size, resample_origin(size, F.col("_first")))
    start = start + (size - DAY_MS if weekly else 0)
    return frame.groupBy("pair", start.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bucket", "ts")


def fill_gaps(df: DataFrame, size_ms: int) -> DataFrame:
    """Put each pair on its whole grid: the close is carried, missing open, high and low take it, volume is 0."""
    grid = df.groupBy("pair").agg(F.explode(F.sequence(F.min("ts"), F.max("ts"), F.lit(size_ms))).alias("ts"))
    close = F.last("close", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    full = grid.join(df, ["pair", "ts"], "left").withColumn("close", close)
    return full.select("pair", "ts", *[F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")], "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def clean_candles(df: DataFrame, timeframe: str) -> DataFrame:
    """Merge duplicates, resample and fill gaps."""
    return fill_gaps(resample(merge_duplicates(df), timeframe), timeframe_ms(timeframe))


def filter_timerange(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows from start to end, the end included: forced exits need it."""
    kept = df if start is None else df.where(F.col("ts") >= start)
    return kept if end is None else kept.where(F.col("ts") <= end)


def slice_half_open(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows from start to before end; an empty range is an error."""
    if start >= end:
        raise ValueError("the slice is empty")
    return df.where((F.col("ts") >= start) & (F.col("ts") < end))


def startup_windows(df: DataFrame, timeframes: dict[str, int], start: int, end: int) -> DataFrame:
    """Of rows with a timeframe column, those from start - startup candles of their timeframe to end. timeframes: startup by timeframe."""
    kept = F.lit(False)
    for tf, startup in timeframes.items():
        kept = kept | ((F.col("timeframe") == tf) & (F.col("ts") >= start - startup * timeframe_ms(tf)) & (F.col("ts") <= end))
    return df.where(kept)


def execution_window(df: DataFrame, start: int, end: int, startup: int) -> DataFrame:
    """Executable rows and the context before them (is_context): the first row of the range, on which no signal can act yet, and up to `startup` rows before it.

    A pair with too little history loses as many rows of the range first. A pair without an executable row has none at all.
    """
    if startup < 0 or start > end:
        raise ValueError("startup must not be negative and the range must not end before it starts")
    whole = Window.partitionBy("pair")
    counts = {"_history": F.count_if(F.col("ts") < start).over(whole), "_all": F.count("*").over(whole)}
    ranked = df.where(F.col("ts") <= end).withColumns(counts).withColumn("_n", F.row_number().over(by_time()))
    head = F.col("_history") + F.greatest(F.lit(0), F.lit(startup) - F.col("_history")) + 1
    ranked = ranked.withColumn("is_context", F.col("_n") <= head).where((F.col("_n") >= head - startup) & (F.col("_all") > head))
    return ranked.drop("_n", "_history", "_all")


def validation_code(line: Window) -> Column:
    """Name of the first rule that a candle breaks, NULL if none. Funding columns count when present."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    not_finite = bad("open") | bad("high") | bad("low") | bad("close") | bad("volume")
    return (
        F.when(F.col("ts") < 0, "negative_time").when(not_finite, "not_finite").when(F.col("open") <= 0, "open_not_positive").when(F.col("high") < F.col("low"), "high_below_low")
        .when(F.col("low") <= 0, "low_not_positive").when(F.col("volume") < 0, "negative_volume").when(F.lag("ts").over(line) >= F.col("ts"), "time_not_increasing")
    )


def validate_candles(df: DataFrame, order: str = "ts") -> DataFrame:
    """The first offending row of each pair in the given order: pair, row, code."""
    line = by_time(order)
    extra = F.lit(None).cast("string")
    if "funding_rate" in df.columns:
        rate, mark = F.col("funding_rate"), F.col("mark_price")
        good = ~F.isnan(rate) & (F.abs(rate) != float("inf")) & ~F.isnan(mark) & (mark > 0) & (mark != float("inf"))
        extra = F.when(rate.isNull() != mark.isNull(), "half_funding").when(rate.isNotNull() & ~good, "bad_funding")
    if "enter_long" in df.columns:
        extra = F.coalesce(extra, F.when((F.coalesce("enter_long", F.lit(0)) != 0) & (F.coalesce("enter_short", F.lit(0)) != 0), "both_sides"))
    coded = df.withColumn("row", (F.row_number().over(line) - 1).cast("long")).withColumn("code", F.coalesce(validation_code(line), extra))
    return coded.where("code is not null").groupBy("pair").agg(F.min("row").alias("row"), F.min_by("code", "row").alias("code"))


def project_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Candles with the named features; a missing one is an error."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features are missing: {', '.join(missing)}")
    return df.select("pair", "ts", *PRICES, "volume", *[f for f in features if f not in (*PRICES, "volume")])


def encode_nonfinite(c: str) -> Column:
    """Text of a number; NaN and infinities become tagged values."""
    v = F.col(c)
    return F.when(v.isNull(), None).when(F.isnan(v), '{"$float":"nan"}').when(v == float("inf"), '{"$float":"inf"}').when(v == float("-inf"), '{"$float":"-inf"}').otherwise(_six_places(v))


@F.pandas_udf(StringType())
def _six_places(v: pd.Series) -> pd.Series:
    """Six places of the double's exact value, ties to even; format_string rounds the double's shortest text, and its ties up."""
    return v.map(lambda x: f"{x:.6f}", na_action="ignore")


def monthly_price_digits(df: DataFrame, seq: str = "ts") -> DataFrame:
    """Most meaningful fractional digits among the prices of each month: pair, month, digits, step.

    Distinct prices are written out once a month, with 14 significant digits. Prices without a fraction are passed over, and so are months with none else.
    """
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / DAY_MS).cast("int")), "yyyy-MM")
    prices = df.select("pair", month.alias("month"), F.explode(F.array(*PRICES)).alias("price")).where("price is not null").distinct()
    digits = F.greatest(F.lit(0), F.lit(14) - F.greatest(F.lit(1), F.floor(F.log10(F.greatest(F.abs("price"), F.lit(1e-9)))) + 1)).cast("int")
    text = F.expr("format_string(concat('%.', cast(_d as string), 'f'), price)")
    size = F.length(F.regexp_extract(text, r"\.([0-9]*[1-9])", 1))
    sized = prices.withColumn("_d", digits).withColumn("digits", size).where("digits > 0")
    return sized.groupBy("pair", "month").agg(F.max("digits").cast("int").alias("digits")).withColumn("step", F.round(F.pow(F.lit(10.0), -F.col("digits")), 12))


def step_changes(monthly: DataFrame) -> DataFrame:
    """A pair's first month and the months whose step differs from the month before."""
    before = F.lag("step").over(Window.partitionBy("pair").orderBy("month"))
    return monthly.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("step"))).drop("_before")


def coverage(df: DataFrame) -> DataFrame:
    """rows, first_ts, last_ts per pair."""
    return df.groupBy("pair").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def quality(df: DataFrame, size_ms: int, order: str = "seq") -> DataFrame:
    """duplicates, reversals, gaps, missing candles and the largest gap per pair, in file order."""
    gap = F.col("ts") - F.lag("ts").over(by_time(order))
    wide = F.col("gap") > size_ms
    return df.withColumn("gap", gap).groupBy("pair").agg(
        F.count_if(F.col("gap") == 0).alias("duplicates"), F.count_if(F.col("gap") < 0).alias("reversals"), F.count_if(wide).alias("gaps"),
        F.coalesce(F.sum(F.when(wide, F.floor(F.col("gap") / size_ms) - 1)), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap"),
    )


def interval_diff(df: DataFrame) -> DataFrame:
    """Milliseconds since the previous candle of the pair."""
    return df.withColumn("gap_ms", F.col("ts") - F.lag("ts").over(by_time()))


def previous_close(df: DataFrame) -> DataFrame:
    return df.withColumn("previous_close", F.lag("close").over(by_time()))


def lookback(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The previous row and its n predecessors as structs lag_1 .. lag_{n + 1}, NULL where there is none."""
    row = F.struct(*columns)
    return df.withColumns({f"lag_{k}": F.lag(row, k).over(by_time()) for k in range(1, n + 2)})


def return_bound(df: DataFrame, roi: float) -> DataFrame:
    """Largest possible return of each pair, and whether any pair can reach the lowest ROI. It is infinite for a lowest price of 0, and NaN if the highest is 0 too."""
    per = df.groupBy("pair").agg(F.max("high").alias("_high"), F.min("low").alias("_low"))
    none = F.when(F.col("_high") > 0, float("inf")).when(F.col("_high") < 0, float("-inf")).when(F.col("_high").isNotNull(), float("nan"))  # of a lowest price of 0
    per = per.select("pair", F.when(F.col("_low") == 0, none).otherwise(F.try_divide("_high", "_low") - 1).alias("bound"))
    return per.withColumn("roi_reachable", F.max("bound").over(Window.partitionBy()) >= roi)


def event_loop_volume(df: DataFrame, start: int) -> DataFrame:
    """Distinct times and pair rows from start on."""
    return df.where(F.col("ts") >= start).agg(F.count_distinct("ts").alias("timestamps"), F.count("*").alias("pair_rows"))


def row_slot(df: DataFrame, n: int) -> DataFrame:
    """Row number modulo n per pair."""
    return df.withColumn("slot", (F.row_number().over(by_time()) - 1) % n)


def pattern_entry(df: DataFrame) -> DataFrame:
    """enter_long where the previous candle rose, this one fell, and there was volume."""
    rose = F.lag("close").over(by_time()) > F.lag("open").over(by_time())
    return df.withColumn("enter_long", F.coalesce(rose & (F.col("close") < F.col("open")) & (F.col("volume") > 0), F.lit(False)).cast("int"))


def first_rule_match(df: DataFrame, rules: list[str]) -> DataFrame:
    """Index of the first rule (SQL condition) that holds, NULL if none."""
    index = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        index = F.when(F.expr(rule), k).otherwise(index)
    return df.withColumn("rule", index)


def replay_prefix(df: DataFrame, cutoff: int) -> DataFrame:
    """Candles up to the time of a difference; pairs without any are gone."""
    return df.where(F.col("ts") <= cutoff)
