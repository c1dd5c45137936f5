"""Strategies: Column functions over candles, or user functions on one pair's pandas frame.

A Column strategy takes and returns a DataFrame and stays inside Spark. A grouped strategy has populate_indicators,
populate_entry_trend and populate_exit_trend and gets one pair's whole history; one task holds one pair.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.functions.timeframes import timeframe_ms
from wickwork.operators.candles import by_time, clean_candles, execution_window, filter_timerange
from wickwork.operators.compare import differences
from wickwork.operators.joins import attach_funding, barrier_asks, coverage_gaps, first_exits, merge_informative, startup_shortfalls
from wickwork.operators.signals import FLAGS, shift_signals, signal_counts

ColumnStrategy = Callable[[DataFrame], DataFrame]
REQUIRED = ("pair", "ts", "open", "high", "low", "close", "volume")


def grouped(df: DataFrame, strategy: Any, schema: str, lookback_ms: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """Run a strategy object on each pair's frame, sorted by time. Its frames must have the columns of schema.

    With chunk_ms a frame is a chunk of a pair's time and the lookback_ms before it, which is trimmed off again, so a long pair is many tasks. That is right only for strategies whose rows depend on
    no more than lookback_ms of rows before them; a strategy declares it here or as its attribute `lookback_ms`, and chunks without it are refused. Rows of a frame keep their order by time.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        meta = {"pair": frame["pair"].iloc[0]}
        out = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        for step in (strategy.populate_indicators, strategy.populate_entry_trend, strategy.populate_exit_trend):
            out = step(out, meta)
        return out

    if chunk_ms is None:
        return df.groupBy("pair").applyInPandas(run, schema)
    back = getattr(strategy, "lookback_ms", None) if lookback_ms is None else lookback_ms
    if back is None or back < 0 or chunk_ms <= 0:
        raise ValueError("chunks need the look-back that the strategy declares")

    def run_chunk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = run(frame.drop(columns="_chunk"))
        return out[out["ts"] // chunk_ms == key[1]]

    chunks = F.sequence(F.floor(F.col("ts") / chunk_ms), F.floor((F.col("ts") + back) / chunk_ms))
    rows = df.withColumn("_chunk", F.explode(chunks))
    own = df.select("pair", F.floor(F.col("ts") / chunk_ms).alias("_chunk")).distinct()  # overlaps into time without rows are left out
    return rows.join(own, ["pair", "_chunk"], "left_semi").groupBy("pair", "_chunk").applyInPandas(run_chunk, schema)


def grouped_with_informative(df: DataFrame, informative: DataFrame, timeframe: str, coarser: str, strategy: Any, schema: str, lookback_ms: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """As grouped(), with the columns of a coarser timeframe merged in first, without lookahead."""
    return grouped(merge_informative(df, informative, timeframe, coarser, ffill=True), strategy, schema, lookback_ms, chunk_ms)


def validate_output(df: DataFrame) -> DataFrame:
    """Rows and rows that do not ascend in time of each pair; a missing column is an error."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"the strategy's frame lacks {', '.join(missing)}")
    back = F.lag("ts").over(by_time(*(["seq"] if "seq" in df.columns else ["ts"])))
    return df.withColumn("_b", back).groupBy("pair").agg(F.count("*").alias("rows"), F.count_if(F.col("_b") >= F.col("ts")).alias("not_ascending"))


def scan_lookahead(candles: DataFrame, strategy: ColumnStrategy, cutoffs: list[int], columns: list[str]) -> DataFrame:
    """Values at or before a cutoff that change when later candles are removed: cutoff, pair, ts, field, expected, actual. Empty for a sound strategy."""
    full = strategy(candles).select("pair", "ts", *columns)
    out = None
    for cut in cutoffs:
        key = F.concat_ws("@", "pair", "ts")
        part = strategy(candles.where(F.col("ts") <= cut)).select(key.alias("key"), *columns)
        found = differences(full.where(F.col("ts") <= cut).select(key.alias("key"), *columns), part, "key", columns).select(F.lit(cut).alias("cutoff"), "key", "field", "expected", "actual")
        out = found if out is None else out.unionByName(found)
    return out


def prepare_candles(
    candles: DataFrame, timeframe: str, start: int, end: int, startup: int, informative: dict[str, DataFrame] | None = None, pairs: list[str] | None = None, policy: str = "strict"
) -> tuple[DataFrame, DataFrame]:
    """(candles, coverage): raw candles cut to the range and its startup, cleaned, and joined with the cleaned informative candles of coarser timeframes (by name).

    coverage has one row a requested pair (all that are there, if none are named): first_ts, last_ts, start_missing, end_missing, accepted (by policy, see coverage_gaps) and missing_candles of the
    startup. Pairs that are not accepted have no candles. Informative candles begin as many of their own candles before the range.
    """
    size = timeframe_ms(timeframe)
    pairs = sorted(r["pair"] for r in candles.select("pair").distinct().collect()) if pairs is None else pairs
    coverage = coverage_gaps(candles, pairs, size, start, end, policy).join(startup_shortfalls(candles, pairs, size, start, startup), "pair")
    accepted = coverage.where("accepted").select("pair")
    own = filter_timerange(candles.join(accepted, "pair", "left_semi"), start - startup * size, end)
    out = clean_candles(own, timeframe)
    for coarser, rows in (informative or {}).items():
        wide = filter_timerange(rows, start - startup * timeframe_ms(coarser), end)
        out = merge_informative(out, clean_candles(wide, coarser), timeframe, coarser)
    return out, coverage


def prepare_signals(candles: DataFrame, strategy: ColumnStrategy, start: int, end: int, events: DataFrame | None = None, startup: int = 0) -> tuple[DataFrame, DataFrame]:
    """(signals, counts): strategy, shift to the next candle, execution window, funding, and counts by pair of the executable rows.

    signals keep the rows before the first executable one, up to startup and the first of the range, as is_context: rules may look back at them, no signal on them is traded.
    """
    shifted = execution_window(shift_signals(strategy(candles)), start, end, startup)
    out = attach_funding(shifted, events) if events is not None else shifted
    executable = out.where("not is_context").select("pair", *[F.col(f"exec_{c}").alias(c) for c in FLAGS])
    return out, signal_counts(executable)


def candidate_sweep(entries: DataFrame, candles: DataFrame, candidates: list[tuple[str, float, int]]) -> DataFrame:
    """One report row a candidate (name, stop, timeout_ms), in the order given: trades, wins and the mean ratio of its exits, status (completed or failed) and error.

    All candidates are rows of one plan: entries times candidates ask the blocks of one scan of the candles. A candidate that cannot be run (a stop that is no share, a timeout below 0) is a
    failed row and does not end the sweep.
    """
    spark = entries.sparkSession
    table = spark.createDataFrame([(k, n, None if s is None else float(s), t) for k, (n, s, t) in enumerate(candidates)], "position int, candidate string, stop double, timeout long")
    bad = F.when(F.col("stop").isNull() | F.isnan("stop") | (F.col("stop") <= 0), "stop").when(F.col("timeout").isNull() | (F.col("timeout") < 0), "timeout")
    table = table.withColumn("error", bad)
    each = F.array(*[F.struct(F.lit(k).alias("_position"), F.lit(float(s)).alias("_share"), F.lit(t).cast("long").alias("_timeout")) for k, (_, s, t) in enumerate(candidates) if s is not None and s > 0 and t is not None and t >= 0])
    asks = entries.select("*", F.explode(each.cast("array<struct<_position:int,_share:double,_timeout:bigint>>")).alias("_c")).select(*entries.columns, "_c.*")
    exits = first_exits(barrier_asks(asks, F.col("_share"), F.col("_timeout")), candles, ["trade_id", "_position"])
    ratio = F.when(F.col("is_short"), 1 - F.col("exit_rate") / F.col("open_rate")).otherwise(F.col("exit_rate") / F.col("open_rate") - 1)
    report = exits.withColumn("_r", ratio).groupBy(F.col("_position").alias("position")).agg(
        F.count("*").alias("trades"), F.count_if(F.col("_r") > 0).alias("wins"), F.round(F.avg(F.round("_r", 8).cast("decimal(28,8)")).cast("double"), 4).alias("mean_ratio")
    )
    status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    none = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0).cast("long")))
    return table.join(report, "position", "left").select("position", "candidate", none("trades").alias("trades"), none("wins").alias("wins"), "mean_ratio", status.alias("status"), "error").orderBy("position")
