"""The flagship query: from events to a summary of labelled entries by pair and exit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.functions.timeframes import DAY_MS, UNIT_MS
from wickwork.operators.candles import clean_candles, pattern_entry
from wickwork.operators.joins import first_barrier
from wickwork.operators.signals import shift_signals
from wickwork.operators.trades import summary_by_pair
from wickwork.sources.tables import ticks


def flagship(spark: SparkSession, sf_dir: str, timeframe: str = "6h") -> DataFrame:
    """Clean candles, a pattern entry shifted to the next candle, the first barrier of each entry, and trades, wins and mean ratio by pair and exit."""
    candles = clean_candles(ticks(spark, sf_dir, UNIT_MS["h"]), timeframe)
    signals = pattern_entry(candles).withColumn("exit_long", (F.col("close") > 2 * F.col("open")).cast("int")).withColumn("exit_short", F.lit(0))
    entries = shift_signals(signals).where("exec_enter_long = 1")
    entries = entries.select(F.concat_ws("@", "pair", "ts").alias("trade_id"), "pair", F.col("ts").alias("open_ts"), F.col("open").alias("open_rate"), F.lit(False).alias("is_short"))
    return summary_by_pair(first_barrier(entries, signals, 0.6, 2 * DAY_MS))
