"""Signals: flags and tags on candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.operators.candles import by_time

FLAGS = ("enter_long", "enter_short", "exit_long", "exit_short")
TAGS = ("enter_tag", "exit_tag")
#: Fixed value: what stands for an empty tag column in transport.
EMPTY_MARKER = "__nfi_bte_empty_tag_column__"


def is_enabled(c: Column) -> Column:
    """On: not NULL, not NaN, not 0."""
    v = c.cast("double")
    return F.coalesce(~F.isnan(v) & (v != 0), F.lit(False))


def normalize_tag(c: Column) -> Column:
    """Empty tags and the transport marker are NULL."""
    return F.when(c.isin("", EMPTY_MARKER), None).otherwise(c)


def shift_signals(df: DataFrame) -> DataFrame:
    """exec_* columns: flags and tags of the candle before; the first row has none, absent flag columns are off."""
    line = by_time()
    flags = {f"exec_{c}": F.coalesce(F.lag(is_enabled(F.col(c)).cast("int")).over(line), F.lit(0)) if c in df.columns else F.lit(0) for c in FLAGS}
    tags = {f"exec_{c}": F.lag(normalize_tag(F.col(c))).over(line) if c in df.columns else F.lit(None).cast("string") for c in TAGS}
    return df.withColumns(flags | tags)


def any_signal() -> Column:
    on = is_enabled(F.col(FLAGS[0]))
    for c in FLAGS[1:]:
        on = on | is_enabled(F.col(c))
    return on


def signal_counts(df: DataFrame) -> DataFrame:
    """Rows and enabled rows by flag of each pair."""
    return df.groupBy("pair").agg(F.count("*").alias("rows"), *[F.count_if(is_enabled(F.col(c))).alias(c) for c in FLAGS])


def signal_rows(df: DataFrame) -> DataFrame:
    """Rows, signal rows and a digest of them per pair.

    The digest is the sum of 48-bit hashes of the rows' text modulo 2^48, so it does not depend on order, needs no group in one place and never overflows.
    """
    text = F.concat_ws("|", "ts", *FLAGS, F.coalesce("enter_tag", F.lit("-")), F.coalesce("exit_tag", F.lit("-")))
    part = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    on = any_signal()
    return df.groupBy("pair").agg(F.count("*").alias("rows"), F.count_if(on).alias("signal_rows"), F.coalesce(F.sum(F.when(on, part).cast("decimal(20,0)")) % F.lit(1 << 48).cast("decimal(20,0)"), F.lit(0)).cast("long").alias("digest"))


def signal_feature_samples(df: DataFrame, times: list[int], features: list[str]) -> DataFrame:
    """Features at the given times and on all signal rows."""
    return df.where(F.col("ts").isin(times) | any_signal()).select("pair", "ts", *features)


def tag_scope(df: DataFrame, scope: list[str], tag: str = "enter_tag") -> DataFrame:
    """supported (non-empty and every word in scope) and the unknown words of each tag."""
    words = F.filter(F.split(F.coalesce(F.col(tag), F.lit("")), r"\s+"), lambda w: w != "")
    known = F.array(*map(F.lit, scope)) if scope else F.array().cast("array<string>")
    unknown = F.array_sort(F.array_except(words, known))
    return df.withColumn("supported", (F.size(words) > 0) & (F.size(unknown) == 0)).withColumn("unknown_words", F.array_join(unknown, " "))


def entry_eligible(df: DataFrame) -> DataFrame:
    """False on the last row of a pair, which serves exits only."""
    return df.withColumn("entry_eligible", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("ts"))) > 1)


def next_entry(df: DataFrame) -> DataFrame:
    """Time of the next entry at or after each row of the pair."""
    ahead = by_time().rowsBetween(0, Window.unboundedFollowing)
    entry = is_enabled(F.col("enter_long")) | is_enabled(F.col("enter_short"))
    return df.withColumn("next_entry_ts", F.min(F.when(entry, F.col("ts"))).over(ahead))


def tag_leverage(tag: Column, rules: list[tuple[list[str], float]], default: float) -> Column:
    """Leverage of the first rule whose set holds every word of the tag; no tag matches the first rule."""
    words = F.filter(F.split(F.coalesce(tag, F.lit("")), r"\s+"), lambda w: w != "")
    out = F.lit(default)
    for names, value in reversed(rules):
        unknown = F.array_except(words, F.array(*map(F.lit, names)))
        out = F.when(F.size(unknown) == 0, F.lit(float(value))).otherwise(out)
    return out


def entry_leverage(signal: Column, by_tag: Column, config: Column, cap: Column) -> Column:
    """First of signal, tag rule and configuration, else 1; capped by the market and never below 1."""
    return F.greatest(F.lit(1.0), F.least(F.coalesce(signal, by_tag, config, F.lit(1.0)), F.coalesce(cap, F.lit(float("inf")))))
