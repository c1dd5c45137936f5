"""Time: timeframes, time ranges and UTC epoch milliseconds.

All operators carry time as `ts`, a long of UTC epoch milliseconds, so nothing depends on a session's time zone.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Milliseconds of a timeframe's unit; a month counts as 30 days.
UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "M": 2_592_000_000}
DAY_MS = UNIT_MS["d"]


def timeframe_ms(text: str) -> int:
    """Milliseconds of a timeframe such as 5m, 1h, 1d, 1w or 1M."""
    m = re.fullmatch(r"([1-9]\d*)([smhdwM])", text)
    if not m:
        raise ValueError(f"not a timeframe: {text!r}")
    return int(m[1]) * UNIT_MS[m[2]]


def timeframe_ms_col(text: Column) -> Column:
    """timeframe_ms of a column; NULL where the text is not a timeframe."""
    shape = r"^([1-9][0-9]*)([smhdwM])$"
    unit = F.regexp_extract(text, shape, 2)
    size = F.lit(None).cast("long")
    for k, v in UNIT_MS.items():
        size = F.when(unit == k, F.lit(v)).otherwise(size)
    return F.try_to_number(F.nullif(F.regexp_extract(text, shape, 1), F.lit("")), F.lit("999999999")).cast("long") * size


def instant_ms(text: Column) -> Column:
    """Bound of a time range: 8 digits are a date, 10 digits seconds, 13 digits milliseconds; NULL for anything else."""
    number = F.when(text.rlike("^[0-9]+$"), text)
    days = F.datediff(F.to_date(F.when(F.length(number) == 8, number), "yyyyMMdd"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.when(F.length(number) == 8, days * DAY_MS).when(F.length(number) == 10, number.cast("long") * 1000).when(F.length(number) == 13, number.cast("long"))


def parse_timerange(text: str) -> tuple[int | None, int | None]:
    """(start, end) in milliseconds of `START-END`; an empty side is open."""
    m = re.fullmatch(r"(\d{8}|\d{10}|\d{13})?-(\d{8}|\d{10}|\d{13})?", text)
    if not m or not (m[1] or m[2]):
        raise ValueError(f"not a time range: {text!r}")

    def side(x: str | None) -> int | None:
        if not x:
            return None
        if len(x) == 8:
            return int(datetime.strptime(x, "%Y%m%d").replace(tzinfo=timezone.utc).timestamp()) * 1000
        return int(x) * (1000 if len(x) == 10 else 1)

    start, end = side(m[1]), side(m[2])
    if start is not None and end is not None and start >= end:
        raise ValueError(f"{text!r} ends before it starts")
    return start, end


def trailing_year(end: Column) -> Column:
    """First day of the year that ends with a date: twelve months earlier, 29 February becoming 28."""
    return F.add_months(end, -12)


def calendar_years(year: Column, n: int) -> Column:
    """The n calendar years before a year, as structs (first day, first day after), newest first."""
    day = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(day(year - k).alias("start"), day(year - k + 1).alias("end")))


def to_ms(df: DataFrame, name: str) -> Column:
    """A timestamp column of df (with or without time zone, or already a long) as UTC epoch milliseconds, floored."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        # without a zone the value is UTC wall-clock time
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`) div 1000")
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(F.col(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long") * DAY_MS
    return F.col(name).cast("long")


def floor_to(ts: Column, size_ms: int, origin: Column | int = 0) -> Column:
    """Start of the bucket of size_ms that holds ts, counted from origin."""
    base = origin if isinstance(origin, Column) else F.lit(origin)
    return ts - F.pmod(ts - base, F.lit(size_ms))


def duration_minutes(open_ts: Column, close_ts: Column) -> Column:
    """Whole minutes between two instants."""
    return F.floor((close_ts - open_ts) / 60_000).cast("long")


def weekday(ts: Column) -> Column:
    """Day of the week of an instant, Monday = 0; 1 January 1970 was a Thursday."""
    return F.pmod(F.floor(ts / DAY_MS) + 3, F.lit(7)).cast("int")
