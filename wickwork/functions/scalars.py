"""Scalar functions for rules, as Columns: what a strategy's conditions need beyond Spark's own operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: last parts of the names whose values a configuration row hides.
SECRET_KEY = r"(?i)(^|[._-])(api[_-]key|apikey|key|password|secret|token)$"
REDACTED = "<redacted>"


def floor_divide(a: Column, b: Column) -> Column:
    """Quotient rounded down; NULL on division by zero."""
    return F.floor(a / F.nullif(b, F.lit(0)))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; NULL on division by zero."""
    d = F.nullif(b, F.lit(0))
    return a - F.floor(a / d) * d


def truthy(c: Column, kind: str) -> Column:
    """Whether a value counts as true: a number other than 0, a non-empty text or list; NULL does not. kind: number, text, list or bool."""
    test = {"number": lambda: c != 0, "text": lambda: F.length(c) > 0, "list": lambda: F.size(c) > 0, "bool": lambda: c}[kind]()
    return F.coalesce(test, F.lit(False))


def chained(*parts: Column) -> Column:
    """a < b < c as one condition; parts must not fall or repeat."""
    out = F.lit(True)
    for a, b in zip(parts, parts[1:]):
        out = out & (a < b)
    return out


def item(values: Column, index: Column) -> Column:
    """Element by index from 0, negative ones from the end; NULL outside."""
    at = F.when(index >= 0, index + 1).otherwise(index)
    return F.try_element_at(values, at.cast("int"))


def char_at(text: Column, index: Column) -> Column:
    """Character by index from 0, negative ones from the end; NULL outside."""
    n = F.length(text)
    at = F.when(index < 0, index + n).otherwise(index)
    return F.when((at >= 0) & (at < n), F.substring(text, (at + 1).cast("int"), F.lit(1)))


def value_text(c: Column, kind: str) -> Column:
    """Text of a value as Python writes it: True, None, 1.0."""
    if kind == "bool":
        return F.when(c, "True").when(~c, "False").otherwise("None")
    return F.coalesce(c.cast("string"), F.lit("None"))


def words(text: Column) -> Column:
    """Words between white space, none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def all_in(values: Column, allowed: Column) -> Column:
    return F.size(F.array_except(values, allowed)) == 0


def any_in(values: Column, allowed: Column) -> Column:
    return F.coalesce(F.arrays_overlap(values, allowed), F.lit(False))


def partition(text: Column, mark: str) -> Column:
    """(before, mark, after) at the first mark; (text, '', '') without one."""
    at = F.instr(text, mark)
    found = at > 0
    return F.struct(F.when(found, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("before"), F.when(found, mark).otherwise("").alias("mark"), F.when(found, F.substring(text, at + len(mark), F.length(text))).otherwise("").alias("after"))


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def at_least(stake: Column, least: Column) -> Column:
    """Stake raised to the minimum."""
    return F.greatest(stake, least)


def first_present(*fields: tuple[Column, Column]) -> Column:
    """Value of the first alias that is present, even when it is NULL. fields: (present, value)."""
    out = F.lit(None)
    for present, value in reversed(fields):
        out = F.when(present, value).otherwise(out)
    return out


def canonical_timestamp(ms: Column, iso: Column) -> Column:
    """Struct (ts, error): integer milliseconds and an ISO date must agree if both are given; a date without a zone is UTC."""
    zoned = F.when(iso.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    from_iso = F.unix_millis(F.try_to_timestamp(zoned))
    ts = F.coalesce(ms, from_iso)
    error = F.when(ms.isNull() & iso.isNull(), "missing").when(iso.isNotNull() & from_iso.isNull(), "not_a_date").when(ms != from_iso, "disagree")
    return F.struct(F.when(error.isNull(), ts).alias("ts"), error.alias("error"))


def protection_timing(minutes: Column, candles: Column, unlock_at: Column, candle_ms: int) -> Column:
    """Struct (duration_ms, unlock_at, error): minutes or candles, not both, an hour by default; or an unlock time HH:MM instead."""
    both = minutes.isNotNull() & candles.isNotNull()
    clash = unlock_at.isNotNull() & (minutes.isNotNull() | candles.isNotNull())
    shape = unlock_at.isNotNull() & ~unlock_at.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$")
    error = F.when(both, "two_durations").when(clash, "duration_and_unlock").when(shape, "unlock_at").when((minutes <= 0) | (candles <= 0), "not_positive")
    span = F.coalesce(minutes * 60_000, candles * candle_ms, F.lit(3_600_000)).cast("long")
    return F.struct(F.when(error.isNull() & unlock_at.isNull(), span).alias("duration_ms"), F.when(error.isNull(), unlock_at).alias("unlock_at"), error.alias("error"))


def redacted(settings: Column) -> Column:
    """Map of flattened settings with the values of secret names hidden."""
    return F.transform_values(settings, lambda k, v: F.when(k.rlike(SECRET_KEY) & (v != ""), REDACTED).otherwise(v))


def canonical_json(c: Column) -> Column:
    """SHA-256 of a struct's JSON; list the fields in name order."""
    return F.sha2(F.to_json(c), 256)


def exact_sum(c: Column, places: int = 8) -> Column:
    """Sum that does not depend on the order of rows."""
    return F.sum(F.round(c, places).cast(f"decimal(28,{places})"))
