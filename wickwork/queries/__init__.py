"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from wickwork.queries import candles, compare, files, joins, locks, plans, runs, scalars, signals, trades  # noqa: F401
from wickwork.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
