"""Broadcasts that look at the size first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has ``rows`` rows at most; beyond that the planner shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
