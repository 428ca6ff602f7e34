"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``max_rows`` rows (counted with a limit), otherwise ``df`` as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
