"""Size-checked broadcast: broadcast a side only when it is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows above which a side is joined by shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows + 1`` rows of
    ``df`` (a bounded action); beyond the bound the frame is returned as is
    and Spark/AQE choose a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def sized(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """``(df or broadcast(df), is_small)``: frames derived from a small side
    (at most as many rows) may then be broadcast too."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df
