"""Broadcast only what was counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.session import materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def file_bytes(table: DataFrame) -> int:
    """Size of a written table as Spark takes it from its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, stored: bool = False) -> DataFrame:
    """Write a dimension out, measure it, and mark it for broadcast only up to ``BROADCAST_BYTES`` of files and ``max_rows`` rows.

    Beyond that the plain frame is returned and the join shuffles, with adaptive execution splitting skewed
    partitions. ``stored`` says that ``df`` is such a table already.
    """
    table = df if stored else materialize(df)
    return F.broadcast(table) if file_bytes(table) <= BROADCAST_BYTES and table.count() <= max_rows else table
