"""Joins against tables that should be small, with a check that they are."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(small: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if it holds at most ``max_rows`` rows and 64 MB.

    Larger tables come back without the hint, so the join shuffles and adaptive
    execution splits skewed partitions. The rows are counted once and kept for
    the join, which also tells their bytes; a lost executor only means they are
    worked out again.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    if small.limit(max_rows + 1).count() > max_rows or stored_bytes(small) > BROADCAST_BYTES:
        return small
    return F.broadcast(small)


def stored_bytes(kept: DataFrame) -> int:
    """Size of a persisted table that has been read as a whole."""
    plan = kept.select("*")._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))
