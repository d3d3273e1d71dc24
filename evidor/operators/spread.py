"""Partitions by the number of rows, so that a task's share does not grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows to a task. Byte targets do not bound them, as sorted keys are compressed to a byte or two.
ROWS = 1 << 19


def tasks(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows: ROWS in each, and not fewer than there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys``; its rows are counted first."""
    return df.repartition(tasks(df, df.count()), *keys)
