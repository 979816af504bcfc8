"""Scan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Rows that one task parses and judges: a second or two of work.
ROWS_PER_TASK = 10_000


def tasks_for(df: DataFrame) -> int:
    """Tasks of about ROWS_PER_TASK rows each, at least one per core. Counting a scan reads file footers only."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a narrow scan over tasks of bounded size.

    The splits of a scan go by bytes: a file of few large row groups gives as many tasks with rows as it has groups,
    whatever the number of its splits, and the rows of a task grow with the table.
    """
    return df.repartition(tasks_for(df), key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of very few splits at least one task per core.

    Parsing costs far more than moving the few source columns, so a lone small file is worth a
    shuffle. A scan that already has that many splits, as any large one has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
