"""Stored captures and decisions: writers, and the purge that deletes.

Captures lie in folders of the day on which they fall due. A purge drops the folders of earlier days, reading none of
them but their row counts, and rewrites the folder of its own day, so its cost does not grow with what stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators.capture import new_captures, retained
from provenant.operators.sinks import append_epoch
from provenant.schemas import CAPTURES, DECISIONS
from provenant.session import configure
from provenant.sources.files import exists, listed, remove, rename

DUE = "purge_day"


def stored_captures(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All stored captures, or those of epochs before one."""
    schema = f"{CAPTURES}, {DUE} date, epoch bigint"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if before is None else rows.filter(F.col("epoch") < before)


def append_captures(captures: DataFrame, path: str, epoch: int) -> None:
    """Store captures as one epoch: new addresses of a site only. Running an epoch again leaves the same rows.

    The stored keys are those of the retention period, whatever the age of the store.
    """
    spark = captures.sparkSession
    added = new_captures(stored_captures(spark, path, epoch), captures)
    # A day's rows meet in few tasks, else every task would write a file for every day; Spark splits a busy day.
    append_epoch(added.withColumn(DUE, F.to_date("purge_after")).hint("rebalance", DUE), path, epoch, DUE)


def purge_captures(spark: SparkSession, path: str, now: str) -> int:
    """Delete every capture that is due before ``now`` (UTC, like 2024-04-05T10:00:00Z); returns how many.

    The survivors of the border day are written aside and take the place of its folder by renaming. If a purge
    dies between the two steps, the next one (or :func:`finish_purge`) completes it.
    """
    configure(spark)
    finish_purge(spark, path)
    at = F.lit(now).cast("timestamp")
    deleted = 0
    for name in listed(spark, path):
        day, folder = name.removeprefix(f"{DUE}="), f"{path}/{name}"
        if day > now[:10] or not name.startswith(f"{DUE}="):
            continue
        rows = spark.read.schema(f"{CAPTURES}, epoch bigint").parquet(folder)
        total = rows.count()
        if day < now[:10]:
            remove(spark, folder)
            deleted += total
            continue
        kept = retained(rows, at)
        staying = kept.count()
        if staying == total:
            continue
        deleted += total - staying
        if staying:
            kept.write.mode("overwrite").partitionBy("epoch").parquet(f"{_aside(path)}/{name}")
            finish_purge(spark, path)
        else:
            remove(spark, folder)
    return deleted


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}.border"


def finish_purge(spark: SparkSession, path: str) -> None:
    """Put survivors that a purge has written aside in place of their folder; unfinished ones are dropped."""
    for name in listed(spark, _aside(path)):
        survivors = f"{_aside(path)}/{name}"
        if exists(spark, f"{survivors}/_SUCCESS"):
            remove(spark, f"{path}/{name}")
            rename(spark, survivors, f"{path}/{name}")
        else:
            remove(spark, survivors)


def append_decisions(log: DataFrame, path: str, epoch: int) -> None:
    """Store a decision log as one epoch, in folders of the day it was decided."""
    append_epoch(log.withColumn("decided_date", F.to_date("decided_at")), path, epoch, "decided_date")


def stored_decisions(spark: SparkSession, path: str) -> DataFrame:
    schema = f"decision_id bigint, {DECISIONS}, decided_date date, epoch bigint"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
