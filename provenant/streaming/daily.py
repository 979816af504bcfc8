"""The daily metrics job: from the stored ledgers to the stored metrics, day by day.

A run looks only at the folders that epochs since its last run have written, so it learns the touched days from
folder names, reads those days and replaces them, whole, in both tables. A day's rows do not depend on how many runs
it took. Progress is noted after the tables are written: a run that dies is done again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import metrics
from provenant.operators.sinks import replace_days
from provenant.schemas import METRICS
from provenant.sources.files import exists, listed, read_small, write_small
from provenant.streaming.collect import Days, ledgers_at

REASONS = "site_id string, metric_date date, reason string, n bigint"


def touched_days(spark: SparkSession, root: str, after: int, through: int) -> list[str]:
    """Days to which epochs ``after`` < epoch <= ``through`` have added accepted or rejected events."""
    days = set()
    for name in ("accepted", "rejected"):
        for day in listed(spark, f"{root}/{name}"):
            epochs = (int(e.removeprefix("epoch=")) for e in listed(spark, f"{root}/{name}/{day}"))
            if any(after < e <= through for e in epochs):
                days.add(day.removeprefix("received_date="))
    return sorted(days)


def progress(spark: SparkSession, target: str) -> int:
    """The last epoch that the stored metrics take into account, -1 before the first run."""
    path = f"{target}/progress"
    return json.loads(read_small(spark, path))["epoch"] if exists(spark, path) else -1


def run_daily(
    spark: SparkSession, root: str, target: str, sites: Sequence[str], computed_at: Column, *, through: int | None = None
) -> list[str]:
    """Bring the stored metrics up to an epoch, the last committed one by default; returns the days replaced."""
    ledgers = ledgers_at(spark, root, through)
    days = touched_days(spark, root, progress(spark, target), ledgers.epoch)
    if days:
        write_days(ledgers.accepted, ledgers.rejected, days, target, sites, computed_at)
        write_small(spark, f"{target}/progress", json.dumps({"epoch": ledgers.epoch}))
    return days


def write_days(
    accepted: DataFrame, rejected: DataFrame, days: Sequence[str], target: str, sites: Sequence[str], computed_at: Column
) -> None:
    """Compute the given days anew, a row for every site, and replace them."""
    spark = accepted.sparkSession
    dates = [F.lit(day).cast("date") for day in days]
    chosen = F.col("received_date").isin(*dates)
    outcomes = metrics.outcomes_of(accepted.filter(chosen), rejected.filter(chosen))
    grid = spark.range(1).select(F.explode(F.array(*dates)).alias("metric_date"))
    measured = metrics.filled(metrics.on_every_site(grid, sites), metrics.daily_metrics(outcomes, sites))
    reasons = metrics.reason_counts(outcomes, sites)
    types = metrics.event_type_counts(outcomes, sites)
    replace_days(reasons, f"{target}/reasons")
    replace_days(metrics.metrics_table(measured, types, reasons, computed_at), f"{target}/daily")


def stored_metrics(spark: SparkSession, target: str, days: Days | None = None) -> DataFrame:
    """The stored rows, one per site and day; only the folders of ``days`` are read."""
    return _stored(spark, f"{target}/daily", METRICS, days)


def stored_reasons(spark: SparkSession, target: str, days: Days | None = None) -> DataFrame:
    """The stored counts of full reason codes, one row per site, day and code."""
    return _stored(spark, f"{target}/reasons", REASONS, days)


def _stored(spark: SparkSession, path: str, schema: str, days: Days | None) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    if days:
        first, last = (F.lit(day).cast("date") for day in days)
        rows = rows.filter((F.col("metric_date") >= first) & (F.col("metric_date") <= last))
    return rows


def day_from_ledgers(spark: SparkSession, root: str, sites: Sequence[str], days: Days) -> DataFrame:
    """The metrics of some days straight from the ledgers, a row for every site and day, without storing them."""
    ledgers = ledgers_at(spark, root, days=days)
    measured = metrics.daily_metrics(metrics.outcomes_of(ledgers.accepted, ledgers.rejected), sites)
    return metrics.dense_range(measured, sites, *days)
