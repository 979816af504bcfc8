"""Distinct counts over any range of days, from sketches stored once per site and day.

A day's exact distinct count can't be added to the next day's. Sketches can: a range is the union of its days,
each read as one small row instead of the day's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column -> name of its count.
COUNTED = {"session_id": "sessions", "browser_id": "subjects"}
#: 2**14 buckets: a relative standard error of about 0.8 % (1.04 / sqrt of the buckets). BOUND is four of them.
LOG2_BUCKETS = 14
BOUND = 4 * 1.04 / 2 ** (LOG2_BUCKETS / 2)
SKETCHES = "site_id string, received_date date, " + ", ".join(f"{name} binary" for name in COUNTED.values())


def daily_sketches(accepted: DataFrame) -> DataFrame:
    """One row per site and day. NULL ids count towards nothing."""
    return accepted.groupBy("site_id", "received_date").agg(*[
        F.hll_sketch_agg(column, F.lit(LOG2_BUCKETS)).alias(name) for column, name in COUNTED.items()])


def estimated_distinct(sketches: DataFrame) -> DataFrame:
    """Estimated counts per site over the days given."""
    return sketches.groupBy("site_id").agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(name, F.lit(False))).alias(f"{name}_estimate") for name in COUNTED.values()])


def exact_distinct(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("site_id").agg(*[F.count_distinct(column).alias(name) for column, name in COUNTED.items()])


def agrees(name: str) -> Column:
    """Whether the estimate of a count is within the stated bound, or within one of a small count."""
    return F.abs(F.col(f"{name}_estimate") - F.col(name)) <= F.greatest(F.lit(1.0), F.col(name) * BOUND)
