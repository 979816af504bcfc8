"""Dense positions in a total order without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.session import shared_dir


def with_ordinal(
    df: DataFrame, order: Sequence[str], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Add the 1-based position of each row, restarting for each value of ``within``.

    Rows are range-partitioned and sorted by ``(within, order)``; a row's position is its place
    inside its partition plus the rows of its group in earlier partitions. The sorted rows are
    checkpointed, because range bounds come from sampling and a second evaluation might cut
    elsewhere. The counts hold one row per partition and group.
    """
    shared_dir(df.sparkSession)
    keys = [*within, *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
    )
    counts = placed.groupBy("_part", *within).agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    earlier = (
        Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "_part", *within, "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    # Null-safe, so that rows of a NULL group keep their place too.
    same = F.col("p._part") == F.col("o._part")
    for column in within:
        same = same & F.col(f"p.{column}").eqNullSafe(F.col(f"o.{column}"))
    position = F.col("o._before") + F.col("p._at") - F.col("o._first") + 1
    return placed.alias("p").join(offsets.alias("o"), same).select(
        *[F.col(f"p.`{c}`") for c in df.columns], position.alias(name)
    )
