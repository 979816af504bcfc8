"""Writers for tables that change: partitions replaced in place, or whole snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenant.sources.files import listed, remove


def replace_days(rows: DataFrame, path: str, day: str = "metric_date") -> None:
    """Upsert by partition: only the days present in ``rows`` are replaced, each as a whole.

    ``rows`` must hold every row of the days it touches, as a metrics run over all sites does, or
    the result of :func:`provenant.operators.dedup.upsert_latest` for them.
    """
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    )


def append_epoch(rows: DataFrame, path: str, epoch: int, folder: str) -> None:
    """Append one epoch below folders of ``folder``, after removing what an unfinished attempt at it has left."""
    spark = rows.sparkSession
    for value in listed(spark, path):
        remove(spark, f"{path}/{value}/epoch={epoch}")
    rows.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy(folder, "epoch").parquet(path)


def write_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Store the table after an upsert or purge as a new version; the one it was read from stays."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """One version of a table. Naming it keeps a reader away from a version still being written."""
    return spark.read.schema(StructType.fromDDL(schema)).parquet(f"{path}/version={version}")
