"""Conflict semantics: first writer wins, insert if absent, upsert.

``row_number() = 1`` is planned with a per-partition group limit ahead of the shuffle, so a key
that holds a large share of the rows sends at most one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER_KEY = ("site_id", "session_id", "client_event_id")
ARRIVAL = ("received_at", "batch_id", "pos")


def _any_null(keys: Sequence[str]) -> Column:
    empty = F.lit(False)
    for key in keys:
        empty = empty | F.col(key).isNull()
    return empty


def first_writer_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the earliest row of each key; rows with a NULL in the key never collide.

    ``order`` must identify a row: it also spreads the NULL-keyed rows over the partitions.
    """
    alone = F.when(_any_null(keys), F.struct(*order))
    first = Window.partitionBy(*keys, alone).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Rows of ``incoming`` to append: new keys only, first arrival per key."""
    stored = existing.select(*keys).dropna(subset=list(keys))
    return first_writer_wins(incoming, keys, order).join(stored, list(keys), "left_anti")


def upsert_latest(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The table after the upsert: one row per key, incoming before existing, latest first."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(
        F.col("_new").desc(), *[F.col(c).desc() for c in order]
    )
    return both.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank", "_new")


def evolve(df: DataFrame, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """Additive schema evolution: missing columns appear, NULLs take the declared default."""
    widened = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(schema)
    ]
    return df.select(*widened).withColumns(
        {name: F.coalesce(F.col(name), value) for name, value in defaults.items()}
    )
