"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.session import configure, new_run_dir
from provenant.sources.files import remove

#: With this setting Spark drops a query's shuffle files when the query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: ContextVar[tuple[list[str], ...]] = ContextVar("folders", default=())


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the jobs, and Arrow batches small enough for very long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    # Tables of fixed size stand in some plans as literals; the driver keeps the plans' texts.
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those staged with ``keep``, which are left to the scope around."""
    scopes = _folders.get()
    mark = _folders.set((*scopes, []))
    try:
        yield
    finally:
        for path in _folders.get()[-1]:
            remove(spark, path)
        _folders.reset(mark)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe when executors go.

    The shuffle files of the computation go with its end.
    """
    spark = df.sparkSession
    path = new_run_dir(spark, label)
    if scopes := _folders.get()[: -1 if keep else None]:
        scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, label: str, key: str) -> DataFrame:
    """Like ``staged``, in buckets by ``key``: what gathers the rows by it later does not move them once more."""
    spark = df.sparkSession
    path, name = new_run_dir(spark, label), f"dealt_{uuid.uuid4().hex}"
    if scopes := _folders.get():
        scopes[-1].append(path)
    writer = df.write.option("compression", "zstd").option("path", path)
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"drop table {name}")  # of the catalogue: the files stay
    return rows


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def fold_of(id_col: str) -> Column:
    """The remainder by five of the CRC-32 of an id written as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)).cast("int")


#: Positions in a bit table: bounded, and whatever collides in it only lets more through.
BITS = 1 << 22


def bit_table(values: DataFrame) -> np.ndarray:
    """Which of BITS positions some value of the only column (a long) takes; the driver gets no more than these."""
    taken = values.select((F.pmod(F.col(values.columns[0]), F.lit(BITS)) + 1).cast("long").alias("bit")).select(
        F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("position"))
    table = np.zeros(BITS, bool)
    for row in taken.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits")).toLocalIterator():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        table[(row["bucket"] - 1) * len(bits) + np.flatnonzero(bits)] = True
    return table
