"""Event batches: admission, and the split into one row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from provenant import contract
from provenant.functions.jsonsplit import split_beyond
from provenant.functions.jsontypes import once

REFUSED = "INVALID_BATCH_FORMAT"
BATCH_SCHEMA = "batch_id bigint, body string, received_at timestamp"


def read_batches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(BATCH_SCHEMA).format(fmt).load(path)


def stream_batches(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str | int
) -> DataFrame:
    reader: DataStreamReader = spark.readStream.schema(BATCH_SCHEMA).format(fmt)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def admit(batches: DataFrame) -> DataFrame:
    """Add ``elements`` (variants), ``beyond``, ``n_events`` and ``error``; NULL ``error`` means admitted.

    A body is refused whole unless it is a JSON array of at most fifty elements. One that Spark cannot parse is
    shipped to a splitter without the parser's limits: ``beyond`` holds its elements as texts, so that an element
    nested too deep or with too long a number is judged alone.
    """
    elements = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    suspect = F.when(F.col("elements").isNull() & F.col("body").rlike(r"^[ \t\r\n]*\["), F.col("body"))
    parsed = once(batches, "elements", elements).withColumn("beyond", split_beyond(suspect)).withColumn(
        "n_events", F.coalesce(F.size("elements"), F.size("beyond")))
    refused = F.col("n_events").isNull() | (F.col("n_events") > contract.MAX_BATCH_EVENTS)
    return parsed.withColumn("error", F.when(refused, F.lit(REFUSED)))


def _nested(value: Column) -> Column:
    """True for an object or array. Reading one member, or none, spares spelling out the type of the whole element."""
    opened = (F.try_variant_get(value, "$", kind) for kind in ("struct<event_type:variant>", "array<variant>"))
    return next(opened).isNotNull() | next(opened).isNotNull()


def split_events(admitted: DataFrame) -> DataFrame:
    """One row per event of the admitted batches, in order, all with the batch's receipt time; see :func:`split_batches`."""
    return split_batches(admitted).filter("error is null").drop("error", "n_events")


def split_batches(admitted: DataFrame) -> DataFrame:
    """The events of the admitted batches, and one row without ``pos`` and ``raw`` for each refused batch.

    Both come out of one parse of the bodies. ``raw`` keeps the members of an object in the order they were sent, which decides the first
    personal-data hit. A string element needs its quotes back to remain JSON.
    """
    texts = F.from_json("body", "array<string>")
    beyond = F.expr("transform(beyond, t -> named_struct('value', cast(null as variant), 'text', t))")
    listed = F.coalesce(F.arrays_zip(F.col("elements").alias("value"), texts.alias("text")), beyond)
    return (
        admitted.select("batch_id", "received_at", "error", "n_events", F.posexplode_outer(
            F.when(F.col("error").isNull(), listed)).alias("pos", "element"))
        # An admitted batch may hold no event.
        .filter("pos is not null or error is not null")
        .select(
            "batch_id", "pos", "received_at", "error", "n_events",
            F.when(F.col("element.value").isNull() | _nested(F.col("element.value")), F.col("element.text"))
            .otherwise(F.to_json("element.value")).alias("raw"),
        )
    )
