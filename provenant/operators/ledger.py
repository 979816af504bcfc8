"""From judged events to the accepted and rejected ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.contract import Registry
from provenant.operators.dedup import ARRIVAL, LEDGER_KEY, first_writer_wins
from provenant.operators.pii import redacted


def collect_outcomes(judged: DataFrame) -> DataFrame:
    """Every rejected event, and the first arrival of every accepted one.

    Both ledgers come out of one pass: a rejected row has no key, so it never collides.
    """
    keyed = judged.withColumn("_key", F.when(F.col("accepted"), F.col("client_event_id")))
    kept = first_writer_wins(keyed, [*LEDGER_KEY[:2], "_key"], ARRIVAL)
    return kept.drop("_key")


def accepted_rows(judged: DataFrame, registry: Registry) -> DataFrame:
    """Ledger columns of accepted events, before conflict handling."""
    return judged.filter("accepted").select(
        "event_id", "site_id",
        F.coalesce("hostname", F.lit("")).alias("hostname"),
        "event_type", "session_id", "browser_id", "client_timestamp_ms", "received_at", "raw",
        F.lit(registry.collector_version).alias("collector_version"),
        "client_event_id", "page_view_id", "previous_page_view_id", "event_sequence_index",
        "event_contract_version",
        F.to_date("received_at").alias("received_date"),
        "batch_id", "pos",
    )


def accepted_ledger(judged: DataFrame, registry: Registry) -> DataFrame:
    return first_writer_wins(accepted_rows(judged, registry), LEDGER_KEY, ARRIVAL)


def rejected_rows(judged: DataFrame, registry: Registry) -> DataFrame:
    """Quarantine columns; an event with personal data keeps only its structural skeleton."""
    return judged.filter(~F.col("accepted")).select(
        "site_id",
        F.when(F.col("pii_rejected"), redacted(F.col("raw"))).otherwise(F.col("raw")).alias("raw"),
        "reason_codes", "received_at",
        F.lit(registry.collector_version).alias("collector_version"),
        F.to_date("received_at").alias("received_date"),
        "batch_id", "pos",
    )
