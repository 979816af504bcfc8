"""Daily data-quality metrics per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant import contract
from provenant.session import shared_dir

KEY = ("site_id", "metric_date", "metrics_version")
COUNTS = (
    "events_received", "events_accepted", "events_rejected", "distinct_sessions",
    "distinct_subjects", "summary_start_mismatch", "unknown_bucket_count",
)


def outcomes_of(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """The two stored ledgers as one frame of outcomes."""
    kept = accepted.select(
        "site_id", "received_at", "session_id", "browser_id", "event_type",
        F.lit(True).alias("accepted"), F.array().cast("array<string>").alias("reason_codes"),
    )
    refused = rejected.select("site_id", "received_at", F.lit(False).alias("accepted"), "reason_codes")
    return kept.unionByName(refused, allowMissingColumns=True)


def _of_sites(outcomes: DataFrame, sites: Sequence[str]) -> DataFrame:
    return outcomes.filter(F.col("site_id").isin(*sites)).withColumn(
        "metric_date", F.to_date("received_at")
    )


def daily_metrics(outcomes: DataFrame, sites: Sequence[str]) -> DataFrame:
    """One row per site and day that has events.

    One scan and one wide shuffle: each accepted event counts towards its session and its
    subject, each rejected one towards the day. Partial aggregation collapses every session,
    subject and day inside each input partition first, so no busy key travels whole.
    """
    def entity(kind: str, ident: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), ident.alias("id"))

    entities = F.when(
        F.col("accepted"),
        F.array(entity("session", F.col("session_id")), entity("subject", F.col("browser_id"))),
    ).otherwise(F.array(entity("rejected", F.lit(None).cast("string"))))
    rows = _of_sites(outcomes, sites).select(
        "site_id", "metric_date",
        (F.col("event_type") == "session_start").cast("int").alias("start"),
        (F.col("event_type") == "session_summary").cast("int").alias("summary"),
        F.array_contains("reason_codes", "UNKNOWN_BUCKET_VALUE").cast("int").alias("bad_bucket"),
        F.explode(entities).alias("e"),
    )
    per_entity = rows.groupBy("site_id", "metric_date", "e.kind", "e.id").agg(
        F.count("*").alias("n"), F.max("start").alias("start"), F.max("summary").alias("summary"),
        F.sum("bad_bucket").alias("bad_bucket"),
    )

    def total(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))

    mismatch = (F.col("start") != F.col("summary")).cast("int")
    measured = per_entity.groupBy("site_id", "metric_date").agg(
        total("session", F.col("n")).alias("events_accepted"),
        total("rejected", F.col("n")).alias("events_rejected"),
        total("session", F.lit(1)).alias("distinct_sessions"),
        total("subject", F.lit(1)).alias("distinct_subjects"),
        total("session", mismatch).alias("summary_start_mismatch"),
        total("rejected", F.col("bad_bucket")).alias("unknown_bucket_count"),
    )
    return with_rates(measured)


def with_rates(measured: DataFrame) -> DataFrame:
    received = F.col("events_accepted") + F.col("events_rejected")
    return measured.withColumns({
        "events_received": received,
        "reject_rate": F.when(received > 0, F.col("events_rejected") / received).otherwise(F.lit(0.0)),
    })


def on_every_site(days: DataFrame, sites: Sequence[str]) -> DataFrame:
    return days.select(
        "metric_date", F.explode(F.array(*[F.lit(s) for s in sites])).alias("site_id")
    )


def filled(grid: DataFrame, measured: DataFrame) -> DataFrame:
    dense = grid.join(measured, ["site_id", "metric_date"], "left")
    return dense.select(
        "site_id", "metric_date",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in COUNTS],
        F.coalesce("reject_rate", F.lit(0.0)).alias("reject_rate"),
    )


def dense_range(measured: DataFrame, sites: Sequence[str], start: str, end: str) -> DataFrame:
    """A row for every site and every day of an inclusive range, zero where nothing happened."""
    days = measured.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("metric_date")
    )
    return filled(on_every_site(days, sites), measured)


def dense_span(measured: DataFrame, sites: Sequence[str]) -> DataFrame:
    """As :func:`dense_range`, over the days from the first to the last one with events.

    The metrics are needed twice, for the span and for the values. They are one row per site and
    day, so they are checkpointed instead of being computed again from the events.
    """
    shared_dir(measured.sparkSession)
    measured = measured.checkpoint()
    span = measured.agg(F.min("metric_date").alias("a"), F.max("metric_date").alias("b"))
    days = span.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("metric_date"))
    return filled(on_every_site(days, sites), measured)


def event_type_counts(outcomes: DataFrame, sites: Sequence[str]) -> DataFrame:
    return (
        _of_sites(outcomes, sites).filter("accepted")
        .groupBy("site_id", "metric_date", "event_type").agg(F.count("*").alias("n"))
    )


def reason_counts(outcomes: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Occurrences per reason code; a code repeated within one event counts each time."""
    return (
        _of_sites(outcomes, sites).filter(~F.col("accepted"))
        .select("site_id", "metric_date", F.explode("reason_codes").alias("reason"))
        .groupBy("site_id", "metric_date", "reason").agg(F.count("*").alias("n"))
    )


def top_reasons(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent reasons of every site and day, most frequent first; ties to the smaller code.

    Counts are exact and made before anything is ranked. Ranks are limited to ``k`` in every partition before the shuffle, so
    a day with any number of codes sends ``k`` rows from each.
    """
    order = Window.partitionBy("site_id", "metric_date").orderBy(F.col("n").desc(), "reason")
    ranked = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return ranked.select("site_id", "metric_date", "place", "reason", "n")


def reason_family(reason: Column) -> Column:
    """Code without the payload path, which is unbounded for personal-data codes."""
    return F.substring_index(reason, ":", 1)


def start_summary_mismatch(outcomes: DataFrame, sites: Sequence[str]) -> DataFrame:
    sessions = (
        _of_sites(outcomes, sites).filter("accepted")
        .groupBy("site_id", "metric_date", "session_id").agg(
            F.max((F.col("event_type") == "session_start").cast("int")).alias("start"),
            F.max((F.col("event_type") == "session_summary").cast("int")).alias("summary"),
        )
    )
    return (
        sessions.filter("start <> summary")
        .groupBy("site_id", "metric_date").agg(F.count("*").alias("summary_start_mismatch"))
    )


def unknown_bucket_events(outcomes: DataFrame, sites: Sequence[str]) -> DataFrame:
    return (
        _of_sites(outcomes, sites)
        .filter(~F.col("accepted") & F.array_contains("reason_codes", "UNKNOWN_BUCKET_VALUE"))
        .groupBy("site_id", "metric_date").agg(F.count("*").alias("unknown_bucket_count"))
    )


def metrics_table(
    dense: DataFrame, types: DataFrame, reasons: DataFrame, computed_at: Column
) -> DataFrame:
    """Rows of the stored metrics table, with the two count maps.

    Maps are built from already counted rows. The event-type map has at most eight entries. The reason map holds
    full codes, and those of personal data name a payload path: it is as long as a day has distinct paths. Readers
    of many days take :func:`reason_counts` instead, one row per code.
    """
    site_day = ["site_id", "metric_date"]

    def as_map(counts: DataFrame, key: str, name: str) -> DataFrame:
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))
        return counts.groupBy(*site_day).agg(entries.alias(name))

    no_counts = F.create_map().cast("map<string,bigint>")
    return (
        dense.join(as_map(types, "event_type", "event_type_counts"), site_day, "left")
        .join(as_map(reasons, "reason", "reject_reason_counts"), site_day, "left")
        .select(
            "site_id", "metric_date", F.lit(contract.METRICS_VERSION).alias("metrics_version"),
            computed_at.alias("computed_at"),
            *[F.col(n).cast("int").alias(n) for n in COUNTS],
            F.col("reject_rate").cast("float").alias("reject_rate"),
            F.coalesce("event_type_counts", no_counts).alias("event_type_counts"),
            F.coalesce("reject_reason_counts", no_counts).alias("reject_reason_counts"),
        )
    )
