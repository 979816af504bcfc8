"""Evidence chains over the accepted ledger.

The contract asks for these results without fixing every detail; choices of our own are named
in each docstring. A session may hold a large share of all events, so none of these gathers or
sorts a session in one place: per-session facts come from aggregates that combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.jsontypes import as_string, once, top_level
from provenant.operators.dedup import first_writer_wins

SESSION = ("site_id", "session_id")
_FORM_KINDS = ("form_success", "ajax_success")


def _of_type(kind: str, value: Column) -> Column:
    return F.when(F.col("event_type") == kind, value)


def with_payload(ledger: DataFrame, *names: str) -> DataFrame:
    """Add string members of ``raw`` as columns."""
    return (
        once(ledger, "_m", top_level(F.col("raw"), names))
        .withColumns({n: as_string(f"_m.{n}") for n in names})
        .drop("_m")
    )


def grade_leads(ledger: DataFrame) -> DataFrame:
    """Grade each lead by what its session showed strictly before it.

    ``trusted``: a page view and, for form kinds, a successful submit came first; an external
    booking or other non-form kind needs a page view or a click. ``degraded``: no such evidence,
    and always for a thank-you page without a successful submit. ``isolated``: a manual test.

    "Something came before" only needs the earliest time per session, so the facts are minima and
    the join meets one row per session.
    """
    ts = F.col("client_timestamp_ms")
    events = with_payload(ledger, "submit_outcome", "source_kind").select(
        *SESSION, "event_id", "event_type", "client_timestamp_ms", "source_kind", "submit_outcome"
    )
    facts = events.groupBy(*SESSION).agg(
        F.min(_of_type("page_view", ts)).alias("first_view"),
        F.min(_of_type("cta_click", ts)).alias("first_click"),
        F.min(F.when((F.col("event_type") == "form_submit") & (F.col("submit_outcome") == "success"), ts))
        .alias("first_success"),
        F.count(_of_type("generate_lead", ts)).alias("leads"),
    ).filter("leads > 0")
    leads = events.filter("event_type = 'generate_lead'").select(
        *SESSION, "event_id", "client_timestamp_ms", "source_kind"
    )

    def before(name: str) -> Column:
        return F.coalesce(F.col(name) < ts, F.lit(False))

    view, click, success = (before(n) for n in ("first_view", "first_click", "first_success"))
    kind = F.col("source_kind")
    grade = (
        F.when(kind == "manual_test_isolated", F.lit("isolated"))
        .when(kind.isin(*_FORM_KINDS), F.when(view & success, F.lit("trusted")).otherwise(F.lit("degraded")))
        .when(kind == "thank_you_page", F.when(success, F.lit("trusted")).otherwise(F.lit("degraded")))
        .otherwise(F.when(view | click, F.lit("trusted")).otherwise(F.lit("degraded")))
    )
    return leads.join(facts, list(SESSION), "left").select(
        "event_id", *SESSION, "source_kind", view.alias("had_view"), click.alias("had_click"),
        success.alias("had_success"), grade.alias("grade"),
    )


def first_form_starts(ledger: DataFrame) -> DataFrame:
    """One form_start per form and session: the earliest by client time, then event id."""
    starts = with_payload(ledger.filter("event_type = 'form_start'"), "form_id")
    return first_writer_wins(starts, [*SESSION, "form_id"], ["client_timestamp_ms", "event_id"])


def session_paths(ledger: DataFrame) -> DataFrame:
    """Views per session and path with the first and last time, one row per distinct path."""
    views = with_payload(ledger.filter("event_type = 'page_view'"), "path")
    ts = F.col("client_timestamp_ms")
    return views.groupBy(*SESSION, "path").agg(
        F.count("*").alias("views"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms")
    )


def session_rollup(ledger: DataFrame) -> DataFrame:
    """Atomic events of a session as one row.

    The path summary is the entry path, the exit path and the number of distinct paths; its long
    form is :func:`session_paths`. Ties in time go to the smaller entry and the larger exit path.
    """
    ts = F.col("client_timestamp_ms")
    path = F.when(F.col("event_type") == "page_view", F.col("path"))
    per_path = with_payload(ledger, "path").groupBy(*SESSION, path.alias("path")).agg(
        F.count("*").alias("events"),
        F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"),
        *[
            F.count(_of_type(kind, ts)).alias(name)
            for kind, name in (
                ("page_view", "page_count"), ("cta_click", "cta_count"),
                ("form_start", "form_start_count"), ("form_submit", "form_submit_count"),
                ("generate_lead", "generate_lead_count"),
            )
        ],
    )
    viewed = F.col("path").isNotNull()
    return per_path.groupBy(*SESSION).agg(
        *[
            F.sum(n).alias(n)
            for n in ("events", "page_count", "cta_count", "form_start_count", "form_submit_count",
                      "generate_lead_count")
        ],
        F.count("path").alias("distinct_paths"),
        F.min(F.when(viewed, F.struct("first_ms", "path")))["path"].alias("entry_path"),
        F.max(F.when(viewed, F.struct("last_ms", "path")))["path"].alias("exit_path"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
    ).withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))


def page_lineage(ledger: DataFrame) -> DataFrame:
    """How far a session's events link back to page views it really had.

    ``linked`` events name a previous page view seen in the session, ``orphans`` one that was
    not. ``sequence_gaps`` counts the missing values between the lowest and highest index.

    Each event becomes up to three marks: a page seen, a page referred to, an index used. Seen
    pages and references are counted per id and meet in one aggregate, so there is one scan, no
    join, and no busy page view or session that moves row by row.
    """
    def mark(kind: str, key: str, seen: int, refs: int) -> str:
        return f"struct('{kind}' as kind, {key} as key, {seen} as seen, {refs} as refs)"

    marks = ledger.select(*SESSION, F.explode(F.expr(f"""array(
        if(event_type = 'page_view' and page_view_id is not null, {mark("page", "page_view_id", 1, 0)}, null),
        if(previous_page_view_id is not null, {mark("page", "previous_page_view_id", 0, 1)}, null),
        if(event_sequence_index is not null,
           {mark("index", "cast(event_sequence_index as string)", 0, 0)}, null))""")).alias("m"))
    per_key = (
        marks.filter("m is not null").groupBy(*SESSION, "m.kind", "m.key")
        .agg(F.max("m.seen").alias("seen"), F.sum("m.refs").alias("refs"))
    )
    page, index = F.col("kind") == "page", F.when(F.col("kind") == "index", F.col("key").cast("bigint"))

    def total(test: Column, value: Column) -> Column:
        return F.sum(F.when(page & test, value).otherwise(F.lit(0)))

    return per_key.groupBy(*SESSION).agg(
        total(F.col("seen") == 1, F.col("seen")).alias("pages"),
        total(F.col("seen") == 1, F.col("refs")).alias("linked"),
        total(F.col("seen") == 0, F.col("refs")).alias("orphans"),
        F.coalesce(F.max(index) - F.min(index) + 1 - F.count(index), F.lit(0)).alias("sequence_gaps"),
    )
