"""Web events, captures and decisions derived from the generic test tables.

The tables hold no web events, so each row of ``events`` is turned into one: the columns below
decide, from the row's own values, what its JSON says and which contract rules it breaks. No row
is left out. The expressions are plain SQL that reads the same everywhere; ``{ms}`` stands for
the row's epoch milliseconds, whose spelling differs by engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.contract import Registry
from provenant.sources.scan import dealt

REGISTRY = Registry(sites=("site_0", "site_1", "site_2", "site_3", "site_4"))

SPARK_MS = "unix_millis(cast(ts as timestamp))"

EVENT_COLUMNS = {
    "event_id": "event_id",
    "received_ms": "{ms} + (event_id % 7) * 1000",
    "site_id": (
        "case user_id % 6 when 5 then 'site_x' else concat('site_', cast(user_id % 6 as varchar(20))) end"
    ),
    "session_id": (
        "case when event_id % 41 = 0 then '' else concat('s', cast(user_id as varchar(20)), '_', "
        "cast(cast(floor({ms} / 432000000.0) as bigint) as varchar(20))) end"
    ),
    "browser_id": (
        "case when event_id % 43 = 0 then null else concat('b', cast(user_id as varchar(20))) end"
    ),
    "hostname": (
        "case when event_id % 19 = 0 then null "
        "else concat('site-', cast(user_id % 6 as varchar(20)), '.example') end"
    ),
    "event_type": (
        "case event_type when 'view' then 'page_view' when 'click' then 'cta_click' "
        "when 'signup' then case when event_id % 3 = 0 then 'form_start' else 'form_submit' end "
        "when 'purchase' then 'generate_lead' "
        "else case event_id % 8 when 0 then 'session_start' when 4 then 'session_start' "
        "when 1 then 'session_summary' when 5 then 'session_summary' when 2 then 'page_state' "
        "when 6 then 'page_state' when 3 then 'cta_state' else 'error' end end"
    ),
    "schema_version": "case when event_id % 101 = 0 then 'thin.v1.0' else 'thin.v2.0' end",
    "consent": "case when event_id % 23 = 0 then 'denied' else 'granted' end",
    "client_event_id": (
        "case when event_id % 10 = 0 then null "
        "else concat('c', cast(cast(floor(value / 5) as bigint) as varchar(20))) end"
    ),
    "contract_version": (
        "case when event_id % 37 = 0 then null when event_type = 'error' and event_id % 3 = 0 then null "
        "else 'event-contract-v0.1' end"
    ),
    "client_ts_ms": (
        "case when event_id % 103 = 0 then null when event_id % 107 = 0 then cast(0 as bigint) "
        "else {ms} + case when event_id % 97 = 0 then cast(-8640000000 as bigint) "
        "when event_id % 89 = 0 then cast(864000000 as bigint) else cast(0 as bigint) end end"
    ),
    "page_view_id": (
        "case when event_id % 31 = 0 then null when event_id % 67 = 0 then '' "
        "else concat('p', cast(event_id % 5 as varchar(20))) end"
    ),
    "previous_page_view_id": (
        "case when event_id % 3 = 0 then null else concat('p', cast((event_id + 2) % 6 as varchar(20))) end"
    ),
    "path": "case when event_id % 47 = 0 then null else concat('/p', cast(event_id % 9 as varchar(20))) end",
    "sequence_index": (
        "case when event_id % 11 = 0 then null else cast(event_id % 20 as double) "
        "+ case when event_id % 113 = 0 then 0.5 else 0.0 end end"
    ),
    "cta_id": "case when event_id % 13 = 0 then null else 'get_report' end",
    "cta_label_bucket": "case when event_id % 26 = 0 then 'hero' else null end",
    "href_category": "case when event_id % 29 = 0 then null else 'internal' end",
    "click_offset_ms": "case when event_id % 7 = 0 then null else event_id % 5000 end",
    "ms_since_page_load": "case when event_id % 14 = 0 then cast(1200 as bigint) else null end",
    "form_start_offset_ms": "case when event_id % 2 = 0 then cast(900 as bigint) else null end",
    "form_id": "case when event_id % 33 = 0 then null else concat('f', cast(event_id % 4 as varchar(20))) end",
    "submit_outcome": (
        "case event_id % 7 when 0 then 'error' when 1 then 'unknown' when 2 then 'maybe' else 'success' end"
    ),
    "error_bucket": (
        "case event_id % 6 when 0 then 'network_error' when 1 then 'other_error' else null end"
    ),
    "lead_type": "case when event_id % 21 = 0 then null else 'demo_request' end",
    "source_kind": (
        "case event_id % 9 when 0 then 'form_success' when 1 then 'thank_you_page' "
        "when 2 then 'ajax_success' when 3 then 'external_booking_confirmation' "
        "when 4 then 'gated_download_confirmation' when 5 then 'newsletter_confirmation' "
        "when 6 then 'manual_test_isolated' when 7 then 'magic' else null end"
    ),
    "source_page_view_id": (
        "case when event_id % 4 = 0 then concat('p', cast(event_id % 5 as varchar(20))) else null end"
    ),
    "dwell_bucket": "case event_id % 5 when 0 then 'forever' when 1 then '' else '30-90s' end",
    "scroll_bucket": "case event_id % 7 when 0 then 'deep' when 1 then null else '0' end",
    "interaction_bucket": "case event_id % 9 when 0 then '7' else '3-5' end",
    "page_count": "case when event_id % 3 = 0 then null else event_id % 12 end",
    "path_summary": "case when event_id % 4 = 1 then '/p1>/p2' else null end",
    "timing_summary": "case when event_id % 5 = 0 then 'short' else null end",
    "timing_buckets": "case when event_id % 7 = 0 then 'b1' else null end",
    "interaction_density": "case when event_id % 6 = 1 then '3-5' else null end",
    "label": (
        "case when event_id % 53 = 0 then concat('mail u', cast(user_id as varchar(20)), '@mail.example.com') "
        "when event_id % 59 = 0 then 'Call +44 20 7946 0958' else 'Get report' end"
    ),
    "contact": (
        "case when event_id % 71 = 0 then concat('u', cast(user_id as varchar(20)), '@corp.example.org') "
        "else null end"
    ),
    "company": "case when event_id % 61 = 0 then 'Acme Ltd' else null end",
}

# JSON key -> derived column; order is the order the keys are written in.
JSON_KEYS = {
    "event_schema_version": "schema_version",
    "event_contract_version": "contract_version",
    "consent_signal": "consent",
    "site_id": "site_id",
    "hostname": "hostname",
    "path": "path",
    "anon_session_id": "session_id",
    "anon_browser_id": "browser_id",
    "event_type": "event_type",
    "client_event_id": "client_event_id",
    "page_view_id": "page_view_id",
    "previous_page_view_id": "previous_page_view_id",
    "event_sequence_index": "sequence_index",
    "cta_id": "cta_id",
    "cta_label_bucket": "cta_label_bucket",
    "href_category": "href_category",
    "click_offset_ms": "click_offset_ms",
    "ms_since_page_load": "ms_since_page_load",
    "form_start_offset_ms": "form_start_offset_ms",
    "form_id": "form_id",
    "submit_outcome": "submit_outcome",
    "error_bucket": "error_bucket",
    "lead_type": "lead_type",
    "source_kind": "source_kind",
    "source_page_view_id": "source_page_view_id",
    "page_count": "page_count",
    "path_summary": "path_summary",
    "timing_summary": "timing_summary",
    "timing_buckets": "timing_buckets",
    "interaction_density": "interaction_density",
    "cta_text_truncated_safe": "label",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_json() -> Column:
    """JSON text of one event. ``to_json`` omits NULL members, so NULL means absent."""
    ts = F.col("client_ts_ms")
    alternative = F.col("event_id") % 17 == 0
    members = [
        F.when(~alternative, ts).alias("client_timestamp_ms"),
        F.when(alternative, ts).alias("occurred_at"),
        *[F.col(column).alias(key) for key, column in JSON_KEYS.items()],
        F.struct(
            F.col("dwell_bucket"),
            F.col("scroll_bucket").alias("scroll_depth_bucket"),
            F.col("interaction_bucket").alias("interaction_density_bucket"),
        ).alias("engagement_proxy"),
        F.when(
            F.col("contact").isNotNull(), F.struct(F.lit("home").alias("page_group"), F.col("contact").alias("user_email"))
        ).alias("adapter_context"),
        F.col("company"),
    ]
    return F.to_json(F.struct(*members))


def flat_events(events: DataFrame) -> DataFrame:
    return events.select(
        *[F.expr(sql.format(ms=SPARK_MS)).alias(name) for name, sql in EVENT_COLUMNS.items()]
    )


def raw_events(events: DataFrame) -> DataFrame:
    """(event_id, batch_id, pos, raw, received_at): one JSON event per source row."""
    return flat_events(events).select(
        "event_id",
        F.col("event_id").alias("batch_id"),
        F.lit(0).alias("pos"),
        _event_json().alias("raw"),
        F.timestamp_millis("received_ms").alias("received_at"),
    )


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events").drop("props")
    return raw_events(dealt(source, "event_id"))


CAPTURE_COLUMNS = {
    "capture_id": "c_custkey",
    "captured_ms": "cast(1704067200000 as bigint) + c_custkey * 600000",
    "site_id": (
        "case when c_custkey % 37 = 0 then null "
        "else concat('site_', cast(cast(floor(c_custkey / 12) as bigint) % 120 as varchar(20))) end"
    ),
    "session_id": "case when c_custkey % 59 = 0 then null else concat('s', cast(c_custkey as varchar(20))) end",
    "browser_id": "case when c_custkey % 5 = 0 then null else concat('b', cast(c_custkey as varchar(20))) end",
    "email": (
        "case when c_custkey % 41 = 0 then null when c_custkey % 43 = 0 then 'no-at-sign' "
        "when c_custkey % 47 = 0 then 'bare@' when c_custkey % 53 = 0 then 'one@two.example@three.example' "
        "else concat(case when c_custkey % 2 = 0 then '  Cust' else 'cUST' end, "
        "cast(cast(floor(c_custkey / 3) as bigint) as varchar(20)), '@', "
        "case cast(floor(c_custkey / 3) as bigint) % 6 when 0 then 'gmail.com' when 1 then 'mailinator.com' "
        "when 2 then 'acme.co.uk' when 3 then 'Outlook.COM' when 4 then 'example.org' else 'yopmail.com' end, ' ') end"
    ),
    "asset_key": "case when c_custkey % 61 = 0 then null else concat('asset_', cast(c_custkey % 4 as varchar(20))) end",
    "trigger_score": "case when c_custkey % 67 = 0 then null else c_custkey % 100 end",
    "config_version": "case when c_custkey % 71 = 0 then null else 'cfg-1' end",
    "probe_version": "case when c_custkey % 73 = 0 then null else '1.0.0' end",
}

DECISION_COLUMNS = {
    "decision_id": "event_id",
    "decided_ms": EVENT_COLUMNS["received_ms"],
    "site_id": EVENT_COLUMNS["site_id"],
    "session_id": (
        "case when event_id % 83 = 0 then null else concat('s', cast(user_id as varchar(20)), '_', "
        "cast(cast(floor({ms} / 86400000.0) as bigint) as varchar(20))) end"
    ),
    "browser_id": EVENT_COLUMNS["browser_id"],
    "decision": (
        "case event_type when 'purchase' then case when event_id % 5 = 0 then 'fire' else 'hold' end "
        "when 'signup' then 'suppress' when 'click' then case when event_id % 7 = 0 then 'dismiss' else 'hold' end "
        "when 'error' then case when event_id % 10 = 0 then 'postpone' else 'hold' end else 'hold' end"
    ),
    "trigger_score": "cast(event_id % 100 as double) / 100",
    "trigger_confidence": "case when event_id % 12 = 0 then null else cast(event_id % 10 as double) / 10 end",
    "trigger_threshold": "case when event_id % 15 = 0 then 0.5e0 else 0.68e0 end",
    "page_group": "case event_id % 4 when 0 then 'pricing' when 1 then 'product' when 2 then 'blog' else null end",
    "page_path": "case when event_id % 9 = 0 then '/legal' else '/p' end",
    "config_version": "case when event_id % 79 = 0 then '' else 'cfg-1' end",
    "probe_version": "'1.0.0'",
}

CONFIG_OVERRIDES = (
    '{"asset_url":"/x/guide.pdf","enabled":true}',
    '{"bootstrap":{"min_runtime_days":3},"cooldown_hours":12}',
    '{"asset_url":null,"daily_budget":3,"dismiss_rate":{"raise_at_pct":40,"window_days":5},"kill_switch":true}',
    '{"extra_flag":1,"fire_rate":{"auto_disable_pct":12,"auto_disable_window_days":3,"auto_raise_pct":4,'
    '"auto_raise_window_days":10,"circuit_breaker_pct":25},"trigger_threshold":0.75}',
    '{"eligible_page_groups":["blog"],"excluded_paths":["/p"],"fire_rate":{"circuit_breaker_pct":30},"max_fire_per_session":0}',
    '{"bootstrap":null}',
)
CONFIG_COLUMNS = {
    "site_id": "concat('site_', cast(s_suppkey as varchar(20)))",
    "config_272": "case when s_suppkey % 2 = 0 then '{}' else "
    "'{\"analysis_window_days\":7,\"min_eligible_sessions\":50,\"min_valid_event_rate\":0.5}' end",
    "config_750": "case s_suppkey % 6 "
    + " ".join(f"when {i} then '{text}'" for i, text in enumerate(CONFIG_OVERRIDES)) + " end",
    "start_day": "case when s_suppkey % 7 = 3 then null else s_suppkey % 40 end",
}


def _flat(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql.format(ms=SPARK_MS) if "{ms}" in sql else sql).alias(n) for n, sql in columns.items()])


def capture_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, body, captured_at): one JSON capture per customer."""
    flat = _flat(dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), CAPTURE_COLUMNS)
    members = [n for n in CAPTURE_COLUMNS if n not in ("capture_id", "captured_ms")]
    return flat.select(
        "capture_id", F.to_json(F.struct(*members)).alias("body"),
        F.timestamp_millis("captured_ms").alias("captured_at"),
    )


def decision_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(decision_id, body, decided_at): one JSON decision per source event."""
    flat = _flat(dealt(table(spark, sf_dir, "events").drop("props", "value"), "event_id"), DECISION_COLUMNS)
    members = [n for n in DECISION_COLUMNS if n not in ("decision_id", "decided_ms")]
    return flat.select(
        "decision_id", F.to_json(F.struct(*members)).alias("body"),
        F.timestamp_millis("decided_ms").alias("decided_at"),
    )


def stored_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored configuration per supplier, with overrides only."""
    flat = _flat(table(spark, sf_dir, "supplier"), CONFIG_COLUMNS)
    started = F.date_add(F.lit("2024-01-01").cast("date"), F.col("start_day").cast("int"))
    return flat.withColumn("deploy_start_date", started).drop("start_day")


def asked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per customer; most have no stored configuration."""
    return dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        F.concat(F.lit("site_"), F.col("c_custkey").cast("string")).alias("site_id")
    )


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events grouped into request bodies of 48, 51 and 1 events per run of a hundred ids.

    Every third one-event batch is posted as a bare object instead of an array.
    """
    place = F.col("event_id") % 100
    block = F.floor(F.col("event_id") / 100)
    part = F.when(place < 48, 0).when(place < 99, 1).otherwise(2)
    events = web_events(spark, sf_dir).select(
        "event_id", "raw", "received_at", (block * 3 + part).alias("batch_id")
    )
    # A body holds at most 51 events by construction, so the gathered lists are short.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "raw"))), lambda e: e["raw"])
    listed = events.groupBy("batch_id").agg(
        F.array_join(ordered, ",").alias("items"), F.min("received_at").alias("received_at")
    )
    bare = (F.col("batch_id") % 3 == 2) & (F.floor(F.col("batch_id") / 3) % 3 == 0)
    body = F.when(bare, F.col("items")).otherwise(F.concat(F.lit("["), F.col("items"), F.lit("]")))
    return listed.select("batch_id", body.alias("body"), "received_at")


ODD_ELEMENT = (
    "case event_id % 8 when 0 then cast(event_id as varchar(20)) when 1 then '\"text\"' when 2 then 'null' when 3 then 'true' "
    "when 4 then '[{{\"event_type\":\"page_view\"}}]' when 5 then '{{}}' "
    "when 6 then concat('{{\"timestamp\":', cast({ms} as varchar(20)), '}}') "
    "else concat('{{\"occurred_at\":\"soon\",\"timestamp\":', cast({ms} as varchar(20)), '}}') end"
)


def odd_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per source event, whose only element is no event: a bare value, an array, or an object with a clock alone."""
    source = dealt(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    element = F.expr(ODD_ELEMENT.format(ms=SPARK_MS))
    return source.select(
        F.col("event_id").alias("batch_id"), F.concat(F.lit("["), element, F.lit("]")).alias("body"),
        F.col("ts").cast("timestamp").alias("received_at"))


# What stands in for the consumer of replay exports: it scores each subject of a file it has read, and writes a record
# of its run. Some records are wrong in known ways.
RUN_MAPS = {"action_distribution": "action", "trq_distribution": "status"}
NEVER_EXPORTED = "2030-01-01T00:00:00Z"


def evidence_cards(lines: DataFrame) -> DataFrame:
    """One card per run and subject, from the exported lines (site_id, window_start, line)."""
    member = lambda name: F.get_json_object("line", f"$.{name}")
    subjects = lines.groupBy("site_id", "window_start", member("anon_browser_id").alias("subject_id")).agg(
        F.count("*").alias("n"), F.max(member("event_type") == "generate_lead").alias("lead"),
        F.max(member("event_type") == "cta_click").alias("click"))
    return subjects.select(
        "site_id", "window_start", _run_id().alias("run_id"), "subject_id",
        F.when(F.col("n") >= 3, "scoreable").when(F.col("n") == 2, "degraded").otherwise("unscorable").alias("status"),
        F.when(F.col("lead"), "fire").when(F.col("click"), "hold").otherwise("none").alias("action"))


def _run_id() -> Column:
    return F.concat_ws("_", F.lit("run"), "site_id", F.left("window_start", F.lit(10)))


def replay_runs(cards: DataFrame, files: DataFrame, windows: tuple[str, str]) -> DataFrame:
    """Run records over ``files`` (site_id, window_start, sha256 as read from the files) and their cards."""
    def tally(column: str) -> DataFrame:
        counts = cards.groupBy("run_id", column).agg(F.count("*").alias("n"))
        return counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"{column}_counts"))

    site, first = F.substring("site_id", -1, 1).cast("int"), F.col("window_start") == windows[0]
    none = F.create_map().cast("map<string,bigint>")
    count = lambda status: F.coalesce(F.element_at("status_counts", status), F.lit(0))
    made = files.withColumn("run_id", _run_id()).join(tally("action"), "run_id", "left").join(tally("status"), "run_id", "left").withColumns({
        "action_counts": F.coalesce("action_counts", none), "status_counts": F.coalesce("status_counts", none)})
    scoreable, degraded, unscorable = (count(status) for status in ("scoreable", "degraded", "unscorable"))
    both_off, total_off = first & (site == 2), first & (site == 1)
    runs = made.filter(first | (site != 3)).select(
        "run_id", "site_id", "window_start",
        F.when(first & (site == 0), F.lit("0")).otherwise(F.col("sha256")).alias("source_sha256"),
        (scoreable + degraded + unscorable + (both_off | total_off).cast("int")).alias("subjects_total"),
        (scoreable + both_off.cast("int")).alias("subjects_scoreable"), degraded.alias("subjects_degraded"), unscorable.alias("subjects_unscorable"),
        F.when(~first & (site == 2), F.map_concat(F.map_filter("action_counts", lambda k, _: k != "none"), F.create_map(
            F.lit("none"), F.coalesce(F.element_at("action_counts", "none"), F.lit(0)) + 1))).otherwise(F.col("action_counts")).alias("action_distribution"),
        F.when(~first & (site == 4), F.map_filter("status_counts", lambda k, _: k != "degraded")).otherwise(F.col("status_counts")).alias("trq_distribution"))
    extra = runs.filter(first & (site == 4)).withColumns({
        "window_start": F.lit(NEVER_EXPORTED), "run_id": F.concat_ws("_", F.lit("run"), "site_id", F.lit(NEVER_EXPORTED[:10])),
        "action_distribution": none, "trq_distribution": none})
    return runs.unionByName(extra)
