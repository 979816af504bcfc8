"""Named queries: each runs a job over the whole of the given tables and returns flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant import contract, schemas
from provenant.functions.personal_data import has_email, has_phone
from provenant.operators import capture, chains, decisions, ledger, metrics, monitors, replay, siteconfig, sketches, stores
from provenant.operators.dedup import evolve, upsert_latest
from provenant.operators.pii import redacted
from provenant.operators.validate import validate_events
from provenant.session import configure, new_run_dir
from provenant.sources import batches as batch_source
from provenant.sources import derived
from provenant.sources.derived import REGISTRY
from provenant.sources.files import exists
from provenant.sources.scan import spread, tasks_for
from provenant.streaming import collect, daily

NOW = "2024-02-10T00:00:00Z"
PURGE_AT = "2024-04-05T00:00:00Z"
# A purge within a day, and the hour before which captures were stored by an earlier run.
PURGE_WITHIN_DAY = "2024-04-01T00:25:00Z"
STORED_BEFORE = "2024-01-01T12:00:00Z"
# Days that cut the events into three micro-batches, one that is measured alone, and a window without events.
EPOCH_DAYS = ("2024-01-11", "2024-01-21")
ONE_DAY = "2024-01-15"
RECONCILED = (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"))
EMPTY_WINDOW = ("2019-01-01", "2019-01-02")
TOP_REASONS = 3
RANGE = ("2023-12-20", "2024-02-20")
REPLAY_WINDOW = ("2023-12-31", "2024-02-15")
# Test key for the round trip only; a deployment passes its own secret.
ROUND_TRIP_KEY = "a" * 64

Query = Callable[[SparkSession, str], DataFrame]


def _judged(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return validate_events(derived.web_events(spark, sf_dir), REGISTRY, strict=strict)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.collect_outcomes(_judged(spark, sf_dir))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.accepted_ledger(_judged(spark, sf_dir), REGISTRY)


def _stored(ledger_rows: DataFrame, label: str) -> DataFrame:
    """The rows as a stored table, for jobs that read a ledger more than once."""
    spark = ledger_rows.sparkSession
    path = new_run_dir(spark, label)
    ledger_rows.write.parquet(path)
    return spark.read.schema(ledger_rows.schema).parquet(path)


_COLLECTED: dict[tuple[str, str], str] = {}


def _posts(events: DataFrame) -> DataFrame:
    """Every event as a batch of its own, whose number is the event's."""
    body = F.concat(F.lit("["), F.col("raw"), F.lit("]")).alias("body")
    return events.select("batch_id", body, "received_at")


def _ledgers(spark: SparkSession, sf_dir: str) -> str:
    """The ledgers of all events, collected in three micro-batches by time of arrival; once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    root = _COLLECTED.get(key)
    if root is None or not exists(spark, f"{root}/commits/2"):
        root = new_run_dir(spark, "ledgers")
        posts = _posts(derived.web_events(spark, sf_dir))
        day = F.to_date("received_at")
        early, late = (F.lit(d).cast("date") for d in EPOCH_DAYS)
        for epoch, part in enumerate((day < early, (day >= early) & (day < late), day >= late)):
            collect.collect_epoch(posts.filter(part), epoch, root, REGISTRY)
        _COLLECTED[key] = root
    return root


def _ms(name: str) -> Column:
    return F.unix_millis(name)


def _day(name: str) -> Column:
    return F.col(name).cast("string")


def _codes() -> Column:
    return F.array_join("reason_codes", "|")


def _metric_row(dense: DataFrame) -> DataFrame:
    return dense.select(
        "site_id", _day("metric_date").alias("metric_date"), *metrics.COUNTS, "reject_rate",
    )


# ---- collection -------------------------------------------------------------------

def truth_metrics_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = metrics.daily_metrics(_outcomes(spark, sf_dir), REGISTRY.sites)
    return _metric_row(metrics.dense_span(measured, REGISTRY.sites))


def collect_outcome_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("received"),
        F.sum(F.col("accepted").cast("bigint")).alias("accepted"),
        F.sum(F.col("pii_rejected").cast("bigint")).alias("pii_rejected"),
    )


def collect_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = _judged(spark, sf_dir).select(F.explode("reason_codes").alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def collect_reason_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("event_id", _codes().alias("codes"))


def accepted_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).select("event_id", "site_id", "session_id", "client_event_id")


def accepted_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.accepted_rows(_judged(spark, sf_dir), REGISTRY)
    return rows.select(
        "event_id", "site_id", "hostname", "event_type", "session_id", "browser_id",
        "client_timestamp_ms", _ms("received_at").alias("received_ms"), "client_event_id",
        "page_view_id", "previous_page_view_id", "event_sequence_index", "event_contract_version",
        "collector_version",
    )


def timestamp_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    verdicts = {
        name: F.array_contains("reason_codes", code).cast("int").alias(name)
        for name, code in (
            ("invalid", "INVALID_TIMESTAMP"), ("future", "FUTURE_TIMESTAMP"), ("stale", "STALE_TIMESTAMP"),
        )
    }
    return judged.select("event_id", "client_timestamp_ms", *verdicts.values())


def contract_version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("event_type", "event_contract_version").agg(F.count("*").alias("n"))


def batch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    admission = batch_source.admit(derived.event_batches(spark, sf_dir))
    return admission.select(
        "batch_id", F.coalesce("n_events", F.lit(-1)).cast("bigint").alias("n_events"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def batch_events_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the events of admitted batches, each judged at its batch's receipt time."""
    events = batch_source.split_events(batch_source.admit(derived.event_batches(spark, sf_dir)))
    return validate_events(events, REGISTRY).select(
        "batch_id", F.col("pos").cast("bigint").alias("pos"), _codes().alias("codes")
    )


def odd_elements_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on elements that are no events: bare values fail at once, arrays and objects without members rule by rule."""
    events = batch_source.split_events(batch_source.admit(derived.odd_batches(spark, sf_dir)))
    return validate_events(events, REGISTRY).select(F.col("batch_id").alias("event_id"), _codes().alias("codes"), "client_timestamp_ms")


# ---- personal data ----------------------------------------------------------------

def pii_event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _judged(spark, sf_dir).filter("pii_rejected")
    parts = F.split("pii_code", ":", 2)
    return hits.groupBy(parts[0].alias("kind"), parts[1].alias("path")).agg(F.count("*").alias("n"))


def pii_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return spread(derived.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", has_email(text).cast("int").alias("email"), has_phone(text).cast("int").alias("phone")
    )


def pii_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    turns = derived.table(spark, sf_dir, "conversations").select("conv_id", "role", "text")
    return spread(turns, "conv_id").groupBy("role").agg(
        F.count("*").alias("turns"),
        F.sum(has_email(text).cast("bigint")).alias("email"),
        F.sum(has_phone(text).cast("bigint")).alias("phone"),
    )


def pii_redacted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _judged(spark, sf_dir).filter("pii_rejected")
    return hits.select("event_id", redacted(F.col("raw")).alias("stored"))


# ---- metrics ----------------------------------------------------------------------

def metrics_event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.event_type_counts(_outcomes(spark, sf_dir), REGISTRY.sites)
    return counts.withColumn("metric_date", _day("metric_date"))


def metrics_reject_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.reason_counts(_judged(spark, sf_dir), REGISTRY.sites)
    return counts.withColumns({
        "metric_date": _day("metric_date"), "family": metrics.reason_family(F.col("reason")),
    })


def metrics_start_summary_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.start_summary_mismatch(_outcomes(spark, sf_dir), REGISTRY.sites)
    return rows.withColumn("metric_date", _day("metric_date"))


def metrics_unknown_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.unknown_bucket_events(_judged(spark, sf_dir), REGISTRY.sites)
    return rows.withColumn("metric_date", _day("metric_date"))


def metrics_dense_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = metrics.daily_metrics(_outcomes(spark, sf_dir), REGISTRY.sites)
    return _metric_row(metrics.dense_range(measured, REGISTRY.sites, *RANGE))


_UPSERTED = (
    "events_received", "events_accepted", "events_rejected", "distinct_sessions", "distinct_subjects",
    "summary_start_mismatch", "unknown_bucket_count",
)


def metrics_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with stale counts, and the second half of the month computed again."""
    measured = metrics.daily_metrics(_outcomes(spark, sf_dir), REGISTRY.sites).select(
        "site_id", "metric_date", F.lit(contract.METRICS_VERSION).alias("metrics_version"), *_UPSERTED
    )
    stale = measured.withColumns({**{n: F.lit(0).cast("bigint") for n in _UPSERTED}, "computed_ms": F.lit(1)})
    again = measured.filter("metric_date >= '2024-01-15'").withColumn("computed_ms", F.lit(2))
    merged = upsert_latest(stale, again, metrics.KEY, ["computed_ms"])
    return merged.withColumn("metric_date", _day("metric_date"))


def _counted(counts: str) -> Column:
    """A map of counts as text, by key."""
    entries = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(entries, "|").alias(counts)


def metrics_from_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored metrics after two runs of the job: over the first two micro-batches, then over what came after."""
    root, target = _ledgers(spark, sf_dir), new_run_dir(spark, "metrics")
    for through in (1, None):
        daily.run_daily(spark, root, target, REGISTRY.sites, F.lit(NOW).cast("timestamp"), through=through)
    rate = F.round(F.col("reject_rate").cast("double"), 5).alias("reject_rate")
    return daily.stored_metrics(spark, target).select(
        "site_id", _day("metric_date").alias("metric_date"), "metrics_version",
        *[F.col(n).cast("bigint").alias(n) for n in metrics.COUNTS], rate,
        _counted("event_type_counts"), _counted("reject_reason_counts"))


def metrics_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day, read from its own folders of the ledgers."""
    return _metric_row(daily.day_from_ledgers(spark, _ledgers(spark, sf_dir), REGISTRY.sites, (ONE_DAY, ONE_DAY)))


def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent reasons of every site and day, in descending order."""
    rejected = collect.rejected_table(spark, _ledgers(spark, sf_dir))
    outcomes = rejected.select("site_id", "received_at", "reason_codes", F.lit(False).alias("accepted"))
    top = metrics.top_reasons(metrics.reason_counts(outcomes, REGISTRY.sites), TOP_REASONS)
    return top.withColumns({"metric_date": _day("metric_date"), "place": F.col("place").cast("bigint")})


def distinct_over_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and subjects of each site over all days: exact, and whether the merged daily sketches agree."""
    accepted = collect.accepted_table(spark, _ledgers(spark, sf_dir)).filter(F.col("site_id").isin(*REGISTRY.sites))
    stored = _stored(sketches.daily_sketches(accepted), "sketches")
    exact = sketches.exact_distinct(accepted)
    return exact.join(sketches.estimated_distinct(stored), "site_id", "left").select(
        "site_id", *sketches.COUNTED.values(),
        *[sketches.agrees(name).cast("int").alias(f"{name}_agree") for name in sketches.COUNTED.values()])


# ---- replay -----------------------------------------------------------------------

def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.replay_rows(_accepted(spark, sf_dir), *REPLAY_WINDOW)
    return rows.select(
        "site_id", "ordinal", "event_id", "client_timestamp_ms",
        F.date_format("received_at", replay.LINE_TIME).alias("received_at"),
        F.sha2(replay.replay_line(F.col("raw")), 256).alias("line_sha256"),
    )


def replay_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = replay.replay_meta(_accepted(spark, sf_dir), *REPLAY_WINDOW)
    return meta.withColumn("collector_versions", F.array_join("collector_versions", ","))


def replay_export_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of every site for two windows, one of them without events, and their files checked again."""
    root = _ledgers(spark, sf_dir)
    checked = []
    for window in (REPLAY_WINDOW, EMPTY_WINDOW):
        target = new_run_dir(spark, "export")
        ledger_rows = collect.accepted_table(spark, root, window)
        replay.export_replays(ledger_rows, REGISTRY.sites, *window, target)
        checked.append(replay.verified_exports(spark, target))
    return checked[0].unionByName(checked[1]).select(
        "site_id", "window_start", "window_end", "event_count", "session_count", "subject_count",
        F.array_join("sort_order", ",").alias("sort_order"), F.array_join("collector_versions", ",").alias("collector_versions"),
        "damaged_parts", F.col("digest_holds").cast("int").alias("digest_holds"))


# ---- configuration ----------------------------------------------------------------

def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siteconfig.effective_config(derived.asked_sites(spark, sf_dir), derived.stored_configs(spark, sf_dir))


def config_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(spark, sf_dir)
    return siteconfig.config_entries(config, "config_272").unionByName(
        siteconfig.config_entries(config, "config_750")
    )


def config_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    gate = siteconfig.bootstrap_status(_config(spark, sf_dir), _accepted(spark, sf_dir), now)
    return gate.select(
        "site_id", F.col("runtime_days").cast("bigint").alias("runtime_days"), "eligible_sessions",
        F.col("required_runtime_days").cast("bigint").alias("required_runtime_days"),
        F.col("required_eligible_sessions").cast("bigint").alias("required_eligible_sessions"),
        F.col("bootstrap_met").cast("int").alias("bootstrap_met"),
    )


def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding: the asked sites get rows of both configurations, defaults merged with what is stored for them."""
    names = ("config_272", "config_750")
    stored = derived.stored_configs(spark, sf_dir).select("site_id", *names).withColumn("updated", F.lit(1))
    seed = siteconfig.seed_rows(_config(spark, sf_dir)).select("site_id", *names, F.lit(2).alias("updated"))
    merged = upsert_latest(stored, seed, ["site_id"], ["updated"])
    # Compared as digests of key=value lines in key order: the stored texts are JSON with members in any order.
    return merged.select("site_id", "updated", *[siteconfig.fingerprint(F.col(n)).alias(n) for n in names])


# ---- captures and decisions -------------------------------------------------------

def _captures(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    read = capture.read_captures(derived.capture_bodies(spark, sf_dir))
    return capture.enrich_captures(read, key)


def capture_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = capture.read_captures(derived.capture_bodies(spark, sf_dir))
    return read.select("capture_id", F.coalesce("error", F.lit("")).alias("error"))


def capture_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captures(spark, sf_dir).select(
        "capture_id", "site_id", "browser_id", "email_hash", "email_domain", "email_class",
        F.col("trigger_score").cast("double").alias("trigger_score"),
        _ms("purge_after").alias("purge_after_ms"),
    )


def _stored_captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures of the first week as already stored, and all of them arriving again."""
    rows = _captures(spark, sf_dir)
    early = rows.filter(F.col("captured_at") < F.lit("2024-01-08T00:00:00Z").cast("timestamp"))
    nothing = rows.filter(F.lit(False))
    return capture.new_captures(nothing, early), rows


def capture_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _stored_captures(spark, sf_dir)
    return capture.new_captures(stored, incoming).select("capture_id", "site_id", "email_hash")


def capture_after_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of captures, written by two runs, holds after a purge within a day."""
    path, rows = new_run_dir(spark, "captures"), _stored(_captures(spark, sf_dir, ROUND_TRIP_KEY), "captures-read")
    stores.append_captures(rows.filter(F.col("captured_at") < F.lit(STORED_BEFORE).cast("timestamp")), path, 0)
    stores.append_captures(rows, path, 1)
    stores.purge_captures(spark, path, PURGE_WITHIN_DAY)
    return stores.stored_captures(spark, path).select(
        "capture_id", "site_id", "email_hash", "email_class", _ms("purge_after").alias("purge_after_ms"), "epoch")


def decision_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored decisions per day and kind, after one of the two runs that wrote them was done twice."""
    path, log = new_run_dir(spark, "decisions"), _decisions(spark, sf_dir)
    odd = F.col("decision_id") % 2 == 1
    for epoch, part in ((0, ~odd), (1, odd), (1, odd)):
        stores.append_decisions(log.filter(part), path, epoch)
    return stores.stored_decisions(spark, path).groupBy(_day("decided_date").alias("decision_date"), "decision").agg(
        F.count("*").alias("n"))


def capture_download_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.download_urls(_captures(spark, sf_dir), derived.stored_configs(spark, sf_dir))


def capture_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(PURGE_AT).cast("timestamp")
    rows = _captures(spark, sf_dir)
    return rows.groupBy("email_class").agg(
        F.count(F.when(F.col("purge_after") < now, 1)).alias("purged"),
        F.count(F.when(F.col("purge_after") >= now, 1)).alias("kept"),
    )


def capture_encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened again, every sealed address still has the hash it was stored under."""
    rows = _captures(spark, sf_dir, ROUND_TRIP_KEY)
    opened = capture.decrypted(F.col("email_encrypted"), ROUND_TRIP_KEY)
    return rows.select("capture_id", F.sha2(opened, 256).alias("opened_hash"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_log(decisions.read_decisions(derived.decision_bodies(spark, sf_dir)))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(
        "decision_id", "site_id", "session_id", "browser_id", "decision",
        F.round(F.col("trigger_score").cast("double"), 4).alias("trigger_score"),
        F.round(F.col("trigger_confidence").cast("double"), 4).alias("trigger_confidence"),
        F.size("trigger_reasons").cast("bigint").alias("n_reasons"),
        "page_path", "page_group",
    )


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older layout and of the present one, read as one table."""
    rows = _stored(ledger.accepted_rows(_judged(spark, sf_dir), REGISTRY).drop("raw"), "layouts")
    split = F.lit("2024-01-15").cast("date")
    added = (
        "client_event_id", "page_view_id", "previous_page_view_id", "event_sequence_index",
        "event_contract_version",
    )
    old = rows.filter(F.col("received_date") < split).drop(*added)
    new = rows.filter(F.col("received_date") >= split)
    defaults = {"event_contract_version": F.lit(contract.LEGACY_CONTRACT)}
    both = evolve(old, schemas.ACCEPTED, defaults).unionByName(evolve(new, schemas.ACCEPTED, defaults))
    return both.select("event_id", "client_event_id", "page_view_id", "event_contract_version")


# ---- streaming --------------------------------------------------------------------

def stream_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source table read as a stream, collected into ledgers, and the accepted one read back."""
    schema = derived.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # The tasks of a file stream are the splits of its files; parsing needs far more of them.
    tasks = tasks_for(derived.table(spark, sf_dir, "events"))
    posts = _posts(derived.raw_events(source.drop("props").repartition(tasks, "event_id")))
    root = new_run_dir(spark, "collect")
    query = collect.start_collect(posts, root, REGISTRY, checkpoint=f"{root}/progress")
    query.awaitTermination()
    return collect.accepted_table(spark, root).select(
        F.col("batch_id").alias("event_id"), "site_id", "session_id", "client_event_id"
    )


def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected side of the same epochs: codes, and whether the text kept its contents."""
    rejected = collect.ledgers_at(spark, _ledgers(spark, sf_dir)).rejected
    return rejected.select(
        F.col("batch_id").alias("event_id"), _codes().alias("codes"),
        F.col("raw").startswith('{"_redacted":true').cast("int").alias("redacted"))


def stream_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as they were posted, collected in one micro-batch: those that were refused whole."""
    root = new_run_dir(spark, "collect")
    collect.collect_epoch(derived.event_batches(spark, sf_dir), 0, root, REGISTRY)
    return collect.refused_table(spark, root).select(
        "batch_id", F.coalesce("n_events", F.lit(-1)).cast("bigint").alias("n_events"), "error")


def stream_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per micro-batch: what came in, and what the three tables say became of it, read at one epoch."""
    root = _ledgers(spark, sf_dir)
    ledgers = collect.ledgers_at(spark, root)
    stored = [
        table.groupBy("epoch").agg(F.count("*").alias(f"stored_{name}"))
        for name, table in (("accepted", ledgers.accepted), ("rejected", ledgers.rejected))
    ]
    counts = collect.epoch_counts(spark, root).filter(F.col("epoch") <= ledgers.epoch)
    return counts.join(stored[0], "epoch", "left").join(stored[1], "epoch", "left").select(
        "epoch", "events", "accepted", "rejected", "repeated", "refused_batches",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("stored_accepted", "stored_rejected")])


# ---- evidence chains and monitors -------------------------------------------------

def lead_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = chains.grade_leads(_stored(_accepted(spark, sf_dir), "ledger"))
    flags = ("had_view", "had_click", "had_success")
    return graded.select("event_id", "source_kind", "grade", *[F.col(n).cast("int").alias(n) for n in flags])


def form_start_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.first_form_starts(_accepted(spark, sf_dir)).select(
        "event_id", "site_id", "session_id", "form_id"
    )


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.session_rollup(_accepted(spark, sf_dir))


def session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.session_paths(_accepted(spark, sf_dir))


def page_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.page_lineage(_accepted(spark, sf_dir))


def _stored_sites_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective configuration of the sites that store one; the others have the defaults."""
    stored = derived.stored_configs(spark, sf_dir)
    return siteconfig.effective_config(stored, stored)


def fire_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = monitors.fire_rates(_decisions(spark, sf_dir), _stored_sites_config(spark, sf_dir))
    return rates.withColumn("decision_date", _day("decision_date"))


def fire_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.cooldown_breaches(_decisions(spark, sf_dir), _stored_sites_config(spark, sf_dir))


def eligibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = metrics.daily_metrics(_outcomes(spark, sf_dir), REGISTRY.sites)
    gate = monitors.eligibility(measured, _stored_sites_config(spark, sf_dir))
    return gate.withColumn("metric_date", _day("metric_date"))


def replay_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of runs against the meta records and the files of the exports that they claim to have read."""
    root = _ledgers(spark, sf_dir)
    exports, lines, files = [], [], []
    for start, end in RECONCILED:
        target = new_run_dir(spark, "export")
        replay.export_replays(collect.accepted_table(spark, root, (start, end)), REGISTRY.sites, start, end, target)
        window = F.lit(f"{start}T00:00:00Z").alias("window_start")
        exports.append(replay.export_meta(spark, target))
        lines.append(replay.export_lines(spark, target).select("site_id", window, "line"))
        read = replay.file_digests(spark, target, REGISTRY.sites)
        files.append(read.select("site_id", window, "sha256"))
    cards = _stored(derived.evidence_cards(lines[0].union(lines[1])), "cards")
    starts = tuple(f"{start}T00:00:00Z" for start, _ in RECONCILED)
    runs = _stored(derived.replay_runs(cards, files[0].union(files[1]), starts), "runs")
    differing = monitors.differing_distributions(runs, cards, derived.RUN_MAPS)
    stated = runs.select("run_id", F.col("subjects_total").cast("bigint").alias("subjects_total"), _counted("action_distribution"))
    checked = monitors.reconcile_runs(runs, exports[0].union(exports[1]))
    return checked.join(differing, "run_id", "left").join(stated, "run_id", "left").select(
        "site_id", "window_start", "run_id", "status", F.coalesce("differing", F.lit("")).alias("differing"),
        "subjects_total", "action_distribution")


def card_lineage_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = derived.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("card_id"),
        F.array(*[F.col("event_id") + step for step in (0, 1, 7)]).alias("source_event_ids"),
    )
    return monitors.lineage_orphans(cards, _accepted(spark, sf_dir)).groupBy("card_id").agg(
        F.count("*").alias("orphans")
    )


def trust_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    state = derived.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("b"), key.cast("string")).alias("subject_id"),
        F.when(key % 4 != 0, (key % 100).cast("int")).alias("trust_score"),
        F.timestamp_millis(F.lit(0)).alias("updated_at"), key.alias("change_id"),
    )
    event = F.col("event_id")
    changes = derived.flat_events(derived.table(spark, sf_dir, "events")).select(
        F.coalesce("browser_id", F.lit("b")).alias("subject_id"),
        F.when(event % 3 == 0, F.lit("pricing")).alias("domain"),
        (event % 101).cast("int").alias("trust_score"),
        F.when(event % 5 == 0, F.lit("raised")).alias("trust_band"),
        F.timestamp_millis("received_ms").alias("updated_at"), event.alias("change_id"),
    )
    rows = monitors.upsert_trust(_with_band(state), changes)
    return rows.select(
        "subject_id", "domain", F.col("trust_score").cast("bigint").alias("trust_score"),
        "trust_band", "probation_state", "change_id",
    )


def _with_band(state: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return state.withColumns({"domain": none, "trust_band": none})


def strict_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = _judged(spark, sf_dir, strict=True).select("event_type", F.explode("reason_codes").alias("reason"))
    return reasons.filter(F.col("reason").startswith("STRICT_")).groupBy("event_type", "reason").agg(
        F.count("*").alias("n")
    )


def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _decisions(spark, sf_dir)
    sites = derived.asked_sites(spark, sf_dir)
    config = siteconfig.effective_config(sites, derived.stored_configs(spark, sf_dir))
    return decisions.audit_decisions(log, config).withColumn("decision_date", _day("decision_date"))


_ALL: tuple[Query, ...] = (
    truth_metrics_daily, collect_outcome_by_type, collect_reason_counts, collect_reason_array,
    accepted_dedup, accepted_envelope, timestamp_policy, contract_version_counts, batch_admission,
    batch_events_judged, odd_elements_judged, pii_event_hits, pii_documents, pii_conversations, pii_redacted_rows,
    metrics_event_type_counts, metrics_reject_reason_counts, metrics_start_summary_mismatch,
    metrics_unknown_bucket, metrics_dense_range, metrics_upsert, metrics_from_ledgers, metrics_one_day, top_reasons,
    distinct_over_range, replay_rows, replay_meta, replay_export_meta,
    config_effective, config_bootstrap, config_upsert, capture_validation, capture_enrich,
    capture_insert_if_absent, capture_download_url, capture_purge, capture_after_purge, capture_encrypt_roundtrip,
    decision_log, decision_store, schema_evolution, stream_collect, stream_rejected, stream_refused, stream_balance, lead_grade, form_start_first, session_rollup,
    session_paths, page_lineage, fire_rate, fire_cooldown, eligibility_gate, replay_reconcile,
    card_lineage_orphans, trust_upsert, strict_contract, decision_audit,
)


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def catalogue() -> dict[str, Query]:
    return {query.__name__: _configured(query) for query in _ALL}
