"""Column layouts of the stored tables, as Spark DDL."""

ACCEPTED = (
    "event_id bigint, site_id string, hostname string, event_type string, session_id string, "
    "browser_id string, client_timestamp_ms bigint, received_at timestamp, raw string, "
    "collector_version string, client_event_id string, page_view_id string, "
    "previous_page_view_id string, event_sequence_index int, event_contract_version string, "
    "batch_id bigint, pos int"
)
REJECTED = (
    "site_id string, raw string, reason_codes array<string>, received_at timestamp, "
    "collector_version string, batch_id bigint, pos int"
)
REFUSED_BATCHES = "batch_id bigint, error string, n_events int, received_at timestamp"
SITE_CONFIGS = (
    "site_id string, config_272 string, config_750 string, deploy_start_date date, updated_at timestamp"
)
METRICS = (
    "site_id string, metric_date date, metrics_version string, computed_at timestamp, "
    "events_received int, events_accepted int, events_rejected int, distinct_sessions int, "
    "distinct_subjects int, summary_start_mismatch int, unknown_bucket_count int, "
    "reject_rate float, event_type_counts map<string,bigint>, reject_reason_counts map<string,bigint>"
)
DECISIONS = (
    "site_id string, session_id string, browser_id string, decision string, trigger_score float, "
    "trigger_confidence float, trigger_threshold float, trigger_reasons array<string>, "
    "safety_result string, safety_reason string, page_path string, page_group string, "
    "config_version string, probe_version string, decided_at timestamp"
)
CAPTURES = (
    "capture_id bigint, site_id string, session_id string, browser_id string, email_hash string, "
    "email_domain string, email_class string, email_encrypted string, asset_key string, "
    "trigger_score float, trigger_confidence float, trigger_reasons array<string>, "
    "mx_verified boolean, config_version string, probe_version string, captured_at timestamp, "
    "purge_after timestamp"
)
REPLAY_RUNS = (
    "run_id string, site_id string, window_start timestamp, window_end timestamp, "
    "collector_versions array<string>, schema_version string, adapter_version string, "
    "mapping_spec_version string, scoring_config_version string, report_renderer_version string, "
    "source_file string, source_sha256 string, subjects_total int, subjects_scoreable int, "
    "subjects_degraded int, subjects_unscorable int, trq_distribution map<string,bigint>, "
    "intent_distribution map<string,bigint>, window_distribution map<string,bigint>, "
    "action_distribution map<string,bigint>, reason_code_frequencies map<string,bigint>, "
    "created_at timestamp"
)
EVIDENCE_CARDS = (
    "card_id bigint, run_id string, subject_id string, status string, evidence_card string, "
    "adapter_quality string, source_event_ids array<bigint>"
)
TRUST_STATE = (
    "subject_id string, domain string, trust_score int, trust_band string, probation_state string, "
    "recovery_state string, reason_codes array<string>, last_decision_at timestamp, updated_at timestamp"
)
