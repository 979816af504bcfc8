"""Fixed values of the event contract, and the per-deployment registry."""

from __future__ import annotations

from dataclasses import dataclass

# ---- Fixed values: event contract -------------------------------------------------
EVENT_TYPES = (
    "session_start", "page_view", "page_state", "cta_click",
    "form_start", "form_submit", "generate_lead", "session_summary",
)
LEGACY_TYPES = ("session_start", "page_state", "session_summary")
CANONICAL_TYPES = ("page_view", "cta_click", "form_start", "form_submit", "generate_lead")
DEPRECATED_TYPES = ("cta_state", "form_state")

LEGACY_CONTRACT = "legacy-thin-v2.0"
CANONICAL_CONTRACT = "event-contract-v0.1"
SCHEMA_VERSION = "thin.v2.0"
CONSENT_GRANTED = "granted"

DWELL_BUCKETS = ("<5s", "5-10s", "10-30s", "30-90s", "90-300s", ">300s")
SCROLL_BUCKETS = ("0", "1-25", "26-50", "51-75", "76-100")
INTERACTION_BUCKETS = ("0", "1-2", "3-5", "6-10", ">10")

SUBMIT_OUTCOMES = ("success", "error", "unknown")
ERROR_BUCKETS = ("validation_error", "network_error", "provider_error", "unknown")
SOURCE_KINDS = (
    "form_success", "thank_you_page", "ajax_success",
    "external_booking_confirmation", "gated_download_confirmation",
    "newsletter_confirmation", "manual_test_isolated",
)

MAX_BATCH_EVENTS = 50
FUTURE_TOLERANCE_MS = 300_000
STALE_AFTER_MS = 90 * 86_400_000
RETENTION_DAYS = 90

# ---- Fixed values: personal-data screening ----------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# White space as ECMAScript's \s defines it; neither Java's nor Python's \s is the same set.
WHITESPACE_CLASS = (
    "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
PHONE_PATTERN = (
    rf"(?:\+?[0-9]{{1,4}}[{WHITESPACE_CLASS}-]?)?\(?[0-9]{{2,4}}\)?"
    rf"[{WHITESPACE_CLASS}.-]?[0-9]{{3,4}}[{WHITESPACE_CLASS}.-]?[0-9]{{3,4}}"
)
PII_KEYS = (
    "email", "phone", "name", "first_name", "last_name", "full_name",
    "message", "address", "postcode", "zip_code", "postal_code",
    "company", "organisation", "organization",
)
STRUCTURAL_KEYS = (
    "anon_session_id", "anon_browser_id", "session_id", "browser_id",
    "client_event_id", "page_view_id", "previous_page_view_id",
    "source_page_view_id", "event_type", "event_schema_version",
    "event_contract_version", "site_id", "hostname", "collector_version",
    "client_timestamp_ms", "event_sequence_index", "occurred_at", "timestamp",
    "adapter_id", "adapter_version", "dedupe_key",
)
REDACTION_KEEPS = (
    "event_type", "site_id", "anon_session_id",
    "client_event_id", "client_timestamp_ms", "event_schema_version",
)

# ---- Fixed values: captures and decisions -----------------------------------------
FREEMAIL_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com",
    "icloud.com", "protonmail.com", "mail.com", "yandex.com", "gmx.com",
)
DISPOSABLE_DOMAINS = (
    "mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "yopmail.com",
)
DECISIONS = ("fire", "hold", "suppress", "dismiss")

# ---- Fixed values: configuration defaults, one JSON text per key -------------------
ANALYSIS_DEFAULTS = {
    "analysis_window_days": "30",
    "min_eligible_sessions": "200",
    "min_valid_event_rate": "0.7",
}
PROBE_DEFAULTS = {
    "enabled": "false",
    "legal_mode": '"disabled"',
    "trigger_threshold": "0.68",
    "confidence_floor": "0.5",
    "eligible_page_groups": '["pricing","product"]',
    "excluded_paths": '["/legal","/thank-you"]',
    "cooldown_hours": "72",
    "max_fire_per_session": "1",
    "daily_budget": "20",
    "bootstrap": '{"min_eligible_sessions":500,"min_runtime_days":14}',
    "fire_rate": (
        '{"auto_disable_pct":8,"auto_disable_window_days":7,"auto_raise_pct":5,'
        '"auto_raise_window_days":7,"circuit_breaker_pct":10}'
    ),
    "dismiss_rate": '{"raise_at_pct":70,"window_days":14}',
    "asset_key": '"buyer_checklist_v1"',
    "asset_url": '"/assets/downloads/buyer-checklist.pdf"',
    "modal_copy": (
        '{"body":"A 1-page guide covering the 5 things most B2B buyers miss during evaluation.",'
        '"cta_text":"Get the checklist","dismiss_text":"No thanks",'
        '"headline":"Before you go — grab the buyer checklist"}'
    ),
    "kill_switch": "false",
    "debug_mode": "false",
    "event_logging_verbosity": '"normal"',
    "probe_version": '"1.0.0"',
}
DEFAULT_REQUIRED_DAYS = 14
DEFAULT_REQUIRED_SESSIONS = 500

COLLECTOR_VERSION = "1.0.0"
METRICS_VERSION = "1.0.0"
EXPORT_VERSION = "1.0.0"


@dataclass(frozen=True)
class Registry:
    """Sites a deployment serves, and the version stamped on what it stores."""

    sites: tuple[str, ...]
    collector_version: str = COLLECTOR_VERSION
