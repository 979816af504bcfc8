import json

from events import DAY_MS, NOW_MS, TYPES, event, judge

LEGACY = ("session_start", "page_state", "session_summary")

CASES = [
    *[(event(t), []) for t in TYPES],
    *[(event(t, "client_event_id", "event_contract_version"), []) for t in LEGACY],
    (event("session_start", "client_timestamp_ms", occurred_at=NOW_MS), []),
    (event("session_start", "client_timestamp_ms", timestamp=NOW_MS), []),
    # The first numeric clock wins even when it is no integer.
    (event("session_start", client_timestamp_ms=1.5, occurred_at=NOW_MS), ["INVALID_TIMESTAMP"]),
    (event("session_start", client_timestamp_ms="1", occurred_at=NOW_MS), []),
    (event("session_start", client_timestamp_ms=float(NOW_MS)), []),
    (event("session_start", client_timestamp_ms=True), ["INVALID_TIMESTAMP"]),
    (event("session_start", client_timestamp_ms=0), ["INVALID_TIMESTAMP"]),
    (event("session_start", client_timestamp_ms=NOW_MS + 300_000), []),
    (event("session_start", client_timestamp_ms=NOW_MS + 300_001), ["FUTURE_TIMESTAMP"]),
    (event("session_start", client_timestamp_ms=1e300), ["FUTURE_TIMESTAMP"]),
    (
        '{"event_type":"session_start","event_schema_version":"thin.v2.0","consent_signal":"granted",'
        '"site_id":"site_0","anon_session_id":"s","anon_browser_id":"b","timestamp":1e999}',
        ["INVALID_TIMESTAMP"],
    ),
    (event("session_start", client_timestamp_ms=NOW_MS - 90 * DAY_MS), []),
    (event("session_start", client_timestamp_ms=NOW_MS - 90 * DAY_MS - 1), ["STALE_TIMESTAMP"]),
    (event("page_view", "client_event_id"), ["MISSING_CLIENT_EVENT_ID"]),
    (event("page_view", client_event_id=""), ["MISSING_CLIENT_EVENT_ID"]),
    (event("cta_click", "event_contract_version"), ["MISSING_OR_INVALID_EVENT_CONTRACT_VERSION"]),
    (event("page_view", "page_view_id"), ["MISSING_PAGE_VIEW_ID"]),
    (event("page_view", page_view_id=7), ["MISSING_PAGE_VIEW_ID"]),
    (event("page_view", "path"), ["MISSING_PATH"]),
    (event("page_state", "page_view_id"), []),
    (event("cta_click", "cta_id"), ["MISSING_CTA_ID_OR_LABEL_BUCKET"]),
    (event("cta_click", "cta_id", cta_label_bucket="hero"), []),
    (event("cta_click", "href_category"), ["MISSING_HREF_CATEGORY"]),
    (event("cta_click", "click_offset_ms"), ["MISSING_CLICK_OFFSET"]),
    (event("cta_click", "click_offset_ms", ms_since_page_load=1), []),
    (event("form_start", "form_id"), ["MISSING_FORM_ID"]),
    (event("form_start", "page_view_id"), ["MISSING_PAGE_VIEW_ID"]),
    (event("form_start", "ms_since_page_load"), ["MISSING_FORM_START_OFFSET"]),
    (event("form_start", "ms_since_page_load", form_start_offset_ms=9.5), []),
    (event("form_submit", "form_id"), ["MISSING_FORM_ID"]),
    (event("form_submit", "submit_outcome"), ["MISSING_OR_INVALID_SUBMIT_OUTCOME"]),
    (event("form_submit", submit_outcome="maybe"), ["MISSING_OR_INVALID_SUBMIT_OUTCOME"]),
    (event("form_submit", submit_outcome="error"), []),
    (event("generate_lead", "lead_type"), ["MISSING_LEAD_TYPE"]),
    (event("generate_lead", "source_kind"), ["MISSING_OR_INVALID_SOURCE_KIND"]),
    (event("generate_lead", source_kind="magic"), ["MISSING_OR_INVALID_SOURCE_KIND"]),
    (event("generate_lead", source_kind="thank_you_page"), []),
    (event("generate_lead", "source_page_view_id", "page_view_id"), ["MISSING_SOURCE_PAGE_VIEW_ID"]),
    (event("generate_lead", "page_view_id", source_page_view_id=""), []),
    (event("session_start", event_type="click"), ["UNKNOWN_EVENT_TYPE"]),
    (event("session_start", event_type=5), ["UNKNOWN_EVENT_TYPE"]),
    (event("session_start", event_schema_version="thin.v1.0"), ["UNKNOWN_SCHEMA_VERSION"]),
    (event("session_start", consent_signal="pending"), ["CONSENT_NOT_GRANTED"]),
    (event("session_start", site_id="site_x"), ["UNKNOWN_SITE_ID"]),
    (event("session_start", anon_session_id=""), ["MISSING_SESSION_ID"]),
    (event("session_start", "anon_browser_id"), ["MISSING_BROWSER_ID"]),
    (
        event("session_start", consent_signal="denied", site_id="bad"),
        ["CONSENT_NOT_GRANTED", "UNKNOWN_SITE_ID"],
    ),
    (event("page_state", engagement_proxy={"dwell_bucket": "invalid"}), ["UNKNOWN_BUCKET_VALUE"]),
    (
        event("session_summary", engagement_proxy={
            "dwell_bucket": 1, "scroll_depth_bucket": True, "interaction_density_bucket": {},
        }),
        ["UNKNOWN_BUCKET_VALUE"] * 3,
    ),
    (
        event("page_state", engagement_proxy={
            "dwell_bucket": 0, "scroll_depth_bucket": "", "interaction_density_bucket": None,
        }),
        [],
    ),
    (event("page_state", engagement_proxy=[1]), []),
    (event("page_view", event_sequence_index=3.0), []),
    (event("page_view", event_sequence_index="x"), []),
    (event("page_view", event_sequence_index=1.5), ["STORAGE_TYPE_ERROR"]),
    (event("page_view", event_sequence_index=2**31), ["STORAGE_TYPE_ERROR"]),
    (
        event("cta_click", cta_text_truncated_safe="Contact pii-test@example.invalid now"),
        ["PII_IN_VALUE:.cta_text_truncated_safe"],
    ),
    (event("cta_click", cta_text_truncated_safe="Call +44 20 7946 0958"), ["PII_IN_VALUE:.cta_text_truncated_safe"]),
    (event("session_start", email="test@example.com"), ["PII_KEY_PRESENT:.email"]),
    (event("form_start", Company=None), ["PII_KEY_PRESENT:.Company"]),
    (event("session_start", user_email="x"), []),
    (
        event("page_state", adapter_context={"group": "home", "user_email": "test@example.com"}),
        ["PII_IN_VALUE:.adapter_context.user_email"],
    ),
    (event("session_start", dedupe_key={"email": "a@b.co"}), []),
    (event("session_start", list=["a", ["b", "ip 10.1234.5678"]]), ["PII_IN_VALUE:.list[1][1]"]),
    ("5", ["INVALID_EVENT_OBJECT"]),
    ("null", ["INVALID_EVENT_OBJECT"]),
    ('"a@b.co"', ["INVALID_EVENT_OBJECT"]),
    ('{"a":', ["INVALID_EVENT_OBJECT"]),
    (
        '[ "a@b.co" ]',
        [
            "UNKNOWN_EVENT_TYPE", "UNKNOWN_SCHEMA_VERSION", "CONSENT_NOT_GRANTED", "UNKNOWN_SITE_ID",
            "MISSING_SESSION_ID", "MISSING_BROWSER_ID", "INVALID_TIMESTAMP", "PII_IN_VALUE:[0]",
        ],
    ),
]


def test_reason_codes_in_order(spark):
    verdicts = judge(spark, [case for case, _ in CASES])
    for (case, expected), verdict in zip(CASES, verdicts, strict=True):
        assert verdict.reason_codes == expected, case
        assert verdict.accepted == (not expected)
        assert verdict.pii_rejected == any(code.startswith("PII") for code in expected)


def test_envelope(spark):
    legacy = event("session_start", "client_event_id", "event_contract_version", hostname=3)
    own = event("page_state", event_contract_version="mine", page_view_id="", client_event_id="")
    late = event("page_view", client_timestamp_ms=1)
    repeated = '{"site_id":"site_1","site_id":"site_0"}'
    rows = judge(spark, [legacy, own, late, repeated])
    assert rows[0].event_contract_version == "legacy-thin-v2.0"
    assert rows[0].hostname is None and rows[0].client_event_id is None
    assert rows[1].event_contract_version == "mine"
    assert rows[1].page_view_id == "" and rows[1].client_event_id is None
    # A stale time is reported and kept.
    assert rows[2].reason_codes == ["STALE_TIMESTAMP"] and rows[2].client_timestamp_ms == 1
    assert rows[3].site_id == "site_0"


def test_strict_profile_adds_codes_only(spark):
    events = [event("session_summary"), event("cta_click", "page_view_id"), event("page_view")]
    rows = judge(spark, events, strict=True)
    assert rows[0].reason_codes == [
        "STRICT_MISSING_PAGE_COUNT", "STRICT_MISSING_PATH_SUMMARY", "STRICT_MISSING_TIMING",
        "STRICT_MISSING_INTERACTION_DENSITY",
    ]
    assert rows[1].reason_codes == ["STRICT_MISSING_PAGE_VIEW_ID"]
    assert rows[2].reason_codes == []


def test_what_cannot_be_screened_is_never_accepted(spark):
    clean = json.dumps(event("page_view"))
    odd = json.dumps(event("page_view", note="reach me: q@r.st"))
    deep = clean[:-1] + ', "x": ' + "[" * 5000 + '"q@r.st"' + "]" * 5000 + "}"
    digits = clean[:-1] + ', "note": "q@r.st", "x": ' + "7" * 6000 + "}"
    texts = [odd + " trailing", odd + odd, odd.replace('"', "'"), deep, digits, "q@r.st"]
    for row in judge(spark, texts):
        assert not row.accepted and (row.pii_rejected or row.reason_codes == ["INVALID_EVENT_OBJECT"])
    assert [r.pii_code for r in judge(spark, [digits, odd + odd])] == ["PII_SCREEN_IMPOSSIBLE"] * 2


def test_half_a_surrogate_pair_in_a_key_is_no_reason_to_fail(spark):
    text = json.dumps(event("page_view"))[:-1] + ', "\\ud800": "q@r.st"}'
    (row,) = judge(spark, [text])
    assert row.pii_rejected and row.pii_code.startswith("PII_IN_VALUE:.")
