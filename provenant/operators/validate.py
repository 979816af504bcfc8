"""Event contract: ordered reason codes, envelope columns and the accept decision.

Every rule is a column expression over one parsed VARIANT, so a validation pass is a chain of
projections without a shuffle. Reason codes are gathered with ``concat_ws`` (which skips NULLs
and keeps order and repeats) because higher-order array functions leave whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant import contract
from provenant.contract import Registry
from provenant.functions.jsontypes import (
    is_array, is_object, list_sql, number_sql, once, string_sql, top_level, truthy_sql,
)
from provenant.operators.pii import UNSCREENED, first_hit

STORAGE_TYPE_ERROR = "STORAGE_TYPE_ERROR"

# Members read, and the event types that read them (None: all), so that the type tests of a
# member run only for events that have a rule on it.
_STRINGS = {
    "event_schema_version": None, "consent_signal": None, "site_id": None,
    "anon_session_id": None, "anon_browser_id": None, "hostname": None, "client_event_id": None,
    "page_view_id": None, "previous_page_view_id": None, "event_contract_version": None,
    "path": ("page_view", "session_start"),
    "cta_id": ("cta_click",), "cta_label_bucket": ("cta_click",), "href_category": ("cta_click",),
    "form_id": ("form_start", "form_submit"), "submit_outcome": ("form_submit",),
    "lead_type": ("generate_lead",), "source_kind": ("generate_lead",),
    "source_page_view_id": ("generate_lead",),
}
_NUMBERS = {
    "client_timestamp_ms": None, "occurred_at": None, "timestamp": None,
    "event_sequence_index": None,
    "click_offset_ms": ("cta_click",), "ms_since_page_load": ("cta_click", "form_start"),
    "form_start_offset_ms": ("form_start",),
}
_STRICT_STRINGS = {"error_bucket": ("form_submit",)}
_STRICT_PRESENT = (
    "page_count", "path_summary", "timing_summary", "timing_buckets", "interaction_density",
)
_BUCKETS = (
    ("dwell_bucket", contract.DWELL_BUCKETS),
    ("scroll_depth_bucket", contract.SCROLL_BUCKETS),
    ("interaction_density_bucket", contract.INTERACTION_BUCKETS),
)
_ENGAGED = ("page_state", "session_summary")
_OUT_OF_RANGE = 2**31


def _members(strict: bool) -> tuple[str, ...]:
    names = ("event_type", *_STRINGS, *_NUMBERS, "engagement_proxy")
    return names + ((*_STRICT_STRINGS, *_STRICT_PRESENT) if strict else ())


def _fields(strict: bool) -> Column:
    """Struct of every member a rule reads; a missing or wrongly typed one is NULL."""
    kind = string_sql("_j.event_type")

    def only(types: tuple[str, ...] | None, value: str) -> str:
        return value if types is None else f"case when {kind} in {list_sql(types)} then {value} end"

    strings = _STRINGS | (_STRICT_STRINGS if strict else {})
    parts = {"event_type": kind}
    parts |= {n: only(types, string_sql(f"_j.{n}")) for n, types in strings.items()}
    parts |= {f"num_{n}": only(types, number_sql(f"_j.{n}")) for n, types in _NUMBERS.items()}
    for name, allowed in _BUCKETS:
        value = f"try_variant_get(_j.engagement_proxy, '$.{name}', 'variant')"
        known = f"coalesce({string_sql(value)} in {list_sql(allowed)}, false)"
        parts[f"bad_{name}"] = only(_ENGAGED, f"{truthy_sql(value)} and not {known}")
    if strict:
        parts |= {
            f"has_{n}": f"coalesce(schema_of_variant(_j.{n}), 'VOID') <> 'VOID'" for n in _STRICT_PRESENT
        }
    return F.expr("struct(" + ", ".join(f"{sql} as {name}" for name, sql in parts.items()) + ")")


def _absent(name: str) -> str:
    return f"coalesce(_f.{name}, '') = ''"


def _on(*types: str) -> str:
    return f"coalesce(_f.event_type in {list_sql(types)}, false)"


def _unlisted(name: str, values: tuple[str, ...]) -> str:
    return f"not coalesce(_f.{name} in {list_sql(values)}, false)"


# rint keeps a double, where floor would saturate at the largest bigint.
_VALID_TIME = "coalesce(_ts = rint(_ts) and _ts > 0 and _ts < double('Infinity'), false)"


def _rules(registry: Registry) -> list[tuple[str, str]]:
    """(predicate, code) in reporting order."""
    canonical = _on(*contract.CANONICAL_TYPES)
    now = "cast(unix_millis(received_at) as double)"
    return [
        (_unlisted("event_type", contract.EVENT_TYPES), "UNKNOWN_EVENT_TYPE"),
        (f"not (_f.event_schema_version <=> '{contract.SCHEMA_VERSION}')", "UNKNOWN_SCHEMA_VERSION"),
        (f"not (_f.consent_signal <=> '{contract.CONSENT_GRANTED}')", "CONSENT_NOT_GRANTED"),
        (_unlisted("site_id", registry.sites), "UNKNOWN_SITE_ID"),
        (_absent("anon_session_id"), "MISSING_SESSION_ID"),
        (_absent("anon_browser_id"), "MISSING_BROWSER_ID"),
        (f"not {_VALID_TIME}", "INVALID_TIMESTAMP"),
        (f"{_VALID_TIME} and _ts > {now} + {contract.FUTURE_TOLERANCE_MS}", "FUTURE_TIMESTAMP"),
        (f"{_VALID_TIME} and _ts < {now} - {contract.STALE_AFTER_MS}", "STALE_TIMESTAMP"),
        (f"{canonical} and {_absent('client_event_id')}", "MISSING_CLIENT_EVENT_ID"),
        (
            f"{canonical} and not (_f.event_contract_version <=> '{contract.CANONICAL_CONTRACT}')",
            "MISSING_OR_INVALID_EVENT_CONTRACT_VERSION",
        ),
        (
            f"{_on('page_view', 'form_start', 'form_submit')} and {_absent('page_view_id')}",
            "MISSING_PAGE_VIEW_ID",
        ),
        (f"{_on('page_view')} and {_absent('path')}", "MISSING_PATH"),
        (
            f"{_on('cta_click')} and {_absent('cta_id')} and {_absent('cta_label_bucket')}",
            "MISSING_CTA_ID_OR_LABEL_BUCKET",
        ),
        (f"{_on('cta_click')} and {_absent('href_category')}", "MISSING_HREF_CATEGORY"),
        (
            f"{_on('cta_click')} and _f.num_click_offset_ms is null and _f.num_ms_since_page_load is null",
            "MISSING_CLICK_OFFSET",
        ),
        (f"{_on('form_start', 'form_submit')} and {_absent('form_id')}", "MISSING_FORM_ID"),
        (
            f"{_on('form_start')} and _f.num_ms_since_page_load is null "
            "and _f.num_form_start_offset_ms is null",
            "MISSING_FORM_START_OFFSET",
        ),
        (
            f"{_on('form_submit')} and {_unlisted('submit_outcome', contract.SUBMIT_OUTCOMES)}",
            "MISSING_OR_INVALID_SUBMIT_OUTCOME",
        ),
        (f"{_on('generate_lead')} and {_absent('lead_type')}", "MISSING_LEAD_TYPE"),
        (
            f"{_on('generate_lead')} and {_unlisted('source_kind', contract.SOURCE_KINDS)}",
            "MISSING_OR_INVALID_SOURCE_KIND",
        ),
        # An empty id passes here: only the type is checked.
        (
            f"{_on('generate_lead')} and _f.source_page_view_id is null and _f.page_view_id is null",
            "MISSING_SOURCE_PAGE_VIEW_ID",
        ),
        # One code per bad bucket, so the same code may appear up to three times.
        *[(f"coalesce(_f.bad_{name}, false)", "UNKNOWN_BUCKET_VALUE") for name, _ in _BUCKETS],
    ]


def _strict_rules() -> list[tuple[str, str]]:
    """Fields the contract document asks for and the base rules do not check (ours)."""
    summary = _on("session_summary")
    return [
        (_on(*contract.DEPRECATED_TYPES), "STRICT_DEPRECATED_EVENT_TYPE"),
        (f"{_on('session_start')} and {_absent('path')}", "STRICT_MISSING_PATH"),
        (f"{_on('session_start')} and {_absent('hostname')}", "STRICT_MISSING_HOSTNAME"),
        (
            f"{_on('session_start')} and {_absent('event_contract_version')}",
            "STRICT_MISSING_CONTRACT_VERSION",
        ),
        (f"{_on('page_state', 'cta_click')} and {_absent('page_view_id')}", "STRICT_MISSING_PAGE_VIEW_ID"),
        (
            f"{_on('form_submit')} and _f.error_bucket is not null "
            f"and {_unlisted('error_bucket', contract.ERROR_BUCKETS)}",
            "STRICT_UNKNOWN_ERROR_BUCKET",
        ),
        (f"{summary} and not _f.has_page_count", "STRICT_MISSING_PAGE_COUNT"),
        (f"{summary} and not _f.has_path_summary", "STRICT_MISSING_PATH_SUMMARY"),
        (
            f"{summary} and not _f.has_timing_summary and not _f.has_timing_buckets",
            "STRICT_MISSING_TIMING",
        ),
        (f"{summary} and not _f.has_interaction_density", "STRICT_MISSING_INTERACTION_DENSITY"),
    ]


def _codes(rules: list[tuple[str, str]]) -> str:
    broken = ", ".join(f"case when {test} then '{code}' end" for test, code in rules)
    return f"case when _object then concat_ws('|', {broken}) else 'INVALID_EVENT_OBJECT' end"


_CONTRACT_VERSION = (
    f"case when {_on(*contract.CANONICAL_TYPES)} then '{contract.CANONICAL_CONTRACT}' "
    f"when {_on(*contract.LEGACY_TYPES)} and _f.event_contract_version <> '' then _f.event_contract_version "
    f"else '{contract.LEGACY_CONTRACT}' end"
)
# The ledger column is a 32-bit integer.
_STORABLE = (
    "coalesce(_f.num_event_sequence_index = rint(_f.num_event_sequence_index) "
    f"and _f.num_event_sequence_index >= -{_OUT_OF_RANGE} "
    f"and _f.num_event_sequence_index < {_OUT_OF_RANGE}, true)"
)
# Column name -> expression over the fields read.
_ENVELOPE_SQL = {
    "site_id": "_f.site_id",
    "hostname": "_f.hostname",
    "event_type": "_f.event_type",
    "session_id": "_f.anon_session_id",
    "browser_id": "_f.anon_browser_id",
    "client_timestamp_ms": f"case when {_VALID_TIME} then try_cast(_ts as bigint) end",
    "client_event_id": "nullif(_f.client_event_id, '')",
    "page_view_id": "_f.page_view_id",
    "previous_page_view_id": "_f.previous_page_view_id",
    "event_sequence_index": f"case when {_STORABLE} then try_cast(_f.num_event_sequence_index as int) end",
    "event_contract_version": _CONTRACT_VERSION,
}
ENVELOPE = tuple(_ENVELOPE_SQL)


def validate_events(events: DataFrame, registry: Registry, *, strict: bool = False) -> DataFrame:
    """Judge one row per event.

    ``events`` needs ``raw`` (JSON text) and ``received_at``; the receipt time is the clock for
    the age rules, so reruns agree. Adds the envelope columns, ``reason_codes``, ``pii_code``,
    ``pii_rejected`` and ``accepted``. ``strict`` appends the document-only codes.
    """
    carried = events.columns
    rules = _rules(registry) + (_strict_rules() if strict else [])
    parsed = once(events, "_j", top_level(F.col("raw"), _members(strict)))
    # An array counts as an object without members, as it does for JavaScript.
    typed = parsed.withColumn("_object", is_object(F.col("_j")) | is_array(F.col("raw")))
    read = once(typed, "_f", _fields(strict), keep=[*carried, "_object"])
    # The first clock that is a number wins, even when it then fails the integer test.
    timed = read.selectExpr(
        "*",
        "coalesce(_f.num_client_timestamp_ms, _f.num_occurred_at, _f.num_timestamp) as _ts",
    )
    ruled = once(timed, "_rules", F.expr(_codes(rules)))
    judged = ruled.select("*", first_hit(F.col("raw")).alias("_pii"))
    # An otherwise valid event that cannot be stored is set aside on its own, not with its batch.
    coded = judged.selectExpr(
        "*",
        f"case when _rules = '' and _pii is null and not {_STORABLE} then '{STORAGE_TYPE_ERROR}' "
        "else _rules end as _codes",
        # What could not be screened is redacted, whatever else is wrong with it. So is an object or array beyond
        # the limits of Spark's parser in which the walk still found something.
        f"case when _object then _pii when _pii = '{UNSCREENED}' or (_pii is not null and raw rlike '^[ \\\\t\\\\r\\\\n]*[{{\\\\[]') "
        f"then '{UNSCREENED}' end as pii_code",
    )
    plain = "case when _codes = '' then cast(array() as array<string>) else split(_codes, '[|]') end"
    return coded.selectExpr(
        *carried,
        *[f"{sql} as {name}" for name, sql in _ENVELOPE_SQL.items()],
        f"case when pii_code is null then {plain} else array_append({plain}, pii_code) end as reason_codes",
        "pii_code",
        "pii_code is not null as pii_rejected",
        "_codes = '' and pii_code is null as accepted",
    )
