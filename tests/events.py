"""Valid events of every type, judged at a fixed receipt time."""

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from provenant.contract import Registry
from provenant.operators.validate import validate_events

NOW_MS = 1_700_000_000_000
NOW = datetime.fromtimestamp(NOW_MS / 1000, timezone.utc)
REGISTRY = Registry(sites=("site_0", "site_1"))
DAY_MS = 86_400_000

# What every event must have, then what each type must have besides. Only the names, types and
# listed values are the contract's; the rest is made up here.
_BASE = dict(
    event_schema_version="thin.v2.0", event_contract_version="event-contract-v0.1", consent_signal="granted",
    site_id="site_0", hostname="shop.site-0.test", path="/catalogue", anon_session_id="visit-40718293645",
    anon_browser_id="device-90817263540", client_timestamp_ms=NOW_MS, client_event_id="sent-60504030201-7",
)
_ATTENTION = dict(
    dwell_bucket="30-90s", scroll_depth_bucket="0", interaction_density_bucket="3-5", tab_visible_ratio=0.4,
)


def _on_page(**members) -> dict:
    return dict(page_view_id="view-a", **members)


_OWN = dict(
    session_start=dict(source_context=dict(campaign_id_seen=None, referrer_present=True)),
    page_view=_on_page(ms_since_last_page_view=None),
    page_state=_on_page(engagement_proxy=_ATTENTION),
    cta_click=_on_page(cta_id="open_basket", href_category="internal", click_offset_ms=321, cta_text_truncated_safe="Basket"),
    form_start=_on_page(form_id="order", ms_since_page_load=87),
    form_submit=_on_page(form_id="order", submit_outcome="success"),
    generate_lead=_on_page(lead_type="order", source_kind="form_success", source_page_view_id="view-b"),
    session_summary=dict(engagement_proxy=_ATTENTION, paths=["/catalogue", "/basket"]),
)
TYPES = tuple(_OWN)


def event(kind: str, *without: str, **changes) -> dict:
    merged = _BASE | {"event_type": kind} | _OWN[kind] | changes
    return {k: v for k, v in merged.items() if k not in without}


def judge(spark: SparkSession, events: list, strict: bool = False) -> list:
    """Verdict rows in input order; a string is taken as JSON text, all else is dumped."""
    rows = [
        (i, i, 0, e if isinstance(e, str) else json.dumps(e), NOW) for i, e in enumerate(events)
    ]
    frame: DataFrame = spark.createDataFrame(
        rows, "event_id bigint, batch_id bigint, pos int, raw string, received_at timestamp"
    )
    return validate_events(frame, REGISTRY, strict=strict).orderBy("event_id").collect()
