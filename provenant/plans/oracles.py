"""SQL counterparts of the named queries, written over flat columns instead of parsed JSON.

They restate each result independently: rules are CASE expressions on the derived columns, and
conflicts, lineage and evidence are window functions and self joins.
"""

from __future__ import annotations

from provenant import contract
from provenant.plans.queries import (
    EMPTY_WINDOW, EPOCH_DAYS, NOW, ONE_DAY, PURGE_AT, PURGE_WITHIN_DAY, RANGE, RECONCILED, REPLAY_WINDOW, STORED_BEFORE, TOP_REASONS,
)
from provenant.sources.derived import (
    CAPTURE_COLUMNS, CONFIG_COLUMNS, DECISION_COLUMNS, EVENT_COLUMNS, JSON_KEYS, NEVER_EXPORTED, REGISTRY,
)

_MS = "(epoch_us(ts) // 1000)"


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _select(columns: dict[str, str], table: str) -> str:
    items = ", ".join(f"{sql.replace('{ms}', _MS)} as {name}" for name, sql in columns.items())
    return f"select {items} from {table}"


_SITES = _list(REGISTRY.sites)
_EMAIL = contract.EMAIL_PATTERN
_PHONE = contract.PHONE_PATTERN

_RULES = (
    (f"event_type not in {_list(contract.EVENT_TYPES)}", "UNKNOWN_EVENT_TYPE"),
    ("schema_version <> 'thin.v2.0'", "UNKNOWN_SCHEMA_VERSION"),
    ("consent <> 'granted'", "CONSENT_NOT_GRANTED"),
    (f"site_id not in {_SITES}", "UNKNOWN_SITE_ID"),
    ("session_id = ''", "MISSING_SESSION_ID"),
    ("browser_id is null", "MISSING_BROWSER_ID"),
    ("client_ts_ms is null or client_ts_ms <= 0", "INVALID_TIMESTAMP"),
    ("client_ts_ms > 0 and client_ts_ms > received_ms + 300000", "FUTURE_TIMESTAMP"),
    ("client_ts_ms > 0 and client_ts_ms < received_ms - 7776000000", "STALE_TIMESTAMP"),
    ("canonical and client_event_id is null", "MISSING_CLIENT_EVENT_ID"),
    ("canonical and contract_version is null", "MISSING_OR_INVALID_EVENT_CONTRACT_VERSION"),
    (
        "event_type in ('page_view', 'form_start', 'form_submit') and coalesce(page_view_id, '') = ''",
        "MISSING_PAGE_VIEW_ID",
    ),
    ("event_type = 'page_view' and path is null", "MISSING_PATH"),
    (
        "event_type = 'cta_click' and cta_id is null and cta_label_bucket is null",
        "MISSING_CTA_ID_OR_LABEL_BUCKET",
    ),
    ("event_type = 'cta_click' and href_category is null", "MISSING_HREF_CATEGORY"),
    (
        "event_type = 'cta_click' and click_offset_ms is null and ms_since_page_load is null",
        "MISSING_CLICK_OFFSET",
    ),
    ("event_type in ('form_start', 'form_submit') and form_id is null", "MISSING_FORM_ID"),
    (
        "event_type = 'form_start' and ms_since_page_load is null and form_start_offset_ms is null",
        "MISSING_FORM_START_OFFSET",
    ),
    (
        "event_type = 'form_submit' and submit_outcome not in ('success', 'error', 'unknown')",
        "MISSING_OR_INVALID_SUBMIT_OUTCOME",
    ),
    ("event_type = 'generate_lead' and lead_type is null", "MISSING_LEAD_TYPE"),
    (
        "event_type = 'generate_lead' and (source_kind is null or "
        f"source_kind not in {_list(contract.SOURCE_KINDS)})",
        "MISSING_OR_INVALID_SOURCE_KIND",
    ),
    (
        "event_type = 'generate_lead' and source_page_view_id is null and page_view_id is null",
        "MISSING_SOURCE_PAGE_VIEW_ID",
    ),
    *[
        (
            f"event_type in ('page_state', 'session_summary') and coalesce({column}, '') <> '' "
            f"and {column} not in {_list(allowed)}",
            "UNKNOWN_BUCKET_VALUE",
        )
        for column, allowed in (
            ("dwell_bucket", contract.DWELL_BUCKETS), ("scroll_bucket", contract.SCROLL_BUCKETS),
            ("interaction_bucket", contract.INTERACTION_BUCKETS),
        )
    ],
)
_STRICT_RULES = (
    ("event_type in ('cta_state', 'form_state')", "STRICT_DEPRECATED_EVENT_TYPE"),
    ("event_type = 'session_start' and path is null", "STRICT_MISSING_PATH"),
    ("event_type = 'session_start' and hostname is null", "STRICT_MISSING_HOSTNAME"),
    ("event_type = 'session_start' and contract_version is null", "STRICT_MISSING_CONTRACT_VERSION"),
    (
        "event_type in ('page_state', 'cta_click') and coalesce(page_view_id, '') = ''",
        "STRICT_MISSING_PAGE_VIEW_ID",
    ),
    ("event_type = 'form_submit' and error_bucket = 'other_error'", "STRICT_UNKNOWN_ERROR_BUCKET"),
    ("event_type = 'session_summary' and page_count is null", "STRICT_MISSING_PAGE_COUNT"),
    ("event_type = 'session_summary' and path_summary is null", "STRICT_MISSING_PATH_SUMMARY"),
    (
        "event_type = 'session_summary' and timing_summary is null and timing_buckets is null",
        "STRICT_MISSING_TIMING",
    ),
    (
        "event_type = 'session_summary' and interaction_density is null",
        "STRICT_MISSING_INTERACTION_DENSITY",
    ),
)


def _cases(rules: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"case when {test} then '{code}' end" for test, code in rules)


_SRC = f"src as ({_select(EVENT_COLUMNS, 'events')})"
_JUDGE = f"""
ruled as (
  select *, concat_ws('|', {_cases(_RULES)}) as rule_codes,
    case when regexp_matches(label, '{_EMAIL}') or regexp_matches(label, '{_PHONE}')
           then 'PII_IN_VALUE:.cta_text_truncated_safe'
         when regexp_matches(contact, '{_EMAIL}') then 'PII_IN_VALUE:.adapter_context.user_email'
         when company is not null then 'PII_KEY_PRESENT:.company' end as pii_code
  from (select *, event_type in {_list(contract.CANONICAL_TYPES)} as canonical from src)
),
judged as (
  select *, case when rule_codes = '' and pii_code is null
                      and sequence_index <> floor(sequence_index) then 'STORAGE_TYPE_ERROR'
                 else concat_ws('|', nullif(rule_codes, ''), pii_code) end as codes,
    case when canonical then 'event-contract-v0.1'
         when event_type in {_list(contract.LEGACY_TYPES)} then coalesce(contract_version, 'legacy-thin-v2.0')
         else 'legacy-thin-v2.0' end as stored_version,
    cast(make_timestamp(received_ms * 1000) as date) as received_date
  from ruled
)"""
_LEDGER = """
accepted as (select * from judged where codes = ''),
kept as (
  select * from accepted where client_event_id is null
  union all
  select * exclude (rn) from (
    select *, row_number() over (
      partition by site_id, session_id, client_event_id order by received_ms, event_id) as rn
    from accepted where client_event_id is not null)
  where rn = 1
)"""
_JUDGED = f"with {_SRC}, {_JUDGE}"
_KEPT = f"{_JUDGED}, {_LEDGER}"

_DAILY = f"""
acc as (
  select site_id, received_date as d, count(*) as a, count(distinct session_id) as s,
         count(distinct browser_id) as b
  from kept where site_id in {_SITES} group by 1, 2
),
rej as (
  select site_id, received_date as d, count(*) as r,
         count(*) filter (where codes like '%UNKNOWN_BUCKET_VALUE%') as u
  from judged where codes <> '' and site_id in {_SITES} group by 1, 2
),
mis as (
  select site_id, d, count(*) as m from (
    select site_id, received_date as d, session_id,
           bool_or(event_type = 'session_start') as st, bool_or(event_type = 'session_summary') as su
    from kept where site_id in {_SITES} group by 1, 2, 3)
  where st <> su group by 1, 2
),
measured as (
  select site_id, d, coalesce(a, 0) + coalesce(r, 0) as received, coalesce(a, 0) as a,
         coalesce(r, 0) as r, coalesce(s, 0) as s, coalesce(b, 0) as b, coalesce(m, 0) as m,
         coalesce(u, 0) as u
  from acc full join rej using (site_id, d) left join mis using (site_id, d)
)"""
_SITE_ROWS = "(values " + ", ".join(f"('{s}')" for s in REGISTRY.sites) + ") as sites(site_id)"


def _dense(days: str) -> str:
    return f"""{_KEPT}, {_DAILY}, days as ({days})
    select site_id, cast(d as varchar) as metric_date, coalesce(received, 0) as events_received,
      coalesce(a, 0) as events_accepted, coalesce(r, 0) as events_rejected,
      coalesce(s, 0) as distinct_sessions, coalesce(b, 0) as distinct_subjects,
      coalesce(m, 0) as summary_start_mismatch, coalesce(u, 0) as unknown_bucket_count,
      case when coalesce(received, 0) > 0 then cast(r as double) / received else 0.0::double end as reject_rate
    from (select site_id, d from days cross join {_SITE_ROWS}) left join measured using (site_id, d)"""


def _days(low: str, high: str) -> str:
    return (
        f"select cast(unnest(generate_series(cast({low} as timestamp), cast({high} as timestamp), "
        "interval 1 day)) as date) as d"
    )


_CAPTURES = f"""
with bodies as ({_select(CAPTURE_COLUMNS, 'customer')}),
read as (
  select *, case when email is null or not contains(email, '@') then 'invalid email'
    when site_id is null then 'missing site_id' when session_id is null then 'missing session_id'
    when asset_key is null then 'missing asset_key' when trigger_score is null then 'missing trigger_score'
    when config_version is null then 'missing config_version'
    when probe_version is null then 'missing probe_version' else '' end as error
  from bodies
),
enriched as (
  select capture_id, site_id, coalesce(browser_id, '') as browser_id, asset_key, captured_ms,
    lower(trim(email)) as address, split_part(lower(trim(email)), '@', 2) as email_domain,
    sha256(lower(trim(email))) as email_hash, cast(trigger_score as double) as trigger_score,
    case when split_part(lower(trim(email)), '@', 2) in {_list(contract.FREEMAIL_DOMAINS)} then 'freemail'
         when split_part(lower(trim(email)), '@', 2) in {_list(contract.DISPOSABLE_DOMAINS)} then 'disposable'
         else 'business' end as email_class,
    captured_ms + 7776000000 as purge_after_ms
  from read where error = ''
)"""

_DECISIONS = f"""
with bodies as ({_select(DECISION_COLUMNS, 'events')}),
log as (
  select decision_id, decided_ms, site_id, session_id, coalesce(browser_id, '') as browser_id, decision,
    cast(cast(trigger_score as float) as double) as trigger_score,
    cast(cast(coalesce(trigger_confidence, 0) as float) as double) as trigger_confidence,
    cast(cast(trigger_threshold as float) as double) as trigger_threshold,
    page_path, page_group, cast(make_timestamp(decided_ms * 1000) as date) as d
  from bodies
  where session_id is not null and config_version <> '' and decision in {_list(contract.DECISIONS)}
)"""

_CONFIG = f"""
stored as ({_select(CONFIG_COLUMNS, 'supplier')}),
asked as (select concat('site_', cast(c_custkey as varchar)) as site_id from customer),
defaults(section, key, value) as (values {", ".join(
    f"('{section}', '{key}', '{text}')"
    for section, entries in (("272", contract.ANALYSIS_DEFAULTS), ("750", contract.PROBE_DEFAULTS))
    for key, text in entries.items())}),
own as (
  select site_id, '272' as section, unnest(json_keys(config_272)) as key, config_272 as doc from stored
  union all
  select site_id, '750', unnest(json_keys(config_750)), config_750 from stored
),
own_values as (
  select site_id, section, key, cast(json_extract(doc, '$.' || key) as varchar) as value from own
),
effective as (
  select site_id, section, key, coalesce(o.value, x.value) as value
  from (
    select site_id, section, key, value from asked cross join defaults
    union all
    select site_id, section, key, null from own_values join asked using (site_id)
    where (section, key) not in (select (section, key) from defaults)
  ) as x left join own_values as o using (site_id, section, key)
)"""


_NUMBERS = ("click_offset_ms", "ms_since_page_load", "form_start_offset_ms", "page_count", "sequence_index")


def _member(key: str, column: str) -> str:
    if column in _NUMBERS:
        return f"""'"{key}":' || cast(cast({column} as bigint) as varchar)"""
    return f"""'"{key}":"' || {column} || '"'"""


def _replay_line(header: str) -> str:
    """The replay line of an accepted event, which holds no personal data: members in key order, absent ones left out."""
    members = {key: _member(key, column) for key, column in JSON_KEYS.items()}
    stamp = "cast(client_ts_ms as varchar)"
    members["client_timestamp_ms"] = f"""case when event_id % 17 <> 0 then '"client_timestamp_ms":' || {stamp} end"""
    members["occurred_at"] = f"""case when event_id % 17 = 0 then '"occurred_at":' || {stamp} end"""
    buckets = ", ".join(_member(key, column) for key, column in (
        ("dwell_bucket", "dwell_bucket"), ("interaction_density_bucket", "interaction_bucket"), ("scroll_depth_bucket", "scroll_bucket")))
    members["engagement_proxy"] = f"""'"engagement_proxy":{{' || concat_ws(',', {buckets}) || '}}'"""
    return f"'{{' || concat_ws(',', {header}, {', '.join(members[key] for key in sorted(members))}) || '}}'"


_LIMITS = {
    "raise_pct": ("$.fire_rate.auto_raise_pct", 5), "raise_days": ("$.fire_rate.auto_raise_window_days", 7),
    "disable_pct": ("$.fire_rate.auto_disable_pct", 8), "disable_days": ("$.fire_rate.auto_disable_window_days", 7),
    "breaker_pct": ("$.fire_rate.circuit_breaker_pct", 10), "dismiss_pct": ("$.dismiss_rate.raise_at_pct", 70),
    "dismiss_days": ("$.dismiss_rate.window_days", 14), "daily_budget": ("$.daily_budget", 20),
    "session_cap": ("$.max_fire_per_session", 1), "cooldown_hours": ("$.cooldown_hours", 72),
}
_FIRE_LIMITS = f"""
stored as ({_select(CONFIG_COLUMNS, 'supplier')}),
limited as (
  select l.*, {", ".join(
      f"coalesce(try_cast(json_extract(s.config_750, '{path}') as double), {default}) as {name}"
      for name, (path, default) in _LIMITS.items())}
  from log l left join stored s using (site_id)
)"""


def _strip_with(sql: str) -> str:
    return sql.strip().removeprefix("with").strip()


_BATCHED = f"""
with {_SRC.replace('src as', 'events_flat as', 1)},
placed as (
  select *, (event_id // 100) * 3 + case when event_id % 100 < 48 then 0 when event_id % 100 < 99 then 1 else 2 end as batch_id
  from events_flat
),
batches as (
  select batch_id, count(*) as n, min(received_ms) as received_ms,
    batch_id % 3 = 2 and (batch_id // 3) % 3 = 0 as bare
  from placed group by batch_id
)"""

_GRADE = """
select l.event_id, l.source_kind,
  cast(v as integer) as had_view, cast(c as integer) as had_click, cast(s as integer) as had_success,
  case when source_kind = 'manual_test_isolated' then 'isolated'
       when source_kind in ('form_success', 'ajax_success') then case when v and s then 'trusted' else 'degraded' end
       when source_kind = 'thank_you_page' then case when s then 'trusted' else 'degraded' end
       when v or c then 'trusted' else 'degraded' end as grade
from (
  select k.event_id, k.source_kind,
    exists (select 1 from kept p where p.site_id = k.site_id and p.session_id = k.session_id
      and p.event_type = 'page_view' and p.client_ts_ms < k.client_ts_ms) as v,
    exists (select 1 from kept p where p.site_id = k.site_id and p.session_id = k.session_id
      and p.event_type = 'cta_click' and p.client_ts_ms < k.client_ts_ms) as c,
    exists (select 1 from kept p where p.site_id = k.site_id and p.session_id = k.session_id
      and p.event_type = 'form_submit' and p.submit_outcome = 'success' and p.client_ts_ms < k.client_ts_ms) as s
  from kept k where k.event_type = 'generate_lead'
) as l"""


def catalogue_sql() -> dict[str, str]:
    ms_date = "cast(received_date as varchar)"
    sql: dict[str, str] = {}
    sql["truth_metrics_daily"] = _dense(
        f"select cast(unnest(generate_series(cast(min(d) as timestamp), cast(max(d) as timestamp), interval 1 day)) as date) as d from measured"
    )
    sql["collect_outcome_by_type"] = f"""{_JUDGED}
        select event_type, count(*) as received, count(*) filter (where codes = '') as accepted,
          count(*) filter (where pii_code is not null) as pii_rejected from judged group by event_type"""
    sql["collect_reason_counts"] = f"""{_JUDGED}
        select reason, count(*) as n from (select unnest(string_split(codes, '|')) as reason from judged where codes <> '')
        group by reason"""
    sql["collect_reason_array"] = f"{_JUDGED} select event_id, codes from judged"
    sql["accepted_dedup"] = f"{_KEPT} select event_id, site_id, session_id, client_event_id from kept"
    sql["stream_collect"] = sql["accepted_dedup"]
    sql["accepted_envelope"] = f"""{_KEPT}
        select event_id, site_id, coalesce(hostname, '') as hostname, event_type, session_id, browser_id,
          client_ts_ms as client_timestamp_ms, received_ms, client_event_id, page_view_id, previous_page_view_id,
          cast(sequence_index as integer) as event_sequence_index, stored_version as event_contract_version,
          '1.0.0' as collector_version from accepted"""
    sql["timestamp_policy"] = f"""{_JUDGED}
        select event_id, case when client_ts_ms > 0 then client_ts_ms end as client_timestamp_ms,
          cast(codes like '%INVALID_TIMESTAMP%' as integer) as invalid,
          cast(codes like '%FUTURE_TIMESTAMP%' as integer) as future,
          cast(codes like '%STALE_TIMESTAMP%' as integer) as stale from judged"""
    sql["contract_version_counts"] = f"""{_JUDGED}
        select event_type, stored_version as event_contract_version, count(*) as n from judged group by 1, 2"""
    sql["batch_admission"] = f"""{_BATCHED}
        select batch_id, case when bare then -1 else n end as n_events,
          case when bare or n > 50 then 'INVALID_BATCH_FORMAT' else '' end as error from batches"""
    sql["batch_events_judged"] = f"""{_BATCHED},
        src as (select p.* replace (b.received_ms as received_ms),
                  row_number() over (partition by batch_id order by event_id) - 1 as pos
                from placed p join batches b using (batch_id) where not bare and n <= 50),
        {_JUDGE} select batch_id, pos, codes from judged"""
    sql["odd_elements_judged"] = f"""
        select event_id, case when event_id % 8 < 4 then 'INVALID_EVENT_OBJECT' else
            'UNKNOWN_EVENT_TYPE|UNKNOWN_SCHEMA_VERSION|CONSENT_NOT_GRANTED|UNKNOWN_SITE_ID|MISSING_SESSION_ID|MISSING_BROWSER_ID'
            || case when event_id % 8 < 6 then '|INVALID_TIMESTAMP' else '' end end as codes,
          case when event_id % 8 > 5 then {_MS} end as client_timestamp_ms from events"""
    sql["pii_event_hits"] = f"""{_JUDGED}
        select split_part(pii_code, ':', 1) as kind, split_part(pii_code, ':', 2) as path, count(*) as n
        from judged where pii_code is not null group by 1, 2"""
    sql["pii_documents"] = f"""
        select doc_id, cast(regexp_matches(text, '{_EMAIL}') as integer) as email,
          cast(regexp_matches(text, '{_PHONE}') as integer) as phone from documents"""
    sql["pii_conversations"] = f"""
        select role, count(*) as turns, count(*) filter (where regexp_matches(text, '{_EMAIL}')) as email,
          count(*) filter (where regexp_matches(text, '{_PHONE}')) as phone from conversations group by role"""
    sql["pii_redacted_rows"] = f"""{_JUDGED}
        select event_id, '{{"_redacted":true,"event_type":"' || event_type || '","site_id":"' || site_id
          || '","anon_session_id":"' || session_id || '"'
          || coalesce(',"client_event_id":"' || client_event_id || '"', '')
          || case when event_id % 17 = 0 or client_ts_ms is null then ''
                  else ',"client_timestamp_ms":' || cast(client_ts_ms as varchar) end
          || ',"event_schema_version":"' || schema_version || '"}}' as stored
        from judged where pii_code is not null"""
    sql["metrics_event_type_counts"] = f"""{_KEPT}
        select site_id, {ms_date} as metric_date, event_type, count(*) as n from kept group by 1, 2, 3"""
    sql["metrics_reject_reason_counts"] = f"""{_JUDGED}
        select site_id, metric_date, reason, split_part(reason, ':', 1) as family, count(*) as n from (
          select site_id, {ms_date} as metric_date, unnest(string_split(codes, '|')) as reason
          from judged where codes <> '' and site_id in {_SITES}) group by 1, 2, 3, 4"""
    sql["metrics_start_summary_mismatch"] = f"""{_KEPT}, {_DAILY}
        select site_id, cast(d as varchar) as metric_date, m as summary_start_mismatch from mis"""
    sql["metrics_unknown_bucket"] = f"""{_KEPT}, {_DAILY}
        select site_id, cast(d as varchar) as metric_date, u as unknown_bucket_count from rej where u > 0"""
    sql["metrics_dense_range"] = _dense(_days(f"'{RANGE[0]}'", f"'{RANGE[1]}'"))
    sql["metrics_upsert"] = f"""{_KEPT}, {_DAILY}
        select site_id, metric_date, metrics_version, events_received, events_accepted, events_rejected, distinct_sessions,
          distinct_subjects, summary_start_mismatch, unknown_bucket_count, computed_ms from (
          select *, row_number() over (partition by site_id, metric_date, metrics_version order by computed_ms desc) as rn
          from (
            select site_id, cast(d as varchar) as metric_date, '1.0.0' as metrics_version,
              cast(0 as bigint) as events_received, cast(0 as bigint) as events_accepted, cast(0 as bigint) as events_rejected,
              cast(0 as bigint) as distinct_sessions, cast(0 as bigint) as distinct_subjects,
              cast(0 as bigint) as summary_start_mismatch, cast(0 as bigint) as unknown_bucket_count, 1 as computed_ms from measured
            union all
            select site_id, cast(d as varchar), '1.0.0', received, a, r, s, b, m, cast(u as bigint), 2 from measured where d >= date '2024-01-15'))
        where rn = 1"""
    reasons = f"""
        select site_id, received_date as d, reason, count(*) as n from (
          select site_id, received_date, unnest(string_split(codes, '|')) as reason from judged
          where codes <> '' and site_id in {_SITES}) group by 1, 2, 3"""
    sql["metrics_from_ledgers"] = f"""{_KEPT}, {_DAILY},
        days as (select received_date as d from kept union select received_date from judged where codes <> ''),
        types as (
          select site_id, d, string_agg(event_type || '=' || cast(n as varchar), '|' order by event_type) as t from (
            select site_id, received_date as d, event_type, count(*) as n from kept group by 1, 2, 3) group by 1, 2),
        reasons as (
          select site_id, d, string_agg(reason || '=' || cast(n as varchar), '|' order by reason) as r from ({reasons}) group by 1, 2)
        select site_id, cast(d as varchar) as metric_date, '1.0.0' as metrics_version, coalesce(received, 0) as events_received,
          coalesce(a, 0) as events_accepted, coalesce(m.r, 0) as events_rejected, coalesce(s, 0) as distinct_sessions,
          coalesce(b, 0) as distinct_subjects, coalesce(m.m, 0) as summary_start_mismatch, coalesce(u, 0) as unknown_bucket_count,
          case when received > 0 then round(cast(cast(cast(m.r as double) / received as float) as double), 5) else 0 end as reject_rate,
          coalesce(t, '') as event_type_counts, coalesce(reasons.r, '') as reject_reason_counts
        from (select site_id, d from days cross join {_SITE_ROWS}) left join measured m using (site_id, d)
          left join types using (site_id, d) left join reasons using (site_id, d)"""
    sql["metrics_one_day"] = _dense(_days(f"'{ONE_DAY}'", f"'{ONE_DAY}'"))
    sql["top_reasons"] = f"""{_JUDGED}
        select site_id, cast(d as varchar) as metric_date, place, reason, n from (
          select *, row_number() over (partition by site_id, d order by n desc, reason) as place from ({reasons}))
        where place <= {TOP_REASONS}"""
    sql["distinct_over_range"] = f"""{_KEPT}
        select site_id, count(distinct session_id) as sessions, count(distinct browser_id) as subjects,
          1 as sessions_agree, 1 as subjects_agree from kept where site_id in {_SITES} group by 1"""
    window = (
        f"received_ms >= epoch_ms(timestamp '{REPLAY_WINDOW[0]} 00:00:00') "
        f"and received_ms <= epoch_ms(timestamp '{REPLAY_WINDOW[1]} 23:59:59')"
    )
    header = """'"_replay":{"event_id":' || cast(event_id as varchar) || ',"received_at":"' || iso
            || '","collector_version":"1.0.0"}'"""
    sql["replay_rows"] = f"""{_KEPT}
        select site_id, row_number() over (partition by site_id order by client_ts_ms, received_ms, event_id) as ordinal,
          event_id, client_ts_ms as client_timestamp_ms, iso as received_at,
          sha256({_replay_line(header)}) as line_sha256
        from (select *, strftime(make_timestamp(received_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as iso from kept where {window})"""
    sql["replay_meta"] = f"""{_KEPT}
        select site_id, count(*) as event_count, count(distinct session_id) as session_count,
          count(distinct browser_id) as subject_count, '1.0.0' as collector_versions
        from kept where {window} group by site_id"""
    sql["replay_export_meta"] = f"""{_KEPT},
        held as (
          select site_id, count(*) as n, count(distinct session_id) as s, count(distinct browser_id) as b from kept where {window} group by 1),
        wanted as (
          select site_id, '{REPLAY_WINDOW[0]}' as low, '{REPLAY_WINDOW[1]}' as high, n, s, b from {_SITE_ROWS} left join held using (site_id)
          union all select site_id, '{EMPTY_WINDOW[0]}', '{EMPTY_WINDOW[1]}', null, null, null from {_SITE_ROWS})
        select site_id, low || 'T00:00:00Z' as window_start, high || 'T23:59:59Z' as window_end, coalesce(n, 0) as event_count,
          coalesce(s, 0) as session_count, coalesce(b, 0) as subject_count, 'client_timestamp_ms,received_at,event_id' as sort_order,
          case when n > 0 then '1.0.0' else '' end as collector_versions, cast(0 as bigint) as damaged_parts, 1 as digest_holds
        from wanted"""
    sql["config_effective"] = f"with {_CONFIG} select site_id, key, value from effective"
    sql["config_bootstrap"] = f"""{_KEPT}, {_CONFIG},
        sessions as (select site_id, count(distinct session_id) as n from kept where event_type = 'session_start' group by 1),
        boot as (select site_id, value from effective where section = '750' and key = 'bootstrap'),
        gate as (
          select site_id,
            coalesce(date_diff('day', date '2024-01-01' + cast(start_day as integer), date '{NOW[:10]}'), 0) as runtime_days,
            coalesce(n, 0) as eligible_sessions,
            coalesce(cast(json_extract(value, '$.min_runtime_days') as bigint), 14) as required_runtime_days,
            coalesce(cast(json_extract(value, '$.min_eligible_sessions') as bigint), 500) as required_eligible_sessions
          from boot left join sessions using (site_id) left join stored using (site_id))
        select *, cast(runtime_days >= required_runtime_days and eligible_sessions >= required_eligible_sessions as integer)
          as bootstrap_met from gate"""
    sql["config_upsert"] = f"""with {_CONFIG},
        seeded as (select site_id, section, string_agg(key || '=' || value, chr(10) order by key) as text from effective group by 1, 2),
        before as (select site_id, section, string_agg(key || '=' || value, chr(10) order by key) as text from own_values group by 1, 2),
        texts as (
          select site_id, 2 as updated, max(text) filter (where section = '272') as a, max(text) filter (where section = '750') as b
          from seeded group by 1
          union all
          select s.site_id, 1, max(text) filter (where section = '272'), max(text) filter (where section = '750')
          from stored s left join before b on s.site_id = b.site_id where s.site_id not in (select site_id from asked) group by 1)
        select site_id, updated, sha256(coalesce(a, '')) as config_272, sha256(coalesce(b, '')) as config_750 from texts"""
    sql["capture_validation"] = f"{_CAPTURES} select capture_id, error from read"
    sql["capture_enrich"] = f"""{_CAPTURES}
        select capture_id, site_id, browser_id, email_hash, email_domain, email_class, trigger_score, purge_after_ms from enriched"""
    sql["capture_insert_if_absent"] = f"""{_CAPTURES}
        select capture_id, site_id, email_hash from (
          select *, row_number() over (partition by site_id, email_hash order by captured_ms, capture_id) as rn,
            min(captured_ms) over (partition by site_id, email_hash) as first_ms from enriched)
        where rn = 1 and first_ms >= epoch_ms(timestamp '2024-01-08 00:00:00')"""
    sql["capture_download_url"] = f"""{_CAPTURES}, {_CONFIG}
        select capture_id, site_id,
          coalesce(json_extract_string(config_750, '$.asset_url'), '/assets/downloads/' || asset_key || '.pdf') as download_url
        from enriched left join stored using (site_id)"""
    purge = f"epoch_ms(timestamp '{PURGE_AT[:10]} 00:00:00')"
    sql["capture_purge"] = f"""{_CAPTURES}
        select email_class, count(*) filter (where purge_after_ms < {purge}) as purged,
          count(*) filter (where purge_after_ms >= {purge}) as kept from enriched group by 1"""
    sql["capture_after_purge"] = f"""{_CAPTURES}
        select capture_id, site_id, email_hash, email_class, purge_after_ms,
          case when captured_ms < epoch_ms(cast('{STORED_BEFORE[:-1]}' as timestamp)) then 0 else 1 end as epoch from (
          select *, row_number() over (partition by site_id, email_hash order by captured_ms, capture_id) as rn from enriched)
        where rn = 1 and purge_after_ms >= epoch_ms(cast('{PURGE_WITHIN_DAY[:-1]}' as timestamp))"""
    sql["decision_store"] = f"""{_DECISIONS}
        select cast(d as varchar) as decision_date, decision, count(*) as n from log group by 1, 2"""
    sql["capture_encrypt_roundtrip"] = f"{_CAPTURES} select capture_id, email_hash as opened_hash from enriched"
    sql["decision_log"] = f"""{_DECISIONS}
        select decision_id, site_id, session_id, browser_id, decision, round(trigger_score, 4) as trigger_score,
          round(trigger_confidence, 4) as trigger_confidence, cast(0 as bigint) as n_reasons, page_path, page_group from log"""
    late = "received_date >= date '2024-01-15'"
    sql["schema_evolution"] = f"""{_KEPT}
        select event_id, case when {late} then client_event_id end as client_event_id,
          case when {late} then page_view_id end as page_view_id,
          case when {late} then stored_version else 'legacy-thin-v2.0' end as event_contract_version from accepted"""
    sql["stream_rejected"] = f"""{_JUDGED}
        select event_id, codes, cast(pii_code is not null as integer) as redacted from judged where codes <> ''"""
    sql["stream_refused"] = f"""{_BATCHED}
        select batch_id, case when bare then -1 else n end as n_events, 'INVALID_BATCH_FORMAT' as error
        from batches where bare or n > 50"""
    epoch = f"case when received_date < date '{EPOCH_DAYS[0]}' then 0 when received_date < date '{EPOCH_DAYS[1]}' then 1 else 2 end"
    sql["stream_balance"] = f"""{_KEPT},
        came as (select {epoch} as epoch, count(*) as events, count(*) filter (where codes <> '') as rejected from judged group by 1),
        stayed as (select {epoch} as epoch, count(*) as accepted from kept group by 1)
        select cast(epoch as bigint) as epoch, events, coalesce(accepted, 0) as accepted, rejected,
          events - coalesce(accepted, 0) - rejected as repeated, cast(0 as bigint) as refused_batches,
          coalesce(accepted, 0) as stored_accepted, rejected as stored_rejected
        from came left join stayed using (epoch)"""
    sql["lead_grade"] = f"{_KEPT} {_GRADE}"
    sql["form_start_first"] = f"""{_KEPT}
        select event_id, site_id, session_id, form_id from (
          select *, row_number() over (partition by site_id, session_id, form_id order by client_ts_ms, event_id) as rn
          from kept where event_type = 'form_start') where rn = 1"""
    sql["session_rollup"] = f"""{_KEPT},
        edges as (
          select distinct site_id, session_id,
            first_value(path) over (partition by site_id, session_id order by client_ts_ms, path) as entry_path,
            first_value(path) over (partition by site_id, session_id order by client_ts_ms desc, path desc) as exit_path
          from kept where event_type = 'page_view')
        select k.site_id, k.session_id, count(*) as events,
          count(*) filter (where event_type = 'page_view') as page_count,
          count(*) filter (where event_type = 'cta_click') as cta_count,
          count(*) filter (where event_type = 'form_start') as form_start_count,
          count(*) filter (where event_type = 'form_submit') as form_submit_count,
          count(*) filter (where event_type = 'generate_lead') as generate_lead_count,
          count(distinct path) filter (where event_type = 'page_view') as distinct_paths,
          any_value(entry_path) as entry_path, any_value(exit_path) as exit_path,
          min(client_ts_ms) as first_ms, max(client_ts_ms) as last_ms,
          max(client_ts_ms) - min(client_ts_ms) as duration_ms
        from kept k left join edges e on k.site_id = e.site_id and k.session_id = e.session_id group by 1, 2"""
    sql["session_paths"] = f"""{_KEPT}
        select site_id, session_id, path, count(*) as views, min(client_ts_ms) as first_ms, max(client_ts_ms) as last_ms
        from kept where event_type = 'page_view' group by 1, 2, 3"""
    sql["page_lineage"] = f"""{_KEPT},
        pages as (select distinct site_id, session_id, page_view_id from kept
                  where event_type = 'page_view' and page_view_id is not null),
        refs as (
          select k.site_id, k.session_id, count(*) filter (where p.page_view_id is not null) as linked,
            count(*) filter (where p.page_view_id is null) as orphans
          from kept k left join pages p on p.site_id = k.site_id and p.session_id = k.session_id
            and p.page_view_id = k.previous_page_view_id
          where k.previous_page_view_id is not null group by 1, 2),
        gaps as (
          select site_id, session_id, sum(idx - prev - 1) as gaps from (
            select *, lag(idx, 1, idx - 1) over (partition by site_id, session_id order by idx) as prev from (
              select distinct site_id, session_id, cast(sequence_index as bigint) as idx
              from kept where sequence_index is not null)) group by 1, 2),
        seen as (select site_id, session_id, count(*) as pages from pages group by 1, 2)
        select site_id, session_id, coalesce(pages, 0) as pages, coalesce(linked, 0) as linked,
          coalesce(orphans, 0) as orphans, cast(coalesce(gaps, 0) as bigint) as sequence_gaps
        from seen full join refs using (site_id, session_id) full join gaps using (site_id, session_id)"""
    sql["fire_rate"] = f"""{_DECISIONS}, {_FIRE_LIMITS},
        daily as (
          select site_id, d, count(*) as sessions, cast(sum(f) as bigint) as fires, cast(sum(x) as bigint) as dismisses,
            count(*) filter (where f > session_cap) as over_session_cap, {", ".join(f"any_value({n}) as {n}" for n in _LIMITS)}
          from (select site_id, d, session_id, count(*) filter (where decision = 'fire') as f,
                  count(*) filter (where decision = 'dismiss') as x, {", ".join(f"any_value({n}) as {n}" for n in _LIMITS)}
                from limited group by 1, 2, 3) group by 1, 2),
        rated as (
          select a.*, sum(b.fires) filter (where b.d > a.d - cast(a.raise_days as integer)) as fr,
            sum(b.sessions) filter (where b.d > a.d - cast(a.raise_days as integer)) as sr,
            sum(b.fires) filter (where b.d > a.d - cast(a.disable_days as integer)) as fd,
            sum(b.sessions) filter (where b.d > a.d - cast(a.disable_days as integer)) as sd,
            sum(b.fires) filter (where b.d > a.d - cast(a.dismiss_days as integer)) as fx,
            sum(b.dismisses) filter (where b.d > a.d - cast(a.dismiss_days as integer)) as xx
          from daily a join daily b on a.site_id = b.site_id and b.d <= a.d group by all),
        shares as (
          select *, case when sr > 0 then cast(fr as double) / cast(sr as double) else 0 end as fire_rate,
            case when sd > 0 then cast(fd as double) / cast(sd as double) else 0 end as disable_rate,
            case when fx > 0 then cast(xx as double) / cast(fx as double) else 0 end as dismiss_rate from rated)
        select site_id, cast(d as varchar) as decision_date, sessions, fires, dismisses, over_session_cap, fire_rate, disable_rate,
          dismiss_rate, cast(fires > daily_budget as integer) as over_budget,
          case when disable_rate * 100 >= breaker_pct then 'break' when disable_rate * 100 >= disable_pct then 'disable'
               when fire_rate * 100 >= raise_pct or dismiss_rate * 100 >= dismiss_pct then 'raise' else 'none' end as action from shares"""
    sql["fire_cooldown"] = f"""{_DECISIONS}, {_FIRE_LIMITS}
        select site_id, browser_id, count(*) as fires,
          count(*) filter (where decided_ms - prior < cooldown_hours * 3600000) as breaches from (
            select *, lag(decided_ms) over (partition by site_id, browser_id order by decided_ms, decision_id) as prior
            from limited where decision = 'fire') group by 1, 2"""
    sql["eligibility_gate"] = f"""{_KEPT}, {_DAILY}, stored as ({_select(CONFIG_COLUMNS, 'supplier')}),
        wanted as (
          select m.*, coalesce(try_cast(json_extract(config_272, '$.analysis_window_days') as integer), 30) as days,
            coalesce(try_cast(json_extract(config_272, '$.min_eligible_sessions') as bigint), 200) as needed,
            coalesce(try_cast(json_extract(config_272, '$.min_valid_event_rate') as double), 0.7) as needed_rate
          from measured m left join stored using (site_id)),
        sums as (
          select a.site_id, a.d, a.needed, a.needed_rate, cast(sum(b.s) as bigint) as sessions, sum(b.a) as valid, sum(b.received) as received
          from wanted a join measured b on a.site_id = b.site_id and b.d <= a.d and b.d > a.d - a.days group by all),
        rates as (select *, cast(valid as double) / cast(received as double) as valid_event_rate from sums)
        select site_id, cast(d as varchar) as metric_date, sessions, valid_event_rate,
          cast(sessions >= needed and valid_event_rate >= needed_rate as integer) as eligible from rates"""
    first, second = RECONCILED
    within = " ".join(
        f"when received_ms >= epoch_ms(timestamp '{low} 00:00:00') and received_ms <= epoch_ms(timestamp '{high} 23:59:59') then {n}"
        for n, (low, high) in enumerate(RECONCILED))
    sql["replay_reconcile"] = f"""{_KEPT},
        subjects as (
          select site_id, w, browser_id, case when count(*) >= 3 then 'scoreable' when count(*) = 2 then 'degraded' else 'unscorable' end as status,
            case when bool_or(event_type = 'generate_lead') then 'fire' when bool_or(event_type = 'cta_click') then 'hold' else 'none' end as action
          from (select *, case {within} end as w from kept) where w is not null group by 1, 2, 3),
        grid as (select site_id, w, cast(right(site_id, 1) as integer) as k from {_SITE_ROWS}, (values (0), (1)) as ws(w)),
        totals as (
          select g.site_id, g.w, g.k, count(browser_id) as n, count(*) filter (where status = 'degraded') as degraded,
            count(*) filter (where action = 'fire') as fire, count(*) filter (where action = 'hold') as hold,
            count(*) filter (where action = 'none') + cast(g.k = 2 and g.w = 1 as integer) as none
          from grid g left join subjects using (site_id, w) group by 1, 2, 3),
        stated as (
          select *, concat_ws('|', case when fire > 0 then 'fire=' || cast(fire as varchar) end, case when hold > 0 then 'hold=' || cast(hold as varchar) end,
              case when none > 0 then 'none=' || cast(none as varchar) end) as actions,
            case when w = 0 then '{first[0]}' else '{second[0]}' end as day from totals)
        select site_id, day || 'T00:00:00Z' as window_start, case when not (k = 3 and w = 1) then concat_ws('_', 'run', site_id, day) end as run_id,
          case when k = 3 and w = 1 then 'no_run' when k = 0 and w = 0 then 'digest_differs' when k = 1 and w = 0 then 'totals_differ'
               when k = 2 and w = 0 then 'subjects_differ' else 'ok' end as status,
          case when k = 2 and w = 1 then 'action_distribution' when k = 4 and w = 1 and degraded > 0 then 'trq_distribution' else '' end as differing,
          case when not (k = 3 and w = 1) then n + cast(w = 0 and k in (1, 2) as integer) end as subjects_total,
          case when not (k = 3 and w = 1) then actions end as action_distribution from stated
        union all
        select site_id, '{NEVER_EXPORTED}', 'run_' || site_id || '_{NEVER_EXPORTED[:10]}', 'no_export', '', n, ''
        from stated where k = 4 and w = 0"""
    sql["card_lineage_orphans"] = f"""{_KEPT},
        cited as (select event_id as card_id, unnest([event_id, event_id + 1, event_id + 7]) as cited_id from events)
        select card_id, count(*) as orphans from cited
        where cited_id not in (select event_id from kept) group by card_id"""
    sql["trust_upsert"] = f"""with {_SRC},
        rows as (
          select concat('b', cast(c_custkey as varchar)) as subject_id, '' as domain,
            case when c_custkey % 4 = 0 then 50 else c_custkey % 100 end as trust_score, 'standard' as trust_band,
            0 as fresh, cast(0 as bigint) as updated_ms, c_custkey as change_id from customer
          union all
          select coalesce(browser_id, 'b'), case when event_id % 3 = 0 then 'pricing' else '' end, event_id % 101,
            case when event_id % 5 = 0 then 'raised' else 'standard' end, 1, received_ms, event_id from src)
        select subject_id, domain, trust_score, trust_band, 'none' as probation_state, change_id from (
          select *, row_number() over (partition by subject_id, domain order by fresh desc, updated_ms desc, change_id desc) as rn
          from rows) where rn = 1"""
    sql["strict_contract"] = f"""with {_SRC}
        select event_type, reason, count(*) as n from (
          select event_type, unnest(string_split(codes, '|')) as reason
          from (select event_type, concat_ws('|', {_cases(_STRICT_RULES)}) as codes from src) where codes <> '')
        group by 1, 2"""
    sql["decision_audit"] = f"""{_DECISIONS}, {_CONFIG},
        settings as (
          select site_id,
            max(try_cast(value as double)) filter (where key = 'trigger_threshold') as threshold,
            max(try_cast(value as double)) filter (where key = 'confidence_floor') as floor,
            max(value) filter (where key = 'eligible_page_groups') as groups,
            max(value) filter (where key = 'excluded_paths') as excluded,
            max(value) filter (where key = 'kill_switch') as killed
          from effective where section = '750'
            and key in ('trigger_threshold', 'confidence_floor', 'eligible_page_groups', 'excluded_paths', 'kill_switch')
          group by site_id)
        select site_id, cast(d as varchar) as decision_date, count(*) as decisions,
          count(*) filter (where decision = 'fire') as fires,
          count(*) filter (where round(trigger_threshold, 4) <> threshold) as threshold_mismatch,
          count(*) filter (where decision = 'fire' and round(trigger_score, 4) < threshold) as fired_below_threshold,
          count(*) filter (where decision = 'fire' and round(trigger_confidence, 4) < floor) as fired_below_confidence,
          count(*) filter (where decision = 'fire' and not contains(groups, '"' || page_group || '"')) as fired_off_group,
          count(*) filter (where decision = 'fire' and contains(excluded, '"' || page_path || '"')) as fired_on_excluded,
          count(*) filter (where decision = 'fire' and killed = 'true') as fired_while_killed
        from log left join settings using (site_id) group by 1, 2"""
    return sql
