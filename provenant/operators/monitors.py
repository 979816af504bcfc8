"""Monitors over small daily tables, and checks between stored artefacts.

Sliding windows run per site over one row per day, never over events, and are as long as the site's configuration says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions.jsontypes import as_number
from provenant.operators.dedup import upsert_latest
from provenant.operators.siteconfig import number_of

# The contract's default thresholds where a configuration holds no number (percent, days, counts).
RAISE_PCT, DISABLE_PCT, BREAKER_PCT, FIRE_DAYS = 5, 8, 10, 7
DISMISS_PCT, DISMISS_DAYS = 70, 14
DAILY_BUDGET, MAX_FIRE_PER_SESSION, COOLDOWN_HOURS = 20, 1, 72
ELIGIBLE_DAYS, ELIGIBLE_SESSIONS, ELIGIBLE_RATE = 30, 200, 0.7

# name -> (top-level key, member or None, default)
FIRE_LIMITS = {
    "raise_pct": ("fire_rate", "auto_raise_pct", RAISE_PCT),
    "raise_days": ("fire_rate", "auto_raise_window_days", FIRE_DAYS),
    "disable_pct": ("fire_rate", "auto_disable_pct", DISABLE_PCT),
    "disable_days": ("fire_rate", "auto_disable_window_days", FIRE_DAYS),
    "breaker_pct": ("fire_rate", "circuit_breaker_pct", BREAKER_PCT),
    "dismiss_pct": ("dismiss_rate", "raise_at_pct", DISMISS_PCT),
    "dismiss_days": ("dismiss_rate", "window_days", DISMISS_DAYS),
    "daily_budget": ("daily_budget", None, DAILY_BUDGET),
    "session_cap": ("max_fire_per_session", None, MAX_FIRE_PER_SESSION),
    "cooldown_hours": ("cooldown_hours", None, COOLDOWN_HOURS),
}


def _number(config: str, key: str, member: str | None) -> Column:
    if member is None:
        return number_of(config, key)
    return as_number(f"try_variant_get(try_parse_json({config}['{key}']), '$.{member}', 'variant')")


def fire_limits(config: DataFrame) -> DataFrame:
    """(site_id, a column for each of FIRE_LIMITS) from the effective configuration."""
    return config.select("site_id", *[
        F.coalesce(_number("config_750", key, member), F.lit(float(default))).alias(name)
        for name, (key, member, default) in FIRE_LIMITS.items()
    ])


def past_sums(daily: DataFrame, date: str, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums over the days (date - length, date] of each site, where the length is a column of the row.

    ``windows``: result -> (summed column, column of the length in days). A frame of a window cannot differ by row.
    The sum is therefore what has run up to the date less what had run up to date - length, looked up
    there as of that day: running totals and lookups are sorted together, per site, one row a day.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    up_to = Window.partitionBy("site_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    totals = daily.withColumn("_day", day).withColumns({
        f"_{name}": F.sum(summed).over(up_to) for name, (summed, _) in windows.items()})
    asked = totals.select("site_id", F.col("_day").alias("_for"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.col("_day") - F.ceil(length)).cast("int").alias("_day"))
        for name, (_, length) in windows.items()
    ])).alias("_w")).select("site_id", "_for", "_w.name", "_w._day", F.lit(1).alias("_asks"))
    none = F.lit(None)
    known = totals.select(
        "site_id", none.cast("int").alias("_for"), none.cast("string").alias("name"), "_day", F.lit(0).alias("_asks"),
        *[f"_{name}" for name in windows])
    as_of = Window.partitionBy("site_id").orderBy("_day", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    looked_up = known.unionByName(asked, allowMissingColumns=True).withColumns({
        f"_{name}": F.last(f"_{name}", ignorenulls=True).over(as_of) for name in windows
    }).filter("_asks = 1").groupBy("site_id", F.col("_for").alias("_day")).agg(*[
        F.max(F.when(F.col("name") == name, F.coalesce(f"_{name}", F.lit(0)))).alias(f"_{name}_before") for name in windows
    ])
    return totals.join(looked_up, ["site_id", "_day"]).select("*", *[
        (F.col(f"_{name}") - F.col(f"_{name}_before")).alias(name) for name in windows
    ]).drop("_day", *[f"_{name}" for name in windows], *[f"_{name}_before" for name in windows])


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def fire_rates(log: DataFrame, config: DataFrame) -> DataFrame:
    """Daily fire and dismiss rates per site with the action they call for.

    All limits and window lengths are those of the site's effective configuration (``config``); a site without a
    row there has the defaults. Denominators are ours: fires over session-days with any decision, dismisses over
    fires. ``fire_rate`` is that of the raising window, ``disable_rate`` that of the disabling one, which the circuit
    breaker shares. ``over_budget`` and ``over_session_cap`` compare a day's fires with the budget and the cap.
    """
    limits = fire_limits(config)
    names = list(FIRE_LIMITS)
    sessions = log.withColumn("decision_date", F.to_date("decided_at")).groupBy(
        "site_id", "decision_date", "session_id"
    ).agg(
        F.count(F.when(F.col("decision") == "fire", 1)).alias("fires"),
        F.count(F.when(F.col("decision") == "dismiss", 1)).alias("dismisses"),
    )
    # Sessions by their number of fires: few rows per site and day, which the site's cap can then be applied to.
    by_fires = sessions.groupBy("site_id", "decision_date", "fires").agg(
        F.count("*").alias("sessions"), F.sum("dismisses").alias("dismisses"))
    daily = by_fires.join(limits, "site_id", "left").withColumns({
        name: F.coalesce(name, F.lit(float(default))) for name, (_, _, default) in FIRE_LIMITS.items()
    }).groupBy("site_id", "decision_date").agg(
        F.sum("sessions").alias("sessions"), F.sum(F.col("fires") * F.col("sessions")).alias("fires"),
        F.sum("dismisses").alias("dismisses"),
        F.sum(F.when(F.col("fires") > F.col("session_cap"), F.col("sessions")).otherwise(F.lit(0))).alias("over_session_cap"),
        *[F.max(name).alias(name) for name in names],
    )
    summed = past_sums(daily, "decision_date", {
        "raise_fires": ("fires", "raise_days"), "raise_sessions": ("sessions", "raise_days"),
        "disable_fires": ("fires", "disable_days"), "disable_sessions": ("sessions", "disable_days"),
        "dismiss_fires": ("fires", "dismiss_days"), "dismiss_dismisses": ("dismisses", "dismiss_days"),
    })
    rated = summed.select(
        "site_id", "decision_date", "sessions", "fires", "dismisses", "over_session_cap", *names,
        _share(F.col("raise_fires"), F.col("raise_sessions")).alias("fire_rate"),
        _share(F.col("disable_fires"), F.col("disable_sessions")).alias("disable_rate"),
        _share(F.col("dismiss_dismisses"), F.col("dismiss_fires")).alias("dismiss_rate"),
    )
    disable = F.col("disable_rate") * 100
    action = (
        F.when(disable >= F.col("breaker_pct"), F.lit("break"))
        .when(disable >= F.col("disable_pct"), F.lit("disable"))
        .when((F.col("fire_rate") * 100 >= F.col("raise_pct")) | (F.col("dismiss_rate") * 100 >= F.col("dismiss_pct")), F.lit("raise"))
        .otherwise(F.lit("none"))
    )
    return rated.withColumns(
        {"over_budget": (F.col("fires") > F.col("daily_budget")).cast("int"), "action": action}
    ).drop(*names)


def cooldown_breaches(log: DataFrame, config: DataFrame) -> DataFrame:
    """Fires per site and browser that came within the site's cooldown of an earlier fire.

    Hours are cut into cooldown-long bins. In a bin every fire after the first is a breach; the
    first is one when the last fire of the bin before is less than a cooldown away. Bins carry a
    count and two times, so a busy browser collapses before it is shuffled. Without a cooldown (none or a negative
    one) nothing is a breach.
    """
    limits = fire_limits(config).select("site_id", (F.col("cooldown_hours") * 3_600_000).alias("span"))
    ms = F.unix_millis("decided_at")
    fires = log.filter("decision = 'fire'").join(limits, "site_id", "left").withColumn(
        "span", F.coalesce("span", F.lit(COOLDOWN_HOURS * 3_600_000.0)))
    key = F.when(F.col("span") > 0, F.floor(ms / F.col("span")))
    bins = fires.groupBy("site_id", "browser_id", "span", key.alias("bin")).agg(
        F.count("*").alias("fires"), F.min(ms).alias("first"), F.max(ms).alias("last"))
    before = bins.select("site_id", "browser_id", (F.col("bin") + 1).alias("bin"), F.col("last").alias("prior"))
    late = F.coalesce((F.col("first") - F.col("prior") < F.col("span")).cast("bigint"), F.lit(0))
    breaches = F.when(F.col("bin").isNull(), F.lit(0)).otherwise(F.col("fires") - 1 + late)
    return (
        bins.join(before, ["site_id", "browser_id", "bin"], "left")
        .groupBy("site_id", "browser_id")
        .agg(F.sum("fires").alias("fires"), F.sum(breaches).alias("breaches"))
    )


def eligibility(metrics: DataFrame, config: DataFrame) -> DataFrame:
    """Sites ready for analysis: enough session-days and a high enough share of valid events in the past days.

    ``config`` is the effective configuration, which says how many days count, how many sessions and what share.
    """
    needs = config.select(
        "site_id",
        F.coalesce(number_of("config_272", "analysis_window_days"), F.lit(float(ELIGIBLE_DAYS))).alias("days"),
        F.coalesce(number_of("config_272", "min_eligible_sessions"), F.lit(float(ELIGIBLE_SESSIONS))).alias("needed"),
        F.coalesce(number_of("config_272", "min_valid_event_rate"), F.lit(ELIGIBLE_RATE)).alias("needed_rate"),
    )
    asked = metrics.join(needs, "site_id", "left").withColumns({
        "days": F.coalesce("days", F.lit(float(ELIGIBLE_DAYS))), "needed": F.coalesce("needed", F.lit(float(ELIGIBLE_SESSIONS))),
        "needed_rate": F.coalesce("needed_rate", F.lit(ELIGIBLE_RATE)),
    })
    sums = past_sums(asked, "metric_date", {
        "sessions": ("distinct_sessions", "days"), "valid": ("events_accepted", "days"), "received": ("events_received", "days"),
    })
    rate = _share(F.col("valid"), F.col("received"))
    return sums.select(
        "site_id", "metric_date", "sessions", rate.alias("valid_event_rate"),
        ((F.col("sessions") >= F.col("needed")) & (rate >= F.col("needed_rate"))).cast("int").alias("eligible"),
    )


def reconcile_runs(runs: DataFrame, exports: DataFrame) -> DataFrame:
    """Replay runs against the exports they claim to have read."""
    run, export = runs.alias("r"), exports.alias("e")
    totals = F.col("subjects_scoreable") + F.col("subjects_degraded") + F.col("subjects_unscorable")
    status = (
        F.when(F.col("r.run_id").isNull(), F.lit("no_run"))
        .when(F.col("e.sha256").isNull(), F.lit("no_export"))
        .when(F.col("r.source_sha256") != F.col("e.sha256"), F.lit("digest_differs"))
        .when(F.col("r.subjects_total") != totals, F.lit("totals_differ"))
        .when(F.col("r.subjects_total") != F.col("e.subject_count"), F.lit("subjects_differ"))
        .otherwise(F.lit("ok"))
    )
    same = (F.col("r.site_id") == F.col("e.site_id")) & (F.col("r.window_start") == F.col("e.window_start"))
    return run.join(export, same, "full").select(
        F.coalesce("r.site_id", "e.site_id").alias("site_id"),
        F.coalesce("r.window_start", "e.window_start").alias("window_start"),
        F.col("r.run_id").alias("run_id"), status.alias("status"),
    )


def differing_distributions(runs: DataFrame, cards: DataFrame, maps: dict[str, str]) -> DataFrame:
    """(run_id, differing): names of the maps of a run that its evidence cards do not bear out, in order, joined by commas.

    ``maps``: map column of ``runs`` -> column of ``cards`` whose values it counts. Maps are compared key by key in long
    form; a key that one side lacks counts as nought. Runs without a difference have no row.
    """
    noted = [
        runs.select("run_id", F.lit(name).alias("name"), F.explode(name).alias("key", "n")) for name in maps
    ]
    found = [
        cards.groupBy("run_id", F.lit(name).alias("name"), F.col(column).alias("key")).agg((-F.count("*")).alias("n"))
        for name, column in maps.items()
    ]
    both = noted[0].select("run_id", "name", "key", F.col("n").cast("bigint").alias("n"))
    for more in (*noted[1:], *found):
        both = both.unionByName(more.select("run_id", "name", "key", F.col("n").cast("bigint").alias("n")))
    unequal = both.groupBy("run_id", "name", "key").agg(F.sum("n").alias("n")).filter("n <> 0")
    return unequal.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("differing"))


def lineage_orphans(cards: DataFrame, ledger: DataFrame) -> DataFrame:
    """Event ids that evidence cards cite and the accepted ledger does not hold."""
    cited = cards.select("card_id", F.explode("source_event_ids").alias("event_id"))
    return cited.join(ledger.select("event_id"), "event_id", "left_anti")


TRUST_KEY = ("subject_id", "domain")


def trust_rows(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill a trust change up to a full row with the table's defaults; ``updated_at`` is by default ``now``."""
    defaults = {
        "domain": F.lit(""), "trust_score": F.lit(50), "trust_band": F.lit("standard"), "probation_state": F.lit("none"),
        "recovery_state": F.lit("none"), "reason_codes": F.array().cast("array<string>"),
        "last_decision_at": F.lit(None).cast("timestamp"), "updated_at": F.current_timestamp() if now is None else now,
    }
    present = changes.columns
    return changes.withColumns({
        name: F.coalesce(F.col(name), value) if name in present else value for name, value in defaults.items()
    })


def upsert_trust(state: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    return upsert_latest(trust_rows(state, now), trust_rows(changes, now), TRUST_KEY, ("updated_at", "change_id"))
