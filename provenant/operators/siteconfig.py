"""Effective site configuration and the bootstrap gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant import contract
from provenant.functions.jsontypes import as_number

_JSON_MAP = "map<string,variant>"


def _default_map(defaults: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in defaults.items() for part in pair])


def merged(overrides: Column, defaults: dict[str, str]) -> Column:
    """map(key -> JSON text): top-level merge. A key that is present wins, even as null."""
    given = F.transform_values(
        F.from_json(F.coalesce(overrides, F.lit("{}")), _JSON_MAP),
        lambda _, value: F.coalesce(F.to_json(value), F.lit("null")),
    )
    return F.map_zip_with(
        _default_map(defaults), given,
        lambda key, default, own: F.coalesce(own, default),
    )


def effective_config(sites: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per asked site; a site without a stored row gets the defaults."""
    return sites.select("site_id").join(stored, "site_id", "left").select(
        "site_id",
        merged(F.col("config_272"), contract.ANALYSIS_DEFAULTS).alias("config_272"),
        merged(F.col("config_750"), contract.PROBE_DEFAULTS).alias("config_750"),
        "deploy_start_date",
    )


def as_json(config: Column) -> Column:
    """The JSON text of map(key -> JSON text), members in key order."""
    entries = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(
        F.to_json(F.array(e["key"])), F.lit(":"), e["value"]))
    # A one-element array is the only way to have a lone string quoted; its brackets go again.
    members = F.transform(entries, lambda text: F.regexp_replace(text, r'^\["((?:[^"\\\\]|\\\\.)*)"\]', '"$1"'))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def seed_rows(config: DataFrame) -> DataFrame:
    """Rows to store for the sites of an effective configuration: defaults merged with their overrides, as JSON."""
    return config.select("site_id", as_json(F.col("config_272")).alias("config_272"), as_json(F.col("config_750")).alias("config_750"))


def fingerprint(text: Column) -> Column:
    """A digest of a configuration's top-level members, whatever their order in the text."""
    members = F.transform_values(F.from_json(text, _JSON_MAP), lambda _, value: F.coalesce(F.to_json(value), F.lit("null")))
    lines = F.transform(F.array_sort(F.map_entries(members)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.array_join(lines, "\n"), 256)


def config_entries(config: DataFrame, name: str) -> DataFrame:
    """Long form (site_id, key, value) of one configuration."""
    return config.select("site_id", F.explode(name).alias("key", "value"))


def eligible_sessions(accepted: DataFrame) -> DataFrame:
    return (
        accepted.filter("event_type = 'session_start'")
        .groupBy("site_id").agg(F.count_distinct("session_id").alias("eligible_sessions"))
    )


def runtime_days(start: Column, now: Column) -> Column:
    """Whole days since the start date, 0 when none is set; negative for a future date."""
    elapsed = F.unix_millis(now) - F.unix_millis(start.cast("timestamp"))
    return F.coalesce(F.floor(elapsed / 86_400_000), F.lit(0))


def _required(name: str, fallback: int) -> Column:
    value = as_number(f"try_variant_get(try_parse_json(config_750['bootstrap']), '$.{name}', 'variant')")
    return F.coalesce(value, F.lit(float(fallback)))


def bootstrap_status(config: DataFrame, accepted: DataFrame, now: Column) -> DataFrame:
    sessions = eligible_sessions(accepted)
    gate = config.join(sessions, "site_id", "left").select(
        "site_id",
        runtime_days(F.col("deploy_start_date"), now).alias("runtime_days"),
        F.coalesce("eligible_sessions", F.lit(0)).alias("eligible_sessions"),
        _required("min_runtime_days", contract.DEFAULT_REQUIRED_DAYS)
        .alias("required_runtime_days"),
        _required("min_eligible_sessions", contract.DEFAULT_REQUIRED_SESSIONS)
        .alias("required_eligible_sessions"),
    )
    met = (F.col("runtime_days") >= F.col("required_runtime_days")) & (
        F.col("eligible_sessions") >= F.col("required_eligible_sessions")
    )
    return gate.withColumn("bootstrap_met", met)


def number_of(config: str, key: str) -> Column:
    return as_number(f"try_parse_json({config}['{key}'])")


def flag_of(config: str, key: str) -> Column:
    return F.element_at(config, key) == "true"


def list_of(config: str, key: str) -> Column:
    return F.from_json(F.element_at(config, key), "array<string>")
