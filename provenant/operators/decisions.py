"""Trigger decisions: validation, defaults and the audit against configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant import contract
from provenant.functions.jsontypes import as_number, as_string, once, one_of, tag, top_level, truthy_sql
from provenant.operators.siteconfig import flag_of, list_of, number_of

_REQUIRED = ("site_id", "session_id", "decision", "config_version", "probe_version")
_OPTIONAL = ("browser_id", "safety_result", "safety_reason", "page_path", "page_group")
_NUMBERS = ("trigger_score", "trigger_confidence", "trigger_threshold")


def read_decisions(bodies: DataFrame) -> DataFrame:
    """Parse decision bodies, apply defaults, and name a failed check in ``error``.

    The table stores text, so a required number or flag is kept as its text.
    """
    carried = bodies.columns
    names = (*_REQUIRED, *_OPTIONAL, *_NUMBERS, "trigger_reasons")
    read = once(bodies, "_j", top_level(F.col("body"), names))
    complete = F.lit(True)
    for name in _REQUIRED:
        complete = complete & F.expr(truthy_sql(f"_j.{name}"))

    def text(name: str) -> Column:
        value = F.col(f"_j.{name}")
        return F.coalesce(as_string(f"_j.{name}"), F.when(tag(value) != "VOID", F.to_json(value)))

    parsed = read.select(
        *carried,
        complete.alias("_complete"),
        *[text(n).alias(n) for n in _REQUIRED],
        F.coalesce(text("browser_id"), F.lit("")).alias("browser_id"),
        *[F.coalesce(as_number(f"_j.{n}"), F.lit(0.0)).cast("float").alias(n) for n in _NUMBERS],
        F.coalesce(
            F.try_variant_get("_j.trigger_reasons", "$", "array<string>"),
            F.array().cast("array<string>"),
        ).alias("trigger_reasons"),
        *[text(n).alias(n) for n in _OPTIONAL[1:]],
    )
    error = F.when(~F.col("_complete"), F.lit("missing required fields")).when(
        ~one_of(F.col("decision"), contract.DECISIONS), F.lit("unknown decision")
    )
    return parsed.withColumn("error", error).drop("_complete")


def decision_log(decisions: DataFrame) -> DataFrame:
    return decisions.filter("error is null").drop("error", "body")


def audit_decisions(log: DataFrame, config: DataFrame) -> DataFrame:
    """Logged decisions that disagree with the site's effective configuration, per site and day.

    The contract states only the settings; which disagreements to count is our choice.
    """
    settings = config.select(
        "site_id",
        number_of("config_750", "trigger_threshold").alias("threshold"),
        number_of("config_750", "confidence_floor").alias("floor"),
        list_of("config_750", "eligible_page_groups").alias("groups"),
        list_of("config_750", "excluded_paths").alias("excluded"),
        flag_of("config_750", "kill_switch").alias("killed"),
    )
    fired = F.col("decision") == "fire"

    def hits(test: Column) -> Column:
        return F.sum(F.coalesce(test, F.lit(False)).cast("bigint"))

    def differs(logged: str, setting: str) -> Column:
        return F.round(F.col(logged).cast("double"), 4) != F.round(setting, 4)

    return (
        log.withColumn("decision_date", F.to_date("decided_at"))
        .join(settings, "site_id", "left")
        .groupBy("site_id", "decision_date").agg(
            F.count("*").alias("decisions"),
            hits(fired).alias("fires"),
            hits(differs("trigger_threshold", "threshold")).alias("threshold_mismatch"),
            hits(fired & (F.round(F.col("trigger_score").cast("double"), 4) < F.round("threshold", 4)))
            .alias("fired_below_threshold"),
            hits(fired & (F.round(F.col("trigger_confidence").cast("double"), 4) < F.round("floor", 4)))
            .alias("fired_below_confidence"),
            hits(fired & ~F.array_contains("groups", F.col("page_group"))).alias("fired_off_group"),
            hits(fired & F.array_contains("excluded", F.col("page_path"))).alias("fired_on_excluded"),
            hits(fired & F.col("killed")).alias("fired_while_killed"),
        )
    )
