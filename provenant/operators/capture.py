"""Contact captures: validation, enrichment, encryption, storage rules and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant import contract
from provenant.functions.jsontypes import as_number, as_string, is_array, is_object, once, one_of, tag, top_level
from provenant.operators.dedup import insert_if_absent

KEY = ("site_id", "email_hash")
_STRINGS = (
    "email", "site_id", "session_id", "asset_key", "config_version", "probe_version", "browser_id",
)
_NUMBERS = ("trigger_score", "trigger_confidence")


def read_captures(bodies: DataFrame) -> DataFrame:
    """Parse capture bodies (``body`` JSON text) and name the first failed check in ``error``."""
    carried = bodies.columns
    members = top_level(F.col("body"), (*_STRINGS, *_NUMBERS, "trigger_reasons"))
    read = once(bodies, "_j", members).select(
        *carried,
        (is_object(F.col("_j")) | is_array(F.col("body"))).alias("_object"),
        *[as_string(f"_j.{n}").alias(n) for n in _STRINGS],
        *[as_number(f"_j.{n}").alias(n) for n in _NUMBERS],
        F.try_variant_get("_j.trigger_reasons", "$", "array<string>").alias("trigger_reasons"),
    )

    def missing(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.lit(f"missing {name}"))

    error = F.coalesce(
        F.when(~F.col("_object"), F.lit("invalid body")),
        F.when(~F.coalesce(F.col("email").contains("@"), F.lit(False)), F.lit("invalid email")),
        *[missing(n) for n in (
            "site_id", "session_id", "asset_key", "trigger_score", "config_version", "probe_version",
        )],
    )
    return read.withColumn("error", error).drop("_object")


def normalised(email: Column) -> Column:
    blank = contract.WHITESPACE_CLASS
    return F.regexp_replace(F.lower(email), f"^[{blank}]+|[{blank}]+$", "")


def email_class(domain: Column) -> Column:
    lowered = F.lower(domain)
    return (
        F.when(one_of(lowered, contract.FREEMAIL_DOMAINS), F.lit("freemail"))
        .when(one_of(lowered, contract.DISPOSABLE_DOMAINS), F.lit("disposable"))
        .otherwise(F.lit("business"))
    )


def encrypted(text: Column, key_hex: str) -> Column:
    """``iv:cipher:tag`` in hex: AES-256-GCM with a random 12-byte nonce and a 16-byte tag."""
    sealed = F.aes_encrypt(text, F.unhex(F.lit(key_hex)), F.lit("GCM"))
    body = F.octet_length(sealed) - 28
    parts = (
        F.substring(sealed, 1, 12), F.substring(sealed, F.lit(13), body),
        F.substring(sealed, F.octet_length(sealed) - 15, F.lit(16)),
    )
    return F.concat_ws(":", *[F.lower(F.hex(part)) for part in parts])


def decrypted(sealed: Column, key_hex: str) -> Column:
    joined = F.unhex(F.replace(sealed, F.lit(":"), F.lit("")))
    return F.aes_decrypt(joined, F.unhex(F.lit(key_hex)), F.lit("GCM")).cast("string")


def enrich_captures(captures: DataFrame, key_hex: str | None = None) -> DataFrame:
    """Rows to store for valid captures: the address leaves only hashed and encrypted."""
    address = normalised(F.col("email"))
    domain = F.coalesce(F.try_element_at(F.split(address, "@"), F.lit(2)), F.lit(""))
    sealed = [encrypted(F.col("_address"), key_hex).alias("email_encrypted")] if key_hex else []
    valid = captures.filter("error is null").withColumns({"_address": address, "_domain": domain})
    return valid.select(
        "capture_id", "site_id", "session_id",
        F.coalesce("browser_id", F.lit("")).alias("browser_id"),
        F.sha2("_address", 256).alias("email_hash"),
        F.col("_domain").alias("email_domain"),
        email_class(F.col("_domain")).alias("email_class"),
        *sealed,
        "asset_key",
        F.col("trigger_score").cast("float").alias("trigger_score"),
        F.coalesce("trigger_confidence", F.lit(0.0)).cast("float").alias("trigger_confidence"),
        F.coalesce("trigger_reasons", F.array().cast("array<string>")).alias("trigger_reasons"),
        F.lit(False).alias("mx_verified"),
        "config_version", "probe_version", "captured_at",
        (F.col("captured_at") + F.expr(f"INTERVAL {contract.RETENTION_DAYS} DAYS")).alias("purge_after"),
    )


def new_captures(stored: DataFrame, captures: DataFrame) -> DataFrame:
    """Rows to append: the first capture of an address per site; a repeat changes nothing."""
    return insert_if_absent(stored, captures, KEY, ("captured_at", "capture_id"))


def download_urls(captures: DataFrame, stored_config: DataFrame) -> DataFrame:
    """Where a captured visitor is sent: the stored row's own URL, never the default one."""
    config = stored_config.select("site_id", F.try_parse_json("config_750").alias("_config"))
    url = F.try_variant_get("_config", "$.asset_url", "variant")
    own = F.when(
        F.coalesce(tag(url), F.lit("VOID")) != "VOID", F.try_variant_get(url, "$", "string")
    )
    fallback = F.concat(F.lit("/assets/downloads/"), F.col("asset_key"), F.lit(".pdf"))
    return captures.join(config, "site_id", "left").select(
        "capture_id", "site_id", F.coalesce(own, fallback).alias("download_url")
    )


def retained(captures: DataFrame, now: Column) -> DataFrame:
    """Captures that survive a purge at ``now``; one due exactly then stays."""
    return captures.filter(F.col("purge_after") >= now)


def purge_count(captures: DataFrame, now: Column) -> DataFrame:
    return captures.agg(F.count(F.when(F.col("purge_after") < now, 1)).alias("purged"))
