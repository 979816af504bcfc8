"""Deterministic replay export of the accepted ledger."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenant import contract
from provenant.functions.jsontypes import as_string, once, top_level
from provenant.operators.ordering import with_ordinal
from provenant.session import shared_dir
from provenant.sources.files import listed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = ("client_timestamp_ms", "received_at", "event_id")
DIGEST_SCHEMA = "site_id string, part int, lines bigint, sha256 string"
META_SCHEMA = (
    "export_version string, site_id string, window_start string, window_end string, event_count bigint, "
    "session_count bigint, subject_count bigint, exported_at string, sort_order array<string>, "
    "collector_versions array<string>, sha256 string"
)
LINE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSX"


def in_window(ledger: DataFrame, start: str, end: str) -> DataFrame:
    """Received from the first second of ``start`` to the last whole second of ``end``.

    Events of the final fraction of a second fall outside, as the bound is 23:59:59 exactly.
    """
    received = F.col("received_at")
    return ledger.filter(
        (received >= F.lit(f"{start}T00:00:00Z").cast("timestamp"))
        & (received <= F.lit(f"{end}T23:59:59Z").cast("timestamp"))
    )


def replay_line(raw: Column) -> Column:
    """JSON line: a ``_replay`` header, then the event; a ``_replay`` member of its own wins."""
    header = F.to_json(F.struct(
        "event_id",
        F.date_format("received_at", LINE_TIME).alias("received_at"),
        "collector_version",
    ))
    members = F.from_json(raw, "map<string,variant>")
    body = F.to_json(F.try_parse_json(raw))
    own = F.to_json(F.element_at(members, "_replay"))
    rest = F.to_json(F.map_filter(members, lambda key, _: key != "_replay"))
    has_own = raw.contains('"_replay"') & F.array_contains(F.map_keys(members), "_replay")
    chosen = F.when(has_own, own).otherwise(header)
    after = F.when(has_own, rest).otherwise(body)
    return F.concat(
        F.lit('{"_replay":'), chosen,
        F.when(after == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substr(after, F.lit(2)))),
    )


def replay_rows(ledger: DataFrame, start: str, end: str) -> DataFrame:
    """Position of every event in its site's replay."""
    return with_ordinal(in_window(ledger, start, end), ORDER, "ordinal", within=["site_id"])


def _with_ids(rows: DataFrame) -> DataFrame:
    """Session and subject as the event itself states them."""
    return once(rows, "_m", top_level(F.col("raw"), ("anon_session_id", "anon_browser_id"))).withColumns(
        {"session": as_string("_m.anon_session_id"), "subject": as_string("_m.anon_browser_id")})


def _summary(ids: DataFrame) -> DataFrame:
    return ids.groupBy("site_id").agg(
        F.count("*").alias("event_count"),
        F.count_distinct(F.nullif("session", F.lit(""))).alias("session_count"),
        F.count_distinct(F.nullif("subject", F.lit(""))).alias("subject_count"),
        F.array_sort(F.collect_set("collector_version")).alias("collector_versions"),
    )


def replay_meta(ledger: DataFrame, start: str, end: str) -> DataFrame:
    """One row per site; session and subject ids are read from the event itself."""
    return _summary(_with_ids(in_window(ledger, start, end)))


def part_digests(lines: DataFrame) -> DataFrame:
    """(site_id, part, lines, sha256): of the lines of each part of a site, in order, newline after each line.

    The lines of a part must lie together in one partition, in order, as a sort by part leaves them.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, count, at = hashlib.sha256(), 0, None
        rows: list[tuple] = []
        for batch in batches:
            for site, number, line in zip(*(column.to_pylist() for column in batch.columns)):
                if (site, number) != at:
                    if count:
                        rows.append((*at, count, running.hexdigest()))
                    running, count, at = hashlib.sha256(), 0, (site, number)
                running.update(line.encode("utf-8") + b"\n")
                count += 1
        if count:
            rows.append((*at, count, running.hexdigest()))
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], ["site_id", "part", "lines", "sha256"])

    return lines.select("site_id", "part", "line").mapInArrow(digest, DIGEST_SCHEMA)


def export_replay(
    ledger: DataFrame, site: str, start: str, end: str, target: str, *, parts: int | None = None
) -> dict[str, str]:
    """Write one site's replay; see :func:`export_replays`."""
    return export_replays(ledger, [site], start, end, target, parts=parts)


def export_replays(
    ledger: DataFrame, sites: Sequence[str], start: str, end: str, target: str, *, parts: int | None = None
) -> dict[str, str]:
    """Write the replays of some sites: ordered text parts, a manifest of digests, and a meta record for each site.

    Below its site's folder, part files sort by name into replay order. Ranges are cut over site and order together,
    so a busy site spans many parts. The digest in the meta record is taken over the ordered part digests, so no
    task reads more than its own part; with one part, that part's digest is the plain digest of the file. A site
    without events in the window has a meta record of zeros. Returns the locations written.
    """
    shared_dir(ledger.sparkSession)
    rows = in_window(ledger.filter(F.col("site_id").isin(*sites)), start, end)
    keys = ("site_id", *ORDER)
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    # Kept once: the lines, their digests and the meta record must describe the same parts.
    placed = (
        _with_ids(ranged.sortWithinPartitions(*keys))
        .select(
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "site_id",
            replay_line(F.col("raw")).alias("line"), "session", "subject", "collector_version",
        )
        .checkpoint()
    )
    at = {name: f"{target.rstrip('/')}/{name}" for name in ("events", "digests", "meta")}
    # Already in this order; said again, so that the writer does not sort by site alone.
    lines = placed.sortWithinPartitions("site_id", "at")
    lines.select("site_id", "line").write.partitionBy("site_id").text(at["events"])
    part_digests(lines).write.json(at["digests"])
    # One row per part, so the ordered list of a site is as short as its list of files.
    digests = _manifest(ledger.sparkSession, target)
    asked = ledger.sparkSession.createDataFrame([(site,) for site in dict.fromkeys(sites)], "site_id string")
    whole = asked.join(_whole(digests), "site_id", "left").select(
        "site_id", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))
    zero = F.lit(0).cast("bigint")
    whole.join(_summary(placed), "site_id", "left").select(
        F.lit(contract.EXPORT_VERSION).alias("export_version"), "site_id",
        F.lit(f"{start}T00:00:00Z").alias("window_start"),
        F.lit(f"{end}T23:59:59Z").alias("window_end"),
        *[F.coalesce(name, zero).alias(name) for name in ("event_count", "session_count", "subject_count")],
        F.date_format(F.current_timestamp(), LINE_TIME).alias("exported_at"),
        F.array(*[F.lit(c) for c in ORDER]).alias("sort_order"),
        F.coalesce("collector_versions", F.array().cast("array<string>")).alias("collector_versions"), "sha256",
    ).write.json(at["meta"])
    return at


def _manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(DIGEST_SCHEMA).json(f"{target.rstrip('/')}/digests")


def _whole(digests: DataFrame) -> DataFrame:
    """One digest per site over the digests of its parts, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "sha256")))
    return digests.groupBy("site_id").agg(F.sha2(F.array_join(ordered["sha256"], ""), 256).alias("sha256"))


def export_meta(spark: SparkSession, target: str) -> DataFrame:
    """The meta records of an export."""
    return spark.read.schema(META_SCHEMA).json(f"{target.rstrip('/')}/meta")


def export_lines(spark: SparkSession, target: str) -> DataFrame:
    """(site_id, part, line, block, at): the exported lines; ``block`` and ``at`` order the lines of a part."""
    folder = f"{target.rstrip('/')}/events"
    schema = "value string, site_id string"
    if not listed(spark, folder):
        return spark.createDataFrame([], "site_id string, part int, line string, block bigint, at bigint")
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    return spark.read.schema(schema).option("lineSep", "\n").text(folder).select(
        "site_id", number.alias("part"), F.col("value").alias("line"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _read_digests(spark: SparkSession, target: str) -> DataFrame:
    """The digests that the parts of an export have now."""
    lines = export_lines(spark, target).repartition("site_id", "part")
    return part_digests(lines.sortWithinPartitions("site_id", "part", "block", "at"))


def file_digests(spark: SparkSession, target: str, sites: Sequence[str]) -> DataFrame:
    """(site_id, sha256): what a reader of the files computes for each of the sites, whatever the meta records say."""
    asked = spark.createDataFrame([(site,) for site in sites], "site_id string")
    return asked.join(_whole(_read_digests(spark, target)), "site_id", "left").select(
        "site_id", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))


def verify_export(spark: SparkSession, target: str) -> DataFrame:
    """Read every part again: (site_id, part, lines, sha256, status) with status ok, altered, missing or extra.

    A part is one file; a file that Spark reads in several splits is put together again by a shuffle that keeps
    its lines in order, with spilling sorts, so a part's size bounds nothing but its own task.
    """
    noted, now = _manifest(spark, target).alias("m"), _read_digests(spark, target).alias("f")
    same = (F.col("m.site_id") == F.col("f.site_id")) & (F.col("m.part") == F.col("f.part"))
    status = (
        F.when(F.col("f.sha256").isNull(), F.lit("missing")).when(F.col("m.sha256").isNull(), F.lit("extra"))
        .when((F.col("m.sha256") != F.col("f.sha256")) | (F.col("m.lines") != F.col("f.lines")), F.lit("altered"))
        .otherwise(F.lit("ok"))
    )
    return noted.join(now, same, "full").select(
        F.coalesce("m.site_id", "f.site_id").alias("site_id"), F.coalesce("m.part", "f.part").alias("part"),
        F.coalesce("f.lines", F.lit(0)).alias("lines"), F.col("f.sha256").alias("sha256"), status.alias("status"))


def verified_exports(spark: SparkSession, target: str) -> DataFrame:
    """The meta record of each site, with its number of damaged parts and whether the files still give its digest."""
    checked = verify_export(spark, target)
    damaged = checked.groupBy("site_id").agg(F.count_if(F.col("status") != "ok").alias("damaged_parts"))
    again = _whole(checked.filter("sha256 is not null")).withColumnRenamed("sha256", "files_sha256")
    empty = F.sha2(F.lit(""), 256)
    return export_meta(spark, target).join(damaged, "site_id", "left").join(again, "site_id", "left").select(
        *[f.name for f in StructType.fromDDL(META_SCHEMA)], F.coalesce("damaged_parts", F.lit(0)).alias("damaged_parts"),
        (F.coalesce("files_sha256", empty) == F.col("sha256")).alias("digest_holds"))
