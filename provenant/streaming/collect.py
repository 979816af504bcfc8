"""Continuous collection: a stream of batches into the ledgers.

Every micro-batch is judged once into a staged table and then written as one epoch of each
ledger, followed by a commit marker. Leftovers of an epoch are removed before it is written and readers only
see committed epochs, so a restart or a lost executor neither doubles nor halves a batch. The
staged table holds what the ledgers hold, personal data already redacted, and goes after the commit.

Ledgers lie in folders of days, each with one folder per epoch, so a job over some days reads no others. Beside them
stand the keys of the accepted events, three narrow columns in folders of KEY_BUCKETS hash buckets, so that
a micro-batch is compared with the buckets that its own keys fall into, and never with the events themselves.

A query numbers its micro-batches from nought. The ledger notes, for the lasting id of each query, the epoch
at which it joined, so a query with a new or lost checkpoint goes on after the last epoch
instead of writing over the first ones.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenant.contract import Registry
from provenant.operators.dedup import ARRIVAL, LEDGER_KEY, first_writer_wins
from provenant.operators.ledger import accepted_rows, rejected_rows
from provenant.operators.ordering import with_ordinal
from provenant.operators.pii import redacted
from provenant.operators.sinks import append_epoch
from provenant.operators.validate import validate_events
from provenant.schemas import ACCEPTED, REFUSED_BATCHES, REJECTED
from provenant.session import new_run_dir
from provenant.sources.batches import admit, split_batches
from provenant.sources.files import exists, listed, remove, write_small

ID_BITS = 40
DAY = "received_date"
#: Hash buckets of the stored keys. Fixed for the life of a ledger.
KEY_BUCKETS = 64
KEYS = "site_id string, session_id string, client_event_id string, bucket int, epoch bigint"
#: First and last day, both included.
Days = tuple[str, str]


def committed(spark: SparkSession, root: str) -> int:
    """Highest committed epoch, -1 before the first."""
    return max((int(name) for name in listed(spark, f"{root}/commits") if name.isdigit()), default=-1)


def joined_at(spark: SparkSession, root: str, query: str) -> int:
    """The epoch of a query's first micro-batch; noted when the query is first seen."""
    path = f"{root}/queries/{query}"
    if not exists(spark, f"{path}/_SUCCESS"):
        first = spark.range(1).select(F.lit(committed(spark, root) + 1).cast("bigint").alias("first"))
        first.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("first bigint").json(path).first()[0]


@dataclass(frozen=True)
class Ledgers:
    """The ledgers as they stood after one epoch: what a reader joins belongs together."""

    epoch: int
    accepted: DataFrame
    rejected: DataFrame
    refused: DataFrame


def ledgers_at(spark: SparkSession, root: str, epoch: int | None = None, days: Days | None = None) -> Ledgers:
    """All ledgers at one committed epoch, the last one by default; only the folders of ``days`` are read."""
    last = committed(spark, root)
    epoch = last if epoch is None else min(epoch, last)

    def table(name: str, schema: str) -> DataFrame:
        return _table(spark, root, name, schema, epoch, days)

    return Ledgers(epoch, table("accepted", ACCEPTED), table("rejected", REJECTED), table("refused", REFUSED_BATCHES))


def _table(spark: SparkSession, root: str, name: str, schema: str, epoch: int, days: Days | None) -> DataFrame:
    path, stored = f"{root}/{name}", f"{schema}, epoch bigint, received_date date"
    if epoch < 0 or not exists(spark, path):
        return spark.createDataFrame([], stored)
    rows = spark.read.schema(stored).parquet(path).filter(F.col("epoch") <= epoch)
    if days:
        first, last = (F.lit(day).cast("date") for day in days)
        rows = rows.filter((F.col("received_date") >= first) & (F.col("received_date") <= last))
    return rows


def accepted_table(spark: SparkSession, root: str, days: Days | None = None) -> DataFrame:
    """Committed accepted events, pruned by ``received_date`` and ``epoch`` folders."""
    return ledgers_at(spark, root, days=days).accepted


def rejected_table(spark: SparkSession, root: str, days: Days | None = None) -> DataFrame:
    return ledgers_at(spark, root, days=days).rejected


def refused_table(spark: SparkSession, root: str, days: Days | None = None) -> DataFrame:
    return ledgers_at(spark, root, days=days).refused


def epoch_counts(spark: SparkSession, root: str) -> DataFrame:
    """What every committed epoch took in and where it went; one row per epoch, from the commit markers."""
    schema = "epoch bigint, events bigint, accepted bigint, rejected bigint, repeated bigint, refused_batches bigint"
    if not exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root}/commits")


def key_bucket() -> Column:
    return F.pmod(F.xxhash64(*LEDGER_KEY), F.lit(KEY_BUCKETS)).cast("int")


def known_keys(spark: SparkSession, root: str, brought: DataFrame, epoch: int) -> DataFrame:
    """Those of the ``brought`` keys that epochs before ``epoch`` have stored.

    The driver learns which buckets the keys fall into, KEY_BUCKETS numbers at most; the scan opens these alone. A
    small set of keys is broadcast by Spark's size check and the stored ones aren't moved; for a large one Spark
    may filter the stored keys by a bloom filter of the brought ones before they are.
    """
    keyed = brought.withColumn("bucket", key_bucket())
    taken = {f"bucket={row['bucket']}" for row in keyed.select("bucket").distinct().collect()}
    folders = [f"{root}/keys/{name}" for name in listed(spark, f"{root}/keys") if name in taken]
    if not folders:
        return brought.limit(0)
    stored = spark.read.schema(KEYS).option("basePath", f"{root}/keys").parquet(*folders).filter(F.col("epoch") < epoch)
    on = ["bucket", *LEDGER_KEY]
    return stored.select(*on).join(keyed, on, "left_semi").select(*LEDGER_KEY)


def collect_epoch(batches: DataFrame, epoch: int, root: str, registry: Registry) -> None:
    """Store one micro-batch as ``epoch``; running it again leaves the same tables.

    The batches are judged in the tasks in which they arrive: a caller whose source has few splits deals them out.
    """
    spark = batches.sparkSession
    staged = new_run_dir(spark, f"epoch-{epoch}")
    # One pass over the batches for all three ledgers: a body is parsed once, whatever becomes of it.
    outcome = F.when(F.col("error").isNotNull(), "refused").when(F.col("accepted"), "accepted").otherwise("rejected")
    stored = F.when(F.col("pii_rejected"), redacted(F.col("raw"))).otherwise(F.col("raw"))
    judged = validate_events(split_batches(admit(batches)), registry).withColumns({"raw": stored, "outcome": outcome})
    judged.write.partitionBy("outcome").parquet(f"{staged}/judged")
    taken = spark.read.schema(judged.schema).parquet(f"{staged}/judged")
    judged, batches_refused = taken.filter("outcome <> 'refused'"), taken.filter("outcome = 'refused'")
    passed, failed = taken.filter("outcome = 'accepted'"), taken.filter("outcome = 'rejected'")

    fresh = first_writer_wins(
        accepted_rows(passed.withColumn("event_id", F.lit(None).cast("bigint")), registry),
        LEDGER_KEY, ARRIVAL,
    )
    keys = list(LEDGER_KEY)
    brought = passed.filter("client_event_id is not null").select(*keys).distinct()
    known = known_keys(spark, root, brought, epoch)
    appended = with_ordinal(fresh.join(known, keys, "left_anti"), ARRIVAL, "_n")
    # Ids rise with the epoch and with arrival inside it.
    numbered = appended.withColumn(
        "event_id", F.lit(epoch).cast("bigint") * 2**ID_BITS + F.col("_n")
    ).drop("_n")
    append_epoch(numbered, f"{root}/accepted", epoch, DAY)
    own_keys = numbered.dropna(subset=keys).select(*keys).withColumn("bucket", key_bucket())
    append_epoch(own_keys.repartition("bucket"), f"{root}/keys", epoch, "bucket")
    # Ranges of arrival time, so that a task writes few dates, as the numbered rows already do.
    rejected = rejected_rows(failed, registry).repartitionByRange(*ARRIVAL)
    append_epoch(rejected, f"{root}/rejected", epoch, DAY)
    refused = batches_refused.select(
        "batch_id", "error", "n_events", "received_at", F.to_date("received_at").alias("received_date")
    )
    append_epoch(refused, f"{root}/refused", epoch, DAY)
    _commit(spark, root, epoch, judged)
    remove(spark, staged)


def _commit(spark: SparkSession, root: str, epoch: int, judged: DataFrame) -> None:
    """Make the epoch visible, with the counts by which a reader can check that nothing was lost."""
    taken = judged.agg(F.count("*").alias("events"), F.count_if(~F.col("accepted")).alias("judged_out")).first()
    counts = {name: _written(spark, f"{root}/{name}", epoch) for name in ("accepted", "rejected", "refused")}
    if counts["rejected"] != taken["judged_out"] or counts["accepted"] + counts["rejected"] > taken["events"]:
        raise RuntimeError(f"epoch {epoch} is not whole: {taken['events']} events, {counts}")
    write_small(spark, f"{root}/commits/{epoch}", json.dumps({
        "epoch": epoch, "events": taken["events"], "accepted": counts["accepted"], "rejected": counts["rejected"],
        "repeated": taken["events"] - counts["accepted"] - counts["rejected"], "refused_batches": counts["refused"],
    }))


def _written(spark: SparkSession, path: str, epoch: int) -> int:
    folders = [f"{path}/{day}/epoch={epoch}" for day in listed(spark, path)]
    folders = [folder for folder in folders if exists(spark, folder)]
    return spark.read.parquet(*folders).count() if folders else 0


def start_collect(
    batches: DataFrame, root: str, registry: Registry, *, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Run the collector over a stream of batches.

    Late and early events are judged by the age rules against the receipt time and recorded. A
    watermark would drop them silently, so none is set.
    """
    def collect(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        collect_epoch(df, joined_at(spark, root, query) + number, root, registry)

    writer = batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(collect)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recent_duplicates_dropped(events: DataFrame, horizon: str) -> DataFrame:
    """Bounded-state alternative for the key conflict: forgets keys older than ``horizon``.

    Weaker than the exact check against the ledger: a repeat after the horizon is stored again.
    Only rows with a client event id may be passed, since NULL ids never collide.
    """
    return events.withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(list(LEDGER_KEY))
