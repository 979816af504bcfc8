"""Stored ledgers, metrics, captures and exports: what a second run, a kill or a purge leaves behind."""

import hashlib
import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from events import NOW, NOW_MS, REGISTRY, event
from provenant.operators import metrics, monitors, replay, sketches, stores
from provenant.session import new_run_dir
from provenant.sources import derived, scan
from provenant.sources.batches import BATCH_SCHEMA
from provenant.sources.files import listed, remove
from provenant.streaming import collect, daily


def _computed():
    return F.lit("2024-01-01T00:00:00Z").cast("timestamp")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _event(n, day=0, **changed):
    return event("page_view", client_event_id=f"c{n}", client_timestamp_ms=NOW_MS + day * 86_400_000, **changed)


def _posts(spark, posts):
    rows = [(n, json.dumps(events), NOW + timedelta(days=day)) for n, day, events in posts]
    return spark.createDataFrame(rows, BATCH_SCHEMA)


@pytest.fixture(scope="module")
def root(spark):
    """Three epochs over three days; the last one adds to the second day only, and repeats a key."""
    folder = new_run_dir(spark, "stores")
    epochs = [
        [(1, 0, [_event(1), _event(2, anon_session_id="s2"), _event(1)]), (2, 1, [_event(3, 1), _event(4, 1, site_id="site_x")])],
        [(3, 1, [_event(5, 1, note="mail a.b@c.test")]), (4, 2, [_event(6, 2, site_id="site_1")]), (5, 2, [_event(n, 2) for n in range(51)])],
        [(6, 1, [_event(2, 1, anon_session_id="s2"), _event(7, 1), _event(8, 1, consent_signal="no")])],
    ]
    for number, posts in enumerate(epochs):
        collect.collect_epoch(_posts(spark, posts), number, folder, REGISTRY)
    return folder


def _day(n):
    return (NOW + timedelta(days=n)).date().isoformat()


def test_a_reader_of_days_opens_only_their_folders_and_parses_nothing(spark, root):
    one = daily.day_from_ledgers(spark, root, REGISTRY.sites, (_day(1), _day(1)))
    plan = _plan(one)
    assert re.search(r"PartitionFilters: \[[^\]]*received_date", plan)
    assert "json" not in plan.lower().replace("provenant", "") and "raw" not in re.findall(r"ReadSchema: (.*)", plan)[0]
    files = collect.accepted_table(spark, root, (_day(1), _day(1))).select(F.input_file_name()).distinct().collect()
    assert files and all(f"received_date={_day(1)}" in f[0] for f in files)
    rows = {r.site_id: r for r in one.collect()}
    assert (rows["site_0"].events_accepted, rows["site_0"].events_rejected) == (2, 2)
    assert rows["site_1"].events_received == 0 and len(rows) == 2


def test_ledgers_are_read_at_one_epoch_and_balance(spark, root):
    for epoch, (accepted, rejected, refused) in enumerate([(3, 1, 0), (4, 2, 1), (5, 3, 1)]):
        at = collect.ledgers_at(spark, root, epoch)
        assert (at.accepted.count(), at.rejected.count(), at.refused.count()) == (accepted, rejected, refused)
    counts = {r.epoch: r for r in collect.epoch_counts(spark, root).collect()}
    assert [counts[n].repeated for n in range(3)] == [1, 0, 1]
    assert all(r.events == r.accepted + r.rejected + r.repeated for r in counts.values())
    assert counts[1].refused_batches == 1


def test_a_kill_between_two_tables_shows_nothing_and_a_rerun_is_whole(spark, monkeypatch):
    folder = new_run_dir(spark, "killed")
    posts = _posts(spark, [(1, 0, [_event(1), _event(2), _event(3, site_id="site_x")]), (2, 1, [_event(4, 1)])])
    write = collect.append_epoch

    def die_at(table):
        def step(rows, path, epoch, by):
            if path.endswith(table):
                raise ConnectionError("killed")
            write(rows, path, epoch, by)
        return step

    for table in ("keys", "rejected", "refused"):
        monkeypatch.setattr(collect, "append_epoch", die_at(table))
        with pytest.raises(ConnectionError):
            collect.collect_epoch(posts, 0, folder, REGISTRY)
        at = collect.ledgers_at(spark, folder)
        assert at.epoch == -1 and at.accepted.count() == at.rejected.count() == at.refused.count() == 0
    monkeypatch.setattr(collect, "append_epoch", write)
    # Another query takes the epoch up with other events: nothing of the dead attempts may stay.
    collect.collect_epoch(_posts(spark, [(9, 0, [_event(1), _event(9, site_id="site_x")])]), 0, folder, REGISTRY)
    collect.collect_epoch(posts, 1, folder, REGISTRY)
    at = collect.ledgers_at(spark, folder)
    assert sorted((r.epoch, r.client_event_id) for r in at.accepted.collect()) == [(0, "c1"), (1, "c2"), (1, "c4")]
    assert sorted(r.epoch for r in at.rejected.collect()) == [0, 1]


def test_history_is_searched_in_the_buckets_of_the_brought_keys(spark):
    folder = new_run_dir(spark, "keys")
    collect.collect_epoch(_posts(spark, [(n, 0, [_event(40 * n + k) for k in range(40)]) for n in range(5)]), 0, folder, REGISTRY)
    assert len(listed(spark, f"{folder}/keys")) > 30
    session = event("page_view")["anon_session_id"]
    at = new_run_dir(spark, "brought")
    spark.createDataFrame([("site_0", session, "c7"), ("site_0", session, "new")], "site_id string, session_id string, client_event_id string").write.parquet(at)
    brought = spark.read.parquet(at)
    known = collect.known_keys(spark, folder, brought, 1)
    buckets = {re.search(r"bucket=\d+", f).group() for f in known.inputFiles() if "bucket=" in f}
    assert len(buckets) <= 2
    plan = _plan(known)
    # The brought keys are broadcast: the stored ones do not move.
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert [tuple(r) for r in known.collect()] == [("site_0", session, "c7")]
    # A set too large to broadcast: the stored keys pass a bloom filter of the brought ones before they move.
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {name: spark.conf.get(name) for name in set_to}
    try:
        for name, value in set_to.items():
            spark.conf.set(name, value)
        large = collect.known_keys(spark, folder, brought, 1)
        assert "might_contain" in _plan(large)
        assert [tuple(r) for r in large.collect()] == [("site_0", session, "c7")]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert collect.known_keys(spark, folder, brought, 0).count() == 0
    assert collect.known_keys(spark, new_run_dir(spark, "none"), brought, 3).count() == 0


def _metrics(spark, target):
    rows = daily.stored_metrics(spark, target).drop("computed_at").collect()
    reasons = daily.stored_reasons(spark, target).collect()
    return sorted(map(str, rows)), sorted(map(str, reasons))


def test_daily_job_touches_only_days_of_new_epochs_and_any_number_of_runs_agree(spark, root):
    at_once, stepwise = new_run_dir(spark, "metrics"), new_run_dir(spark, "metrics")
    assert daily.run_daily(spark, root, at_once, REGISTRY.sites, _computed()) == [_day(0), _day(1), _day(2)]
    touched = [daily.run_daily(spark, root, stepwise, REGISTRY.sites, _computed(), through=n) for n in (0, 1)]
    assert touched == [[_day(0), _day(1)], [_day(1), _day(2)]]
    untouched = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        f"{stepwise}/daily/metric_date={_day(2)}").select("path").collect()}
    assert daily.run_daily(spark, root, stepwise, REGISTRY.sites, _computed()) == [_day(1)]
    assert daily.run_daily(spark, root, stepwise, REGISTRY.sites, _computed()) == []
    again = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        f"{stepwise}/daily/metric_date={_day(2)}").select("path").collect()}
    assert untouched == again
    assert _metrics(spark, at_once) == _metrics(spark, stepwise)
    row = daily.stored_metrics(spark, at_once, (_day(1), _day(1))).filter("site_id = 'site_0'").first()
    assert (row.events_received, row.events_accepted, row.events_rejected) == (4, 2, 2)
    assert row.event_type_counts == {"page_view": 2} and row.reject_rate == 0.5
    # Full codes, payload paths included.
    assert row.reject_reason_counts == {"PII_IN_VALUE:.note": 1, "CONSENT_NOT_GRANTED": 1}
    assert daily.stored_metrics(spark, at_once).count() == 6


def test_top_reasons_rank_before_the_shuffle(spark):
    rows = [("s", "d", f"r{n}", n % 7) for n in range(50)]
    counts = spark.createDataFrame(rows, "site_id string, metric_date string, reason string, n bigint")
    top = metrics.top_reasons(counts, 3)
    assert _plan(top).count("WindowGroupLimit") == 2
    assert [(r.place, r.reason) for r in top.orderBy("place").collect()] == [(1, "r13"), (2, "r20"), (3, "r27")]


def test_sketches_of_days_merge_within_their_bound(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int"))
    rows = spark.range(60_000).select(
        F.concat(F.lit("site_"), (F.col("id") % 2).cast("string")).alias("site_id"), day.alias("received_date"),
        (F.col("id") % 25_001).cast("string").alias("session_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 40).cast("string")).alias("browser_id"))
    merged = sketches.estimated_distinct(sketches.daily_sketches(rows))
    found = sketches.exact_distinct(rows).join(merged, "site_id").select(
        "*", *[sketches.agrees(n).alias(f"{n}_ok") for n in sketches.COUNTED.values()]).collect()
    assert len(found) == 2 and all(r.sessions_ok and r.subjects_ok for r in found)


def _captures(spark, rows):
    due = [(n, "s", None, "b", f"h{n}", "d", "business", None, "a", 0.5, 0.0, [], False, "1", "1", at - timedelta(days=90), at) for n, at in rows]
    schema = stores.CAPTURES
    return spark.createDataFrame(due, schema)


def _at(day, hour):
    return datetime(2024, 4, day, hour, tzinfo=timezone.utc)


def test_a_purge_deletes_expired_rows_from_every_file(spark, monkeypatch):
    path = new_run_dir(spark, "captures")
    stores.append_captures(_captures(spark, [(1, _at(1, 0)), (2, _at(5, 9)), (3, _at(5, 12)), (4, _at(6, 0))]), path, 0)
    for _ in range(2):
        stores.append_captures(_captures(spark, [(3, _at(5, 13)), (5, _at(5, 12)), (6, _at(5, 3)), (7, _at(9, 0))]), path, 1)
    assert stores.stored_captures(spark, path).count() == 7
    # A purge that dies after writing the survivors aside is completed by the next one.
    with monkeypatch.context() as patch:
        calls = []
        patch.setattr(stores, "finish_purge", lambda *a: calls.append(a) if not calls else (_ for _ in ()).throw(ConnectionError()))
        with pytest.raises(ConnectionError):
            stores.purge_captures(spark, path, "2024-04-05T12:00:00Z")
    assert stores.purge_captures(spark, path, "2024-04-05T12:00:00Z") == 0
    left = {(r.capture_id, r.epoch) for r in stores.stored_captures(spark, path).collect()}
    assert left == {(3, 0), (4, 0), (5, 1), (7, 1)}
    raw = spark.read.option("recursiveFileLookup", True).parquet(path).select("capture_id").collect()
    assert sorted(r[0] for r in raw) == [3, 4, 5, 7]
    assert listed(spark, f"{path}.border") == []
    assert stores.purge_captures(spark, path, "2024-04-06T00:00:00Z") == 2
    assert stores.purge_captures(spark, path, "2024-05-01T00:00:00Z") == 2
    assert stores.stored_captures(spark, path).count() == 0 and listed(spark, path) == []


def _ledger(spark, n):
    rows = [(i, "site_0" if i % 3 else "site_1", 1000 - i // 2, datetime(2024, 1, 2, 10, tzinfo=timezone.utc), "1.0",
             json.dumps({"n": i, "anon_session_id": f"s{i % 7}", "anon_browser_id": "b"})) for i in range(n)]
    return spark.createDataFrame(rows, "event_id bigint, site_id string, client_timestamp_ms bigint, received_at timestamp, collector_version string, raw string")


def _tamper(path, change):
    with open(path) as f:
        lines = f.read().splitlines()
    with open(path, "w") as f:
        f.write("".join(f"{line}\n" for line in change(lines)))
    remove_crc = path.rsplit("/", 1)
    import os
    crc = f"{remove_crc[0]}/.{remove_crc[1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_an_export_of_many_sites_is_ordered_and_a_reader_finds_every_damage(spark):
    target = new_run_dir(spark, "exports")
    at = replay.export_replays(_ledger(spark, 600), ["site_0", "site_1", "site_2"], "2024-01-02", "2024-01-02", target, parts=5)
    meta = {r.site_id: r for r in replay.verified_exports(spark, target).collect()}
    assert [meta[s].event_count for s in ("site_0", "site_1", "site_2")] == [400, 200, 0]
    assert all(r.damaged_parts == 0 and r.digest_holds for r in meta.values())
    assert meta["site_2"].collector_versions == [] and meta["site_2"].sha256 == hashlib.sha256(b"").hexdigest()
    lines = replay.export_lines(spark, target).orderBy("site_id", "part", "block", "at").collect()
    for site in ("site_0", "site_1"):
        order = [json.loads(r.line)["_replay"]["event_id"] for r in lines if r.site_id == site]
        assert order == sorted(order, key=lambda i: (1000 - i // 2, i))
    files = sorted({r[0].removeprefix("file:") for r in spark.read.text(at["events"]).select("_metadata.file_path").distinct().collect()})
    files = [re.sub(r"^/+", "/", f) for f in files if "site_id=site_0" in f]
    assert len(files) >= 3
    _tamper(files[0], lambda x: [x[1], x[0], *x[2:]])
    _tamper(files[1], lambda x: x[:-1])
    remove(spark, files[2])
    found = {r.part: r.status for r in replay.verify_export(spark, target).filter("status <> 'ok'").collect()}
    assert sorted(found.values()) == ["altered", "altered", "missing"]
    checked = {r.site_id: r for r in replay.verified_exports(spark, target).collect()}
    assert checked["site_0"].damaged_parts == 3 and not checked["site_0"].digest_holds
    assert checked["site_1"].damaged_parts == 0 and checked["site_1"].digest_holds


def test_a_part_read_in_many_splits_keeps_its_digest(spark):
    target = new_run_dir(spark, "exports")
    replay.export_replays(_ledger(spark, 3000), ["site_0"], "2024-01-02", "2024-01-02", target, parts=1)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert replay.export_lines(spark, target).select("block").distinct().count() > 3
        assert [r.status for r in replay.verify_export(spark, target).collect()] == ["ok"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_sums_over_windows_as_long_as_each_row_says(spark):
    rows = [(s, d, (7 * d + len(s)) % 5, float(1 + (d + len(s)) % 6)) for s in ("a", "bb") for d in range(40) if (d * 3 + len(s)) % 4]
    frame = spark.createDataFrame(rows, "site_id string, d int, n int, days double").withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    got = {(r.site_id, r.d): r.total for r in monitors.past_sums(frame, "day", {"total": ("n", "days")}).collect()}
    assert got == {(s, d): sum(n for t, e, n, _ in rows if t == s and d - days < e <= d) for s, d, _, days in rows}


def test_trust_rows_have_every_default(spark):
    row = monitors.trust_rows(spark.createDataFrame([("x", None)], "subject_id string, trust_score int"), _computed()).first()
    assert (row.domain, row.trust_score, row.trust_band, row.probation_state, row.recovery_state) == ("", 50, "standard", "none", "none")
    assert row.reason_codes == [] and row.last_decision_at is None and row.updated_at is not None


def test_a_day_of_captures_is_written_by_few_tasks(spark):
    path, days = new_run_dir(spark, "captures"), range(1, 31)
    rows = _captures(spark, [(100 * day + n, _at(day, n)) for day in days for n in range(8)]).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stores.append_captures(rows, path, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = stores.stored_captures(spark, path)
    assert stored.count() == 240
    assert len(stored.inputFiles()) == len(days)


def test_sites_and_captures_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 10)
    for made in (derived.asked_sites, derived.capture_bodies):
        rows = made(spark, "/root/testdata/sf0.001")
        assert rows.rdd.getNumPartitions() == -(-rows.count() // 10) > 8


def test_a_task_judges_few_rows_of_a_large_table(spark):
    rows = scan.dealt(spark.range(400_000).withColumnRenamed("id", "event_id"), "event_id")
    sizes = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 12_000 and sizes[1] == 400_000
