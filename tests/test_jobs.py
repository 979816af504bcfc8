"""Replay export, configuration, captures, decisions and chains."""

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from provenant import contract
from provenant.operators import capture, decisions, monitors, replay, sinks, siteconfig
from provenant.session import new_run_dir
from provenant.streaming import collect

KEY = "a" * 64


def _at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def _ledger(spark, rows):
    return spark.createDataFrame(
        rows, "event_id bigint, site_id string, client_timestamp_ms bigint, received_at timestamp, "
              "collector_version string, raw string")


def test_replay_export(spark):
    rows = [
        (i, "site_0", 1000 - i // 2, _at("2024-01-02T10:00:00"), f"1.0.{i % 2}",
         json.dumps({"z": i, "anon_session_id": f"s{i % 7}", "anon_browser_id": f"b{i % 3}"}))
        for i in range(500)
    ]
    rows += [
        (900, "site_1", 1, _at("2024-01-02T10:00:00"), "1.0.0", "{}"),
        (901, "site_0", 1, _at("2024-01-03T23:59:59.500000"), "1.0.0", "{}"),
    ]
    ledger = _ledger(spark, rows)
    for parts in (1, None):
        target = new_run_dir(spark, "export-test")
        at = replay.export_replay(ledger, "site_0", "2024-01-02", "2024-01-03", target, parts=parts)
        lines = [r.value for r in spark.read.text(at["events"]).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
        expected = sorted((r for r in rows if r[0] < 900), key=lambda r: (r[2], r[0]))
        assert [json.loads(line)["_replay"]["event_id"] for line in lines] == [r[0] for r in expected]
        meta = spark.read.json(at["meta"]).first()
        assert (meta.event_count, meta.session_count, meta.subject_count) == (500, 7, 3)
        assert meta.collector_versions == ["1.0.0", "1.0.1"]
        digests = spark.read.json(at["digests"]).orderBy("part").collect()
        assert sum(d.lines for d in digests) == 500
        start = 0
        for d in digests:
            text = "".join(f"{line}\n" for line in lines[start:start + d.lines])
            assert d.sha256 == hashlib.sha256(text.encode()).hexdigest()
            start += d.lines
        whole = "".join(d.sha256 for d in digests)
        assert meta.sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert lines[0].startswith('{"_replay":{"event_id":498,"received_at":"2024-01-02T10:00:00.000Z","collector_version":"1.0.0"},')


def test_replay_line_keeps_an_own_header(spark):
    rows = [(1, "s", 1, _at("2024-01-02T10:00:00"), "1", raw) for raw in ('{"_replay":7,"a":1.0}', "{}", '{"a":"\\"_replay\\""}')]
    lines = [r[0] for r in _ledger(spark, rows).select(replay.replay_line(F.col("raw"))).collect()]
    header = '{"_replay":{"event_id":1,"received_at":"2024-01-02T10:00:00.000Z","collector_version":"1"}'
    assert lines == ['{"_replay":7,"a":1}', header + "}", header + ',"a":"\\"_replay\\""}']


def test_effective_config(spark):
    stored = spark.createDataFrame(
        [("s1", "{}", '{"bootstrap":{"min_runtime_days":3},"asset_url":null,"extra":[1]}', None),
         ("s2", "{}", '{"bootstrap":null}', datetime(2024, 1, 1).date())],
        "site_id string, config_272 string, config_750 string, deploy_start_date date")
    sites = spark.createDataFrame([("s1",), ("s2",), ("none",)], "site_id string")
    config = siteconfig.effective_config(sites, stored)
    found = {r.site_id: r.config_750 for r in config.collect()}
    assert found["none"] == contract.PROBE_DEFAULTS
    assert found["s1"]["bootstrap"] == '{"min_runtime_days":3}'
    assert found["s1"]["asset_url"] == "null" and found["s1"]["extra"] == "[1]"
    accepted = spark.createDataFrame([("s1", "session_start", "a")], "site_id string, event_type string, session_id string")
    for now, days in (("2024-01-15T00:00:00Z", 14), ("2023-12-31T12:00:00Z", -1)):
        gate = siteconfig.bootstrap_status(config, accepted, F.lit(now).cast("timestamp"))
        rows = {r.site_id: r for r in gate.collect()}
        assert (rows["s1"].required_runtime_days, rows["s1"].required_eligible_sessions) == (3, 500)
        assert (rows["s2"].required_runtime_days, rows["s2"].runtime_days) == (14, days)
        assert rows["none"].runtime_days == 0 and rows["s1"].eligible_sessions == 1


_CAPTURE = {
    "email": " Test@Example.com﻿", "site_id": "s1", "session_id": "x", "asset_key": "guide",
    "trigger_score": 0, "config_version": "1", "probe_version": "1",
}


def _captures(spark, bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b), _at("2024-01-01T00:00:00")) for i, b in enumerate(bodies)]
    return capture.read_captures(spark.createDataFrame(rows, "capture_id bigint, body string, captured_at timestamp"))


def test_captures(spark):
    order = ("email", "site_id", "session_id", "asset_key", "trigger_score", "config_version", "probe_version")
    bodies = ["7", "[]", *[{k: v for k, v in _CAPTURE.items() if k not in order[i:]} for i in range(7)]]
    errors = [r.error for r in _captures(spark, bodies).orderBy("capture_id").collect()]
    assert errors == ["invalid body", "invalid email", "invalid email", *[f"missing {n}" for n in order[1:]]]
    good = [_CAPTURE, _CAPTURE | {"email": "a@b@gmail.com"}, _CAPTURE | {"email": "a@mailinator.com", "site_id": "s2"},
            _CAPTURE | {"email": "a@GMAIL.com "}]
    rows = capture.enrich_captures(_captures(spark, good), KEY)
    opened = rows.withColumn("opened", capture.decrypted(F.col("email_encrypted"), KEY)).orderBy("capture_id").collect()
    assert [r.email_class for r in opened] == ["business", "business", "disposable", "freemail"]
    assert [r.email_domain for r in opened][:2] == ["example.com", "b"]
    assert opened[0].opened == "test@example.com"
    assert opened[0].email_hash == hashlib.sha256(b"test@example.com").hexdigest()
    assert [len(part) for part in opened[0].email_encrypted.split(":")] == [24, 32, 32]
    assert "email" not in rows.columns
    due = rows.first().purge_after
    assert capture.retained(rows, F.lit(due)).count() == 4
    assert capture.purge_count(rows, F.lit(due) + F.expr("interval 1 second")).first().purged == 4
    config = spark.createDataFrame([("s1", '{"asset_url":"/own"}')], "site_id string, config_750 string")
    urls = {r.capture_id: r.download_url for r in capture.download_urls(rows, config).collect()}
    assert (urls[0], urls[2]) == ("/own", "/assets/downloads/guide.pdf")


def test_decisions(spark):
    base = {"site_id": "s", "session_id": "x", "decision": "fire", "config_version": "1", "probe_version": "1"}
    bodies = [base, base | {"session_id": ""}, base | {"decision": "maybe"}, base | {"config_version": 2, "trigger_score": 0.5}]
    rows = [(i, json.dumps(b), _at("2024-01-01T00:00:00")) for i, b in enumerate(bodies)]
    read = decisions.read_decisions(spark.createDataFrame(rows, "decision_id bigint, body string, decided_at timestamp"))
    found = {r.decision_id: r for r in read.collect()}
    assert [found[i].error for i in range(4)] == [None, "missing required fields", "unknown decision", None]
    assert found[0].browser_id == "" and found[0].trigger_score == 0 and found[0].trigger_reasons == []
    assert found[3].config_version == "2" and found[3].trigger_score == 0.5


def test_reconcile(spark):
    runs = spark.createDataFrame(
        [("r1", "s", 1, "d1", 3, 2, 1, 0), ("r2", "s", 2, "zz", 1, 1, 0, 0), ("r3", "s", 3, "d3", 5, 1, 1, 1), ("r4", "s", 9, "d", 0, 0, 0, 0)],
        "run_id string, site_id string, window_start int, source_sha256 string, subjects_total int, "
        "subjects_scoreable int, subjects_degraded int, subjects_unscorable int")
    exports = spark.createDataFrame(
        [("s", 1, 3, "d1"), ("s", 2, 1, "d2"), ("s", 3, 5, "d3"), ("s", 4, 1, "d4")],
        "site_id string, window_start int, subject_count int, sha256 string")
    found = {r.window_start: r.status for r in monitors.reconcile_runs(runs, exports).collect()}
    assert found == {1: "ok", 2: "digest_differs", 3: "totals_differ", 4: "no_run", 9: "no_export"}


def test_sinks_replace_days_and_keep_versions(spark):
    path = new_run_dir(spark, "sink-test")
    schema = "site string, n int, metric_date date"

    def rows(*days):
        return spark.createDataFrame([("s", n, datetime(2024, 1, d).date()) for d, n in days], schema)

    sinks.replace_days(rows((1, 1), (2, 2)), f"{path}/metrics")
    for _ in range(2):
        sinks.replace_days(rows((2, 20)), f"{path}/metrics")
    stored = spark.read.schema(schema).parquet(f"{path}/metrics")
    assert {(r.metric_date.day, r.n) for r in stored.collect()} == {(1, 1), (2, 20)} and stored.count() == 2
    sinks.write_snapshot(rows((1, 1), (2, 2)), f"{path}/state", 1)
    first = sinks.read_snapshot(spark, f"{path}/state", schema, 1)
    sinks.write_snapshot(first.filter("n > 1"), f"{path}/state", 2)
    assert sinks.read_snapshot(spark, f"{path}/state", schema, 2).count() == 1 and first.count() == 2


def test_bounded_stream_dedup(spark):
    source = new_run_dir(spark, "bounded-source")
    schema = "site_id string, session_id string, client_event_id string, received_at timestamp"
    at = _at("2024-01-01T00:00:00")
    spark.createDataFrame([("s", "x", "c1", at), ("s", "x", "c1", at), ("s", "x", "c2", at)], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    target = new_run_dir(spark, "bounded-target")
    query = collect.recent_duplicates_dropped(stream, "1 hour").writeStream.option(
        "checkpointLocation", f"{target}/progress").trigger(availableNow=True).start(f"{target}/rows")
    query.awaitTermination()
    assert spark.read.parquet(f"{target}/rows").count() == 2
