"""Batches, conflict rules, upserts, metrics and the streaming collector."""

import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from events import NOW, NOW_MS, REGISTRY, TYPES, event
from provenant import schemas
from provenant.operators import metrics
from provenant.operators.dedup import evolve, first_writer_wins, insert_if_absent, upsert_latest
from provenant.operators.ordering import with_ordinal
from provenant.session import new_run_dir
from provenant.sources import scan
from provenant.sources.batches import BATCH_SCHEMA, admit, split_events, stream_batches
from provenant.streaming import collect


def _batches(spark, bodies):
    return spark.createDataFrame([(i, b, NOW) for i, b in enumerate(bodies)], BATCH_SCHEMA)


def test_admission_and_split(spark):
    bodies = ["[]", json.dumps([1] * 50), json.dumps([1] * 51), "{}", "[1,", "7",
              '[{"b":1,"a":"x"}, "{\\"a\\":1}", null, [2], true]']
    rows = {r.batch_id: r for r in admit(_batches(spark, bodies)).collect()}
    assert [rows[i].error is None for i in range(7)] == [True, True, False, False, False, False, True]
    events = split_events(admit(_batches(spark, bodies))).filter("batch_id = 6").orderBy("pos").collect()
    assert [e.raw for e in events] == ['{"b":1,"a":"x"}', '"{\\"a\\":1}"', "null", "[2]", "true"]
    assert {e.received_at for e in events} == {NOW.replace(tzinfo=None)}


def _extreme():
    clean = json.dumps(event("page_view"))
    deep = clean[:-1] + ', "x": ' + "[" * 5000 + '"q@r.st"' + "]" * 5000 + "}"
    digits = clean[:-1] + ', "note": "q@r.st", "x": ' + "7" * 6000 + "}"
    return clean, deep, digits


def test_an_extreme_element_does_not_refuse_its_batch(spark):
    clean, deep, digits = _extreme()
    bodies = [f" [{clean}, {deep} ,{clean}]", f'[{digits},"a\\"]",null,-1.5e3,[{{}}]]', f"[{deep},{clean}", f"[{deep},{{a:1}}]",
              f"[{deep},]", f"[{','.join([digits] * 51)}]", f'{{"x":{deep}}}', f"[{deep},01]"]
    admitted = admit(_batches(spark, bodies))
    rows = {r.batch_id: (r.n_events, r.error is None) for r in admitted.collect()}
    assert rows == {0: (3, True), 1: (5, True), 5: (51, False), **{k: (None, False) for k in (2, 3, 4, 6, 7)}}
    raws = [r.raw for r in split_events(admitted).orderBy("batch_id", "pos").collect()]
    assert raws == [clean, deep, clean, digits, '"a\\"]"', "null", "-1.5e3", "[{}]"]


def test_the_collector_rejects_an_extreme_element_alone(spark):
    clean, deep, digits = _extreme()
    other = json.dumps(event("page_view", client_event_id="other"))
    root = _run(spark, [(1, f"[{clean},{deep},{other}]", NOW), (2, f"[{digits}]", NOW)], 1)
    accepted, rejected, refused = _ledgers(spark, root)
    assert {(b, p) for b, p, _ in accepted} == {(1, 0), (1, 2)} and refused == []
    assert [(b, p, c[-1]) for b, p, c in rejected] == [(1, 1, "PII_SCREEN_IMPOSSIBLE"), (2, 0, "PII_SCREEN_IMPOSSIBLE")]
    assert not any("q@r.st" in str(r) for r in collect.rejected_table(spark, root).collect())


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k string, at int")


def test_first_writer_wins_and_is_idempotent(spark):
    frame = _rows(spark, [("a", 2), ("a", 1), (None, 3), (None, 4), ("b", 5)])
    once = first_writer_wins(frame, ["k"], ["at"])
    expected = {("a", 1), (None, 3), (None, 4), ("b", 5)}
    assert {tuple(r) for r in once.collect()} == expected
    assert {tuple(r) for r in first_writer_wins(once, ["k"], ["at"]).collect()} == expected
    added = insert_if_absent(_rows(spark, [("a", 0), (None, 0)]), frame, ["k"], ["at"])
    assert {tuple(r) for r in added.collect()} == {(None, 3), (None, 4), ("b", 5)}


def test_busy_key_is_limited_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"))
    plan = first_writer_wins(frame, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_upsert_and_evolution(spark):
    merged = upsert_latest(_rows(spark, [("a", 9), ("c", 1)]), _rows(spark, [("a", 1), ("a", 2)]), ["k"], ["at"])
    assert {tuple(r) for r in merged.collect()} == {("a", 2), ("c", 1)}
    old = spark.createDataFrame([("site_0",)], "site_id string")
    row = evolve(old, schemas.ACCEPTED, {"event_contract_version": F.lit("legacy-thin-v2.0")}).first()
    assert row.site_id == "site_0" and row.client_event_id is None
    assert row.event_contract_version == "legacy-thin-v2.0"


def test_ordinal_is_dense_in_every_group(spark):
    frame = spark.range(5000).select(F.expr("nullif(id % 3, 2)").alias("g"), F.hash("id").alias("h"), "id").repartition(7)
    rows = with_ordinal(frame, ["h", "id"], "n", within=["g"]).collect()
    for group in (0, 1, None):
        members = sorted((r for r in rows if r.g == group), key=lambda r: (r.h, r.id))
        assert [r.n for r in members] == list(range(1, len(members) + 1))
    assert len(rows) == 5000


def _outcome(site, at, session, browser, kind, codes=None):
    return (site, at, session, browser, kind, not codes, codes or [])


def test_daily_metrics_semantics(spark):
    noon = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
    night = datetime(2024, 3, 2, 1, tzinfo=timezone.utc)
    rows = [
        _outcome("site_0", noon, "s1", "b1", "session_start"),
        _outcome("site_0", night, "s1", "b1", "session_summary"),
        _outcome("site_0", noon, "s2", "b1", "session_start"),
        _outcome("site_0", noon, "s2", "b1", "session_summary"),
        _outcome("site_0", noon, "", "", "page_state", ["UNKNOWN_BUCKET_VALUE", "UNKNOWN_BUCKET_VALUE"]),
        _outcome("site_x", noon, "s", "b", "page_view", ["UNKNOWN_SITE_ID"]),
        _outcome(None, noon, None, None, None, ["INVALID_EVENT_OBJECT"]),
    ]
    outcomes = spark.createDataFrame(
        rows, "site_id string, received_at timestamp, session_id string, browser_id string, "
              "event_type string, accepted boolean, reason_codes array<string>")
    measured = metrics.daily_metrics(outcomes, REGISTRY.sites)
    dense = metrics.dense_range(measured, REGISTRY.sites, "2024-02-29", "2024-03-02")
    found = {(r.site_id, str(r.metric_date)): r for r in dense.collect()}
    assert len(found) == 6
    first, second = found["site_0", "2024-03-01"], found["site_0", "2024-03-02"]
    assert (first.events_accepted, first.events_rejected, first.events_received) == (3, 1, 4)
    assert (first.distinct_sessions, first.distinct_subjects) == (2, 1)
    # A session across midnight counts on both days.
    assert (first.summary_start_mismatch, second.summary_start_mismatch) == (1, 1)
    assert first.unknown_bucket_count == 1 and first.reject_rate == 0.25
    assert found["site_1", "2024-03-01"].events_received == 0
    spanned = metrics.dense_span(measured, REGISTRY.sites).collect()
    assert len(spanned) == 4
    reasons = metrics.reason_counts(outcomes, REGISTRY.sites)
    assert {(r.reason, r.n) for r in reasons.collect()} == {("UNKNOWN_BUCKET_VALUE", 2)}
    table = metrics.metrics_table(dense, metrics.event_type_counts(outcomes, REGISTRY.sites), reasons, F.current_timestamp())
    stored = {(r.site_id, str(r.metric_date)): r for r in table.collect()}["site_0", "2024-03-01"]
    assert stored.event_type_counts == {"session_start": 2, "session_summary": 1}
    assert stored.reject_reason_counts == {"UNKNOWN_BUCKET_VALUE": 2}


def _posts():
    rng = random.Random(3)
    posts = []
    for i in range(30):
        size = rng.choice([0, 1, 5, 20, 51])
        events = [
            event(rng.choice(TYPES), client_event_id=f"c{rng.randint(0, 40)}", anon_session_id=f"s{rng.randint(0, 4)}",
                  site_id=rng.choice(["site_0", "site_1", "site_x"]), client_timestamp_ms=NOW_MS + i)
            for _ in range(size)
        ]
        posts.append((i, json.dumps(events), NOW + timedelta(seconds=i)))
    return posts


def _run(spark, posts, files):
    root, source = new_run_dir(spark, "stream-test"), new_run_dir(spark, "stream-source")
    for part in range(files):
        # Files are read in the order they were written.
        chunk = posts[part * len(posts) // files:(part + 1) * len(posts) // files]
        spark.createDataFrame(chunk, BATCH_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = stream_batches(spark, source, maxFilesPerTrigger=1)
    collect.start_collect(stream, root, REGISTRY, checkpoint=f"{root}/progress").awaitTermination()
    return root


def _ledgers(spark, root):
    accepted = {(r.batch_id, r.pos, r.client_event_id) for r in collect.accepted_table(spark, root).collect()}
    rejected = sorted((r.batch_id, r.pos, tuple(r.reason_codes)) for r in collect.rejected_table(spark, root).collect())
    refused = sorted((r.batch_id, r.n_events) for r in collect.refused_table(spark, root).collect())
    return accepted, rejected, refused


def test_stream_equals_brute_force_for_any_number_of_micro_batches(spark):
    posts = _posts()
    seen, accepted, rejected, refused = set(), set(), 0, 0
    for batch_id, body, _ in posts:
        events = json.loads(body)
        if len(events) > 50:
            refused += 1
            continue
        for pos, e in enumerate(events):
            key = (e["site_id"], e["anon_session_id"], e["client_event_id"])
            if e["site_id"] == "site_x":
                rejected += 1
            elif key not in seen:
                seen.add(key)
                accepted.add((batch_id, pos, e["client_event_id"]))
    results = {n: _run(spark, posts, n) for n in (1, 3, 10)}
    for root in results.values():
        ledgers = _ledgers(spark, root)
        assert ledgers[0] == accepted
        assert len(ledgers[1]) == rejected and len(ledgers[2]) == refused
    # Ids are unique and rise with arrival.
    ids = collect.accepted_table(spark, results[3]).orderBy("received_at", "batch_id", "pos").collect()
    assert [r.event_id for r in ids] == sorted({r.event_id for r in ids})
    # A rerun of the last epoch changes nothing.
    last = collect.committed(spark, results[3])
    before = _ledgers(spark, results[3])
    again = spark.createDataFrame(posts[20:], BATCH_SCHEMA)
    collect.collect_epoch(again, last, results[3], REGISTRY)
    assert _ledgers(spark, results[3]) == before


def test_a_new_checkpoint_goes_on_after_the_stored_epochs(spark):
    root = new_run_dir(spark, "stream-test")
    for part in ("first", "second"):
        source = new_run_dir(spark, "stream-source")
        post = json.dumps([event("page_view", client_event_id=part)])
        spark.createDataFrame([(1, post, NOW)], BATCH_SCHEMA).coalesce(1).write.parquet(source)
        collect.start_collect(stream_batches(spark, source), root, REGISTRY, checkpoint=f"{root}/{part}").awaitTermination()
    stored = {r.client_event_id: r.epoch for r in collect.accepted_table(spark, root).collect()}
    assert stored == {"first": 0, "second": 1}


def test_no_file_of_the_collector_holds_the_personal_data(spark):
    root = new_run_dir(spark, "stream-test")
    posts = [(1, json.dumps([event("page_view", note="write to someone.here@mailbox.test")]), NOW)]
    collect.collect_epoch(spark.createDataFrame(posts, BATCH_SCHEMA), 0, root, REGISTRY)
    assert collect.rejected_table(spark, root).first().reason_codes == ["PII_IN_VALUE:.note"]
    jvm = spark._jvm.org.apache.hadoop.fs.Path(root).getParent()
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).listFiles(jvm, True)
    while files.hasNext():
        path = files.next().getPath().toUri().getPath()
        with open(path, "rb") as f:
            assert b"someone.here@mailbox" not in f.read(), path


def test_an_epoch_reads_its_batches_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    one = json.dumps(event("page_view"))
    bodies = [f"[{one}]", "{}", "[]", f"[{','.join([one] * 51)}]", f'[{one}, "a", 7]']
    root = new_run_dir(spark, "once")
    collect.collect_epoch(_batches(spark, bodies).mapInArrow(counted, BATCH_SCHEMA), 0, root, REGISTRY)
    assert read.value == len(bodies)
    accepted, rejected, refused = _ledgers(spark, root)
    assert {(b, p) for b, p, _ in accepted} == {(0, 0)} and {(b, p) for b, p, _ in rejected} == {(4, 1), (4, 2)}
    assert {(r.batch_id, r.n_events) for r in collect.refused_table(spark, root).collect()} == {(1, None), (3, 51)}
    assert len(refused) == 2


def test_rows_of_one_group_are_dealt_over_tasks(spark, monkeypatch):
    path = new_run_dir(spark, "group")
    spark.range(2000).coalesce(1).write.parquet(path)
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 100)
    sizes = [r["count"] for r in scan.dealt(spark.read.parquet(path), "id").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and len(sizes) == 20 and max(sizes) < 200
