"""Live side: equal to the batch result, safe to replay, refreshed by new versions."""

import json
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from netsight.operators import registry
from netsight.operators.ids import with_ids
from netsight.operators.ingest import accepted, ingest_counters, parse_lines
from netsight.operators.match import active_indicators, match_events, prepare_snapshot
from netsight.schemas import FEEDS, IOCS, SYSLOG_LINES
from netsight.session import shuffles_removed
from netsight.sources import derived
from netsight.sources.storage import append_events, events_table
from netsight.streaming import jobs

T0 = datetime(2026, 8, 26, 6)


def _line(i):
    kind = i % 4
    return ["<134>Aug 26 06:00:00 GW kernel: [1.5] [FW-DROP] IN=a OUT=b SRC=10.0.0.%d DST=1.1.1.1 PROTO=TCP" % (i % 7),
            "<30>Aug 26 06:00:00 GW dnsmasq[7]: query[A] h%d.evil.com from 10.0.0.3" % i, "", "<13>Foo 26 06:00:00 h x"][kind]


def _lines(spark, start, stop):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=i), _line(i)) for i in range(start, stop)], SYSLOG_LINES)


def _tables(spark, *values):
    feeds = spark.createDataFrame([(1, "f", "plain", "u", None, None, True, 60, None, None, None, None, T0)], FEEDS)
    iocs = spark.createDataFrame([(i, 1, t, v, None, None, None, None, None, None, True, T0)
                                  for i, (t, v) in enumerate(values, 1)], IOCS)
    return iocs, feeds


@pytest.fixture()
def store(spark, tmp_path):
    return jobs.LiveStore(spark, str(tmp_path / "live"), str(tmp_path / "versions"), retro_hours=24 * 365)


def _keys(df):
    return sorted((r.event_id, r.ioc_id, r.match_type) for r in df.collect())


def test_batches_replay_and_new_version(spark, store):
    iocs, feeds = _tables(spark, ("ip", "10.0.0.3"))
    registry.publish_version(iocs, feeds, store.versions)
    jobs.ingest_batch(_lines(spark, 0, 40), 0, store)
    first = _keys(store.detections())
    assert first
    jobs.ingest_batch(_lines(spark, 0, 40), 0, store)      # a replay changes nothing
    assert _keys(store.detections()) == first and store.events().count() == 20

    # a new version: the stored events are scanned again, from the watermark on
    wider, _ = _tables(spark, ("ip", "10.0.0.3"), ("domain", "evil.com"))
    registry.publish_version(wider, feeds, store.versions)
    jobs.ingest_batch(_lines(spark, 40, 60), 1, store)
    lines = _lines(spark, 0, 60)
    events = accepted(parse_lines(lines)).withColumn("id", F.expr("(line_id div 4) * 2 + line_id % 4 + 1"))
    expected = match_events(events, prepare_snapshot(active_indicators(wider, feeds)))
    assert _keys(store.detections()) == _keys(expected)
    assert sorted(r.id for r in store.events().select("id").collect()) == list(range(1, 31))
    ids = sorted(r.id for r in store.detections().select("id").collect())
    assert ids == list(range(1, len(ids) + 1))
    state = store.before()
    assert (state["last_event_id"], state["version"], state["watermark"], state["errors"]) == (30, 2, 20, 5)
    live = store.table("live").all()
    assert {r.kind: r["count"] for r in live.groupBy("kind").count().collect()} == {"event": 30, "detection": len(ids), "buckets": 24}
    told = {r.kind: [json.loads(x.json) for x in live.filter((F.col("number") == 2) & (F.col("kind") == r.kind)).collect()]
            for r in live.select("kind").distinct().collect()}
    assert {b["bucket"]: b["n"] for b in told["buckets"] if b["n"]} == {"Firewall · DROP": 15, "DNS": 15, "_total": 30}
    assert store.bucket_totals("2026-08-26")["_total"] == 30
    # events come with their detections, detections of the rescan with fields of their old events
    assert sum(e["det_count"] or 0 for e in told["event"]) == store.detections().filter("event_id > 20").count()
    assert all(d["hostname"] or d["src_ip"] for d in told["detection"])
    assert {d["hostname"] for d in told["detection"] if d["match_type"] == "host"} == {f"h{i}.evil.com" for i in range(1, 60, 4)}


def test_a_fresh_checkpoint_on_a_filled_store_loses_nothing(spark, store, tmp_path):
    landed = tmp_path / "in"
    landed.mkdir()
    (landed / "a.log").write_text("first\nsecond\n")
    stream = jobs.syslog_text_stream(spark, str(landed))
    jobs.run_available(jobs.ingest(stream, store, str(tmp_path / "one")))
    (landed / "b.log").write_text("third\n")
    jobs.run_available(jobs.ingest(stream, store, str(tmp_path / "one")))
    other = tmp_path / "new"
    other.mkdir()
    (other / "c.log").write_text("fourth\nfifth\nsixth\n")
    jobs.run_available(jobs.ingest(jobs.syslog_text_stream(spark, str(other)), store, str(tmp_path / "two")))
    assert sorted((r.id, r.msg) for r in store.events().collect()) == list(
        enumerate(["first", "second", "third", "fourth", "fifth", "sixth"], 1))
    assert sorted((r.number, r.last_event_id) for r in store.state().collect()) == [(1, 2), (2, 3), (3, 6)]


def test_gaps_raise_and_unfinished_batches_are_not_seen(spark, store):
    with pytest.raises(ValueError, match="not stored"):
        jobs.ingest_batch(_lines(spark, 0, 4), 3, store)
    jobs.ingest_batch(_lines(spark, 0, 8), 0, store, "a")
    # what a lost run wrote before its state row
    store.events().drop("run", "batch_id").write.partitionBy("event_date").parquet(store.path("events", "lost", 0))
    assert store.events().count() == 4
    jobs.ingest_batch(_lines(spark, 8, 16), 0, store, "b")
    assert sorted(r.id for r in store.events().collect()) == list(range(1, 9))


def test_no_stage_folder_is_left(spark, store):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.iterdir())
    iocs, feeds = _tables(spark, ("ip", "10.0.0.3"))
    registry.publish_version(iocs, feeds, store.versions)
    jobs.ingest_batch(_lines(spark, 0, 40), 0, store)
    append_events(_lines(spark, 0, 20), f"{store.root}/more")
    assert set(root.iterdir()) == before


def test_counters_are_those_of_the_write(spark, tmp_path):
    path = str(tmp_path / "events")
    got = append_events(_lines(spark, 0, 40), path)
    assert got == {"received": 40, "parsed": 20, "errors": 10, "stored": 20}
    more = append_events(_lines(spark, 40, 48), path, start=20)
    assert more["stored"] == 4 and sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(1, 25))
    table = events_table(spark, path)
    assert sum(f.rows for f in table.files()) == 24 and table.log.version().number == 2
    assert table.newest(3)[1] > 20 and all(f.bounds["id"][0] > 20 for f in table.newest(3)[0])
    # what was parsed and is not in the table is an error
    kept = spark.read.parquet(path).filter("id <= 17")
    counters = ingest_counters(parse_lines(_lines(spark, 0, 40)), kept, kept.limit(3))
    assert {r.counter: r.n for r in counters.collect()} == {"received": 40, "parsed": 20, "stored": 17, "errors": 13, "detections": 3}


def test_text_stream_without_indicators(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("kernel: SRC=1.1.1.1 IN=a\n\nplain text\n")
    stream = jobs.syslog_text_stream(spark, str(tmp_path / "in"))
    jobs.run_available(jobs.ingest(stream, store, str(tmp_path / "cp")))
    assert store.events().count() == 2 and store.detections().count() == 0
    (tmp_path / "in" / "b.log").write_text("more\n")
    jobs.run_available(jobs.ingest(stream, store, str(tmp_path / "cp")))
    assert sorted(r.id for r in store.events().collect()) == [1, 2, 3]


def test_stateful_views_equal_batch(spark, tmp_path):
    path = str(tmp_path / "landed")
    _lines(spark, 0, 200).repartition(3).write.parquet(path)
    lines = jobs.landed_line_stream(spark, path, maxFilesPerTrigger="1")
    jobs.run_available(jobs.updates_to(jobs.daily_buckets(lines), str(tmp_path / "d"), str(tmp_path / "c1")))
    daily = {r.bucket: r.n for r in jobs.latest_updates(spark, str(tmp_path / "d"), "day", "bucket").collect()}
    assert daily == {"Firewall · DROP": 50, "DNS": 50}
    jobs.run_available(jobs.updates_to(jobs.arrival_rate(lines, "1 hour"), str(tmp_path / "r"), str(tmp_path / "c2")))
    rate = jobs.latest_updates(spark, str(tmp_path / "r"), "window_end").collect()
    assert sum(r.n for r in rate) == 200 * 6 and max(r.n for r in rate) == 60


def test_very_late_lines_count(spark, tmp_path):
    path = str(tmp_path / "landed")
    line = "<134>Aug %02d 06:00:00 GW kernel: [1.5] [FW-DROP] IN=a OUT=b SRC=10.0.0.3 DST=1.1.1.1 PROTO=TCP"
    for i, day in enumerate((26, 27, 1, 2)):
        rows = [(i, datetime(2026, 8, day, 6), line % day)]
        spark.createDataFrame(rows, SYSLOG_LINES).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    lines = jobs.landed_line_stream(spark, path, maxFilesPerTrigger="1")
    snapshot = prepare_snapshot(active_indicators(*_tables(spark, ("ip", "10.0.0.3"))))
    made = {"d": jobs.daily_buckets(lines), "r": jobs.arrival_rate(lines)}
    for name, df in made.items():
        jobs.run_available(jobs.updates_to(df, str(tmp_path / name), str(tmp_path / f"c{name}")))
    daily = jobs.latest_updates(spark, str(tmp_path / "d"), "day", "bucket").collect()
    assert sorted((r.day.day, r.n) for r in daily) == [(1, 1), (2, 1), (26, 1), (27, 1)]
    assert sum(r.n for r in jobs.latest_updates(spark, str(tmp_path / "r"), "window_end").collect()) == 4 * 6
    hits = jobs.inline_detections(lines, snapshot, F.col("line_id"))
    jobs.run_available(jobs.updates_to(hits, str(tmp_path / "h"), str(tmp_path / "ch"), mode="append"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [0, 1, 2, 3]


def test_counts_without_state_take_lines_of_any_age(spark, tmp_path):
    line = "<134>Aug %02d 06:00:00 GW kernel: [1.5] [FW-DROP] IN=a OUT=b SRC=10.0.0.3 DST=1.1.1.1 PROTO=TCP"
    batches = [spark.createDataFrame([(i, datetime(2026, 8, d, 6), line % d) for i in range(3)], SYSLOG_LINES).coalesce(1) for d in (26, 27, 1, 28, 2, 26)]
    daily = jobs.RunningCounts(spark, str(tmp_path / "d"), "day date, bucket string", merge_files=4)
    rate = jobs.RunningCounts(spark, str(tmp_path / "r"), "window_end timestamp", merge_files=4)
    held = []
    for n in range(20):
        daily.add(jobs.day_bucket_rows(batches[n % 6]), n)
        daily.add(jobs.day_bucket_rows(batches[n % 6]), n)  # a replay adds nothing
        held.append((len(daily.table.files()), len(list(Path(daily.log.folder).iterdir()))))
    # what a batch opens does not grow with the batches before it
    assert max(files for files, _ in held) <= 8 and max(names for _, names in held) <= 80
    assert sorted((r.day.day, r.n) for r in daily.now().collect()) == [(1, 9), (2, 9), (26, 21), (27, 12), (28, 9)]
    again = jobs.RunningCounts(spark, str(tmp_path / "d"), "day date, bucket string")  # another process reads the log
    assert sum(r.n for r in again.now().collect()) == 60 and again.log.version().number == daily.log.version().number
    rate.add(jobs.arrival_window_rows(batches[0]), 0)
    assert sum(r.n for r in rate.now().collect()) == 18


def test_resent_lines_are_stored_once_at_any_distance(spark, tmp_path):
    snapshot = prepare_snapshot(active_indicators(*_tables(spark, ("ip", "10.0.0.3"), ("cidr", "1.1.1.0/24"))))
    kept = jobs.ResentDetections(spark, str(tmp_path / "hits"), snapshot, F.col("line_id"), merge_files=3)
    for n, (low, high) in enumerate(((0, 20), (20, 40), (40, 60), (0, 20), (10, 50), (60, 64))):
        kept.add(_lines(spark, low, high), n)
    events = accepted(parse_lines(_lines(spark, 0, 64))).withColumnRenamed("line_id", "id")
    assert _keys(kept.now()) == _keys(match_events(events, snapshot))


def test_batches_are_merged_and_unfinished_ones_repeated(spark, tmp_path):
    store = jobs.LiveStore(spark, str(tmp_path / "live"), str(tmp_path / "versions"), merge_files=3)
    for n in range(4):
        jobs.ingest_batch(_lines(spark, 8 * n, 8 * n + 8), n, store)
    assert len(store.table("events").files()) < 4 and store.events().count() == 16
    assert sorted(r.id for r in store.events().select("id").collect()) == list(range(1, 17))
    # a batch that wrote its files and died before its commit
    fresh = jobs.LiveStore(spark, store.root, store.versions, merge_files=99)
    commit, fresh.logs["log"] = None, jobs.CommitLog(spark, store.root)
    fresh.log.commit = lambda *a, **b: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        jobs.ingest_batch(_lines(spark, 32, 40), 4, fresh)
    assert store.events().count() == 16 and commit is None
    jobs.ingest_batch(_lines(spark, 32, 40), 4, store)
    assert sorted(r.id for r in store.events().select("id").collect()) == list(range(1, 21))


def test_inline_detections_drop_resent_lines(spark, tmp_path):
    path = str(tmp_path / "landed")
    df = _lines(spark, 0, 40)
    df.unionByName(df).repartition(2).write.parquet(path)
    snapshot = prepare_snapshot(active_indicators(*_tables(spark, ("ip", "10.0.0.3"), ("cidr", "1.1.1.0/24"))))
    lines = jobs.landed_line_stream(spark, path)
    hits = jobs.inline_detections(lines, snapshot, F.col("line_id"))
    out = str(tmp_path / "o")
    jobs.run_available(jobs.updates_to(hits, out, str(tmp_path / "c"), mode="append"))
    events = accepted(parse_lines(df)).withColumnRenamed("line_id", "id")
    assert _keys(spark.read.parquet(out)) == _keys(match_events(events, snapshot))


def test_kafka_shape(spark):
    df = spark.createDataFrame([(bytearray(b"a \xff"), T0)], "value binary, timestamp timestamp")
    assert tuple(jobs.kafka_lines(df).first()) == ("a �", T0)


def test_lines_of_one_row_group_are_parsed_on_all_cores(spark, tmp_path):
    rows = [(i, f"user {i}", T0 + timedelta(seconds=i), "click") for i in range(40)]
    frame = spark.createDataFrame([(i, i % 5, t, kind) for i, _, t, kind in rows], "event_id bigint, user_id bigint, ts timestamp, event_type string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    lines = derived.syslog_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == cores > 1
    got = append_events(lines, f"{tmp_path}/stored")
    stored = [(r["id"], r["raw"]) for r in spark.read.parquet(f"{tmp_path}/stored").orderBy("id").collect()]
    wanted = [r["raw"] for r in accepted(parse_lines(lines)).orderBy("received_at", "line_id").collect()]
    assert stored == list(enumerate(wanted, 1)) and got["stored"] == len(wanted)
    plan = with_ids(lines, [40] * cores)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Join" not in plan


def _shared_network(spark, store, n_feeds=12):
    """A network that many indicators name, one that names the source of some events, and what two batches store."""
    wider = [("cidr", "1.1.1.0/24")] * n_feeds + [("cidr", "1.1.0.0/16"), ("ip", "10.0.0.3"), ("domain", "evil.com")]
    iocs, feeds = _tables(spark, *wider)
    registry.publish_version(iocs, feeds, store.versions)
    for n in range(2):
        jobs.ingest_batch(_lines(spark, 40 * n, 40 * n + 40), n, store)
    events = accepted(parse_lines(_lines(spark, 0, 80))).withColumn("id", F.expr("(line_id div 4) * 2 + line_id % 4 + 1"))
    return match_events(events, prepare_snapshot(active_indicators(iocs, feeds)), F.col("received_at"))


def test_stored_rows_do_not_grow_with_the_indicators_of_a_network(spark, store):
    expected = _shared_network(spark, store)
    assert expected.count() > 20 * 12
    assert _keys(store.detections()) == _keys(expected)
    rows = sorted((r.event_id, r.match_type, r.ioc_id, r.feed_id, r.feed_name, r.matched_value, r.created_at) for r in expected.collect())
    columns = ["event_id", "match_type", "ioc_id", "feed_id", "feed_name", "matched_value", "created_at"]
    assert sorted(tuple(r) for r in store.detections().select(*columns).collect()) == rows
    ids = [r.id for r in store.detections().orderBy("event_id", "id").collect()]
    assert ids == list(range(1, len(rows) + 1)) and store.before()["last_detection_id"] == len(rows)
    # one row for each event value and key, whatever number of indicators the key has
    held = {name: sum(f.rows for f in store.table(name).files()) for name in jobs.TABLES}
    probes = expected.join(spark.createDataFrame([(i, "a" if i <= 12 else str(i)) for i in range(1, 16)], "ioc_id bigint, k string"), "ioc_id")
    assert held["runs"] == probes.select("event_id", "match_type", "k").distinct().count()
    assert (held["detections"], held["indicators"], held["live"]) == (0, 15, 40 + 2 * 12)


def test_counts_of_runs_are_those_of_the_detections(spark, store):
    expected = _shared_network(spark, store).groupBy("ioc_id", "match_type", "matched_value").count()
    assert sorted(map(tuple, store.detection_counts().collect())) == sorted(map(tuple, expected.collect()))
    # a version more: every indicator is stored twice, and detections of older events lie outside the runs
    wider, feeds = _tables(spark, *[("cidr", "1.1.1.0/24")] * 12, ("cidr", "1.1.0.0/16"), ("ip", "10.0.0.3"), ("domain", "evil.com"), ("ip", "10.0.0.5"))
    registry.publish_version(wider, feeds, store.versions)
    jobs.ingest_batch(_lines(spark, 80, 120), 2, store)
    assert sum(f.rows for f in store.table("detections").files()) > 0
    events = accepted(parse_lines(_lines(spark, 0, 120))).withColumn("id", F.expr("(line_id div 4) * 2 + line_id % 4 + 1"))
    hits = match_events(events, prepare_snapshot(active_indicators(wider, feeds)))
    assert _keys(store.detections()) == _keys(hits)
    ids = sorted(r.id for r in store.detections().select("id").collect())
    assert ids == list(range(1, len(ids) + 1))
    counted = hits.groupBy("ioc_id", "match_type", "matched_value").count()
    assert sorted(map(tuple, store.detection_counts().collect())) == sorted(map(tuple, counted.collect()))


def test_viewers_are_told_every_detection_of_a_run(spark, store):
    _shared_network(spark, store)
    told = [json.loads(r.json) for r in store.table("live").all().filter("kind = 'detection'").collect()]
    events = {r.id: r for r in store.events().collect()}
    expected = [{"id": d.id, "created_at": d.created_at.isoformat() + "+00:00", "match_type": d.match_type, "matched_value": d.matched_value,
                 "feed_name": d.feed_name, "src_ip": e.src_ip, "dst_ip": e.dst_ip, "hostname": e.hostname, "event_action": e.action}
                for d in store.detections().collect() for e in [events[d.event_id]]]
    by_id = lambda rows: sorted(rows, key=lambda r: r["id"])
    assert by_id(told) == by_id(expected) and [*told[0]] == [*expected[0]]
    counts = {r.id: r.n for r in store.detections().groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("n")).collect()}
    seen = [json.loads(r.json) for r in store.table("live").all().filter("kind = 'event'").collect()]
    assert {e["id"]: e["det_count"] for e in seen} == {i: counts.get(i) for i in events}


def test_no_shuffle_file_is_left_by_a_batch(spark, store):
    spark.range(9).repartition(3).count()
    temp = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString())
    files = lambda: {p.name for p in temp.rglob("shuffle_*.data")}
    iocs, feeds = _tables(spark, ("ip", "10.0.0.3"))
    registry.publish_version(iocs, feeds, store.versions)
    before = files()
    with shuffles_removed(spark):
        spark.range(100).repartition(3).write.parquet(f"{store.root}/some")
    assert not files() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    jobs.ingest_batch(_lines(spark, 0, 40), 0, store)
    assert len(files() - before) <= 16, files() - before


def test_lines_by_arrival_are_the_same_lines(spark, tmp_path):
    rows = [(i, i % 7, T0 + timedelta(seconds=(i * 37) % 100), ["click", "view", "purchase"][i % 3]) for i in range(200)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    lines = derived.syslog_lines_by_arrival(spark, str(tmp_path), 4)
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, derived.syslog_lines(spark, str(tmp_path)).collect()))
    spans = [(min(p), max(p)) for p in lines.rdd.map(lambda r: r.received_at).glom().collect() if p]
    assert len(spans) == 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    plan = derived.syslog_lines_by_arrival(spark, str(tmp_path), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan
