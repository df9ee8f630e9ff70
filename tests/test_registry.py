"""Indicator and feed table merges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netsight.operators import registry as R
from netsight.operators.feeds import parse_plain
from netsight.operators import ids
from netsight.operators.ids import assign_ids
from netsight.schemas import FEEDS, IOCS, PARSER_CONFIG

NOW = datetime(2026, 8, 26, 12)
OLD = datetime(2026, 1, 1)


def now():
    return F.lit("2026-08-26 12:00:00").cast("timestamp")


def _feed(id, name, type="plain", url="u", enabled=True, deleted=None):
    return (id, name, type, url, None, None, enabled, 60, None, "old status", None, deleted, OLD)


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame([
        _feed(1, "a"), _feed(2, "b", "csv"), _feed(3, "gone", deleted=OLD, enabled=False),
        _feed(4, "off", enabled=False), _feed(5, "Spamhaus DROP/EDROP", "csv")], FEEDS)


def _by(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_upsert_iocs(spark):
    stored = spark.createDataFrame([
        (7, 1, "ip", "1.1.1.1", "old", ["x"], "high", "r", OLD, OLD, False, OLD),
        (8, 1, "domain", "keep.example.com", None, None, None, None, OLD, OLD, True, OLD)], IOCS)
    batch = "feed_id int, payload_id long, pos int, type string, value string, description string, " \
            "tags array<string>, severity string, reference string, first_seen timestamp, last_seen timestamp"
    rows = [(1, 1, 0, "ip", "1.1.1.1", "first", ["a"], None, None, None, None),
            (1, 1, 5, "ip", "1.1.1.1", "last", [], None, "new", datetime(2025, 1, 1), None),
            (1, 1, 9, "url", "http://x/", None, None, None, None, None, None),
            (1, 1, 2, "ip", "2.2.2.2", None, None, None, None, None, None)]
    got = {(r.type, r.value): r for r in R.upsert_iocs(stored, spark.createDataFrame(rows, batch), now()).collect()}
    assert len(got) == 4
    hit = got["ip", "1.1.1.1"]
    assert (hit.id, hit.description, hit.tags, hit.severity, hit.reference, hit.active) == (7, "last", None, None, "new", True)
    assert (hit.first_seen, hit.last_seen, hit.created_at) == (datetime(2025, 1, 1), NOW, OLD)
    kept = got["domain", "keep.example.com"]
    assert (kept.id, kept.active, kept.last_seen) == (8, True, OLD)
    # new ids follow the order of the batch
    assert (got["ip", "2.2.2.2"].id, got["url", "http://x/"].id) == (9, 10)
    assert got["url", "http://x/"].first_seen == NOW


def test_upsert_is_idempotent(spark):
    payload = spark.createDataFrame([(1, 1, "1.1.1.1\n2.2.2.2\n1.1.1.1\n")], "feed_id int, payload_id long, payload string")
    once = R.upsert_iocs(spark.createDataFrame([], IOCS), parse_plain(payload), now())
    twice = R.upsert_iocs(once, parse_plain(payload), now())
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == 2


def test_assign_ids_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    rows = assign_ids(df, ["v"], 100).orderBy("v").collect()
    assert [r.id for r in rows] == list(range(101, 5101))


def test_ids_of_many_ranges_are_dense_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(ids, "PART_ROWS", 300)
    rows = spark.range(0, 4000, 1, 5).selectExpr("timestamp_seconds(id div 90) AS at", "CASE WHEN id % 11 = 0 THEN NULL ELSE 4000 - id END AS n", "CAST(id % 7 AS STRING) AS s")
    stored = ids.written_once(rows, "test")
    deal = ids.Deal.of(stored, ["at", "n", "s"])
    assert len(deal.bounds) == 7 and min(deal.counts(stored)) > 100
    got = ids.number_stored(stored, ["at", "n", "s"], 10).collect()
    key = lambda r: (r["at"], r["n"] is not None, r["n"] or 0, r["s"])
    assert [r["id"] for r in sorted(got, key=lambda r: (key(r), r["id"]))] == list(range(11, 4011))
    kept = stored.filter("s <> '3'")
    some = ids.with_ids(deal.ordered(stored).filter("s <> '3'"), deal.counts(kept)).collect()
    assert sorted(r["id"] for r in some) == list(range(1, len(some) + 1)) and len(some) == kept.count()


def test_seed_feeds(spark, feeds):
    got = _by(R.upsert_seed_feeds(feeds, R.seed_feeds(spark), now()))
    assert len(got) == 8
    assert (got[5]["type"], got[5]["auto_pull_minutes"], got[5]["last_status"]) == ("plain", 360, "old status")
    assert {got[i]["name"] for i in (6, 7, 8)} == {
        "Abuse.ch ThreatFox (recent)", "Abuse.ch URLhaus (recent)", "Abuse.ch Feodo IP blocklist"}
    assert got[1]["type"] == "plain" and got[3]["deleted_at"] == OLD


def test_feed_changes(spark, feeds):
    schema = ("change_id long, op string, feed_id int, name string, type string, source_url string, auth_json string, "
              f"parser_config {PARSER_CONFIG.simpleString()}, enabled boolean, auto_pull_minutes int")
    c = lambda i, op, feed=None, name=None, type=None, url=None, enabled=None, minutes=None: (
        i, op, feed, name, type, url, None, None, enabled, minutes)
    changes = spark.createDataFrame([
        c(1, "create", name=" new ", type="plain", url=" http://n "), c(2, "create", name="new", type="csv", url="u"),
        c(3, "create", name=" ", type="plain", url="u"), c(4, "create", name="x", type="zip", url="u"),
        c(5, "create", name="x", type="stix", url=" "), c(6, "create", name="a", type="plain", url="u"),
        c(7, "create", name="gone", type="taxii", url="u", minutes=5), c(8, "update", feed=1, name="renamed", enabled=False),
        c(9, "update", feed=1, minutes=15), c(10, "update", feed=3, name="z"), c(11, "update", feed=2, type="zip"),
        c(12, "update", feed=2, name="a"), c(13, "update", feed=2, name="b", type="stix"), c(14, "update", feed=99)], schema)
    checked = R.check_feed_changes(changes, feeds)
    reasons = {r.change_id: r.reason for r in checked.collect()}
    kinds = "type must be one of ('plain', 'csv', 'stix', 'taxii')"
    taken = "a feed named '{}' already exists"
    assert reasons == {1: None, 2: taken.format("new"), 3: "name is required", 4: kinds, 5: "source_url is required",
                       6: taken.format("a"), 7: None, 8: None, 9: None, 10: "feed not found", 11: kinds,
                       12: taken.format("a"), 13: None, 14: "feed not found"}
    got = _by(R.apply_feed_changes(feeds, checked, now()))
    assert (got[1]["name"], got[1]["enabled"], got[1]["auto_pull_minutes"], got[1]["type"]) == ("renamed", False, 15, "plain")
    assert got[2]["type"] == "stix" and got[3]["name"] == "gone"
    assert (got[6]["name"], got[6]["source_url"], got[6]["auto_pull_minutes"], got[6]["enabled"]) == ("new", "http://n", 1440, True)
    assert (got[7]["name"], got[7]["auto_pull_minutes"]) == ("gone", 5) and len(got) == 7


def test_soft_delete(spark, feeds):
    iocs = spark.createDataFrame([(i, f, "ip", str(i), None, None, None, None, None, None, True, OLD)
                                  for i, f in ((1, 1), (2, 2), (3, 1))], IOCS)
    gone = spark.createDataFrame([(1,), (1,)], "feed_id int")
    after = _by(R.soft_delete_feeds(feeds, gone, now()))
    assert (after[1]["deleted_at"], after[1]["enabled"]) == (NOW, False) and after[2]["enabled"]
    assert {i for i, r in _by(R.deactivate_feed_iocs(iocs, gone)).items() if r["active"]} == {2}


def test_pull_log_status_and_triage(spark, feeds):
    results = spark.createDataFrame([(1, OLD, 3, None), (1, NOW, None, "boom"), (2, NOW, 5, None)],
                                    "feed_id int, pulled_at timestamp, n long, error string")
    assert {(r.feed_id, r.level, r.message) for r in R.pull_log_rows(results).collect()} == {
        (1, "info", "pull ok: ok (3)"), (1, "error", "pull failed: boom"), (2, "info", "pull ok: ok (5)")}
    got = _by(R.record_pulls(feeds, results))
    assert (got[1]["last_status"], got[1]["last_error"], got[1]["last_pull"]) == ("error", "boom", NOW)
    assert (got[2]["last_status"], got[2]["last_error"]) == ("ok (5)", None) and got[4]["last_status"] == "old status"
    requests = spark.createDataFrame([(i, f, None if i != 2 else OLD) for i, f in enumerate([1, 3, 2, 4, 77], 1)],
                                     "id long, feed_id int, processed_at timestamp")
    skip = "skipped (feed unavailable)"
    assert {r.id: r.status for r in R.pending_pulls(requests, feeds).collect()} == {1: "pull", 3: "pull", 4: skip, 5: skip}
    assert {r.id for r in R.enabled_feeds(feeds).collect()} == {1, 2, 5}


def test_versions(spark, feeds, tmp_path):
    root = str(tmp_path / "v")
    iocs = spark.createDataFrame([], IOCS)
    assert R.current_version(spark, root) == 0
    assert [R.publish_version(iocs, feeds, root) for _ in range(2)] == [1, 2]
    assert R.read_version(spark, root, R.current_version(spark, root))[1].count() == 5
