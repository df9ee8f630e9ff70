"""Feed parsers and pull outcomes on payloads written for each rule."""

import csv
import io
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netsight.constants import PAYLOAD_CAP_BYTES
from netsight.functions.csv import csv_fields, csv_records
from netsight.functions.stix import pattern_values
from netsight.operators import feeds as FD
from netsight.operators import registry as R
from netsight.plans.sweep import sweep
from netsight.schemas import FEEDS, IOCS, PARSER_CONFIG
from netsight.session import work_path
from netsight.sources import derived_feeds
from netsight.sources.storage import read_payload_files

CFG = f"feed_id int, payload_id long, payload string, collection_id string, parser_config {PARSER_CONFIG.simpleString()}"


def config(**given):
    return {name: given.get(name) for name in PARSER_CONFIG.fieldNames()}


@pytest.fixture(scope="module")
def payload(spark):
    def make(*texts, collection=None, **cfg):
        return spark.createDataFrame([(1, i, t, collection, config(**cfg)) for i, t in enumerate(texts)], CFG)
    return make


def _rows(df):
    return [r.asDict() for r in df.orderBy("payload_id", "pos").collect()]


def _values(df):
    return [(r["type"], r["value"]) for r in _rows(df)]


def test_plain_list(payload):
    kept = {"203.0.113.0/28": "cidr", "198.51.100.200": "ip", "2001:db8:5::/48": "cidr", "tracker.invalid": "domain",
            "gopher://hole.invalid/a?b": "url", "*.ads.invalid": "domain"}
    noise = ["", "   ", "# heading", "; remark", "// remark", "one-label", ";198.51.100.1"]
    lines = [x for pair in zip([f"{v}  ; seen twice" if i % 2 else f"\t{v} trailing words" for i, v in enumerate(kept)], noise, strict=False) for x in pair]
    for end in ("\n", "\r\n", "\r", " "):
        assert _values(FD.parse_plain(payload(end.join([*lines, noise[-1]])))) == [(t, v) for v, t in kept.items()]
    assert _values(FD.parse_plain(payload("", "#\n;\n//\n"))) == []


def test_csv_columns(payload):
    text = "when|what|note|labels|link\nmon|sink.invalid|\"parked; \"\"old\"\" one\"|p1, p2 ,|http://r.invalid/1\ntue|nothing here|x|y|z\nwed|192.0.2.77|||\n"
    cfg = {"has_header": True, "delimiter": "|", "value_column": 2, "description_column": 3, "tags_column": 4, "reference_column": 5}
    rows = _rows(FD.parse_csv(payload(text, **cfg)))
    assert [(r["type"], r["value"], r["description"], r["tags"], r["reference"]) for r in rows] == [
        ("domain", "sink.invalid", 'parked; "old" one', ["p1", "p2"], "http://r.invalid/1"), ("ip", "192.0.2.77", None, None, None)]


def test_csv_spaces_before_a_quote_do_not_quote(payload):
    rows = _rows(FD.parse_csv(payload('x, "u,v", 192.0.2.5\n"u,v", 192.0.2.6,k\n', value_column=2)))
    assert _values(FD.parse_csv(payload('x, "u,v", 192.0.2.5\n', value_column=4))) == [("ip", "192.0.2.5")]
    assert [r["value"] for r in rows] == ["192.0.2.6"]


@pytest.mark.parametrize(("text", "values"), [
    ("192.0.2.1\n192.0.2.2\n", ["192.0.2.2"]), ("\n192.0.2.1\n192.0.2.2\n", ["192.0.2.1", "192.0.2.2"]),
    ("; remark\n192.0.2.1\n192.0.2.2", ["192.0.2.2"]), ('"# remark"\n192.0.2.1\n192.0.2.2', ["192.0.2.2"]), ("", [])])
def test_csv_header_is_the_first_record_that_is_no_remark(payload, text, values):
    assert [v for _, v in _values(FD.parse_csv(payload(text, has_header=True, value_column=1)))] == values


def test_csv_defaults_to_the_first_column(payload):
    assert [v for _, v in _values(FD.parse_csv(payload("192.0.2.1,q\n\n192.0.2.2")))] == ["192.0.2.1", "192.0.2.2"]


def test_csv_errors(payload):
    bad = payload("p,q\rr\n", "p,q\r\nr,s\r", '"' + "long " * 60000 + '"\n192.0.2.1\n')
    got = {r.payload_id: r.error for r in FD.csv_errors(bad).collect()}
    assert set(got) == {0} and "new-line" in got[0]
    assert [v for _, v in _values(FD.parse_csv(bad))] == ["192.0.2.1"]
    assert FD.csv_errors(payload("p", delimiter="::")).count() == 1


def test_csv_dialect_against_standard_library(spark):
    rnd = random.Random(11)
    alphabet = ['"', '""', ",", "\n", "\r\n", "k", "  ", ",z", '"w"', "ß", "\t"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 16))) for _ in range(300)]
    texts += ['"m"n,o', '"m\nn",o', '"never\nclosed', 'm"n"o', '"m""n"', ",,", '"' + "r\n" * 5000 + '",s']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    records = csv_records(F.col("t"), F.lit(","))
    fields = F.transform(records, lambda r: F.when(r != "", csv_fields(r, F.lit(","))).otherwise(F.array().cast("array<string>")))
    got = {r.i: r.f for r in df.select("i", fields.alias("f")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == list(csv.reader(io.StringIO(text))), repr(text)


def indicator(pattern, **given):
    return {"type": "indicator", "pattern": pattern, **given}


OBJECTS = [
    indicator("[domain-name:value = 'mail.invalid']", labels=["phish"], confidence=40, description="seen in mail",
              created="2030-02-03T04:05:06Z", modified="2030-03-01T00:00:00Z", external_references=[{"id": 1}, {"url": "http://notes.invalid/9"}]),
    indicator("[ipv6-addr:value = '2001:db8::7' AND url:value = 'http://mail.invalid/go']", x_severity="medium", confidence=2),
    indicator("[url:value IN ('http://k.invalid', 'http://l.invalid')]", labels=["kit", "lure"]),
    {"type": "domain-name", "value": "bare.invalid", "labels": ["seen"], "name": "label", "description": "long text"},
    {"type": "tool", "name": "ignored"}, 17, "text", indicator(""), {"type": "ipv4-addr", "value": ""}]


def test_stix_bundle(payload):
    rows = _rows(FD.parse_stix(payload(json.dumps({"type": "bundle", "objects": OBJECTS}))))
    assert [(r["type"], r["value"], r["tags"], r["severity"], r["description"]) for r in rows] == [
        ("domain", "mail.invalid", ["phish"], "40", "seen in mail"), ("ip", "2001:db8::7", ["http://mail.invalid/go"], "medium", None),
        ("url", "http://k.invalid", ["kit", "lure", "http://l.invalid"], None, None), ("domain", "bare.invalid", ["seen"], None, "label")]
    assert rows[0]["reference"] == "http://notes.invalid/9"
    assert (rows[0]["first_seen"], rows[0]["last_seen"]) == (datetime(2030, 2, 3, 4, 5, 6), datetime(2030, 3, 1))


def test_stix_shapes_and_errors(payload):
    texts = [json.dumps(x) for x in (OBJECTS[:2], OBJECTS[0], {"type": "bundle", "objects": []}, OBJECTS[3], True, {"objects": "none"})] + ["[1, "]
    assert [r["payload_id"] for r in _rows(FD.parse_stix(payload(*texts)))] == [0, 0, 1]
    assert [r.payload_id for r in FD.stix_errors(payload(*texts)).collect()] == [6]


def test_stix_severity_property_is_a_setting(payload):
    text = json.dumps(indicator("[domain-name:value='s.invalid']", x_rank="top", confidence=61))
    assert [_rows(FD.parse_stix(payload(text), *name))[0]["severity"] for name in ((), ("x_rank",))] == ["61", "top"]


def test_pattern_values_come_equals_first(spark):
    text = "[domain-name IN ('q1', \"q2\") OR url:value='q3' AND ipv4-addr = 'q4']"
    got = spark.createDataFrame([(text,)], "p string").select(pattern_values(F.col("p")).alias("v")).first().v
    assert [tuple(x) for x in got] == [("url", "q3"), ("ipv4-addr", "q4"), ("domain-name", "q1"), ("domain-name", "q2")]


def test_taxii_collections(spark):
    one = json.dumps({"objects": OBJECTS[:1]})
    rows = [(7, 1, one, "north", config()), (7, 2, one, "south", config()), (8, 3, one, "north", config(collection_id="south")),
            (8, 4, one, "south", config(collection_id="south")), (9, 5, one, "north", config(collection_id="east")), (10, 6, one, None, config()),
            (11, 7, json.dumps(OBJECTS[:1]), "north", config())]
    df = spark.createDataFrame(rows, CFG)
    assert [(r["feed_id"], r["payload_id"]) for r in _rows(FD.parse_taxii(df))] == [(7, 1), (8, 4)]
    errors = {r.feed_id: r.error for r in FD.chosen_collections(df).filter("error is not null").collect()}
    assert errors == {9: "collection east not found on server", 10: "TAXII server exposes no collections"}


def test_payload_size_and_bad_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"fine \xfe")), (2, bytearray(b"y" * 31))], "payload_id long, payload binary")
    got = {r.payload_id: r for r in FD.admit_payloads(df, cap=30).collect()}
    assert (got[1].payload, got[1].error) == ("fine �", None)
    assert (got[2].payload, got[2].error) == (None, "feed payload exceeds 30 bytes: 2")
    assert PAYLOAD_CAP_BYTES == 20 << 20


@pytest.fixture(scope="module")
def round_of_feeds(spark, tmp_path_factory):
    """Landed files: oversized, half refused, with an unread broken collection, and good ones."""
    kinds = {1: "plain", 2: "csv", 3: "taxii", 4: "stix", 5: "plain", 6: "taxii"}
    landed = tmp_path_factory.mktemp("landed")
    files = {(1, 1): "192.0.2.1\n" * 40, (1, 2): "192.0.2.9\n", (2, 3): "192.0.2.2\n", (2, 4): "a,b\rc\n",
             (3, 5): json.dumps({"objects": OBJECTS[:1]}), (3, 6): "{broken", (4, 7): "[" + "1," * 200, (5, 8): "192.0.2.5\n",
             (6, 9): json.dumps({"objects": OBJECTS[:1]}), (6, 10): "{broken"}
    for (feed, number), text in files.items():
        folder = landed / f"feed_id={feed}" / f"payload_id={number}"
        folder.mkdir(parents=True)
        (folder / "body").write_bytes(text.encode())
    collections = spark.createDataFrame([(5, "read"), (6, "unread"), (9, "read"), (10, "read")], "payload_id long, collection_id string")
    payloads = read_payload_files(spark, str(landed), cap=380).join(collections, "payload_id", "left")
    feeds = spark.createDataFrame(
        [{**dict.fromkeys(FEEDS.fieldNames()), "id": i, "name": f"feed {i}", "type": kind, "enabled": True, "parser_config": config(), "auto_pull_minutes": 60}
         for i, kind in kinds.items()], FEEDS)
    return payloads, feeds


def test_a_failed_pull_merges_nothing(spark, round_of_feeds):
    payloads, feeds = round_of_feeds
    root = work_path(spark, "round")
    R.publish_version(spark.createDataFrame([], IOCS), feeds, root)
    assert sweep(payloads, root, F.lit("2031-01-01").cast("timestamp")) == 2
    iocs, after = R.read_version(spark, root, 2)
    assert {(r.feed_id, r.value) for r in iocs.collect()} == {(3, "mail.invalid"), (5, "192.0.2.5")}
    status = {r.id: (r.last_status, r.last_error) for r in after.collect()}
    assert status == {1: ("error", "feed payload exceeds 380 bytes: 1"), 2: ("error", "new-line character seen in unquoted field"),
                      3: ("ok (1)", None), 4: ("error", "feed payload exceeds 380 bytes: 7"), 5: ("ok (1)", None), 6: ("error", "invalid JSON")}
    logs = {r.feed_id: (r.level, r.message) for r in spark.read.parquet(f"{root}/logs").collect()}
    assert logs[1] == ("error", "pull failed: feed payload exceeds 380 bytes: 1") and logs[5] == ("info", "pull ok: ok (1)")


def test_the_version_stays_when_every_pull_fails(spark, round_of_feeds):
    payloads, feeds = round_of_feeds
    root = work_path(spark, "round")
    R.publish_version(spark.createDataFrame([], IOCS), feeds, root)
    assert sweep(payloads.where("feed_id in (1, 6)"), root, F.lit("2031-01-01").cast("timestamp")) == 1
    iocs, after = R.read_version(spark, root, R.current_version(spark, root))
    assert iocs.count() == 0 and {r.id for r in after.where("last_status = 'error'").collect()} == {1, 6}


@pytest.mark.parametrize("make", [derived_feeds.plain_payloads, derived_feeds.csv_payloads, derived_feeds.stix_payloads])
def test_payloads_of_a_small_file_are_dealt_to_all_cores(spark, make):
    payloads = make(spark, "/root/testdata/sf0.001")
    parts = payloads.groupBy(F.spark_partition_id()).count().count()
    assert parts == spark.sparkContext.defaultParallelism
