"""Served views: literal cases and plan shape; full results are checked against SQL in test_queries."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netsight.constants import BUCKETS
from netsight.functions.buckets import age_text, bucket_of, percent_share, ticker_label
from netsight.plans import views
from netsight.plans.catalog import all_queries
from netsight.plans.hits import HitTable
from netsight.plans.stored import stored
from netsight.sources import trigrams
from netsight.sources.storage import json_rows, read_payload_files, read_syslog_files

SF = "/root/testdata/sf0.001"


def test_bucket_of(spark):
    cases = [("kernel", "FW-DROP", "Firewall · DROP"), ("kernel", "FW-REJECT", "Firewall · DROP"),
             ("kernel", "FW-ACCEPT", "Firewall · ACCEPT"), ("KERNEL", "allow-x", "Firewall · ACCEPT"),
             ("kernel", "DPIA-BLOCK", "IPS / DPIA"), ("kernel", "CLIPS", "IPS / DPIA"),
             (None, "DMZ_WAN-A-10000", "Firewall · Rule"), ("", "x", "Firewall · Rule"), ("kernel", None, "Kernel"),
             ("dnsmasq", None, "DNS"), ("dnsmasq-dhcp", None, "DHCP"), ("hostapd", None, "WLAN"), ("pppd", None, "WAN"),
             ("syslog", None, "System"), ("ubios", "DROP", "System"), (None, None, "Other"), ("new", "FW-DROP", "Other")]
    df = spark.createDataFrame(cases, "tag string, action string, expected string")
    for r in df.withColumn("got", bucket_of(F.col("tag"), F.col("action"))).collect():
        assert r.got == r.expected, r


def test_display_scalars(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(0,), (59,), (60,), (3599,), (3600,), (86399,), (86400,), (200000,), (-5,)], "s int")
    ages = [r.a for r in df.orderBy("s").select(age_text(now - F.make_dt_interval(secs=F.col("s")), now).alias("a")).collect()]
    assert ages == ["0s ago", "0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "2d ago"]
    rows = [("1.1.1.1", "2.2.2.2", None, "m", "1.1.1.1→2.2.2.2"), (None, None, "h", "m", "h"),
            (None, "2.2.2.2", None, "x" * 40, "x" * 34), (None, None, None, None, "")]
    df = spark.createDataFrame(rows, "s string, d string, h string, m string, e string")
    assert all(r.got == r.e for r in df.withColumn(
        "got", ticker_label(F.col("s"), F.col("d"), F.col("h"), F.col("m"))).collect())
    shares = spark.createDataFrame([(1, 8), (1, 3), (1, 0), (1, 200)], "n long, t long")
    assert [r[0] for r in shares.select(percent_share(F.col("n"), F.col("t"))).collect()] == [13, 33, 0, 1]


def test_bucket_totals_are_zero_filled(spark):
    events = spark.createDataFrame([(datetime(2026, 1, 2, 5), "kernel", "FW-DROP"), (datetime(2026, 1, 1), "pppd", None)],
                                   "ts timestamp, tag string, action string")
    got = {r.bucket: r.n for r in views.bucket_totals(events, F.lit("2026-01-02 12:00:00").cast("timestamp")).collect()}
    assert got == {**{b: 0 for b in BUCKETS}, "Firewall · DROP": 1, "_total": 1}


def test_paging_limits(spark):
    t = stored(spark, SF)
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            views.browse_events(t.events, t.detections, **bad)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_page_reads_its_own_days_and_ids(spark):
    t = stored(spark, SF)
    since = F.lit("2024-01-20 00:00:00").cast("timestamp")
    for df in (views.browse_events(t.events, t.detections), views.browse_events(t.events, t.detections, flows_only=True, since=since),
               views.events_since(t.events, t.detections, 40)):
        plan = _plan(df)
        assert "PartitionFilters: [event_date" in plan and "GreaterThanOrEqual(id," in plan and "GreaterThanOrEqual(event_id," in plan
    for df in (views.browse_detections(t.detections, t.events, t.iocs), views.detections_since(t.detections, t.events, 5),
               views.detection_detail(t.detections, t.events, t.iocs, 3)):
        assert "(id," in _plan(df).split("events")[0] or "PushedFilters: [IsNotNull(id), " in _plan(df)
    narrow = views.filter_events(t.events, flows_only=True, since=since).select("id", "event_date").orderBy(F.desc("id")).limit(50)
    assert "TakeOrderedAndProject" in _plan(narrow) and "msg" not in _plan(narrow)


def test_pages_open_the_files_that_can_hold_them(spark):
    t = stored(spark, SF)
    every = len(t.event_log.files())
    page = views.browse_events(t.event_log, t.detection_log, limit=50)
    opened = {f for f in page.inputFiles() if "event_date" in f}
    assert 0 < len(opened) <= max(2, every // 4)
    assert [r.id for r in page.select("id").collect()] == [r.id for r in views.browse_events(t.events, t.detections, limit=50).select("id").collect()]
    low, total = 40, t.events.count()
    newest, bound = t.event_log.newest(low)
    assert t.event_log.read(newest).filter(F.col("id") >= bound).count() >= low and bound <= total - low + 1
    for df in (views.browse_detections(t.detection_log, t.event_log, t.iocs, limit=20), views.detections_since(t.detection_log, t.event_log, 30)):
        assert "PartitionFilters: [event_date" in _plan(df) or "event_date" in _plan(df)
        assert len({f for f in df.inputFiles() if "event_date" in f}) < every


@pytest.mark.parametrize("q", ["10.0.0.1_/32", "ALPHA.example", "%%", "ab", "no such text", "h1", "accept", "é", "dns\\x", "wan0%lan3"])
def test_search_by_trigrams_equals_the_scan(spark, q):
    t = stored(spark, SF)
    ids = lambda df: [r.id for r in df.select("id").collect()]
    for more in ({}, {"flows_only": True, "limit": 7, "offset": 3}):
        assert ids(views.browse_events(t.event_log, t.detection_log, q=q, terms=t.event_terms, **more)) == ids(
            views.browse_events(t.events, t.detections, q=q, **more))


def test_a_rare_text_is_looked_up_in_few_blocks(spark, tmp_path):
    rows = [(i, f"common words here {'needle42' if i == 20_500 else i % 7}", None, None, None) for i in range(1, 40_001)]
    events = spark.createDataFrame(rows, "id long, raw string, src_ip string, dst_ip string, hostname string")
    trigrams.write_postings(events, str(tmp_path / "terms"))
    terms = spark.read.schema(trigrams.POSTINGS).parquet(str(tmp_path / "terms"))
    assert [r.block for r in trigrams.blocks_with(terms, trigrams.trigrams_of("Needle4")).collect()] == [20_500 // trigrams.BLOCK]
    assert trigrams.BLOCK < 0.05 * len(rows)
    assert trigrams.trigrams_of("a%b_c") is None and trigrams.trigrams_of("ab%cde") == ["cde"]


def test_windowed_counters_open_the_days_of_their_window(spark):
    t = stored(spark, SF)
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    assert "PartitionFilters: [isnotnull(event_date" in _plan(views.bucket_totals(t.events, now))
    assert _plan(views.stats(t.events, t.detections, t.feeds, t.iocs, now)).count("PartitionFilters: [isnotnull(") == 2


def test_json_rows(spark):
    df = spark.sql("""SELECT 1L AS id, timestamp'2026-01-01 00:00:00.5' AS a, timestamp'2026-01-01' AS b, 1.50BD AS d,
        array(named_struct('t', timestamp'2026-01-01', 'n', CAST(NULL AS INT))) AS l, CAST(NULL AS STRING) AS s""")
    assert json.loads(json_rows(df).first().json) == {
        "id": 1, "a": "2026-01-01T00:00:00.500000+00:00", "b": "2026-01-01T00:00:00+00:00", "d": 1.5,
        "l": [{"t": "2026-01-01T00:00:00+00:00", "n": None}], "s": None}


def test_file_sources(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.log").write_bytes(b"one\r\n\nbad \xff byte\n")
    assert [r.line for r in read_syslog_files(spark, str(tmp_path / "lines")).collect()] == ["one\r", "", "bad � byte"]
    folder = tmp_path / "pay" / "feed_id=3" / "payload_id=9"
    folder.mkdir(parents=True)
    (folder / "x.txt").write_bytes(b"1.1.1.1\n# c\n")
    row = read_payload_files(spark, str(tmp_path / "pay")).first()
    assert (row.feed_id, row.payload_id, row.payload, row.error) == (3, 9, "1.1.1.1\n# c\n", None)
    assert read_payload_files(spark, str(tmp_path / "pay"), cap=3).first().error.startswith("feed payload exceeds 3")


def test_pages_make_the_detections_they_show(spark, tmp_path):
    """Same rows and ids as stored detections, in blocks of any size."""
    t = stored(spark, SF)
    rows = lambda df: [tuple(r) for r in df.collect()]
    some = [r.event_id for r in t.detections.select("event_id").orderBy("event_id").limit(40).collect()]
    hits = HitTable(t.event_log, t.snapshot, least=100)
    assert hits.largest_id == t.detections.count()
    for view in (lambda d: views.detection_detail(d, t.event_log, t.iocs, 42), lambda d: views.detections_since(d, t.event_log, 30),
                 lambda d: views.browse_detections(d, t.event_log, t.iocs, feed_id=2, limit=30, offset=2),
                 lambda d: views.event_detail(t.event_log, d, some[-1]), lambda d: views.browse_events(t.event_log, d, limit=30)):
        assert rows(view(hits)) == rows(view(t.detections))
    assert hits.with_ids([0, hits.largest_id + 1]).count() == hits.above(hits.largest_id, 5).count() == 0


def test_a_page_stores_no_detections(spark, tmp_path):
    (tmp_path / "sf").symlink_to(SF)
    sf = str(tmp_path / "sf")
    for name in ("events_search", "detections_since_id", "detection_detail"):
        all_queries()[name](spark, sf).collect()
    assert "detections" not in stored(spark, sf).__dict__
