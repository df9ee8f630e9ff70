"""Matcher: golden rows, brute force over random inputs, and plan shape."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netsight.operators import match as M

# Each rule: an indicator, and the event values it must and must not meet, with the text of the match.
CASES = [
    ("ip", "198.18.7.7", "address", {"198.18.7.7": "198.18.7.7", "198.18.7.70": None, "": None}),
    ("ip", "198.18.7.7", "address", {}),  # a second feed lists it too
    ("ip", "2001:db8:40::9", "address", {"2001:db8:40::9": "2001:db8:40::9", "2001:db8:40::99": None}),
    ("ip", "2001:DB8:40::9", "address", {}),  # texts must be equal, so this one never matches
    ("cidr", "198.19.4.130/25", "address", {"198.19.4.128": "198.19.4.128", "198.19.4.255": "198.19.4.255", "198.19.4.127": None}),
    ("cidr", "172.30.5.64/255.255.255.192", "address", {"172.30.5.100": "172.30.5.100", "172.30.5.1": None}),
    ("cidr", "2001:db8:80::/42", "address", {"2001:db8:bf::1": "2001:db8:bf::1", "2001:db8:c0::1": None}),
    ("cidr", "2001:db8:99::5/128", "address", {"2001:db8:99::5": "2001:db8:99::5"}),
    ("cidr", "198.19.0.0 to 198.19.9.9", "address", {}),
    ("domain", "Trap.invalid", "host", {"trap.invalid": "trap.invalid", "Deep.TRAP.invalid..": "deep.trap.invalid",
                                        "mousetrap.invalid": None, "trap.invalid.:53": None, "invalid": None}),
    ("domain", "*.wild.invalid", "host", {"a.wild.invalid": None}),
    ("domain", "dot.invalid.", "host", {"dot.invalid": None}),
    ("url", "ftp://files.invalid/k?q", "host", {"files.invalid:2121": "files.invalid", "www.files.invalid": "www.files.invalid"}),
    ("url", "http://port.invalid:8080/", "host", {"port.invalid:8080": None}),  # the port stays in the key, and is cut from the event
    ("url", "files.invalid/only/path", "host", {}),
]
MEETS_TOO = {"2001:db8:99::5": ["2001:db8:80::/42"], "2001:db8:40::9": [], "198.18.7.7": ["198.18.7.7"]}
ROWS = [(i, 50 + i % 4, f"feed {i % 4}", kind, value) for i, (kind, value, _, _) in enumerate(CASES)]
IND = "ioc_id long, feed_id int, feed_name string, type string, value string"
EV = "id long, src_ip string, dst_ip string, hostname string"
EVENTS, EXPECTED = [(0, None, None, None)], set()
for _i, (_, _value, _side, _values) in enumerate(CASES):
    for _text, _match in _values.items():
        for _column in ("src", "dst") if _side == "address" else ("host",):
            _id = len(EVENTS)
            EVENTS.append((_id, *(_text if _column == c else None for c in ("src", "dst", "host"))))
            if _match is not None:
                _others = [j for j, c in enumerate(CASES) if j != _i and c[1] in MEETS_TOO.get(_text, [])]
                EXPECTED |= {(_id, j, _column, _match) for j in (_i, *_others)}


def _hits(df):
    rows = [(r.event_id, r.ioc_id, r.match_type, r.matched_value) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("one_pass", [True, False])
def test_golden_rows(spark, one_pass):
    snapshot = M.prepare_snapshot(spark.createDataFrame(ROWS, IND))
    events = spark.createDataFrame(EVENTS, EV)
    assert _hits(M.match_events(events, snapshot, one_pass=one_pass)) == EXPECTED


def test_search_over_all_prefix_lengths_equals_probes(spark):
    rng = random.Random(5)
    nets = [f"2001:db8:{rng.getrandbits(16):x}::{rng.getrandbits(16):x}/{n}" for n in range(129) for _ in range(2)]
    nets += [f"198.18.{rng.randrange(4)}.{rng.randrange(256)}/{n}" for n in range(33) for _ in range(3)]
    rows = [(i, i % 3, "f", "cidr", v) for i, v in enumerate(nets)] + [(900, 1, "f", "ip", "198.18.1.1"), (901, 1, "f", "domain", "x.test")]
    some = [str(ipaddress.ip_network(v, strict=False)[0]) for v in nets] + [f"198.18.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(60)]
    events = spark.createDataFrame([(i, a, rng.choice(some), "a.x.test") for i, a in enumerate([*some, "203.0.113.9", "::1"])], EV)
    indicators = spark.createDataFrame(rows, IND)
    searched, probed = M.prepare_snapshot(indicators), M.prepare_snapshot(indicators, probed_lengths=200)
    assert searched.nodes is not None and probed.nodes is None
    hits = _hits(M.match_events(events, searched))
    assert hits == _hits(M.match_events(events, probed)) and len(hits) > 1000
    # look-ups for each address: 8 for 129 lengths, where probes take one for each
    assert max(map(len, M.marker_lengths(list(range(129))).values())) <= 8
    values = events.selectExpr("src_ip AS value", "'ip' AS match_type").distinct()
    assert M.probe_keys(values, probed.prefix_lens).count() > 10 * 8 * values.filter("value LIKE '%:%'").count()


def test_added_keys_give_what_a_full_match_adds(spark):
    indicators, events = spark.createDataFrame(ROWS, IND), spark.createDataFrame(EVENTS, EV).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    before = M.prepare_snapshot(indicators.filter("ioc_id % 3 <> 0"))
    now = M.prepare_snapshot(indicators)
    old = M.match_events(events, before)
    fresh = M.retro_scan_added(M.stored_values(events), M.added_keys(now, before), old.limit(0), F.current_timestamp())
    assert _hits(fresh) == EXPECTED - _hits(old) and _hits(old)
    # an indicator that was active before has its detections already
    assert _hits(M.retro_scan_added(M.stored_values(events), M.added_keys(now, before), M.match_events(events, now), F.current_timestamp())) == set()


def test_reference_counts(spark):
    got = {r.type: r.n_refs for r in M.reference_counts(spark.createDataFrame(ROWS, IND)).collect()}
    assert got == {"ip": 4, "cidr": 4, "domain": 3, "url": 2}


def test_random_against_brute_force(spark):
    rnd = random.Random(11)
    v4 = lambda: f"10.{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(256)}"
    v6 = lambda: str(ipaddress.IPv6Address((0x20010db8 << 96) + rnd.getrandbits(6) * (1 << 64) + rnd.getrandbits(4)))
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5)))
    inds, events = [], []
    for i in range(300):
        kind = rnd.choice(["ip", "cidr", "domain", "url"])
        value = {"ip": lambda: rnd.choice([v4, v6])(),
                 "cidr": lambda: rnd.choice([f"{v4()}/{rnd.randrange(0, 33)}", f"{v6()}/{rnd.randrange(0, 129)}"]),
                 "domain": lambda: host().upper(), "url": lambda: f"http://{host()}/p"}[kind]()
        inds.append((i, i % 7, f"f{i % 7}", kind, value))
    for i in range(400):
        # a third of the events share one source
        src = "10.0.0.1" if i % 3 == 0 else rnd.choice([v4, v6])()
        events.append((i, src, rnd.choice([v4(), None]), rnd.choice([host(), None])))
    expected = set()
    for eid, src, dst, name in events:
        for iid, _, _, kind, value in inds:
            for side, ip in (("src", src), ("dst", dst)):
                if ip and (kind == "ip" and value == ip or kind == "cidr" and
                           ipaddress.ip_address(ip) in ipaddress.ip_network(value, strict=False)):
                    expected.add((eid, iid, side, ip))
            target = value.lower() if kind == "domain" else value[7:-2] if kind == "url" else None
            if name and target and (name == target or name.endswith("." + target)):
                expected.add((eid, iid, "host", name))
    snapshot = M.prepare_snapshot(spark.createDataFrame(inds, IND))
    df = spark.createDataFrame(events, EV)
    assert _hits(M.match_events(df, snapshot, one_pass=True)) == expected
    assert _hits(M.match_events(df, snapshot, one_pass=False)) == expected


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loop_and_no_python(spark, tmp_path):
    spark.createDataFrame(ROWS, IND).write.parquet(str(tmp_path / "inds"))
    spark.createDataFrame(EVENTS, EV).write.parquet(str(tmp_path / "events"))
    snapshot = M.prepare_snapshot(spark.read.parquet(str(tmp_path / "inds")))
    events = spark.read.parquet(str(tmp_path / "events"))
    for one_pass in (True, False):
        plan = _plan(M.match_events(events, snapshot, one_pass=one_pass))
        for bad in ("NestedLoop", "CartesianProduct", "Python"):
            assert bad not in plan
        assert "ReadSchema: struct<id:bigint,src_ip:string,dst_ip:string,hostname:string>" in plan
    plan = _plan(M.match_events(events, snapshot, one_pass=True))
    assert "SortMergeJoin" not in plan


def test_a_hot_address_does_not_need_adaptive_execution(spark):
    """Half of the events share one address; all joins are shuffled and no plan is changed at run time."""
    hot = [(i, "198.18.7.7", None, None) for i in range(100, 400)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        snapshot = M.prepare_snapshot(spark.createDataFrame(ROWS, IND))
        for one_pass in (True, False):
            df = M.match_events(spark.createDataFrame(EVENTS + hot, EV), snapshot, one_pass=one_pass)
            assert "SortMergeJoin" in _plan(df) or "ShuffledHashJoin" in _plan(df)
            assert _hits(df) == EXPECTED | {(e, i, "src", "198.18.7.7") for e, *_ in hot for i in (0, 1)}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_a_retro_scan_opens_the_days_of_its_window_only(spark, tmp_path):
    spark.createDataFrame(EVENTS, EV).withColumn("ts", F.expr("timestamp'2031-01-05 00:00:00' - make_dt_interval(cast(id as int))")) \
        .withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(str(tmp_path / "ev"))
    events = spark.read.parquet(str(tmp_path / "ev"))
    recent = M.retro_candidates(events, F.lit("2031-01-05 00:00:00").cast("timestamp"), 72, None)
    assert "PartitionFilters: [isnotnull(event_date" in _plan(recent)
    assert {r.id for r in recent.collect()} == {0, 1, 2, 3}


def test_insert_and_retro_scan(spark):
    hit = "event_id long, ioc_id long, match_type string"
    hits = spark.createDataFrame([(1, 1, "src"), (1, 1, "src"), (1, 2, "src"), (2, 1, "dst")], hit)
    stored = spark.createDataFrame([(1, 2, "src")], hit)
    got = {tuple(r) for r in M.new_detections(hits, stored).select("event_id", "ioc_id", "match_type").collect()}
    assert got == {(1, 1, "src"), (2, 1, "dst")}

    events = spark.createDataFrame(EVENTS, EV).withColumn(
        "ts", F.expr("timestamp'2026-01-02 00:00:00' - make_dt_interval(0, cast(id as int) * 2)"))
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    snapshot = M.prepare_snapshot(spark.createDataFrame(ROWS, IND))
    empty = spark.createDataFrame([], hit)
    # 24 hours back reaches event 12; the watermark hides events 1 to 3
    found = _hits(M.retro_scan(events, empty, snapshot, now, 24, 3))
    assert found == {h for h in EXPECTED if 3 < h[0] <= 12}
    assert _hits(M.retro_scan(events, empty, snapshot, now, 24, None)) == {h for h in EXPECTED if h[0] <= 12}
    assert M.next_watermark(events, now, 24, 3).first()[0] == 12
    assert M.next_watermark(events, now, 24, 99).first()[0] == 99


def test_new_detections_make_only_what_is_not_stored_distinct(spark):
    rows = [(e, i, t, f"v{e}") for e in (1, 2, None) for i in (8, 16) for t in ("src", "host")]
    hits = spark.createDataFrame([*rows, *rows[:5]], "event_id long, ioc_id long, match_type string, matched_value string")
    stored = hits.filter("match_type = 'src' AND event_id = 1")
    got = M.new_detections(hits, stored)
    want = sorted((r for r in rows if not (r[0] == 1 and r[2] == "src")), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    plan = M.new_detections(hits.hint("merge"), stored.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") < plan.index("SortMergeJoin") and "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_one_pass_shares_probes_between_lengths(spark):
    rng = random.Random(9)
    nets = [f"198.18.{rng.randrange(3)}.{rng.randrange(256)}/{n}" for n in range(33) for _ in range(6)] + [f"2001:db8::{i:x}/{n}" for i in range(3) for n in (64, 66, 127, 128)]
    indicators = spark.createDataFrame([(i, i % 3, "f", "cidr", v) for i, v in enumerate(nets)] + [(900, 1, "f", "ip", "198.18.1.1"), (901, 1, "f", "url", "http://x.test/")], IND)
    some = [str(ipaddress.ip_network(v, strict=False)[-1]) for v in nets] + [f"198.18.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(80)] + ["0.0.0.0", "255.255.255.255", "198.18.1.1"]
    events = spark.createDataFrame([(i, a, rng.choice(some), "a.x.test") for i, a in enumerate(some)], EV)
    snapshot = M.prepare_snapshot(indicators, probed_lengths=200)
    expected = {(i, j, k) for i, s, d, _ in map(tuple, events.collect()) for k, a in (("src", s), ("dst", d)) for j, v in enumerate(nets)
                if ipaddress.ip_address(a).version == ipaddress.ip_network(v, strict=False).version and ipaddress.ip_address(a) in ipaddress.ip_network(v, strict=False)}
    hits = _hits(M.match_events(events, snapshot, one_pass=True))
    assert {(i, j, k) for i, j, k, _ in hits if j < 900} == expected and hits == _hits(M.match_events(events, snapshot))
    values = M.event_values(events).filter("value NOT LIKE '%:%' AND match_type <> 'host'")
    assert M.grouped_probes(values, snapshot).count() == 12 * values.count()  # 33 lengths in 11, and the address
    counts = M.hit_counts(events, snapshot, F.floor(F.col("event_id") / 10))
    assert {r.part: r.n for r in counts.collect()} == {p: sum(h[0] // 10 == p for h in hits) for p in {h[0] // 10 for h in hits}}
