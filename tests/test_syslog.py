"""Syslog lines made from the parsing rules, each with the fields it must give."""

from datetime import datetime, timezone

import pytest

from netsight.operators.ingest import accepted, parse_lines, rejected

NOW = datetime(2031, 5, 14, 18, 30, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def parse(spark):
    def run(*lines, now=NOW, tz="UTC"):
        rows = [(i, now, line) for i, line in enumerate(lines)]
        df = spark.createDataFrame(rows, "line_id long, received_at timestamp, line string")
        return [r.asDict() for r in parse_lines(df, tz).orderBy("line_id").collect()]
    return run


def fields(row, *names):
    return tuple(row[n] for n in names)


def fw(rule, **pairs):
    return f"[{rule}] " + " ".join(f"{k}={v}" for k, v in pairs.items())


def test_header_and_priority(parse):
    for pri, facility, severity in ((0, "kern", "emerg"), (11, "user", "err"), (46, "syslog", "info"),
                                    (191, "local7", "debug"), (192, None, "emerg"), (199, None, "debug")):
        row = parse(f"<{pri}>May 02 03:04:05 attic kernel: hello")[0]
        assert fields(row, "pri", "facility", "severity") == (pri, facility, severity)
        assert fields(row, "ts", "host", "tag", "msg") == (datetime(2031, 5, 2, 3, 4, 5), "attic", "kernel", "hello")
    bare = parse("May 02 03:04:05 attic kernel: hello")[0]
    assert fields(bare, "pri", "facility", "severity", "host") == (None, None, None, "attic")


def test_lines_without_header_take_the_time_of_arrival(parse):
    for line, tag, msg in (("loose words only", None, "loose words only"), ("loose words only\r\n", None, "loose words only"),
                           ("ftp://z", "ftp", "//z"), ("backup: done", "backup", "done")):
        row = parse(line)[0]
        assert fields(row, "ts", "host", "tag", "msg") == (datetime(2031, 5, 14, 18, 30), None, tag, msg)
        assert row["reject_reason"] is None and row["raw"] == line.rstrip("\r\n")


def test_packet_fields(parse):
    line = "<132>May 13 22:15:40 barn kernel: [77.5] " + fw("LAN-REJECT", IN="vlan7", OUT="", SRC="172.20.8.9", DST="198.51.100.77", PROTO="TCP", SPT=40001, DPT=8443)
    row = parse(line)[0]
    assert fields(row, "action", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "in_if", "out_if") == (
        "LAN-REJECT", "172.20.8.9", "198.51.100.77", 40001, 8443, "TCP", "vlan7", None)
    named = parse("<12>May 13 22:16:00 barn barn " + fw("GUEST_OUT-7", IN="wg0", OUT="eth5", SRC="172.21.0.2", DST="203.0.113.4", DPT=853))[0]
    assert fields(named, "host", "tag", "action", "dst_port", "in_if", "out_if") == ("barn", None, "GUEST_OUT-7", 853, "wg0", "eth5")
    device = parse("<4>May 13 22:17:00 loft 0011aabbccdd,mesh-node-2.1: kernel: [9.1] " + fw("GUEST", SRC="172.21.0.3"))[0]
    assert fields(device, "host", "tag", "action", "src_ip") == ("loft", "kernel", "GUEST", "172.21.0.3")
    assert device["msg"].startswith("[9.1] [GUEST]")
    no_rule = parse("<6>May 13 22:18:00 barn barn kernel: port [sw_unit_3]: carrier lost")[0]
    assert fields(no_rule, "tag", "action", "msg") == ("kernel", None, "port [sw_unit_3]: carrier lost")


def test_which_value_a_field_takes(parse):
    twice, before_flag, name, spaced, words, wide, mapped = parse(
        "kernel: SRC=203.0.113.1 X=y SRC=203.0.113.2 Z=w",
        "kernel: DST=203.0.113.3 ACK WINDOW=9",
        "kernel: SRC=printer.home DST=203.0.113.5 PROTO=UDP",
        "kernel: SRC = 203.0.113.6 DST\t=\t203.0.113.7",
        "kernel: SPT=70000 DPT=domain",
        "kernel: SRC=2001:0DB8:0:7:0:0:0:9 DST=2001:db8:0:0:1:0:0:1",
        "kernel: SRC=::ffff:203.0.113.8 DST=2001:db8::1::2")
    assert twice["src_ip"] == "203.0.113.2"
    assert before_flag["dst_ip"] is None
    assert fields(name, "src_ip", "dst_ip") == (None, "203.0.113.5") and "printer.home" in name["msg"]
    assert fields(spaced, "src_ip", "dst_ip") == (None, "203.0.113.7")
    assert fields(words, "src_port", "dst_port") == (70000, None)
    assert fields(wide, "src_ip", "dst_ip") == ("2001:db8:0:7::9", "2001:db8::1:0:0:1")
    assert fields(mapped, "src_ip", "dst_ip") == ("::ffff:cb00:7108", None)


def test_name_services(parse):
    lease, ask, clash, radio, dial = parse(
        "<30>May 13 08:00:00 barn dnsmasq-dhcp[77]: DHCPACK(vlan7) 172.20.8.40 02:00:5e:10:00:01 kiosk-4",
        "<30>May 13 08:00:01 barn dnsmasq[78]: query[AAAA] cams.example.org from 172.20.8.40",
        "dnsmasq: query[PTR] zone.example.org from 172.20.8.41 SRC=nothing",
        "<30>May 13 08:00:02 barn hostapd[79]: ra1: STA 02:00:5e:10:00:02 left",
        "<86>May 13 08:00:03 barn pppd[80]: remote address 203.0.113.9")
    assert fields(lease, "tag", "hostname", "src_ip") == ("dnsmasq-dhcp", "kiosk-4", None)
    assert fields(ask, "tag", "hostname", "src_ip", "dst_ip", "action") == ("dnsmasq", "cams.example.org", "172.20.8.40", None, None)
    assert fields(clash, "hostname", "src_ip") == ("zone.example.org", None)
    assert fields(radio, "tag", "msg") == ("hostapd", "ra1: STA 02:00:5e:10:00:02 left")
    assert fields(dial, "tag", "src_ip") == ("pppd", None)


def test_rejects(spark, parse):
    cases = {"": "empty", "\n": "empty", "<14>Mai 02 03:04:05 h x": "error", "<14>May 02 24:00:00 h x": "bad_timestamp",
             "<14>May 02 03:60:00 h x": "bad_timestamp", "<14>May 02 03:04:61 h x": "bad_timestamp",
             "<14>Apr 31 03:04:05 h x": "bad_timestamp", "<14>Feb 29 03:04:05 h x": "error", "fine": None}
    assert {line: row["reject_reason"] for line, row in zip(cases, parse(*cases), strict=True)} == cases
    df = spark.createDataFrame([(i, NOW, s) for i, s in enumerate(cases)], "line_id long, received_at timestamp, line string")
    parsed = parse_lines(df)
    assert accepted(parsed).count() == 1 and rejected(parsed).count() == 8
    assert rejected(parsed).columns == ["line_id", "line", "reason"]


@pytest.mark.parametrize(("stamp", "now", "year"), [
    ("Dec 30 20:00:00", (2032, 1, 2), 2031), ("Jan 03 01:00:00", (2031, 12, 31, 20), 2031),
    ("Jan 02 01:00:00", (2031, 12, 31, 20), 2031), ("Feb 29 10:00:00", (2032, 3, 5), 2032),
    ("May 15 18:29:59", (2031, 5, 14, 18, 30), 2031), ("May 15 18:30:01", (2031, 5, 14, 18, 30), 2030)])
def test_the_year_is_that_of_arrival_unless_a_day_ahead(parse, stamp, now, year):
    assert parse(f"{stamp} h x", now=datetime(*now, tzinfo=timezone.utc))[0]["ts"].year == year


@pytest.mark.parametrize(("tz", "hour"), [("UTC", 9), ("Asia/Tokyo", 0), ("America/New_York", 13), ("Nowhere/Land", 9)])
def test_header_times_are_local(parse, tz, hour):
    assert parse("May 14 09:00:00 barn x", tz=tz)[0]["ts"] == datetime(2031, 5, 14, hour)


def test_a_skipped_local_hour_moves_on(parse):
    assert parse("Mar 09 02:15:00 barn x", tz="America/New_York")[0]["ts"] == datetime(2031, 3, 9, 7, 15)
