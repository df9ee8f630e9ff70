"""Address and network expressions against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from netsight.functions.indicators import infer_ioc_type, url_hostname
from netsight.functions.ip import ip_bits, ip_canonical, network_key, parse_network


def _canonical(text):
    """Expected text; zones are invalid and mapped addresses keep the hex form."""
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    if "%" in text:
        return None
    mapped = getattr(ip, "ipv4_mapped", None)
    if mapped is not None:
        n = int(mapped)
        return f"::ffff:{n >> 16:x}:{n & 0xffff:x}"
    return str(ip)


def _random_texts(seed):
    rnd = random.Random(seed)
    out = ["1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "", " 1.2.3.4", "1.2.3.4\n",
           "::", "::1", "1::", ":1", "1:", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
           "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4",
           "::1.2.3.4", "1.2.3.4::", "::1.2.3.04", "2001:DB8::1", "fe80::1%eth0", "12345::",
           "g::1", "0:0:1:0:0:1:0:0", "0:0:0:1:0:0:0:1", "1:0:0:2:0:0:0:3", "0:0:0:0:0:0:0:0",
           "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5::1.2.3.4", "٣.1.1.1"]
    for _ in range(400):
        groups = [rnd.choice(["0", "0", "0000", f"{rnd.getrandbits(16):x}",
                              f"{rnd.getrandbits(16):04X}"]) for _ in range(8)]
        text = ":".join(groups)
        if rnd.random() < 0.5:
            cut = rnd.randrange(0, 8)
            text = ":".join(groups[:cut]) + "::" + ":".join(groups[cut + rnd.randrange(1, 4):])
        out.append(text)
        out.append(".".join(str(rnd.randrange(0, 300)) for _ in range(4)))
    return out


def test_canonical_matches_standard_library(spark):
    texts = _random_texts(7)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.c for r in df.select("t", ip_canonical(F.col("t")).alias("c")).collect()}
    assert {t: got[t] for t in texts} == {t: _canonical(t) for t in texts}


def _network_texts(seed):
    rnd = random.Random(seed)
    out = ["1.2.3.0/255.255.255.0", "1.2.3.0/0.0.0.255", "1.2.3.0/0.0.0.0", "1.2.3.0/255.255.255.255",
           "1.2.3.0/255.0.255.0", "1.2.3.4/024", "1.2.3.4/33", "1.2.3.4/", "/24", "1.2.3.4/24/8",
           "1.2.3.4", "::1", "::/0", "0.0.0.0/0", "2001:db8::/129", "2001:db8::/32", "x/24",
           "1.2.3.4/-1", "1.2.3.4/ 24", "1.2.3.4/99999999999999", "::1/255.255.255.0", "1.2.3.4/255.255.255.00"]
    for _ in range(150):
        out.append(f"{ipaddress.IPv4Address(rnd.getrandbits(32))}/{rnd.randrange(0, 35)}")
        out.append(f"{ipaddress.IPv6Address(rnd.getrandbits(128))}/{rnd.randrange(0, 131)}")
    return out


def test_network_keys_decide_containment(spark):
    nets = _network_texts(3)
    rnd = random.Random(5)
    rows = []
    for text in nets:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            rows.append((text, "1.2.3.4", None, None))
            continue
        size = net.num_addresses
        first = int(net.network_address)
        make = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        top = 2 ** net.max_prefixlen
        for n in {first, first + size - 1, first + rnd.randrange(size),
                  (first + size) % top, (first - 1) % top, rnd.randrange(top)}:
            ip = make(n)
            rows.append((text, str(ip) if net.version == 4 else ip.exploded, net.prefixlen, ip in net))
    df = spark.createDataFrame(rows, "net string, ip string, len int, inside boolean")
    net = parse_network(F.col("net"))
    got = df.select(
        "*", net.alias("n"), network_key(ip_bits(F.col("ip")), net["prefix_len"]).alias("key")).collect()
    for r in got:
        if r.len is None:
            assert r.n is None, r
        else:
            assert r.n is not None and r.n.prefix_len == r.len, r
            assert (r.key == r.n.key) == r.inside, r


def test_type_inference(spark):
    cases = {
        "203.0.113.77": "ip", "0.0.0.0": "ip", "fd12:3456::9:1": "ip", "fe80::7%wan0": "ip",
        "198.18.0.0/15": "cidr", "172.20.4.0/22": "cidr", "203.0.113.64/0.0.0.63": "cidr", "198.18.4.0/023": "cidr", "fd12::/16": "cidr",
        "left/right": None, "mail.shop-7.test": "domain", "x-9.org": "domain", "*.shop-7.test": "domain",
        "shop-7.test.": "domain", "10.20": "domain", "7.7.7.7.7.7": "domain", "gateway": None,
        "http://shop-7.test/": "url", "https://cdn.shop-7.test/a/b.js?v=3#top": "url",
        " ": None, "two words": None, "256.0.0.1": None, "1.300.1.1": None,
        "\t'203.0.113.77'": "ip", '"shop-7.test" ': "domain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.t for r in df.select("v", infer_ioc_type(F.col("v")).alias("t")).collect()}
    assert got == cases


def test_url_hostname(spark):
    cases = {"https://cdn.shop-7.test/a?b=/c": "cdn.shop-7.test", "ftp://n1.n2:2121": "n1.n2:2121", "HTTPS://Who@Shop#part": "Who@Shop",
             "http://shop-7.test?x": "shop-7.test", "shop-7.test/a": None, "//shop-7.test": None, "http://": None, "http://?q": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.h for r in df.select("v", url_hostname(F.col("v")).alias("h")).collect()}
    assert got == cases
