"""IP addresses and networks as column expressions.

An address is stored as canonical text. A network is turned into a *network
key*: version, prefix length and the leading bits. An address lies in a network
exactly when the key built from the address at that prefix length is equal, so
containment becomes an equi-join.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsight.functions.text import let

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = "[0-9a-f]{1,4}"
_V6_FULL = rf"^{_GROUP}(?::{_GROUP}){{7}}\z"
_V6_SHORT = rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?\z"
_DIGITS = r"^[0-9]+\z"
_ALL_ONES = 0xFFFFFFFF


def is_v4(ip: Column) -> Column:
    return ip.rlike(rf"^{_V4}\z")


def v4_number(ip: Column) -> Column:
    """The 32 bits of a valid dotted quad as BIGINT."""
    octets = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("bigint"))
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda n, octet: n * 256 + octet)


def _hex_tail(text: Column) -> Column:
    """Rewrite a dotted-quad tail (``::ffff:1.2.3.4``) as two hex groups."""

    def join_up(parts: Column) -> Column:
        head = F.left(text, F.length(text) - F.length(parts["quad"]))
        high, low = F.hex(F.shiftright(parts["n"], 16)), F.hex(parts["n"].bitwiseAND(0xFFFF))
        return F.lower(F.concat(head, high, F.lit(":"), low))

    with_number = lambda quad: F.struct(quad.alias("quad"), v4_number(quad).alias("n"))
    tail = F.regexp_extract(text, rf"(?<=:){_V4}\z", 0)
    return F.when(text.contains("."), let(let(tail, with_number), join_up)).otherwise(text)


def v6_groups(ip: Column) -> Column:
    """Eight four-digit groups of a valid IPv6 text, else NULL.

    Zone-scoped addresses (``%eth0``) are not valid here.
    """

    def groups(text: Column) -> Column:
        side = lambda i: F.array_remove(
            F.split(F.split_part(text, F.lit("::"), F.lit(i)), ":"), "").alias(f"s{i}")

        def fill(sides: Column) -> Column:
            gap = 8 - F.size(sides["s1"]) - F.size(sides["s2"])
            return F.when(gap >= 1, F.concat(sides["s1"], F.array_repeat(F.lit("0"), gap), sides["s2"]))

        filled = (F.when(text.rlike(_V6_FULL), F.split(text, ":"))
                  .when(text.rlike(_V6_SHORT), let(F.struct(side(1), side(2)), fill)))
        return F.transform(filled, lambda g: F.lpad(g, 4, "0"))

    return F.when(ip.contains(":"), let(_hex_tail(F.lower(ip)), groups))


def v6_text(groups: Column) -> Column:
    """Canonical text: no leading zeros, first longest zero run (two or more) as ``::``."""
    plain = F.array_join(
        F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")

    def squeeze(text: Column) -> Column:
        ends = lambda c: F.when(c == "", ":").otherwise(c)
        pattern = lambda run: rf"^((?:{_GROUP}:)*?)0(?::0){{{run - 1}}}((?::{_GROUP})*)\z"
        longest = F.coalesce(*[F.when(text.rlike(pattern(run)), F.lit(pattern(run)))
                               for run in range(8, 1, -1)])
        cut = lambda p: F.concat(ends(F.call_function("regexp_extract", text, p, F.lit(1))), ends(F.call_function("regexp_extract", text, p, F.lit(2))))
        return F.coalesce(let(longest, cut), text)

    return let(plain, squeeze)


def ip_canonical(ip: Column) -> Column:
    """Canonical text of an IPv4 or IPv6 address, NULL when it is neither."""
    return F.when(is_v4(ip), ip).when(ip.contains(":"), v6_text(v6_groups(ip)))


def is_ip(ip: Column) -> Column:
    """True for any valid address text; a zone after an IPv6 address is allowed."""
    unscoped = F.regexp_replace(ip, r"(?s)%[^%]+\z", "")
    return is_v4(ip) | F.coalesce(v6_groups(unscoped).isNotNull(), F.lit(False))


def ip_version(ip: Column) -> Column:
    """4 or 6 for a canonical address text."""
    return F.when(ip.contains(":"), 6).when(ip.isNotNull(), 4)


def ip_search_text(ip: Column) -> Column:
    """Address text with its full-length mask, the form that text search looks at."""
    return F.concat(ip, F.when(ip.contains(":"), "/128").otherwise("/32"))


def ip_bits(ip: Column) -> Column:
    """Struct of the address bits: ``n`` for IPv4, ``hex`` (32 digits) for IPv6."""
    return F.struct(
        F.when(is_v4(ip), v4_number(ip)).alias("n"),
        F.array_join(v6_groups(ip), "").alias("hex"))


def network_key(bits: Column, prefix_len: Column) -> Column:
    """Key of the network of ``prefix_len`` bits that holds the address ``bits``."""
    n, digits = bits["n"], bits["hex"]
    v4 = F.concat_ws("/", F.lit("4"), prefix_len,
                     F.call_function("shiftright", n, 32 - prefix_len))
    whole, rest = F.floor(prefix_len / 4).cast("int"), prefix_len % 4
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).try_cast("int")
    part = F.when(rest > 0, F.call_function("shiftright", nibble, 4 - rest).cast("string"))
    v6 = F.concat_ws("/", F.lit("6"), prefix_len, F.left(digits, whole),
                     F.coalesce(part, F.lit("")))
    return F.when(n.isNotNull(), v4).when(digits.isNotNull(), v6)


def _v4_prefix_len(mask: Column) -> Column:
    """Length from digits, a netmask or a hostmask; NULL when it is none of them."""
    number = F.when(mask.rlike(_DIGITS), mask.try_cast("int"))
    bits = F.when(is_v4(mask), v4_number(mask))
    hole = _ALL_ONES - bits
    is_block = lambda c: c.bitwiseAND(c + 1) == 0
    return (F.when(number <= 32, number)
            .when(is_block(hole), 32 - F.bit_count(hole))
            .when(is_block(bits), 32 - F.bit_count(bits)))


def parse_network(value: Column) -> Column:
    """Struct ``(ver, prefix_len, key, bits)`` of a network text, NULL when unparsable.

    ``bits`` are those of the address as it is written. Host bits are ignored; a missing mask means the full length.
    """
    one_mask = ~F.coalesce(value.rlike("/.*/"), F.lit(False))
    parts = F.struct(
        ip_bits(F.split_part(value, F.lit("/"), F.lit(1))).alias("bits"),
        F.when(value.contains("/"), F.split_part(value, F.lit("/"), F.lit(2))).alias("mask"))

    def with_length(p: Column) -> Column:
        n, digits, mask = p["bits"]["n"], p["bits"]["hex"], p["mask"]
        v6_len = F.when(mask.rlike(_DIGITS), mask.try_cast("int"))
        length = (F.when(n.isNotNull(), F.when(mask.isNull(), 32).otherwise(_v4_prefix_len(mask)))
                  .when(digits.isNotNull(), F.when(mask.isNull(), 128).when(v6_len <= 128, v6_len)))
        return let(length.cast("int"), lambda bits_kept: F.when(bits_kept.isNotNull(), F.struct(
            F.when(n.isNotNull(), 4).otherwise(6).alias("ver"),
            bits_kept.alias("prefix_len"),
            network_key(p["bits"], bits_kept).alias("key"), p["bits"].alias("bits"))))

    return F.when(one_mask, let(parts, with_length))
