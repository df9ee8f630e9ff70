"""Syslog line fields as column expressions."""

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsight.constants import (
    ACTION_PATTERN, DAEMON_PATTERN, DHCP_ACK_PATTERN, DNS_QUERY_PATTERN, FACILITY_NAMES,
    FIELD_PATTERN, HEADER_PATTERN, LINE_END_PATTERN, MONTH_NAMES, PID_PATTERN, SEVERITY_NAMES,
    TAG_PATTERN, WS_CHARS)
from netsight.functions.ip import ip_canonical
from netsight.functions.text import let, lstrip, nullif_empty


def raw_text(line: Column) -> Column:
    return F.regexp_replace(line, LINE_END_PATTERN, "")


def _split_by_groups(text: Column, pattern: str, groups: int) -> Column:
    """Groups of a whole-text match as an array, NULL when the text does not match.

    One regular-expression pass: the text is rewritten as its groups joined by
    line feeds. All groups but the last hold no white space, so cutting at the
    first ``groups - 1`` line feeds is exact, and a match always changes the text.
    """
    joined = F.regexp_replace(text, pattern, "\n".join(f"${i}" for i in range(1, groups + 1)))
    return let(joined, lambda j: F.when(j != text, F.split(j, "\n", groups)))


def header_parts(raw: Column) -> Column:
    """``[pri, month, day, hour, minute, second, host, rest]`` or NULL without a header."""
    return _split_by_groups(raw, HEADER_PATTERN, 8)


def month_number(name: Column) -> Column:
    position = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), name)
    return F.when(position > 0, position.cast("int"))


def facility_name(pri: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, FACILITY_NAMES)), F.floor(pri / 8).cast("int") + 1)


def severity_name(pri: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, SEVERITY_NAMES)), pri % 8 + 1)


def header_clock(parts: Column, now: Column) -> Column:
    """Date and time of a header as a struct.

    ``known_month``; ``possible``: a real date and time in a leap year, so that 29
    February passes; ``local``: zone-less time with its year taken from ``now``,
    NULL when that year has no such day. A time more than a day ahead belongs to
    the year before, one more than 365 days back to the year after.
    """

    def make(year: Column, n: Column) -> Column:
        in_range = (n["h"] <= 23) & (n["mi"] <= 59) & (n["s"] <= 59)
        return F.when(in_range, F.try_make_timestamp_ntz(
            year, n["mon"], n["d"], n["h"], n["mi"], n["s"].cast("decimal(16,6)")))

    def shift(local: Column) -> Column:
        return (F.when(local > now + F.expr("INTERVAL 1 DAY"), -1)
                .when(local < now - F.expr("INTERVAL 365 DAYS"), 1).otherwise(0))

    def build(n: Column) -> Column:
        year = F.year(now)
        return F.struct(
            n["mon"].isNotNull().alias("known_month"),
            make(F.lit(2000), n).isNotNull().alias("possible"),
            let(make(year, n), lambda t: F.when(shift(t) == 0, t).otherwise(
                make(year + shift(t), n))).alias("local"))

    number = lambda i, name: parts[i].try_cast("int").alias(name)
    numbers = F.struct(month_number(parts[1]).alias("mon"), number(2, "d"), number(3, "h"),
                       number(4, "mi"), number(5, "s"))
    return F.when(parts.isNotNull(), let(numbers, build))


def zone_or_utc(tz: str) -> str:
    """The zone name when it is known, else UTC."""
    try:
        ZoneInfo(tz)
        return tz
    except (KeyError, ValueError, OSError):
        return "UTC"


def local_to_utc(local: Column, tz: str) -> Column:
    """Zone-less local time to an instant; the session time zone is UTC."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone_or_utc(tz))


def without_repeated_host(rest: Column, host: Column) -> Column:
    doubled = F.startswith(rest, F.concat(host, F.lit(" ")))
    return F.when(doubled, F.substr(rest, F.length(host) + 2)).otherwise(rest)


def tag_parts(rest: Column) -> Column:
    """``[tag, msg]`` or NULL when the text does not start with a tag."""
    return _split_by_groups(rest, TAG_PATTERN, 2)


def without_pid(tag: Column) -> Column:
    return F.regexp_replace(tag, PID_PATTERN, "")


def hidden_daemon(tag: Column, msg: Column) -> Column:
    """Text at the head of ``msg`` that names the daemon behind a device-id tag."""
    device = tag.contains(",") | tag.contains("+")
    return F.when(device, nullif_empty(F.regexp_extract(msg, DAEMON_PATTERN, 0)))


def daemon_name(head: Column) -> Column:
    return F.regexp_extract(head, DAEMON_PATTERN, 1)


def after_head(msg: Column, head: Column) -> Column:
    return lstrip(F.substr(msg, F.length(head) + 1))


def key_values(msg: Column) -> Column:
    """Struct of the arrays ``k`` and ``v`` of all key=value fields, the last field first."""
    found = F.reverse(F.regexp_extract_all(msg, F.lit(FIELD_PATTERN), F.lit(0)))
    side = lambda pair, i: F.trim(F.substring_index(pair, "=", i), F.lit(WS_CHARS))
    pairs = let(found, lambda all_: F.struct(
        F.transform(all_, lambda pair: side(pair, 1)).alias("k"),
        F.transform(all_, lambda pair: side(pair, -1)).alias("v")))
    return F.when(msg.contains("="), pairs)


def last_value(pairs: Column, key: str) -> Column:
    position = F.nullif(F.array_position(pairs["k"], key), F.lit(0))
    return F.try_element_at(pairs["v"], position.cast("int"))


def firewall_action(tag: Column, msg: Column, pairs: Column) -> Column:
    flow_keys = F.array(*map(F.lit, ["SRC", "DST", "IN", "OUT"]))
    has_flow = F.arrays_overlap(pairs["k"], flow_keys)
    return F.when((F.coalesce(tag, F.lit("kernel")) == "kernel") & has_flow,
                  nullif_empty(F.regexp_extract(msg, ACTION_PATTERN, 1)))


def dns_query_name(tag: Column, msg: Column) -> Column:
    return F.when(tag == "dnsmasq", nullif_empty(F.regexp_extract(msg, DNS_QUERY_PATTERN, 1)))


def dns_querier(tag: Column, msg: Column) -> Column:
    return F.when(tag == "dnsmasq", nullif_empty(F.regexp_extract(msg, DNS_QUERY_PATTERN, 2)))


def dhcp_client_name(tag: Column, msg: Column) -> Column:
    return F.when(tag == "dnsmasq-dhcp", nullif_empty(F.regexp_extract(msg, DHCP_ACK_PATTERN, 1)))


def canonical_all(*texts: Column) -> Column:
    """Canonical form of several addresses, through one copy of the expression."""
    return F.transform(F.array(*texts), ip_canonical)


def port_number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
