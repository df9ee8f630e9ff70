"""Traffic buckets and display scalars."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsight.constants import SYSTEM_TAGS


def bucket_of(tag: Column, action: Column) -> Column:
    """Display bucket of an event, decided by its daemon tag and firewall action."""
    tag = F.lower(F.coalesce(tag, F.lit("")))
    action = F.upper(F.coalesce(action, F.lit("")))
    mentions = lambda *words: F.array_contains(
        F.array(*[action.contains(w) for w in words]), True)
    firewall = (F.when(mentions("DPIA", "IPS"), "IPS / DPIA")
                .when(mentions("DROP", "REJECT"), "Firewall · DROP")
                .when(mentions("ACCEPT", "ALLOW"), "Firewall · ACCEPT")
                .when(action != "", "Firewall · Rule")
                .otherwise("Kernel"))
    return (F.when((tag == "kernel") | ((tag == "") & (action != "")), firewall)
            .when(tag == "dnsmasq-dhcp", "DHCP")
            .when(tag == "dnsmasq", "DNS")
            .when(tag == "hostapd", "WLAN")
            .when(tag == "pppd", "WAN")
            .when(tag.isin(*SYSTEM_TAGS), "System")
            .otherwise("Other"))


def utc_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ssZ``; the session time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss'Z'")


def age_text(ts: Column, now: Column) -> Column:
    """Relative age, never negative: seconds, minutes, hours, then days."""
    seconds = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000))
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return (F.when(seconds < 60, F.concat(whole(1), F.lit("s ago")))
            .when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
            .when(seconds < 86400, F.concat(whole(3600), F.lit("h ago")))
            .otherwise(F.concat(whole(86400), F.lit("d ago"))))


def ticker_label(src_ip: Column, dst_ip: Column, hostname: Column, msg: Column) -> Column:
    """``source→destination`` when a source is known, else the head of the message."""
    source = F.coalesce(src_ip, hostname)
    arrow = F.coalesce(F.concat(F.lit("→"), dst_ip), F.lit(""))
    return F.when(source.isNotNull(), F.concat(source, arrow)) \
        .otherwise(F.left(F.coalesce(msg, F.lit("")), F.lit(34)))


def percent_share(n: Column, total: Column) -> Column:
    """Whole percent, halves rounded up; 0 when the total is 0."""
    return F.when(total > 0, F.floor(n / total * 100 + 0.5)).otherwise(0).cast("int")
