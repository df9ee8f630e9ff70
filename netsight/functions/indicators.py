"""Indicator values: type inference, cleaning and URL host names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsight.constants import DOMAIN_PATTERN, DOTTED_QUAD_PATTERN, URL_HOST_PATTERN
from netsight.functions.ip import is_ip, parse_network
from netsight.functions.text import clean_value, let, nullif_empty, strip


def infer_ioc_type(value: Column) -> Column:
    """``url``, ``cidr``, ``ip`` or ``domain`` for an indicator text, NULL for junk."""

    def kind(v: Column) -> Column:
        return (F.when(v.contains("://"), "url")
                .when(v.contains("/"), F.when(parse_network(v).isNotNull(), "cidr"))
                .when(is_ip(v), "ip")
                .when(v.rlike(DOTTED_QUAD_PATTERN), None)
                .when(v.rlike(DOMAIN_PATTERN), "domain"))

    return let(clean_value(value), kind)


def url_hostname(url: Column) -> Column:
    """Authority part of a URL (port and user info kept), NULL without a scheme."""
    return nullif_empty(F.regexp_extract(strip(url), URL_HOST_PATTERN, 1))


def host_key(host: Column) -> Column:
    """Lower-case host name without trailing dots."""
    return F.regexp_replace(F.lower(host), r"\.+\z", "")


def pick_column(columns: Column, index: Column) -> Column:
    """1-based pick from an array of texts: trimmed, unquoted, blank words as NULL."""
    value = clean_value(F.when(index >= 1, F.try_element_at(columns, index)))
    return F.when((value != "") & ~F.lower(value).isin("none", "null"), value)


def split_tags(text: Column) -> Column:
    """Comma list to an array of trimmed, non-empty tags; NULL when none is left."""
    tags = F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")
    return F.when(F.size(tags) > 0, tags)
