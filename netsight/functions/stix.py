"""STIX patterns and objects as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsight.constants import STIX_EQUALS_PATTERN, STIX_IN_PATTERN, STIX_KINDS
from netsight.functions.text import strip, strip_quotes


def pattern_values(pattern: Column) -> Column:
    """Array of ``(kind, value)``: all ``=`` comparisons first, then all ``IN`` lists."""
    group = lambda regex, i: F.regexp_extract_all(pattern, F.lit(regex), F.lit(i))
    pair = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    equal = F.zip_with(group(STIX_EQUALS_PATTERN, 1), group(STIX_EQUALS_PATTERN, 2), pair)

    def members(kind: Column, inside: Column) -> Column:
        items = F.filter(F.transform(F.split(inside, ","), strip), lambda v: v != "")
        return F.transform(items, lambda v: pair(kind, strip_quotes(v)))

    lists = F.zip_with(group(STIX_IN_PATTERN, 1), group(STIX_IN_PATTERN, 2), members)
    return F.concat(equal, F.flatten(lists))


def ioc_type_of_kind(kind: Column) -> Column:
    """Indicator type of an observable kind, NULL for any other text."""
    result = F.lit(None).cast("string")
    for name, ioc_type in STIX_KINDS.items():
        result = F.when(kind == name, ioc_type).otherwise(result)
    return result


def first_reference_url(references: Column) -> Column:
    urls = F.filter(references, lambda r: F.coalesce(r["url"], F.lit("")) != "")
    return F.try_element_at(urls, F.lit(1))["url"]


def truthy(text: Column) -> Column:
    """JSON scalar as text, NULL where it counts as no value."""
    return F.when(~text.isin("", "0", "0.0", "false"), text)
