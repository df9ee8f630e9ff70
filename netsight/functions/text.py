"""Small text helpers shared by the parsers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsight.constants import WS


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Cut white space (Unicode meaning) from both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+", "")


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["']+|["']+\z""", "")


def clean_value(c: Column) -> Column:
    """Trim, then cut quotes from both ends."""
    return strip_quotes(strip(c))


def nullif_empty(c: Column) -> Column:
    return let(c, lambda v: F.when(v != "", v))


def computed_once(df, name: str, value: Column):
    """``df.withColumn`` through a generator of one row.

    Filters on ``name`` then run on the finished value instead of being pushed
    down with a second copy of a costly expression.
    """
    return df.withColumn(name, F.explode(F.array(value)))
