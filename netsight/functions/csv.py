"""Delimited text as column expressions, with the rules of the common CSV dialect.

A field is quoted only when its first character is the quote; inside, a doubled
quote is a quote, and line ends are data. Text after the closing quote is kept.
What has no quote anywhere is plainly split, which gives the same and is much faster.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsight.functions.text import let


def _delimiter(delimiter: Column) -> Column:
    return F.concat(F.lit(r"\x{"), F.hex(F.ascii(delimiter)), F.lit("}"))


def _field(delimiter: Column) -> Column:
    """Pattern of one field; possessive loops keep long fields off the stack."""
    d = _delimiter(delimiter)
    return F.concat(F.lit(r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^\r\n'), d, F.lit(r']*+|\z)|[^"\r\n'), d,
                    F.lit(r'][^\r\n'), d, F.lit(r']*+|)'))


def _records(text: Column, delimiter: Column, group: int) -> Column:
    field, d = _field(delimiter), _delimiter(delimiter)
    record = F.concat(F.lit("("), field, F.lit("(?:"), d, field, F.lit(r")*+)(\r*\n|\r+|\z)"))
    found = F.regexp_extract_all(text, record, F.lit(group))
    # the last match is the empty one at the end of the text
    return let(found, lambda m: F.slice(m, F.lit(1), F.size(m) - 1))


def _plain(text: Column) -> Column:
    return ~text.contains('"')


def csv_records(text: Column, delimiter: Column) -> Column:
    """Array of records as raw text without their line ends; a blank line is a record."""
    split = let(F.split(text, r"\r*\n|\r+"), lambda m: F.when(
        F.element_at(m, -1) == "", F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m))
    return F.when(_plain(text), split).otherwise(_records(text, delimiter, 1))


def has_bare_return(text: Column, delimiter: Column) -> Column:
    """True when a carriage return ends a record inside a line, which the dialect refuses."""
    ends = F.when(text.rlike(r"\r[^\r\n]"), _records(text, delimiter, 2))
    return F.coalesce(let(ends, lambda e: F.exists(
        F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), lambda r: r.endswith("\r"))), F.lit(False))


def first_field(record: Column, delimiter: Column) -> Column:
    quoted = F.call_function("regexp_extract", record, F.concat(F.lit("^"), _field(delimiter)), F.lit(0))
    return F.when(_plain(record), F.split_part(record, delimiter, F.lit(1))).otherwise(quoted)


def _unquoted(field: Column) -> Column:
    part = lambda i: F.regexp_extract(field, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)\z', i)
    inner, rest = part(1), part(2)
    return F.when(field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)) \
        .otherwise(field)


def csv_fields(record: Column, delimiter: Column) -> Column:
    """Fields of one record, unquoted."""
    pattern = F.concat(_delimiter(delimiter), F.lit("("), _field(delimiter), F.lit(")"))
    found = F.regexp_extract_all(F.concat(delimiter, record), pattern, F.lit(1))
    return (F.when(_plain(record) & (delimiter == ","), F.split(record, ","))
            .when(_plain(record), F.split(record, _delimiter(delimiter)))
            .otherwise(F.transform(found, _unquoted)))
