"""A trigram posting table beside stored events, for free-text search.

A row says that a run of three characters occurs in the searched texts of some event of a block of
``BLOCK`` consecutive ids. A search looks up the trigrams of its literal parts, intersects their
blocks, and tests the events of these blocks alone. Postings are sorted by trigram, so a look-up
opens few row groups. Blocks of ids are counted, not events: a common trigram has one row a block.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.functions.ip import ip_search_text

BLOCK = 1024
POSTINGS = "trigram string, block bigint"


def search_text() -> Column:
    """Lower-cased texts of an event that a search looks at; no literal spans two of them."""
    return F.lower(F.concat_ws("\x00", F.col("raw"), ip_search_text(F.col("src_ip")), ip_search_text(F.col("dst_ip")), F.col("hostname")))


def block_of(event_id: Column) -> Column:
    return F.floor(event_id / BLOCK).cast("bigint")


def postings(events: DataFrame) -> DataFrame:
    """(trigram, block) of all events; equal ones are combined before they are shuffled."""
    text = F.col("text")
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))
    found = events.select(block_of(F.col("id")).alias("block"), search_text().alias("text")).filter(F.length(text) >= 3)
    return found.select("block", F.explode(F.array_distinct(runs)).alias("trigram")).distinct().select("trigram", "block")


def write_postings(events: DataFrame, path: str) -> None:
    """Append the postings of events; a block that grows later has its new ones appended."""
    (postings(events).repartitionByRange("trigram").sortWithinPartitions("trigram", "block")
     .write.mode("append").parquet(path))


def trigrams_of(q: str) -> list[str] | None:
    """The trigrams that every match of a ``like`` text must have, or None if there is none to go by.

    ``%`` and ``_`` part the text into literals. Texts with an escape, with letters beyond ASCII
    (whose cases are many) or with literals under three characters alone need a scan.
    """
    if "\\" in q or not q.isascii():
        return None
    parts = re.split("[%_]", q.lower())
    return sorted({part[i:i + 3] for part in parts for i in range(len(part) - 2)}) or None


def blocks_with(table: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block) of the blocks that have all of the trigrams, newest first."""
    return (table.filter(F.col("trigram").isin(trigrams)).groupBy("block").agg(F.count_distinct("trigram").alias("n"))
            .filter(F.col("n") == len(trigrams)).select("block").orderBy(F.desc("block")))
