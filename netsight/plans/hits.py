"""Detections by their ids without storing them: made when a page asks, for the events it needs.

Stored detections are numbered by event, indicator and match type. The hits of each block of
consecutive events, counted once (``match.hit_counts``), therefore tell which events hold an id,
and only these are matched. There may be many more detections than events and indicators; the
counts are at most ``BLOCKS``, so they come to the driver.
"""

from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.operators.match import DETECTION_KEY, Snapshot, hit_counts, match_events
from netsight.sources.commits import LogTable

BLOCKS, LEAST = 4096, 1024


class HitTable:
    """What ``append_detections`` would store of ``events`` under ``snapshot``, with the same ids."""

    def __init__(self, events: LogTable, snapshot: Snapshot, created_at: str = "received_at", least: int = LEAST):
        self.events, self.snapshot, self.created_at, self.least = events, snapshot, created_at, least

    @cached_property
    def size(self) -> int:
        """Events of a block."""
        return max(self.least, -(-max((f.bounds["id"][1] for f in self.events.files()), default=0) // BLOCKS))

    def block_of(self, event_id: Column) -> Column:
        return F.floor((event_id - 1) / self.size).cast("bigint")

    @cached_property
    def ends(self) -> list[int]:
        """The largest id in each block; an empty one has that of the block before."""
        counts = hit_counts(self.events.all(), self.snapshot, self.block_of(F.col("event_id")))
        found = {r["part"]: r["n"] for r in counts.collect()}
        return list(accumulate(found.get(b, 0) for b in range(max(found, default=-1) + 1)))

    @property
    def largest_id(self) -> int:
        return self.ends[-1] if self.ends else 0

    def of_events(self, events: DataFrame) -> DataFrame:
        """The detections of these events, without ids."""
        return match_events(events, self.snapshot, F.col(self.created_at), one_pass=True)

    def in_blocks(self, blocks: list[int]) -> DataFrame:
        """The detections of all events of some blocks, with ids."""
        spans = [(b * self.size + 1, (b + 1) * self.size) for b in blocks]
        low, high = (min(a for a, _ in spans), max(b for _, b in spans)) if spans else (0, -1)
        files = [f for f in self.events.files(low, high) if any(f.meets("id", a, b) for a, b in spans)] if spans else []
        part = self.block_of(F.col("id"))
        events = self.events.read(files).filter(F.col("id").between(low, high))
        if len(blocks) < high // self.size - low // self.size:
            events = events.filter(part.isin(blocks))
        before = events.sparkSession.createDataFrame([(b, self.ends[b - 1] if b else 0) for b in blocks], "_part bigint, _before bigint")
        hits = self.of_events(events).withColumn("_part", self.block_of(F.col("event_id"))).join(F.broadcast(before), "_part")
        number = F.row_number().over(Window.partitionBy("_part").orderBy(*DETECTION_KEY))
        return hits.select((F.col("_before") + number).alias("id"), *[c for c in hits.columns if not c.startswith("_")])

    def with_ids(self, ids: list[int]) -> DataFrame:
        blocks = sorted({bisect_left(self.ends, i) for i in ids if 0 < i <= self.largest_id})
        return self.in_blocks(blocks).filter(F.col("id").isin(ids))

    def with_events(self, event_ids: list[int]) -> DataFrame:
        blocks = sorted({(i - 1) // self.size for i in event_ids})
        return self.in_blocks([b for b in blocks if 0 <= b < len(self.ends)]).filter(F.col("event_id").isin(event_ids))

    def above(self, after_id: int, limit: int) -> DataFrame:
        """Detections above an id: the next ``limit`` of them at least."""
        low, high = max(0, after_id) + 1, min(max(0, after_id) + limit, self.largest_id)
        blocks = range(bisect_left(self.ends, low), bisect_left(self.ends, high) + 1) if low <= high else []
        return self.in_blocks(list(blocks)).filter(F.col("id") > after_id)

    def steps(self, k: int) -> Iterator[tuple[DataFrame, bool]]:
        """(the newest rows, whether these are all): ``k`` rows or more, then four times as many, and so on."""
        while True:
            first = bisect_left(self.ends, max(1, self.largest_id - k + 1))
            yield self.in_blocks(list(range(first, len(self.ends)))), self.largest_id <= k
            if self.largest_id <= k:
                return
            k *= 4
