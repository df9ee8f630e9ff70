"""The stored tables behind the served queries, built once per session and input folder."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.operators.match import Snapshot, active_indicators, match_events, prepare_snapshot
from netsight.plans.hits import HitTable
from netsight.session import prepare, work_path
from netsight.sources import derived, trigrams
from netsight.sources.commits import LogTable
from netsight.sources.storage import append_detections, append_events, detections_table, events_table

_open: dict[tuple[str, str], "StoredTables"] = {}


class StoredTables:
    """Feeds, indicators, events and detections as Parquet tables in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.root = work_path(spark, "tables")

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def feeds(self) -> DataFrame:
        return self._written("feeds", derived.feeds(self.spark, self.sf_dir))

    @cached_property
    def iocs(self) -> DataFrame:
        return self._written("iocs", derived.iocs(self.spark, self.sf_dir))

    @cached_property
    def indicators(self) -> DataFrame:
        return active_indicators(self.iocs, self.feeds)

    @cached_property
    def snapshot(self) -> Snapshot:
        return prepare_snapshot(self.indicators, persist=True)

    @cached_property
    def events(self) -> DataFrame:
        path = f"{self.root}/events"
        append_events(derived.syslog_lines(self.spark, self.sf_dir), path)
        return self.spark.read.parquet(path)

    @cached_property
    def detections(self) -> DataFrame:
        path = f"{self.root}/detections"
        append_detections(match_events(self.events, self.snapshot, F.col("received_at")), path)
        return self.spark.read.parquet(path)

    @property
    def event_log(self) -> LogTable:
        """The events by their commit log, for pages and look-ups."""
        self.events  # noqa: B018
        return events_table(self.spark, f"{self.root}/events")

    @cached_property
    def event_terms(self) -> DataFrame:
        """Trigram postings of the events."""
        path = f"{self.root}/terms"
        trigrams.write_postings(self.events, path)
        return self.spark.read.schema(trigrams.POSTINGS).parquet(path)

    @cached_property
    def hits(self) -> HitTable:
        """The detections for pages: the same rows and ids, none of them stored."""
        return HitTable(self.event_log, self.snapshot)

    @property
    def detection_log(self) -> LogTable:
        self.detections  # noqa: B018
        return detections_table(self.spark, f"{self.root}/detections")


def stored(spark: SparkSession, sf_dir: str) -> StoredTables:
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = StoredTables(spark, sf_dir)
    return _open[key]
