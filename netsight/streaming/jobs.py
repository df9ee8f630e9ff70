"""The live side as Structured Streaming queries.

``ingest`` parses, stores and matches each micro-batch. A run is the life of one
checkpoint, which keeps the run's name. Every batch writes only folders named after
its run and ``batch_id`` in overwrite mode, and then one commit that makes their files
part of the tables (``sources.commits``), with the state after it. A replayed batch
therefore replaces itself and changes nothing else, and one that has its commit is
skipped: the effect is exactly-once without keyed state. A new checkpoint is a new
run, whose batches count from 0 again but go on with the ids. Readers see committed
files alone. A batch whose predecessor has no commit is an error.

What a batch reads does not grow with the batches before it: the state is in the
newest commit, totals are sums of the counts that each commit adds, a new indicator
version meets stored values of the events it may still change, and small files are
merged, some each batch.

Indicators often share a key (lists name the same networks again and again), and then detections
grow with events times indicators. They are stored as runs: one row for each event value and key
that it hits, with the first of the run's ids. The indicators of a version are stored once, numbered
in the order of their keys, so that a run is a span of them. ``LiveStore.detections`` and the live
table give every detection as a row of its own again.
"""

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from netsight.constants import BUCKETS
from netsight.functions.buckets import bucket_of
from netsight.operators.ids import assign_ids, number_runs, number_stored
from netsight.operators.ingest import accepted, parse_lines, rejected
from netsight.operators.match import (
    DETECTION_KEY, Snapshot, active_indicators, added_keys, hit_runs, match_events, new_detections, prepare_snapshot, retro_scan_added, stored_values)
from netsight.operators.registry import current_version, read_version
from netsight.plans.views import with_bucket
from netsight.schemas import DETECTIONS, EVENTS, SYSLOG_LINES, fields_of
from netsight.session import path_exists, shuffles_removed, spread, stage_scope, written_once
from netsight.sources.commits import CommitLog, File, LogTable, Version
from netsight.sources.storage import json_joined, json_object, valid_text


def syslog_text_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Landed text files as a stream of lines; arrival is the time of the micro-batch."""
    text = spark.readStream.options(**options).text(path).withColumnRenamed("value", "line")
    return valid_text(text, "line").withColumn("received_at", F.current_timestamp())


def kafka_lines(messages: DataFrame) -> DataFrame:
    """Lines of a Kafka stream or batch: the ``value`` bytes, arrived at ``timestamp``."""
    return valid_text(messages.select(F.col("value").alias("line"), F.col("timestamp").alias("received_at")), "line")


def landed_line_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Landed Parquet files of ``(line_id, received_at, line)`` as a stream."""
    return spark.readStream.options(**options).schema(SYSLOG_LINES).parquet(path)


STATE = ["number", "last_event_id", "last_detection_id", "version", "watermark", "received", "parsed", "stored", "errors", "detections"]
MERGE_FILES = 16
MERGE_ROWS = 1 << 22
#: Columns of the live tables, the ones whose bounds the log keeps, and the day they lie in.
#: ``keys`` has the first number (``low``) and the count of each key's ``indicators``; ``runs`` are detections
#: by key, with what viewers are told of them; ``detections`` are those that a scan of older events found.
TABLES = {
    "events": (f"{fields_of(EVENTS)}, event_date date", ("id",), "event_date"),
    "detections": (f"{fields_of(DETECTIONS)}, event_date date", ("id", "event_id", "ioc_id"), None),
    "keys": ("version bigint, key string, low bigint, n bigint", ("version", "low"), None),
    "indicators": ("version bigint, at bigint, low bigint, ioc_id bigint, feed_id int, feed_name string", ("version", "at"), None),
    "runs": ("id bigint, n bigint, low bigint, event_id bigint, match_type string, matched_value string, created_at timestamp, "
             "event_date date, number bigint, head string, tail string", ("id", "event_id"), None),
    "values": ("event_id bigint, ts timestamp, match_type string, value string, event_date date", ("event_id",), "event_date"),
    "rejects": ("line_id bigint, line string, reason string", (), None),
    "live": ("number bigint, kind string, id bigint, json string", ("number",), None),
}
_ORDER = {"events": "id", "detections": "id", "keys": "low", "indicators": "at", "runs": "id", "values": "event_id", "live": "number"}
_FLOW = ("src_ip", "dst_ip", "hostname", "action")
_TOLD = (*_FLOW[:-1], "event_action")


class ToldTable(LogTable):
    """What batches told their viewers: the stored rows, and those of the detections that are stored as runs."""

    def __init__(self, store: "LiveStore", *table):
        super().__init__(store.log, *table)
        self.store = store

    def all(self) -> DataFrame:
        runs, indicators = self.store.table("runs").all(), self.store.table("indicators").all()
        named = indicators.select("low", "at", json_object(indicators, "feed_name").alias("feed"))
        number = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit("}"))
        told = _run_ids(runs.join(named, "low")).select(
            "number", F.lit("detection").alias("kind"), "id", json_joined(number, F.col("head"), F.col("feed"), F.col("tail")).alias("json"),
            "run", "batch_id")
        return super().all().unionByName(told)


def _run_ids(rows: DataFrame) -> DataFrame:
    """Rows of runs and their indicators with the id of each in place of the run's first."""
    return rows.withColumn("id", F.col("id") + F.col("at") - F.col("low"))


@dataclass(frozen=True)
class LiveStore:
    """The live tables, and where indicator versions are published."""

    spark: SparkSession
    root: str
    versions: str
    tz: str = "UTC"
    retro_hours: int = 24
    merge_files: int = MERGE_FILES
    snapshots: dict = field(default_factory=dict, compare=False)
    logs: dict = field(default_factory=dict, compare=False)

    @property
    def log(self) -> CommitLog:
        return self.logs.setdefault("log", CommitLog(self.spark, self.root))

    def path(self, name: str, run: str, batch_id: int) -> str:
        return f"{self.root}/{name}/run={run}/batch_id={batch_id}"

    def table(self, name: str) -> LogTable:
        table = (name, f"{TABLES[name][0]}, run string, batch_id int", f"{self.root}/{name}", _ORDER.get(name, "id"))
        return ToldTable(self, *table) if name == "live" else LogTable(self.log, *table)

    def events(self) -> DataFrame:
        return self.table("events").all()

    def detections(self) -> DataFrame:
        found = self.table("detections").all()
        return found.unionByName(self.of_runs(self.table("runs").all(), self.table("indicators").all()).select(*found.columns))

    def of_runs(self, runs: DataFrame, indicators: DataFrame) -> DataFrame:
        """The detections that runs stand for, of some indicators or all."""
        return _run_ids(runs.join(indicators.select("low", "at", "ioc_id", "feed_id", "feed_name"), "low"))

    def detection_counts(self) -> DataFrame:
        """(ioc_id, match_type, matched_value, n): ``detections`` counted, the runs before they are made rows.

        An indicator that is stored once has one key, so its counts are whole already; only those
        of the others, and of detections not in runs, are summed up.
        """
        group = ["match_type", "matched_value"]
        indicators, others = self.table("indicators").all(), self.table("detections").all()
        once = (indicators.select("ioc_id").unionByName(others.select("ioc_id")).groupBy("ioc_id").agg(F.count(F.lit(1)).alias("_n"))
                .filter((F.col("_n") == 1) & F.col("ioc_id").isNotNull()).select("ioc_id", F.lit(True).alias("_once")))
        marked = indicators.select("low", "ioc_id").join(once, "ioc_id", "left").withColumn("_once", F.coalesce("_once", F.lit(False)))
        counted = self.table("runs").all().groupBy("low", *group).agg(F.count(F.lit(1)).alias("n"))
        found = lambda some: counted.join(marked.filter(some), "low").select("ioc_id", *group, "n")
        rest = found(~F.col("_once")).unionByName(others.select("ioc_id", *group, F.lit(1).cast("bigint").alias("n")))
        return found(F.col("_once")).unionByName(rest.groupBy("ioc_id", *group).agg(F.sum("n").alias("n")))

    def state(self) -> DataFrame:
        """The states after the last batches, one row each."""
        rows = [tuple(r.get(c, 0) for c in STATE) for r in self.log.version().recent]
        return self.spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in STATE))

    def before(self) -> dict:
        """The state after the newest batch of any run."""
        return dict.fromkeys([*STATE, "clock"], 0) | self.log.version().state

    def done(self, run: str, batch_id: int) -> bool:
        return self.log.version().runs.get(run, -1) >= batch_id

    def bucket_totals(self, day: str) -> dict[str, int]:
        """Events of a UTC day by bucket, all buckets and ``_total``: sums kept by the log, no table is read."""
        return _totals(self.log.version(), day)

    def snapshot(self, version: int) -> Snapshot:
        """Prepared indicators of a version; the last two asked for are kept in memory."""
        if version not in self.snapshots:
            while len(self.snapshots) > 1:
                self.snapshots.pop(next(iter(self.snapshots))).keys.unpersist()
            indicators = active_indicators(*read_version(self.spark, self.versions, version))
            self.snapshots[version] = prepare_snapshot(indicators, persist=True)
        return self.snapshots[version]

    def write(self, df: DataFrame, name: str, run: str, batch_id: int, as_it_lies: bool = False) -> tuple[DataFrame, list[File]]:
        """Write a batch's rows of a table, in few files; they are part of it once committed.

        ``as_it_lies``: a shuffle has just dealt the rows to partitions of a file's size, so they are not moved again.
        """
        columns, bounds, day = TABLES[name]
        path = self.path(name, run, batch_id)
        order = [c for c in (day, _ORDER.get(name)) if c]
        dealt = df if as_it_lies else df.hint("rebalance", *[F.col(day)] if day else [])
        dealt = dealt.sortWithinPartitions(*order) if order and not as_it_lies else dealt
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(*([day] if day else [])).parquet(path)
        rows = self.spark.read.schema(columns).option("basePath", path).parquet(path)
        return rows, self.log.written(rows, path, bounds, day)

    def merge_small(self) -> None:
        """Merge small files, at most one group of each table; replaced files stay for readers that hold them."""
        for name in TABLES:
            table, folder = self.table(name), uuid.uuid4().hex
            put = lambda rows, name=name, folder=folder: self.write(rows.drop("run", "batch_id"), name, f"merged-{folder}", 0)[1]
            made = table.merge(_ORDER.get(name), self.merge_files, MERGE_ROWS, put)
            if made is not None:
                self.log.commit({name: made[0]}, remove={name: made[1]})


def _totals(version: Version, day: str) -> dict[str, int]:
    own = version.totals.get(day, {})
    return {b: own.get(b, 0) for b in BUCKETS} | {"_total": sum(own.values())}


def ingest_batch(lines: DataFrame, batch_id: int, store: LiveStore, run: str = "0") -> None:
    """Store one micro-batch: events, values, rejects, detections, live rows; then the commit."""
    if store.done(run, batch_id):
        return
    if batch_id > 0 and not store.done(run, batch_id - 1):
        raise ValueError(f"batch {batch_id} of run {run} follows a batch that was not stored")
    with shuffles_removed(store.spark, lines.sparkSession):
        with stage_scope(lines.sparkSession):
            _ingest_batch(lines, batch_id, store, run)
        store.merge_small()


def _ingest_batch(lines: DataFrame, batch_id: int, store: LiveStore, run: str) -> None:
    spark, before = lines.sparkSession, store.before()
    if "line_id" not in lines.columns:
        lines = lines.withColumn("line_id", F.monotonically_increasing_id())
    made: dict[str, list[File]] = {}

    def put(name: str, df: DataFrame, as_it_lies: bool = False) -> DataFrame:
        rows, made[name] = store.write(df, name, run, batch_id, as_it_lies)
        return rows

    with stage_scope(spark):
        # a batch may be a few files of one row group each; parsing them is the work
        read = parse_lines(spread(lines), store.tz)
        # an event has its text as ``raw``
        parsed = written_once(read.withColumn("line", F.when(F.col("reject_reason").isNotNull(), F.col("line"))), "parsed")
        put("rejects", rejected(parsed))
        numbered = number_stored(accepted(parsed), ["received_at", "line_id"], before["last_event_id"])
        events = put("events", numbered.select(*EVENTS.fieldNames(), F.to_date("ts").alias("event_date")))
        counts = parsed.agg(
            F.count(F.lit(1)).alias("received"), F.count_if(F.col("reject_reason").isNull()).alias("parsed"),
            F.count_if(F.col("reject_reason") == "error").alias("errors")).first()
    put("values", stored_values(events))

    # the version is read once per batch, so all its rows see one snapshot
    version = current_version(spark, store.versions)
    newest = events.agg(F.unix_micros(F.max("received_at"))).first()[0]
    clock, watermark = max(before["clock"], newest or 0), before["watermark"]
    hits, runs = (spark.createDataFrame([], TABLES[name][0]) for name in ("detections", "runs"))
    older, n_hits = None, 0
    if version > 0:
        if version != before["version"] and before["last_event_id"] > 0 and newest is not None:
            added, watermark = _retro_scan(store, before, version, newest)
            added = written_once(added, "retro")
            older = _events_of(store, added)
            numbered = assign_ids(added, ["event_id", "ioc_id", "match_type"], before["last_detection_id"])
            hits = put("detections", numbered.select(*DETECTIONS.fieldNames(), "event_date"))
            n_hits = sum(f.rows for f in made["detections"])
        with stage_scope(spark):
            found = written_once(hit_runs(events, store.snapshot(version), _keys_of(store, version, put), F.col("received_at"), _FLOW), "runs")
            # older events have the lower ids, so the detections of new ones go on after theirs
            found, n_found = number_runs(found, ["event_id", "match_type", "low"], "n", before["last_detection_id"] + n_hits)
            head, tail = json_object(found, "created_at", "match_type", "matched_value"), json_object(_flow(found), *_TOLD)
            told = _flow(found).withColumns({"head": head, "tail": tail, "number": F.lit(before["number"] + 1).cast("bigint")})
            runs = put("runs", told.select(*[c.split()[0] for c in TABLES["runs"][0].split(", ")]), as_it_lies=True)
        n_hits += n_found

    stored = sum(f.rows for f in made["events"])
    by_day: dict[str, dict[str, int]] = {}
    for r in _day_counts(events).collect():  # eleven buckets a day at most
        by_day.setdefault(str(r["event_date"]), {})[r["bucket"]] = r["n"]
    day = str(spark.range(1).select(F.to_date(F.timestamp_micros(F.lit(clock)))).first()[0])
    after = {b: n + by_day.get(day, {}).get(b, 0) for b, n in store.bucket_totals(day).items() if b != "_total"}
    told = live_rows(events, hits, after | {"_total": sum(after.values())}, older, runs)
    put("live", told.select(F.lit(before["number"] + 1).cast("bigint").alias("number"), "*"), as_it_lies=True)

    state = {"number": before["number"] + 1, "last_event_id": before["last_event_id"] + stored,
             "last_detection_id": before["last_detection_id"] + n_hits, "version": version, "watermark": watermark,
             "clock": clock, "received": counts["received"], "parsed": counts["parsed"], "stored": stored,
             "errors": counts["errors"] + counts["parsed"] - stored, "detections": n_hits}
    store.log.commit(made, state, run, batch_id, by_day)


def _keys_of(store: LiveStore, version: int, put) -> DataFrame:
    """(key, low, n) of a version; the first batch that meets it stores its indicators."""
    files = [f for f in store.table("keys").files() if f.meets("version", version, version)]
    if files:
        return store.table("keys").read(files).filter(F.col("version") == version).select("key", "low", "n")
    last = max((f.bounds["at"][1] for f in store.table("indicators").files()), default=0)
    number = F.lit(version).cast("bigint").alias("version")
    with stage_scope(store.spark):
        own = store.snapshot(version).keys.select("key", "ioc_id", "feed_id", "feed_name")
        numbered = written_once(assign_ids(own, own.columns, last, "at"), "indicators")
        keys = put("keys", numbered.groupBy("key").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n")).select(number, "*"))
        put("indicators", numbered.join(keys.select("key", "low"), "key").select(number, "at", "low", "ioc_id", "feed_id", "feed_name"))
    return keys.select("key", "low", "n")


def _day_counts(events: DataFrame) -> DataFrame:
    """Counts by (day, tag, action) first, so that the text tests run on few rows."""
    raw = events.groupBy("event_date", "tag", "action").agg(F.count(F.lit(1)).alias("n"))
    return with_bucket(raw).groupBy("event_date", "bucket").agg(F.sum("n").alias("n"))


def _retro_scan(store: LiveStore, before: dict, version: int, newest: int) -> tuple[DataFrame, int]:
    """(new detections of stored events, watermark after it) when a new version is met.

    Events above the watermark were matched with the version before as they came, so only what was
    added since meets their values. Of detections, files that may hold the added indicators are read.
    """
    spark = store.spark
    since = F.timestamp_micros(F.lit(newest)) - F.make_dt_interval(hours=F.lit(store.retro_hours))
    start = spark.range(1).select(F.to_date(since)).first()[0]
    low = before["watermark"] + 1
    values = store.table("values")
    recent = values.read(values.files(low=low, since=str(start))).where(
        (F.col("event_id") >= low) & (F.col("event_id") <= before["last_event_id"]) & (F.col("ts") >= since))
    none = Snapshot(spark.createDataFrame([], "ioc_id bigint, key string"), None)
    added = added_keys(store.snapshot(version), store.snapshot(before["version"]) if before["version"] else none)
    span = added.keys.agg(F.min("ioc_id"), F.max("ioc_id")).first()
    known, runs = store.table("detections"), store.table("runs")
    stored = known.read([f for f in known.files(low=low, column="event_id") if span[0] is not None and f.meets("ioc_id", *span)])
    named = store.table("indicators").all().join(added.keys.select("ioc_id").distinct(), "ioc_id", "left_semi")
    in_runs = store.of_runs(runs.read(runs.files(low=low, column="event_id")), named)
    stored = stored.select(*DETECTION_KEY).unionByName(in_runs.select(*DETECTION_KEY))
    hits = retro_scan_added(recent.select("event_id", "ts", "match_type", "value", "event_date"), added, stored,
                            F.timestamp_micros(F.lit(newest)))
    # Days after the first lie wholly in the window: their newest id is in the log.
    events = store.table("events")
    later = [f.bounds["id"][1] for f in events.files(low=low, high=before["last_event_id"]) if f.day > str(start)]
    first = events.read([f for f in events.files(low=low, days={str(start)})]).where(
        (F.col("id") <= before["last_event_id"]) & (F.col("ts") >= since)).agg(F.max("id")).first()[0]
    return hits, max([before["watermark"], *later, *([first] if first is not None else [])])


def _events_of(store: LiveStore, hits: DataFrame) -> DataFrame:
    """The stored events that detections name, from the files of their days and ids."""
    span = hits.agg(F.min("event_id"), F.max("event_id"), F.collect_set("event_date")).first()
    table = store.table("events")
    files = [] if span[0] is None else table.files(low=span[0], high=span[1], days={str(d) for d in span[2]})
    return table.read(files).join(hits.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")


def _flow(events: DataFrame) -> DataFrame:
    """Rows with the fields that viewers of a detection are told of its event."""
    return events.withColumnRenamed("action", "event_action")


def live_rows(events: DataFrame, detections: DataFrame, totals: dict[str, int], older: DataFrame | None = None,
              runs: DataFrame | None = None) -> DataFrame:
    """What a batch tells its viewers, as ``(kind, id, json)`` rows.

    ``event``: every event with its bucket and its number of detections (null: none);
    ``detection``: every detection with the address, name and action fields of its event, which
    may be one of ``older`` events; ``buckets``: the day's count of every bucket after the batch.
    The detections of ``runs`` are counted alone: the table of runs has what is told of them.
    """
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id" if "id" in df.columns else F.lit(None).cast("bigint").alias("id"),
                                        json_object(df, *df.columns).alias("json"))
    counts = detections.select("event_id", F.lit(1).cast("bigint").alias("n"))
    counts = counts if runs is None else counts.unionByName(runs.select("event_id", "n"))
    counts = counts.groupBy(F.col("event_id").alias("id")).agg(F.sum("n").alias("det_count"))
    told = with_bucket(events).select(*EVENTS.fieldNames(), "bucket").join(counts, "id", "left")
    flow = lambda df: _flow(df).select(F.col("id").alias("event_id"), *_TOLD)
    sides = flow(events) if older is None else flow(events).unionByName(flow(older))
    found = detections.select("id", "event_id", "created_at", "match_type", "matched_value", "feed_name").join(sides, "event_id").drop("event_id")
    buckets = events.sparkSession.createDataFrame([*totals.items()], "bucket string, n bigint").coalesce(1)
    return tagged(told, "event").unionByName(tagged(found, "detection")).unionByName(tagged(buckets, "buckets"))


def ingest(lines: DataFrame, store: LiveStore, checkpoint: str) -> DataStreamWriter:
    """Continuous ingest with inline detection; start it with the trigger of your choice."""
    run = run_name(lines.sparkSession, checkpoint)
    return (lines.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, batch_id: ingest_batch(df, batch_id, store, run)))


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name that a checkpoint keeps for its run; made with the checkpoint."""
    path = f"{checkpoint}/run"
    if not path_exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.parquet(path)
    return spark.read.schema("run string").parquet(path).first()[0]


def day_bucket_rows(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """(day, bucket) of every event, UTC days."""
    events = parse_lines(lines, tz).filter("reject_reason IS NULL")
    return events.select(F.to_date("ts").alias("day"), bucket_of(F.col("tag"), F.col("action")).alias("bucket"))


def arrival_window_rows(lines: DataFrame) -> DataFrame:
    """(window_end) of every line and every window of 60 seconds, each 10 seconds, that it arrived in."""
    ends = F.explode(F.sequence(F.col("w.end"), F.col("w.end") + F.expr("INTERVAL 50 SECONDS"), F.expr("INTERVAL 10 SECONDS")))
    return lines.select(F.window("received_at", "10 seconds").alias("w")).select(ends.alias("window_end"))


class RunningCounts:
    """Counts by key over a stream, kept as the sum of what each batch adds.

    A batch writes its own counts and commits them, so a replay replaces itself. There is no state
    in memory and no watermark: a row however late adds to its key like any other. Small files are
    summed into one from time to time, so the table has about as many rows as there are keys.
    """

    def __init__(self, spark: SparkSession, root: str, keys: str, merge_files: int = MERGE_FILES):
        self.spark, self.root, self.merge_files = spark, root, merge_files
        self.keys = [k.split()[0] for k in keys.split(", ")]
        self.schema = f"{keys}, n bigint, run string, batch_id int"
        self.log = CommitLog(spark, root)
        self.table = LogTable(self.log, "counts", self.schema, f"{root}/counts", "n")

    def _write(self, counts: DataFrame, run: str, batch_id: int) -> list[File]:
        path = f"{self.root}/counts/run={run}/batch_id={batch_id}"
        counts.write.mode("overwrite").parquet(path)
        return self.log.written(counts, path, ())

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum("n").alias("n"))

    def add(self, rows: DataFrame, batch_id: int, run: str = "0") -> None:
        """Count a batch's rows."""
        if self.log.version().runs.get(run, -1) >= batch_id:
            return
        counts = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        self.log.commit({"counts": self._write(counts, run, batch_id)}, run=run, batch=batch_id)
        made = self.table.merge(None, self.merge_files, MERGE_ROWS,
                                lambda old: self._write(self._summed(old).coalesce(1), f"merged-{uuid.uuid4().hex}", 0))
        if made is not None:
            self.log.commit({"counts": made[0]}, remove={"counts": made[1]})

    def keep(self, lines: DataFrame, rows_of, checkpoint: str) -> DataStreamWriter:
        """Count ``rows_of`` every batch of a stream of lines."""
        run = run_name(self.spark, checkpoint)
        return (lines.writeStream.option("checkpointLocation", checkpoint)
                .foreachBatch(lambda df, batch_id: self.add(rows_of(df), batch_id, run)))

    def now(self) -> DataFrame:
        return self._summed(self.table.all())


class ResentDetections:
    """Detections of a stream in which lines may come again, at any distance in time.

    A hit is new if its key is not stored. Of the stored keys, the files whose event ids overlap
    the batch's are read, so ids that go up with time keep that small, and no state is held.
    """

    def __init__(self, spark: SparkSession, root: str, snapshot: Snapshot, event_id: Column, tz: str = "UTC", merge_files: int = MERGE_FILES):
        self.spark, self.root, self.snapshot, self.event_id, self.tz, self.merge_files = spark, root, snapshot, event_id, tz, merge_files
        self.log = CommitLog(spark, root)
        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DETECTIONS.fields if f.name != "id")
        self.table = LogTable(self.log, "hits", f"{names}, run string, batch_id int", f"{root}/hits", "event_id")

    def _write(self, rows: DataFrame, run: str, batch_id: int) -> list[File]:
        path = f"{self.root}/hits/run={run}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.log.written(rows, path, ("event_id",))

    def add(self, lines: DataFrame, batch_id: int, run: str = "0") -> None:
        if self.log.version().runs.get(run, -1) >= batch_id:
            return
        with stage_scope(self.spark):
            events = accepted(parse_lines(lines, self.tz)).withColumn("id", self.event_id)
            hits = written_once(match_events(events, self.snapshot, F.col("received_at")), "hits")
            span = hits.agg(F.min("event_id"), F.max("event_id")).first()
            known = self.table.read([] if span[0] is None else self.table.files(*span))
            fresh = new_detections(hits, known)
            self.log.commit({"hits": self._write(fresh, run, batch_id)}, run=run, batch=batch_id)
        made = self.table.merge("event_id", self.merge_files, MERGE_ROWS,
                                lambda old: self._write(old.drop("run", "batch_id"), f"merged-{uuid.uuid4().hex}", 0))
        if made is not None:
            self.log.commit({"hits": made[0]}, remove={"hits": made[1]})

    def keep(self, lines: DataFrame, checkpoint: str) -> DataStreamWriter:
        run = run_name(self.spark, checkpoint)
        return (lines.writeStream.option("checkpointLocation", checkpoint)
                .foreachBatch(lambda df, batch_id: self.add(df, batch_id, run)))

    def now(self) -> DataFrame:
        return self.table.all().drop("run", "batch_id")


def _until(rows: DataFrame, column: str, lateness: str | None) -> DataFrame:
    """``rows`` whose state ends ``lateness`` after ``column``; None keeps it, so that no late row is dropped."""
    return rows if lateness is None else rows.withWatermark(column, lateness)


def daily_buckets(lines: DataFrame, tz: str = "UTC", lateness: str | None = None) -> DataFrame:
    """Running count per UTC day and bucket, late lines included.

    The state is as large as the result. With ``lateness``, older days leave it and their late
    lines are lost.
    """
    events = parse_lines(lines, tz).filter("reject_reason IS NULL").select(
        "ts", bucket_of(F.col("tag"), F.col("action")).alias("bucket"))
    return (_until(events, "ts", lateness)
            .groupBy(F.window("ts", "1 day").alias("w"), "bucket").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("date").alias("day"), "bucket", "n"))


def arrival_rate(lines: DataFrame, lateness: str | None = None) -> DataFrame:
    """Arrivals in the trailing 60 seconds, every 10 seconds; ``lateness`` as in ``daily_buckets``."""
    return (_until(lines, "received_at", lateness)
            .groupBy(F.window("received_at", "60 seconds", "10 seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").alias("window_end"), "n"))


def inline_detections(lines: DataFrame, snapshot: Snapshot, event_id: Column, tz: str = "UTC",
                      lateness: str | None = None) -> DataFrame:
    """Pure stream: parse, match with a fixed snapshot, drop re-sent duplicates.

    ``event_id`` must identify a line across re-sends. The state holds the keys of all hits; with
    ``lateness``, those of that time alone, and later lines are lost.
    """
    events = accepted(parse_lines(lines, tz)).withColumn("id", event_id)
    hits = match_events(events, snapshot, F.col("received_at"))
    keys = ["event_id", "ioc_id", "match_type"]
    if lateness is None:
        return hits.dropDuplicates(keys)
    return hits.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(keys)


def updates_to(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataStreamWriter:
    """Write the changed rows of every batch to its own folder under ``path``."""
    def put(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)


def latest_updates(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Last written value of ``n`` per key."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Work through everything that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
