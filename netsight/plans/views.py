"""Served queries as DataFrames over the stored tables.

``limit`` and ``offset`` page a list as the service does. The ids of a page are
taken first, by a top-k over narrow columns; ``PAGE_MAX`` bounds them, so they come
to the driver and go into the filters of the second step, which then reads the
page's days and id range alone. So a page is chosen when its frame is made, and later
rows do not change it. Windowed counters read the day folders of their window. Filters
stay on base columns so that they reach the Parquet scan.

Events and detections may be frames, or tables of a commit log (``sources.commits``).
The log says which files hold the newest ids, or the ids of a page, and no other file
is opened; a filtered page walks down from the newest files until it is full. A
detection names the day of its event, so that the event is looked up in its day.
Detections may also be a ``HitTable``, which matches the events of a page when it is asked.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.constants import (
    BUCKETS, DETECTIONS_SINCE_LIMIT, EVENTS_SINCE_LIMIT, PAGE_DEFAULT, PAGE_MAX,
    SNAPSHOT_DETECTIONS, SNAPSHOT_EVENTS)
from netsight.functions.buckets import (
    age_text, bucket_of, percent_share, ticker_label, utc_text)
from netsight.functions.ip import ip_search_text
from netsight.operators.ids import max_id
from netsight.plans.hits import HitTable
from netsight.sources.commits import LogTable
from netsight.sources.trigrams import BLOCK, block_of, blocks_with, trigrams_of

Table = DataFrame | LogTable | HitTable

EVENT_FIELDS = ["ts", "host", "facility", "severity", "tag", "raw", "src_ip", "dst_ip", "src_port",
                "dst_port", "proto", "action", "msg", "hostname"]
_FLOW_FIELDS = ["src_ip", "dst_ip", "hostname", "src_port", "dst_port", "proto"]


def _page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MAX} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def _from(df: DataFrame, time: str, day: str, since: Column) -> DataFrame:
    """Rows from a time on; with a day column, older folders are not opened."""
    recent = df.filter(F.col(time) >= since)
    return recent.filter(F.col(day) >= F.to_date(since)) if day in df.columns else recent


def _with_ids(df: DataFrame, column: str, ids: list[int]) -> DataFrame:
    """Rows whose ``column`` is one of a page's ids; the range prunes files and row groups."""
    if not ids:
        return df.limit(0)
    return df.filter(F.col(column).between(min(ids), max(ids)) & F.col(column).isin(ids))


def _looked_up(table: Table, column: str, ids: list[int], days: list | None = None) -> DataFrame:
    """Rows of a page's ids, from the files that can hold them; ``days`` may have None for "not known"."""
    if isinstance(table, HitTable):
        return table.with_events(ids) if column == "event_id" else table.with_ids(ids)
    days = None if not days or None in days else sorted(set(days))
    if isinstance(table, LogTable):
        table = table.read(table.files(min(ids), max(ids), days and {str(d) for d in days}, column=column) if ids else [])
    found = _with_ids(table, column, ids)
    return found.filter(F.col("event_date").isin(days)) if days and ids and "event_date" in table.columns else found


def _first_rows(table: Table, keep, order: list[Column], limit: int, offset: int, *columns: str) -> list:
    """The first page of the rows that ``keep`` lets through: these columns of theirs, and the day of an event.

    In a table of the log the newest files are read, and older ones while the page is not full.
    """
    def page(df: DataFrame) -> list:
        day = [c for c in ("event_date",) if c in df.columns]
        return _page(keep(df).select(*columns, *day), order, limit, offset).collect()

    if isinstance(table, DataFrame):
        return page(table)
    rows = []
    for df, whole in table.steps(limit + offset):
        rows = page(df)
        if whole or len(rows) == limit:
            break
    return rows


def _found_rows(table: LogTable, terms: DataFrame, trigrams: list[str], keep, want: int) -> list:
    """The newest ``want`` ids that ``keep`` lets through, from the blocks that have all trigrams.

    Blocks are tried from the newest down, four times as many in each step; a text of very many
    blocks ends in one scan of what lies below.
    """
    rows, below, step = [], None, 16
    found = blocks_with(terms, trigrams)
    while len(rows) < want:
        blocks = [] if step > 4096 else [r["block"] for r in (found if below is None else found.filter(F.col("block") < below)).limit(step).collect()]
        if not blocks and step <= 4096:
            break
        if blocks:
            files = [f for f in table.files((blocks[-1]) * BLOCK, (blocks[0] + 1) * BLOCK - 1)
                     if any(f.meets("id", b * BLOCK, (b + 1) * BLOCK - 1) for b in blocks)]
            df = table.read(files).filter(F.col("id").between(blocks[-1] * BLOCK, (blocks[0] + 1) * BLOCK - 1) & block_of(F.col("id")).isin(blocks))
        else:
            df = table.read(table.files(high=below * BLOCK - 1)).filter(F.col("id") < below * BLOCK)
        rows += keep(df).select("id", "event_date").orderBy(F.desc("id")).limit(want - len(rows)).collect()
        if len(blocks) < step:
            break
        below, step = blocks[-1], step * 4
    return rows


def _days(rows: list) -> list:
    return [r["event_date"] for r in rows] if rows and "event_date" in rows[0] else []


def _newer(table: Table, after_id: int, limit: int) -> DataFrame:
    """Rows above an id; of a table of the log, the files that can hold the next ``limit`` of them."""
    if isinstance(table, DataFrame):
        return table.filter(F.col("id") > after_id)
    if isinstance(table, HitTable):
        return table.above(after_id, limit)
    files, taken, low = sorted(table.files(low=after_id + 1), key=lambda f: f.bounds["id"][1]), 0, None
    for f in files:
        if f.bounds["id"][0] > after_id:
            taken += f.rows
            low = f.bounds["id"][1]
        if taken >= limit:
            break
    return table.read([f for f in files if taken < limit or f.bounds["id"][0] <= low]).filter(F.col("id") > after_id)


def _contains(text: str, *columns: Column) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the text stay wildcards.

    A backslash makes the next character a plain one, as in the service's database; Spark takes
    it before a wildcard or a backslash only.
    """
    pattern = re.sub(r"(?s)\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{text}%")
    return reduce(lambda a, b: a | b, [c.ilike(pattern) for c in columns])


def _day_of(now: Column) -> Column:
    return F.date_trunc("day", now)


# -- statistics and buckets --------------------------------------------------

def stats(events: DataFrame, detections: DataFrame, feeds: DataFrame, iocs: DataFrame,
          now: Column) -> DataFrame:
    """Eight counters as ``(name, n)`` rows; windows read their days, totals no column at all."""
    live = F.col("deleted_at").isNull()
    total = F.count(F.lit(1))
    counts = [
        (_from(events, "ts", "event_date", _day_of(now)), {"events_today": total}), (events, {"events_total": total}),
        (_from(detections, "created_at", "created_date", now - F.expr("INTERVAL 24 HOURS")), {"detections_24h": total}),
        (detections, {"detections_total": total}),
        (feeds, {"active_feeds": F.count_if(F.col("enabled") & live), "feeds_total": F.count_if(live)}),
        (iocs, {"iocs_active": F.count_if(F.col("active")), "iocs_total": total}),
    ]
    rows = [df.agg(*[n.alias(name) for name, n in made.items()])
              .select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in made])))
            for df, made in counts]
    return reduce(DataFrame.unionByName, rows)


def with_bucket(events: DataFrame) -> DataFrame:
    return events.withColumn("bucket", bucket_of(F.col("tag"), F.col("action")))


def _bucket_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Counts by (tag, action) first, so the text tests run on few rows."""
    raw = events.groupBy(*keys, "tag", "action").agg(F.count(F.lit(1)).alias("n"))
    return with_bucket(raw).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def bucket_totals(events: DataFrame, now: Column) -> DataFrame:
    """``(bucket, n)`` for the UTC day of ``now``: all buckets, and ``_total``."""
    counts = _bucket_counts(_from(events, "ts", "event_date", _day_of(now)))
    zeros = events.sparkSession.createDataFrame([(b, 0) for b in BUCKETS], "bucket string, n bigint")
    names = F.array(F.col("bucket"), F.lit("_total"))
    return (counts.unionByName(zeros).withColumn("bucket", F.explode(names))
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_share(totals: DataFrame) -> DataFrame:
    """Whole-percent share of every bucket; ``totals`` holds twelve rows."""
    total = F.max(F.when(F.col("bucket") == "_total", F.col("n"))).over(Window.partitionBy())
    return (totals.withColumn("_n", total).filter("bucket <> '_total'")
            .select("bucket", "n", percent_share(F.col("n"), F.col("_n")).alias("pct")))


def bucket_totals_daily(events: DataFrame) -> DataFrame:
    """``(day, bucket, n)`` for every UTC day that has events."""
    return _bucket_counts(events.withColumn("day", F.to_date("ts")), "day")


def events_per_minute(events: DataFrame) -> DataFrame:
    """Arrivals in the 60 seconds before each full 10 seconds, as ``(window_end, n)``."""
    slices = events.groupBy(F.window("received_at", "10 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    ends = F.explode(F.sequence(F.col("w.end"), F.col("w.end") + F.expr("INTERVAL 50 SECONDS"),
                                F.expr("INTERVAL 10 SECONDS")))
    return slices.select(ends.alias("window_end"), "n").groupBy("window_end").agg(F.sum("n").alias("n"))


# -- events ------------------------------------------------------------------

def filter_events(events: DataFrame, q: str | None = None, since: Column | None = None,
                  flows_only: bool = False) -> DataFrame:
    """The list filters; an empty ``q`` means no filter. ``since`` also prunes date folders."""
    df = events
    if flows_only:
        df = df.filter(F.col("src_ip").isNotNull() | F.col("dst_ip").isNotNull())
    if q:
        df = df.filter(_contains(q, F.col("raw"), ip_search_text(F.col("src_ip")),
                                 ip_search_text(F.col("dst_ip")), F.col("hostname")))
    return df if since is None else _from(df, "ts", "event_date", since)


def _with_det_count(page: DataFrame, detections: Table, ids: list[int]) -> DataFrame:
    """Add ``det_count`` (NULL when none) to a page: only its own detections are counted."""
    own = (detections.of_events(page.withColumn(detections.created_at, F.col("ts"))) if isinstance(detections, HitTable)
           else _looked_up(detections, "event_id", ids))
    counts = own.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("det_count"))
    return page.join(counts, "id", "left")


def browse_events(events: Table, detections: Table, q: str | None = None,
                  since: Column | None = None, flows_only: bool = False,
                  limit: int = PAGE_DEFAULT, offset: int = 0, terms: DataFrame | None = None) -> DataFrame:
    """Newest events first, with their detection count and the ``flagged`` mark.

    With ``terms``, the trigram postings of an event table, a search opens the blocks that can
    match; a ``q`` without three literal ASCII characters in a row, or with an escape, is a scan.
    """
    keep = lambda df: filter_events(df, q, since, flows_only)
    trigrams = trigrams_of(q) if q and terms is not None and isinstance(events, LogTable) else None
    if trigrams is None:
        rows = _first_rows(events, keep, [F.desc("id")], limit, offset, "id")
    else:
        _page(events.read([]), [F.desc("id")], limit, offset)
        rows = _found_rows(events, terms, trigrams, keep, limit + offset)[offset:]
    ids = [r["id"] for r in rows]
    page = _looked_up(events, "id", ids, _days(rows)).select("id", *EVENT_FIELDS)
    return (_with_det_count(page, detections, ids)
            .withColumn("flagged", F.coalesce(F.col("det_count"), F.lit(0)) > 0).orderBy(F.desc("id")))


def event_detail(events: Table, detections: Table, event_id: int) -> DataFrame:
    """One event with its detections in id order."""
    hits = _looked_up(detections, "event_id", [event_id]).groupBy(F.col("event_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(
            "id", "ioc_id", "feed_id", "feed_name", "match_type", "matched_value", "created_at"))).alias("detections"))
    return (_looked_up(events, "id", [event_id]).select("id", *EVENT_FIELDS).join(hits, "id", "left")
            .withColumn("detections", F.coalesce("detections", F.array().cast(hits.schema["detections"].dataType))))


def events_since(events: Table, detections: Table, after_id: int,
                 limit: int = EVENTS_SINCE_LIMIT) -> DataFrame:
    """The next events above an id, oldest first."""
    rows = _first_rows(_newer(events, after_id, limit), lambda df: df, [F.asc("id")], limit, 0, "id")
    ids = [r["id"] for r in rows]
    page = _looked_up(events, "id", ids, _days(rows)).select("id", *EVENT_FIELDS)
    return _with_det_count(page, detections, ids).orderBy("id")


def event_labels(events: DataFrame, now: Column) -> DataFrame:
    """Display texts of events: time, age, ticker label and bucket."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return with_bucket(events).select(
        "id", utc_text(F.col("ts")).alias("time_text"), age_text(F.col("ts"), now).alias("age"),
        ticker_label(blank("src_ip"), blank("dst_ip"), blank("hostname"), F.col("msg")).alias("label"), "bucket")


# -- detections ---------------------------------------------------------------

def _event_side(events: DataFrame, *more: Column) -> DataFrame:
    return events.select(F.col("id").alias("event_id"), F.col("ts").alias("event_ts"),
                         F.col("action").alias("event_action"), F.col("tag").alias("event_tag"),
                         *_FLOW_FIELDS, *more)


def _ioc_side(iocs: DataFrame, *more: Column) -> DataFrame:
    fields = ["description", "tags", "severity", "reference", "first_seen", "last_seen", "value"]
    return iocs.select(F.col("id").alias("ioc_id"), *[F.col(f).alias(f"ioc_{f}") for f in fields], *more)


def browse_detections(detections: Table, events: Table, iocs: DataFrame,
                      feed_id: int | None = None, q: str | None = None, since: Column | None = None,
                      limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """Newest detections first with their event and indicator; ``feed_id`` 0 means all.

    Every detection has its event (deleting an event deletes them), so the page
    can be cut before the joins.
    """
    def keep(df: DataFrame) -> DataFrame:
        if feed_id:
            df = df.filter(F.col("feed_id") == feed_id)
        if q:
            df = df.filter(_contains(q, F.col("matched_value"), F.col("feed_name")))
        return df if since is None else _from(df, "created_at", "created_date", since)

    rows = _first_rows(detections, keep, [F.desc("id")], limit, offset, "id", "event_id", "ioc_id")
    page = _looked_up(detections, "id", [r["id"] for r in rows]).select(
        "id", "created_at", "match_type", "matched_value", "feed_name", "feed_id", "event_id", "ioc_id")
    with_event = _event_side(_looked_up(events, "id", [r["event_id"] for r in rows], _days(rows))).join(F.broadcast(page), "event_id")
    indicators = _ioc_side(_with_ids(iocs, "id", sorted({r["ioc_id"] for r in rows if r["ioc_id"] is not None})))
    return with_event.join(indicators, "ioc_id", "left").drop("ioc_id").orderBy(F.desc("id"))


def detection_detail(detections: Table, events: Table, iocs: DataFrame, detection_id: int) -> DataFrame:
    """One detection with its event and indicator, either of which may be gone."""
    found = _looked_up(detections, "id", [detection_id])
    one = found.select("id", "event_id", "ioc_id", "feed_id", "feed_name", "match_type", "matched_value", "created_at")
    keys = found.select("event_id", "ioc_id", *[c for c in ("event_date",) if c in found.columns]).collect()
    wanted = lambda c: [r[c] for r in keys if r[c] is not None]
    event = _event_side(_looked_up(events, "id", wanted("event_id"), _days(keys)), F.col("raw").alias("event_raw"), F.col("host").alias("event_host"))
    indicator = _ioc_side(_with_ids(iocs, "id", wanted("ioc_id")), F.col("type").alias("ioc_type"))
    return one.join(event, "event_id", "left").join(indicator, "ioc_id", "left")


def detections_since(detections: Table, events: Table, after_id: int,
                     limit: int = DETECTIONS_SINCE_LIMIT) -> DataFrame:
    """The next detections above an id, oldest first."""
    rows = _first_rows(_newer(detections, after_id, limit), lambda df: df, [F.asc("id")], limit, 0, "id", "event_id")
    page = _looked_up(detections, "id", [r["id"] for r in rows]).select(
        "id", "created_at", "match_type", "matched_value", "feed_name", "event_id")
    side = _looked_up(events, "id", [r["event_id"] for r in rows], _days(rows)).select(
        F.col("id").alias("event_id"), "src_ip", "dst_ip", "hostname", F.col("action").alias("event_action"))
    return side.join(F.broadcast(page), "event_id").drop("event_id").orderBy("id")


# -- feeds and indicators ------------------------------------------------------

def list_feeds(feeds: DataFrame, iocs: DataFrame, feed_id: int | None = None) -> DataFrame:
    """Live feeds by id with their number of active indicators; credentials are masked."""
    live = feeds.filter("deleted_at IS NULL")
    active = iocs.filter("active")
    if feed_id is not None:
        live, active = live.filter(F.col("id") == feed_id), active.filter(F.col("feed_id") == feed_id)
    counts = active.groupBy(F.col("feed_id").alias("id")).agg(F.count(F.lit(1)).alias("ioc_count"))
    return (live.join(counts, "id", "left")
            .withColumn("ioc_count", F.coalesce("ioc_count", F.lit(0)))
            .withColumn("auth_json", F.when(F.col("auth_json").isNotNull(), "***")).orderBy("id"))


def browse_iocs(iocs: DataFrame, feeds: DataFrame, feed_id: int | None = None, ioc_type: str | None = None,
                q: str | None = None, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """Active indicators of live feeds, newest id first."""
    df = iocs.filter("active")
    if feed_id:
        df = df.filter(F.col("feed_id") == feed_id)
    if ioc_type:
        df = df.filter(F.col("type") == ioc_type)
    if q:
        df = df.filter(_contains(q, F.col("value"), F.col("description")))
    live = feeds.filter("deleted_at IS NULL").select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name"))
    found = df.join(live, "feed_id").select(
        "id", "type", "value", "description", "tags", "severity", "reference", "first_seen", "last_seen",
        "active", "created_at", "feed_name")
    return _page(found, [F.desc("id")], limit, offset)


def ioc_detail(iocs: DataFrame, feeds: DataFrame, ioc_id: int) -> DataFrame:
    """One indicator, active or not, with its feed's name."""
    names = feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name"))
    return iocs.filter(F.col("id") == ioc_id).join(names, "feed_id")


def feed_logs(logs: DataFrame, feed_id: int, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Log of one feed, newest first."""
    return _page(logs.filter(F.col("feed_id") == feed_id).select("id", "feed_id", "ts", "level", "message"),
                 [F.desc("ts"), F.desc("id")], limit)


# -- live view -----------------------------------------------------------------

def max_ids(events: DataFrame, detections: DataFrame) -> DataFrame:
    """Largest event and detection id, 0 for an empty table."""
    return (max_id(events).select(F.lit("events").alias("name"), "m")
            .unionByName(max_id(detections).select(F.lit("detections").alias("name"), "m")))


def _largest_id(table: Table) -> int:
    if isinstance(table, HitTable):
        return table.largest_id
    if isinstance(table, LogTable):
        return max((f.bounds["id"][1] for f in table.files() if "id" in f.bounds), default=0)
    return max_id(table).first()["m"]


def live_snapshot(events: Table, detections: Table, now: Column) -> DataFrame:
    """What a new live viewer gets, as rows of three kinds with the columns of their kind filled.

    ``event``: the newest events, with their bucket and number of detections; ``detection``: the
    newest detections, with fields of their event; ``bucket``: the day's count of every bucket.
    """
    ev = with_bucket(events_since(events, detections, max(0, _largest_id(events) - SNAPSHOT_EVENTS)))
    det = detections_since(detections, events, max(0, _largest_id(detections) - SNAPSHOT_DETECTIONS))
    tot = bucket_totals(events.all() if isinstance(events, LogTable) else events, now)
    kinds = [df.withColumn("kind", F.lit(kind)) for df, kind in ((ev, "event"), (det, "detection"), (tot, "bucket"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
