"""Feed and indicator tables: merges, feed changes, pull log, snapshot versions."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.constants import DEFAULT_PULL_MINUTES, ERROR_TEXT_CHARS, FEED_TYPES, PENDING_PULLS_LIMIT, SEED_FEEDS
from netsight.functions.text import strip
from netsight.operators.ids import assign_ids
from netsight.schemas import FEEDS, IOCS, PARSER_CONFIG
from netsight.session import path_exists, written_once

IOC_KEY = ["feed_id", "type", "value"]
_IOC_ATTRIBUTES = ["description", "tags", "severity", "reference"]


# -- indicators -------------------------------------------------------------

def upsert_iocs(existing: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The indicator table after a pull.

    ``batch`` is what the feed parsers return. Per (feed, type, value) the last
    row of the batch gives the attributes, the seen window only widens, and the
    row becomes active; indicators missing from the batch stay as they are. New
    ids go up in batch order.

    The batch is merged first, by partial aggregates, so that a value repeated
    many times does not fill one task, and written once. The stored table is not
    aggregated: it meets the merged batch in joins, which need no shuffle of the
    table as long as the written batch is small enough to broadcast.
    """
    order = F.struct(F.col("payload_id").cast("bigint").alias("payload_id"), F.col("pos").cast("bigint").alias("pos"))
    rows = batch.select(
        *IOC_KEY, "description", F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), "severity", "reference",
        F.coalesce("first_seen", now).alias("first_seen"), F.coalesce("last_seen", now).alias("last_seen"),
        order.alias("_order"))
    merged = written_once(rows.groupBy(*IOC_KEY).agg(
        F.max_by(F.struct(*_IOC_ATTRIBUTES), "_order").alias("_new"),
        F.min("first_seen").alias("_first_seen"), F.max("last_seen").alias("_last_seen"),
        F.min("_order").alias("_order")), "merged")

    hit = F.col("_order").isNotNull()
    pick = {**{c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in _IOC_ATTRIBUTES},
            "first_seen": F.least("first_seen", "_first_seen"), "last_seen": F.greatest("last_seen", "_last_seen"),
            "active": F.col("active") | hit}
    names = IOCS.fieldNames()
    kept = existing.join(merged, IOC_KEY, "left").select(*[pick.get(c, F.col(c)).alias(c) for c in names])

    known = existing.select(*IOC_KEY).join(merged.select(*IOC_KEY), IOC_KEY, "left_semi")
    added = merged.join(known, IOC_KEY, "left_anti").select(
        *IOC_KEY, "_new.*", F.col("_first_seen").alias("first_seen"), F.col("_last_seen").alias("last_seen"),
        F.lit(True).alias("active"), now.alias("created_at"), "_order.payload_id", "_order.pos")
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = assign_ids(added, ["payload_id", "pos", *IOC_KEY], start)
    return kept.unionByName(fresh.select(*names))


def deactivate_feed_iocs(iocs: DataFrame, feed_ids: DataFrame) -> DataFrame:
    """Mark indicators of the feeds in ``feed_ids(feed_id)`` as inactive."""
    gone = feed_ids.select("feed_id").distinct().withColumn("_gone", F.lit(True))
    return (iocs.join(gone, "feed_id", "left")
            .withColumn("active", F.col("active") & F.col("_gone").isNull()).select(*iocs.columns))


# -- feeds ------------------------------------------------------------------

def seed_feeds(spark: SparkSession) -> DataFrame:
    """The bundled feed definitions."""
    rows = [(n, t, u, {k: cfg.get(k) for k in PARSER_CONFIG.fieldNames()}, m)
            for n, t, u, cfg, m in SEED_FEEDS]
    return spark.createDataFrame(rows, FEEDS["name"].name + " string, type string, source_url string, "
                                 f"parser_config {PARSER_CONFIG.simpleString()}, auto_pull_minutes int")


def upsert_seed_feeds(feeds: DataFrame, seeds: DataFrame, now: Column) -> DataFrame:
    """Feed table after registering definitions by name among live feeds.

    A live feed of that name gets the new type, address, settings and interval and
    keeps its pull history; other names become new feeds.
    """
    changed = ["type", "source_url", "parser_config", "auto_pull_minutes"]
    live = F.col("deleted_at").isNull()
    renamed = seeds.select(F.col("name").alias("_name"), F.lit(True).alias("_hit"),
                           *[F.col(c).alias(f"_{c}") for c in changed])
    kept = feeds.join(renamed, live & (F.col("name") == F.col("_name")), "left").select(*[
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in FEEDS.fieldNames()])
    fresh = seeds.join(feeds.filter(live).select("name"), "name", "left_anti")
    return kept.unionByName(_new_feed_rows(fresh, feeds, ["name"], now))


def _new_feed_rows(rows: DataFrame, feeds: DataFrame, order: list[str], now: Column) -> DataFrame:
    start = feeds.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = assign_ids(rows, order, start)
    given = {"enabled": F.lit(True), "created_at": now}
    return numbered.select(*[
        (F.col(f.name) if f.name in numbered.columns else given.get(f.name, F.lit(None)))
        .cast(f.dataType).alias(f.name) for f in FEEDS.fields])


def check_feed_changes(changes: DataFrame, feeds: DataFrame) -> DataFrame:
    """Changes with trimmed texts and ``reason``: NULL when accepted, else why not.

    ``changes(change_id, op, feed_id, name, type, source_url, auth_json,
    parser_config, enabled, auto_pull_minutes)``; ``op`` is ``create`` or
    ``update``; a NULL field of an update means "leave as it is". A name may be
    claimed once: a live feed keeps it, then the lowest ``change_id`` gets it.
    """
    is_new = F.col("op") == "create"
    tidy = changes.withColumns({
        "name": F.when(is_new, strip(F.coalesce("name", F.lit("")))).otherwise(F.col("name")),
        "source_url": F.when(is_new, strip(F.coalesce("source_url", F.lit("")))).otherwise(F.col("source_url"))})
    live = feeds.filter("deleted_at IS NULL")
    owner = live.select("name", F.col("id").alias("_owner"))
    known = live.select(F.col("id").alias("feed_id"), F.lit(True).alias("_known"))
    bad_type = ~F.coalesce(F.col("type"), F.lit("")).isin(*FEED_TYPES)
    type_error = "type must be one of (" + ", ".join(f"'{t}'" for t in FEED_TYPES) + ")"
    taken = F.concat(F.lit("a feed named '"), F.col("name"), F.lit("' already exists"))
    reason = (F.when(is_new & (F.col("name") == ""), "name is required")
              .when(is_new & bad_type, type_error)
              .when(is_new & (F.col("source_url") == ""), "source_url is required")
              .when(~is_new & F.col("_known").isNull(), "feed not found")
              .when(~is_new & F.col("type").isNotNull() & bad_type, type_error)
              .when(F.col("_owner").isNotNull() & (is_new | (F.col("_owner") != F.col("feed_id"))), taken))
    first_pass = (tidy.join(owner, "name", "left").join(known, "feed_id", "left")
                  .withColumn("reason", reason))
    claims = (first_pass.filter("reason IS NULL AND name IS NOT NULL AND _owner IS NULL")
              .groupBy("name").agg(F.min("change_id").alias("change_id"))
              .select("change_id", F.lit(True).alias("_wins")))
    lost = (F.col("reason").isNull() & F.col("name").isNotNull() & F.col("_owner").isNull()
            & F.col("_wins").isNull())
    return (first_pass.join(claims, "change_id", "left")
            .withColumn("reason", F.when(lost, taken).otherwise(F.col("reason")))
            .select(*changes.columns, "reason"))


def apply_feed_changes(feeds: DataFrame, checked: DataFrame, now: Column) -> DataFrame:
    """Feed table after the accepted changes; of several updates the last one wins per field."""
    fields = ["name", "type", "source_url", "auth_json", "parser_config", "enabled", "auto_pull_minutes"]
    good = checked.filter("reason IS NULL")
    updates = good.filter("op = 'update'").groupBy(F.col("feed_id").alias("id")).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change_id"))).alias(f"_{c}") for c in fields])
    kept = feeds.join(updates, "id", "left").select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in FEEDS.fieldNames()])
    minutes = F.coalesce(F.nullif("auto_pull_minutes", F.lit(0)), F.lit(DEFAULT_PULL_MINUTES))
    fresh = good.filter("op = 'create'").select(
        "change_id", "name", "type", "source_url", F.coalesce("auth_json", F.lit("{}")).alias("auth_json"),
        "parser_config", minutes.alias("auto_pull_minutes"))
    return kept.unionByName(_new_feed_rows(fresh, feeds, ["change_id"], now))


def soft_delete_feeds(feeds: DataFrame, feed_ids: DataFrame, now: Column) -> DataFrame:
    """Mark feeds as deleted and disabled; see also :func:`deactivate_feed_iocs`."""
    gone = feed_ids.select(F.col("feed_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    return (feeds.join(gone, "id", "left")
            .withColumn("deleted_at", F.when(F.col("_gone"), now).otherwise(F.col("deleted_at")))
            .withColumn("enabled", F.col("enabled") & F.col("_gone").isNull())
            .select(*feeds.columns))


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter("enabled AND deleted_at IS NULL")


# -- pulls ------------------------------------------------------------------

def pull_log_rows(results: DataFrame, *keep: str) -> DataFrame:
    """Log rows of ``results(feed_id, pulled_at, n, error)``; ``keep`` names columns to carry along."""
    failed = F.col("error").isNotNull()
    return results.select(
        *keep, "feed_id", F.col("pulled_at").alias("ts"),
        F.when(failed, "error").otherwise("info").alias("level"),
        F.when(failed, F.concat(F.lit("pull failed: "), F.col("error"))).otherwise(
            F.concat(F.lit("pull ok: ok ("), F.col("n").cast("string"), F.lit(")"))).alias("message"))


def record_pulls(feeds: DataFrame, results: DataFrame) -> DataFrame:
    """Feed table with the outcome of each feed's latest pull."""
    status = F.when(F.col("error").isNotNull(), "error").otherwise(
        F.concat(F.lit("ok ("), F.col("n").cast("string"), F.lit(")")))
    latest = results.groupBy(F.col("feed_id").alias("id")).agg(
        F.max_by(F.struct(F.col("pulled_at").alias("_pull"), status.alias("_status"),
                          F.left("error", F.lit(ERROR_TEXT_CHARS)).alias("_error")), "pulled_at").alias("_r")).select("id", "_r.*")
    pulled = F.col("_pull").isNotNull()
    put = {"last_pull": "_pull", "last_status": "_status", "last_error": "_error"}
    return feeds.join(latest, "id", "left").select(*[
        F.when(pulled, F.col(put[c])).otherwise(F.col(c)).alias(c) if c in put else F.col(c)
        for c in FEEDS.fieldNames()])


def pending_pulls(requests: DataFrame, feeds: DataFrame, limit: int = PENDING_PULLS_LIMIT) -> DataFrame:
    """The next unprocessed requests by id, with what to do about each."""
    usable = enabled_feeds(feeds).select(F.col("id").alias("feed_id"), F.lit(True).alias("_ok"))
    head = requests.filter("processed_at IS NULL").select("id", "feed_id").orderBy("id").limit(limit)
    return head.join(usable, "feed_id", "left").select(
        "id", "feed_id", F.when(F.col("_ok"), "pull").otherwise("skipped (feed unavailable)").alias("status"))


def request_pulls(requests: DataFrame, wanted: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """Queue after adding ``wanted(request_no, feed_id)``; deleted and unknown feeds are refused.

    A disabled feed may be asked for; the triage skips it.
    """
    live = feeds.filter("deleted_at IS NULL").select(F.col("id").alias("feed_id"))
    start = requests.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = assign_ids(wanted.join(live, "feed_id", "left_semi"), ["request_no"], start).select(
        "id", "feed_id", now.alias("requested_at"))
    return requests.unionByName(added, allowMissingColumns=True)


def finish_pulls(requests: DataFrame, pending: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Queue after a round: skipped requests and those whose feed has a result are done.

    ``pending`` is the triage, ``results(feed_id, n, error)`` the outcome per feed. The
    pending rows are bounded by the round's limit.
    """
    outcome = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.left("error", F.lit(200)))).when(
        F.col("n").isNotNull(), F.concat(F.lit("ok ("), F.col("n").cast("string"), F.lit(")")))
    done = (pending.join(results.select("feed_id", "n", "error"), "feed_id", "left")
            .select("id", F.when(F.col("status") == "pull", outcome).otherwise(F.col("status")).alias("_status"))
            .filter("_status IS NOT NULL"))
    hit = F.col("_status").isNotNull()
    put = {"processed_at": F.when(hit, now).otherwise(F.col("processed_at")),
           "status": F.coalesce("_status", "status")}
    return requests.join(done, "id", "left").select(
        *[put.get(c, F.col(c)).alias(c) for c in requests.columns])


# -- snapshot versions ------------------------------------------------------

def publish_version(iocs: DataFrame, feeds: DataFrame, root: str, raise_version: bool = True) -> int:
    """Write both tables into a folder of their own and then its pointer row; returns the version.

    Folders are never written twice, so writers cannot clobber one another, and a table without
    a pointer row is not visible. ``raise_version=False`` replaces the tables of the current
    version, for a round that changed no indicator.
    """
    spark = iocs.sparkSession
    version, order, _ = _newest(spark, root)
    version += raise_version or not version
    folder = f"v{version}-{uuid.uuid4().hex}"
    iocs.write.parquet(f"{root}/{folder}/iocs")
    feeds.write.parquet(f"{root}/{folder}/feeds")
    spark.createDataFrame([(version, order + 1, folder)], _POINTER).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


_POINTER = "version bigint, published bigint, folder string"


def _newest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, int, str | None]:
    """(version, order of publication, folder) of the newest pointer, or of the version's newest."""
    if not path_exists(spark, f"{root}/versions"):
        return 0, 0, None
    rows = spark.read.schema(_POINTER).parquet(f"{root}/versions")
    found = (rows if version is None else rows.where(F.col("version") == version)).orderBy(
        F.desc("version"), F.desc("published"), F.desc("folder")).first()
    return tuple(found) if found else (0, 0, None)


def current_version(spark: SparkSession, root: str) -> int:
    """Latest published version, 0 when there is none."""
    return _newest(spark, root)[0]


def read_version(spark: SparkSession, root: str, version: int) -> tuple[DataFrame, DataFrame]:
    """``(iocs, feeds)`` of a version."""
    folder = _newest(spark, root, version)[2]
    return (spark.read.schema(IOCS).parquet(f"{root}/{folder}/iocs"),
            spark.read.schema(FEEDS).parquet(f"{root}/{folder}/feeds"))
