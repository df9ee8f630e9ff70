"""Sources and sinks: landed text and payload files, stored tables, JSON rows."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsight.constants import PAYLOAD_CAP_BYTES
from netsight.operators.feeds import admit_payloads, too_large
from netsight.operators.ids import assign_ids, number_stored
from netsight.operators.ingest import EVENT_COLUMNS, accepted, parse_lines
from netsight.operators.match import new_detections
from netsight.schemas import DETECTIONS, EVENTS, fields_of
from netsight.session import stage_scope, written_once
from netsight.sources.commits import CommitLog, LogTable


def valid_text(df: DataFrame, column: str) -> DataFrame:
    """Bytes to text with U+FFFD for bad UTF-8."""
    return df.withColumn(column, F.make_valid_utf8(F.col(column).cast("string")))


def read_syslog_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one datagram per line, as ``line``; blank lines are kept."""
    return valid_text(spark.read.text(path, lineSep="\n").withColumnRenamed("value", "line"), "line")


def read_payload_files(spark: SparkSession, path: str, cap: int = PAYLOAD_CAP_BYTES) -> DataFrame:
    """Payload files under ``feed_id=…/payload_id=…/`` as text rows.

    Files above ``cap`` are told by their length and never opened; they get an ``error``.
    """
    files = spark.read.format("binaryFile").option("basePath", path).load(f"{path}/feed_id=*/payload_id=*/*")
    keys = [F.col("feed_id").cast("int"), F.col("payload_id").cast("bigint"), F.col("modificationTime").alias("pulled_at")]
    admitted = admit_payloads(files.where(F.col("length") <= cap).select(*keys, F.col("content").alias("payload")), cap=cap)
    refused = files.where(F.col("length") > cap).select(
        *keys, F.lit(None).cast("string").alias("payload"), F.col("length").cast("int").alias("n_bytes"),
        too_large(F.col("payload_id"), cap).alias("error"))
    return admitted.unionByName(refused)


EVENTS_BY_DAY = f"{fields_of(EVENTS)}, event_date date"
DETECTIONS_BY_DAY = f"{fields_of(DETECTIONS)}, event_date date, created_date date"


def events_table(spark: SparkSession, path: str) -> LogTable:
    """The event folder at ``path`` by its commit log."""
    return LogTable(CommitLog(spark, path), "rows", EVENTS_BY_DAY, path)


def detections_table(spark: SparkSession, path: str) -> LogTable:
    return LogTable(CommitLog(spark, path), "rows", DETECTIONS_BY_DAY, path)


def _commit_new(spark: SparkSession, rows: DataFrame, path: str, bounds: tuple[str, ...], day: str, state: dict) -> None:
    """Put the files of ``path`` that are in no commit yet into its log."""
    log = CommitLog(spark, path)
    known = log.version().files.get("rows", {})
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, paths = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".parquet") and f"/{day}=" in name:
            paths.append(name)
    same = {p.partition(":")[2].lstrip("/") for p in known}  # schemes may come with one slash or three
    fresh = [p for p in paths if p.partition(":")[2].lstrip("/") not in same]
    log.commit({"rows": log.written(rows, path, bounds, day, fresh) if fresh else []}, state)


def append_events(lines: DataFrame, path: str, tz: str = "UTC", start: int = 0) -> dict[str, int]:
    """Parse lines and append the events, one folder per UTC day; returns the counters of the write.

    Ids go up in arrival order. Every line is parsed once, into an intermediate table; the ranges
    of arrivals are counted from its order columns, and its rows numbered as they are written.
    The counters are measured where the rows pass to the writers.
    """
    spark = lines.sparkSession
    read, stored = Observation(), Observation()
    with stage_scope(spark):
        parsed = parse_lines(lines, tz).observe(
            read, F.count("*").alias("received"), F.count_if(F.col("reject_reason").isNull()).alias("parsed"),
            F.count_if(F.col("reject_reason") == "error").alias("errors"))
        kept = written_once(accepted(parsed), "parsed")
        rows = (number_stored(kept, ["received_at", "line_id"], start)
                .select(*EVENTS.fieldNames(), F.to_date("ts").alias("event_date")))
        rows.observe(stored, F.count("*").alias("stored")).write.mode("append").partitionBy("event_date").parquet(path)
        measured = {"received": 0, "parsed": 0, "errors": 0, "stored": 0} | read.get | stored.get
        _commit_new(spark, rows, path, ("id",), "event_date", measured)
    return measured


def append_detections(hits: DataFrame, path: str, stored: DataFrame | None = None, start: int = 0) -> int:
    """Append hits that are not stored yet, numbered by event, indicator and match type; returns how many."""
    fresh = hits if stored is None else new_detections(hits, stored)
    count = Observation()
    with stage_scope(hits.sparkSession):
        rows = assign_ids(fresh, ["event_id", "ioc_id", "match_type"], start)
        day = F.col("event_date") if "event_date" in rows.columns else F.lit(None).cast("date").alias("event_date")
        rows = rows.select(*DETECTIONS.fieldNames(), day, F.to_date("created_at").alias("created_date"))
        rows.observe(count, F.count("*").alias("n")).write.mode("append").partitionBy("created_date").parquet(path)
        n = count.get["n"]
        _commit_new(hits.sparkSession, rows, path, ("id", "event_id", "ioc_id"), "created_date", {"stored": n})
    return n


def _json_value(value: Column, kind: T.DataType) -> Column:
    """Times as ISO 8601 text (fraction only when there is one), decimals as doubles."""
    if isinstance(kind, T.TimestampType):
        fraction = F.when(F.unix_micros(value) % 1_000_000 != 0, F.date_format(value, ".SSSSSS"))
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(fraction, F.lit("")),
                        F.date_format(value, "xxx"))
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _json_value(v, kind.elementType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_json_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text, nested values included, missing values as ``null``."""
    return df.select(json_object(df, *df.columns).alias("json"))


def json_object(df: DataFrame, *names: str) -> Column:
    """Some columns of ``df`` as the text ``json_rows`` gives for them."""
    safe = [_json_value(F.col(n), df.schema[n].dataType).alias(n) for n in names]
    return F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})


def json_joined(*objects: Column) -> Column:
    """One JSON object with the fields of several, in their order; each has a field at least."""
    fields = [F.substr(o, F.lit(2), F.length(o) - 2) for o in objects]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
