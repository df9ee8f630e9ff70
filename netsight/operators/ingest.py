"""Syslog lines to events: one narrow pass, no shuffle, no Python worker."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.functions import syslog as S
from netsight.functions.text import computed_once
from netsight.schemas import EVENTS

EVENT_COLUMNS = [name for name in EVENTS.fieldNames() if name != "id"]


def parse_lines(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Parse ``lines(line_id, received_at, line)``.

    Adds every event column plus ``reject_reason``: NULL for an event, else
    ``empty``, ``bad_timestamp`` (impossible date or time) or ``error`` (unknown
    month, or 29 February in a year that has none). ``received_at`` is the clock
    that supplies the missing year, so replays give the same result. ``tz`` is the
    zone of the senders; an unknown zone counts as UTC.
    """
    c = F.col
    parts, clock = c("_parts"), c("_clock")
    now = c("received_at").cast("timestamp_ntz")
    lines = lines.withColumn("raw", S.raw_text(c("line")))
    split = computed_once(lines, "_parts", S.header_parts(c("raw")))
    timed = computed_once(split, "_clock", S.header_clock(parts, now))
    staged = (
        timed.withColumns({
            "pri": parts[0].try_cast("int"),
            "host": parts[6],
            "_rest": S.without_repeated_host(F.coalesce(parts[7], c("raw")), parts[6]),
        })
        .withColumn("_tag", S.tag_parts(c("_rest")))
        .withColumns({
            "tag": S.without_pid(c("_tag")[0]),
            "msg": F.coalesce(c("_tag")[1], c("_rest")),
        })
        .withColumn("_daemon", S.hidden_daemon(c("tag"), c("msg")))
        .withColumns({
            "tag": F.when(c("_daemon").isNotNull(), S.daemon_name(c("_daemon"))).otherwise(c("tag")),
            "msg": F.when(c("_daemon").isNotNull(), S.after_head(c("msg"), c("_daemon")))
                    .otherwise(c("msg")),
        })
        .withColumn("_pairs", S.key_values(c("msg")))
        .withColumns({
            "_src": S.last_value(c("_pairs"), "SRC"),
            "_dst": S.last_value(c("_pairs"), "DST"),
            "_sport": S.last_value(c("_pairs"), "SPT"),
            "_dport": S.last_value(c("_pairs"), "DPT"),
            "proto": S.last_value(c("_pairs"), "PROTO"),
            "in_if": S.last_value(c("_pairs"), "IN"),
            "out_if": S.last_value(c("_pairs"), "OUT"),
            "action": S.firewall_action(c("tag"), c("msg"), c("_pairs")),
            "hostname": F.coalesce(S.dns_query_name(c("tag"), c("msg")),
                                   S.dhcp_client_name(c("tag"), c("msg"))),
            "_querier": S.dns_querier(c("tag"), c("msg")),
        })
        # a SRC field that is no address still blocks the querier
        .withColumn("_ips", S.canonical_all(F.coalesce(c("_src"), c("_querier")), c("_dst")))
    )
    reason = (F.when(c("raw") == "", "empty")
              .when(parts.isNull(), None)
              .when(~clock["known_month"], "error")
              .when(~clock["possible"], "bad_timestamp")
              .when(clock["local"].isNull(), "error"))
    return staged.select(
        "line_id", "line", reason.alias("reject_reason"),
        F.when(parts.isNull(), c("received_at")).otherwise(S.local_to_utc(clock["local"], tz)).alias("ts"),
        "received_at", "host", "pri",
        S.facility_name(c("pri")).alias("facility"),
        S.severity_name(c("pri")).alias("severity"),
        "tag", "raw",
        c("_ips")[0].alias("src_ip"), c("_ips")[1].alias("dst_ip"),
        S.port_number(c("_sport")).alias("src_port"),
        S.port_number(c("_dport")).alias("dst_port"),
        "proto", "action", "in_if", "out_if", "msg", "hostname")


def accepted(parsed: DataFrame) -> DataFrame:
    """Parsed lines that became events."""
    return parsed.filter("reject_reason IS NULL").select("line_id", *EVENT_COLUMNS)


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines that gave no event, with the reason."""
    return parsed.filter("reject_reason IS NOT NULL").select(
        "line_id", "line", F.col("reject_reason").alias("reason"))


def ingest_counters(parsed: DataFrame, stored: DataFrame, detections: DataFrame) -> DataFrame:
    """received / parsed / stored / detections / errors as ``(counter, n)`` rows.

    ``stored`` and ``detections`` are the rows that really got into their tables; what was parsed
    and is not there counts as an error. One aggregate per table.
    """
    ok = F.col("reject_reason").isNull()
    n = F.count(F.lit(1))
    lines = parsed.agg(n.alias("received"), F.count_if(ok).alias("parsed"),
                       (F.count_if(F.col("reject_reason") == "error") + F.count_if(ok)).alias("errors"))
    kept = stored.agg(n.alias("stored"), (-n).alias("errors"))
    hits = detections.agg(n.alias("detections"))
    rows = [df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in df.columns]))).select("col.*")
            for df in (lines, kept, hits)]
    return reduce(DataFrame.unionByName, rows).groupBy("counter").agg(F.sum("n").alias("n"))
