"""Syslog lines, feeds and indicators derived from the star-schema tables.

The SQL texts below only use functions that mean the same in Spark and in an ANSI
engine, so a check can compute the expected values from the generating columns
while the engine has to recover them by parsing the rendered lines. ``{name}``
stands for a table; ``{header}`` for the text ``Mon dd HH:MM:SS`` of ``ts``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.schemas import PARSER_CONFIG
from netsight.session import spread

SPARK_HEADER = "date_format(ts, 'MMM dd HH:mm:ss')"

DIV = "CAST(floor({0} / {1}) AS BIGINT)"


def _div(a, b) -> str:
    return DIV.format(a, b)


def _text(expr) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


def _dotted(n: str) -> str:
    """SQL text of 10.a.b.c for the low 24 bits of ``n``."""
    parts = [f"{_div(n, 65536)} % 256", f"{_div(n, 256)} % 256", f"{n} % 256"]
    return "'10.' || " + " || '.' || ".join(_text(p) for p in parts)


def _hex(expr) -> str:
    return f"lower(hex(CAST({expr} AS BIGINT)))"


# 198.51.100.7 is the destination of a third of all flows
EVENT_TRUTH = f"""
SELECT *,
  CASE WHEN shape = 'no_header' THEN NULL WHEN event_type IN ('click', 'error') THEN 166
       WHEN event_type = 'view' THEN 14 ELSE 29 END AS pri,
  CASE WHEN shape = 'no_header' THEN NULL WHEN event_type = 'view' THEN 'core7' ELSE 'rt-02' END AS host,
  CASE WHEN shape = 'no_header' AND event_type = 'view' THEN 'core7 ' || body ELSE body END AS msg,
  CASE event_type WHEN 'click' THEN 'lan3' WHEN 'error' THEN 'wan1' WHEN 'view' THEN 'vlan40' END AS in_if,
  CASE event_type WHEN 'click' THEN 'wan0' WHEN 'view' THEN 'wan6' END AS out_if,
  CASE event_type WHEN 'click' THEN 'TCP' WHEN 'error' THEN 'UDP' WHEN 'view' THEN 'ICMP' END AS proto,
  CASE event_type WHEN 'click' THEN 1024 + event_id % 60000 WHEN 'error' THEN 1901 END AS src_port,
  CASE event_type WHEN 'click' THEN 8443 WHEN 'error' THEN 1900 END AS dst_port,
  CASE WHEN shape = 'empty' THEN ''
       WHEN event_type = 'view' AND shape = 'no_header' THEN 'core7 ' || body
       WHEN shape = 'no_header' THEN tag_text || body
       ELSE CASE WHEN event_type IN ('click', 'error') THEN '<166>'
                 WHEN event_type = 'view' THEN '<14>' ELSE '<29>' END
            || CASE shape WHEN 'error' THEN 'Foo' || substr(hdr, 4)
                          WHEN 'bad_timestamp' THEN substr(hdr, 1, 7) || '25' || substr(hdr, 10)
                          ELSE hdr END
            || CASE WHEN event_type = 'view' THEN ' core7 core7 ' ELSE ' rt-02 ' || tag_text END
            || body END AS line
FROM (
  SELECT *,
    CASE event_type
      WHEN 'click' THEN 'seq 41 [web-ACCEPT-3] OUT=wan0 IN=lan3 PROTO=TCP DPT=8443 SPT=' || {_text("1024 + event_id % 60000")}
           || ' DST=' || dst_ip || ' SRC=' || src_text || ' QUEUE=2'
      WHEN 'error' THEN 'seq 42 [edge-DROP] OUT= IN=wan1 PROTO=UDP DPT=1900 SPT=1901 DST=' || dst_ip || ' SRC=' || src_text || ' HOPS=3'
      WHEN 'view' THEN '[' || action || '] NOTE="lab, north" OUT=wan6 IN=vlan40 DST=' || dst_ip || ' PROTO=ICMP SRC=' || src_text
      WHEN 'purchase' THEN 'query[AAAA] ' || hostname || ' from ' || src_text
      ELSE CASE event_id % 4
           WHEN 0 THEN 'DHCPACK(lan3) ' || src_text || ' 02:5e:77:01:9c:34 ' || hostname
           WHEN 1 THEN 'radio 2 has 4 stations'
           WHEN 2 THEN 'session resumed' ELSE 'beat ' || {_text("event_id")} END END AS body,
    CASE WHEN event_type = 'error' AND event_id % 6 = 5 THEN '02aa77c1,node-3: kernel: '
         WHEN tag = 'kernel' THEN 'kernel: ' WHEN tag IS NULL THEN '' ELSE tag || '[311]: ' END AS tag_text,
    CASE WHEN event_type = 'signup' OR src_text = 'router.local' THEN NULL
         WHEN src_g IS NULL THEN src_text
         ELSE '2001:db8:0:' || {_hex("src_g")} || '::' || {_hex("src_h")} END AS src_ip
  FROM (
    SELECT event_id, event_type, user_id, ts AS event_ts, {{header}} AS hdr,
      CASE event_id % 97 WHEN 0 THEN 'empty' WHEN 1 THEN 'error' WHEN 2 THEN 'bad_timestamp'
           WHEN 3 THEN 'no_header' ELSE 'ok' END AS shape,
      CASE WHEN event_type = 'click' AND event_id % 41 = 0 THEN 'router.local'
           WHEN event_type = 'view' AND event_id % 5 = 0
           THEN '2001:DB8:0:' || lpad(hex(CAST(1 + user_id % 255 AS BIGINT)), 4, '0') || ':0:0:0:'
                || hex(CAST(1 + event_id % 4095 AS BIGINT))
           ELSE {_dotted("user_id")} END AS src_text,
      CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 1 + user_id % 255 END AS src_g,
      CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 1 + event_id % 4095 END AS src_h,
      CASE WHEN event_type = 'signup' OR (event_type = 'click' AND event_id % 41 = 0)
                OR (event_type = 'view' AND event_id % 5 = 0) THEN NULL
           ELSE 167772160 + user_id % 16777216 END AS src_n,
      CASE WHEN event_type NOT IN ('click', 'error', 'view') THEN NULL
           WHEN event_id % 3 = 0 THEN '198.51.100.7'
           WHEN event_id % 3 = 1 THEN '198.51.' || {_text("96 + event_id % 8")} || '.'
                || {_text("1 + event_id % 254")}
           ELSE '100.' || {_text(f"64 + {_div('user_id', 256)} % 64")} || '.' || {_text("user_id % 256")}
                || '.' || {_text("event_id % 256")} END AS dst_ip,
      CASE WHEN event_type NOT IN ('click', 'error', 'view') THEN NULL
           WHEN event_id % 3 = 0 THEN 3325256711
           WHEN event_id % 3 = 1 THEN 3325231104 + 256 * (96 + event_id % 8) + 1 + event_id % 254
           ELSE 1677721600 + 65536 * (64 + {_div('user_id', 256)} % 64) + 256 * (user_id % 256)
                + event_id % 256 END AS dst_n,
      CASE event_type WHEN 'click' THEN 'web-ACCEPT-3' WHEN 'error' THEN 'edge-DROP'
           WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'DPIA-hold'
                            ELSE 'zone4.rule-' || {_text("event_id % 5")} END END AS action,
      CASE event_type WHEN 'click' THEN 'kernel' WHEN 'error' THEN 'kernel' WHEN 'purchase' THEN 'dnsmasq'
           WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'dnsmasq-dhcp' WHEN 1 THEN 'hostapd'
                              WHEN 2 THEN 'pppd' ELSE 'syslog' END END AS tag,
      CASE WHEN event_type = 'purchase' THEN
                CASE event_id % 3 WHEN 0 THEN 'h' || {_text("user_id")} || '.alpha.example.com'
                     WHEN 1 THEN 'www.Z' || {_text("user_id")} || '.beta.example.net'
                     ELSE 'x' || {_text("user_id")} || '.gamma.example.org' END
           WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'dev' || {_text("event_id % 9")} END AS hostname
    FROM {{events}}
  ) base
) body
"""

# columns past created_at are ground truth for checks: v4 range, v6 group and its shift, host
_IOC_COLUMNS = """
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'sample ' || CAST(k % 100 AS VARCHAR(20)) END AS description,
  CASE WHEN k % 4 = 0 THEN NULL ELSE 'c2,t' || CAST(k % 7 AS VARCHAR(20)) END AS tags_text,
  CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN '70' END AS severity,
  CASE WHEN k % 2 = 0 THEN 'https://ref.example/' || CAST(k AS VARCHAR(20)) END AS reference,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(k % 20 AS INT) * INTERVAL '1' DAY AS first_seen,
  TIMESTAMP '2024-01-21 00:00:00' + CAST(k % 9 AS INT) * INTERVAL '1' DAY AS last_seen,
  k % 10 <> 9 AS active,
  TIMESTAMP '2024-01-02 00:00:00' AS created_at"""

_PART_LEN = "CAST(24 + k % 9 AS INT)"
_PART_NET = f"(1677721600 + 65536 * (64 + {_div('k', 256)} % 64) + 256 * (k % 256) + (k * 37) % 256)"
_POW = "CAST(power(2, 32 - {0}) AS BIGINT)"

IOC_TRUTH = f"""
SELECT 8 * k AS id, CAST(1 + {_div('k', 15)} AS INT) AS feed_id, 'ip' AS type,
  {_dotted('(2 * k)')} AS value, {_IOC_COLUMNS},
  CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS BIGINT) AS g,
  CAST(NULL AS BIGINT) AS shift, CAST(NULL AS VARCHAR(200)) AS host
FROM (SELECT c_custkey AS k FROM {{customer}}) c
UNION ALL
SELECT 8 * k + 1, CAST(1 + k % 10 AS INT), 'cidr',
  '198.51.' || {_text('96 + k % 8')} || '.' || {_text('8 * (k % 30)')} || '/' || {_text('24 + k % 6')},
  {_IOC_COLUMNS},
  {_div("(3325231104 + 256 * (96 + k % 8) + 8 * (k % 30))", _POW.format('(24 + k % 6)'))} * {_POW.format('(24 + k % 6)')},
  ({_div("(3325231104 + 256 * (96 + k % 8) + 8 * (k % 30))", _POW.format('(24 + k % 6)'))} + 1) * {_POW.format('(24 + k % 6)')} - 1,
  NULL, NULL, NULL
FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM {{nation}}) n
UNION ALL
SELECT 8 * k + 2, CAST(1 + k % 10 AS INT), 'cidr',
  '2001:db8:0:' || {_hex('1 + k * 10')} || '::/' || {_text('64 - 4 * (k % 3)')}, {_IOC_COLUMNS},
  NULL, NULL, 1 + k * 10, 4 * (k % 3), NULL
FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM {{nation}}) n
UNION ALL
SELECT 8 * k + 3, CAST(1 + k AS INT), 'domain',
  CASE WHEN k % 2 = 0 THEN 'H' || {_text('k')} || '.alpha.example.com'
       ELSE 'z' || {_text('k')} || '.beta.example.net' END, {_IOC_COLUMNS},
  NULL, NULL, NULL, NULL,
  CASE WHEN k % 2 = 0 THEN 'h' || {_text('k')} || '.alpha.example.com'
       ELSE 'z' || {_text('k')} || '.beta.example.net' END
FROM (SELECT s_suppkey AS k FROM {{supplier}}) s
UNION ALL
SELECT 8 * k + 4, CAST(1 + {_div('k', 5)} AS INT), 'url',
  CASE WHEN k % 4 = 0 THEN 'http://X' || {_text('k')} || '.gamma.example.org./x' ELSE url END, {_IOC_COLUMNS},
  NULL, NULL, NULL, NULL,
  CASE WHEN k % 4 = 0 THEN 'x' || {_text('k')} || '.gamma.example.org' 
       ELSE lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) END
FROM (SELECT page_id AS k, url FROM {{pages}}) p
UNION ALL
SELECT 8 * k + 5, CAST(1 + {_div('k', 20)} AS INT), 'cidr',
  CASE WHEN k % 50 = 7 THEN '100.64.0.0/99' ELSE
  '100.' || {_text(f"64 + {_div('k', 256)} % 64")} || '.' || {_text('k % 256')} || '.' || {_text('(k * 37) % 256')}
  || CASE WHEN k % 10 = 0 THEN '/255.255.255.' || {_text(f"256 - {_POW.format(_PART_LEN)}")}
          WHEN k % 10 = 1 AND k % 9 < 8 THEN '/0.0.0.' || {_text(f"{_POW.format(_PART_LEN)} - 1")}
          ELSE '/' || {_text(_PART_LEN)} END END, {_IOC_COLUMNS},
  CASE WHEN k % 50 <> 7 THEN {_div(_PART_NET, _POW.format(_PART_LEN))} * {_POW.format(_PART_LEN)} END,
  CASE WHEN k % 50 <> 7 THEN ({_div(_PART_NET, _POW.format(_PART_LEN))} + 1) * {_POW.format(_PART_LEN)} - 1 END,
  NULL, NULL, NULL
FROM (SELECT p_partkey AS k FROM {{part}}) p
UNION ALL
SELECT 8 * k + 6, CAST(1 + k AS INT), 'cidr', '10.0.' || {_text('k')} || '.0/26', {_IOC_COLUMNS},
  167772160 + 256 * k, 167772160 + 256 * k + 63, NULL, NULL, NULL
FROM (SELECT CAST(r_regionkey AS BIGINT) AS k FROM {{region}}) r
"""

FEED_TRUTH = """
SELECT CAST(1 + s_suppkey AS INT) AS id, 'feed-' || s_name AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'csv' WHEN 2 THEN 'stix' ELSE 'taxii' END AS type,
  'https://feeds.example/' || CAST(s_suppkey AS VARCHAR(20)) AS source_url,
  s_suppkey % 7 <> 3 AS enabled,
  CASE WHEN s_suppkey % 2 = 0 THEN 60 ELSE 1440 END AS auto_pull_minutes,
  CASE WHEN s_suppkey % 11 = 4 THEN TIMESTAMP '2024-01-20 00:00:00' END AS deleted_at,
  TIMESTAMP '2023-12-01 00:00:00' AS created_at, s_suppkey AS k
FROM {supplier}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_truth(spark: SparkSession, sf_dir: str, ranges: int | None = None) -> DataFrame:
    """Events with what their lines say. Few bytes of events make long lines, so the narrow rows are dealt first: to all cores, or to ranges of time."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    events = spread(events) if ranges is None else events.repartitionByRange(ranges, "ts")
    return spark.sql(EVENT_TRUTH.replace("{header}", SPARK_HEADER), events=events)


def _lines_of(truth: DataFrame) -> DataFrame:
    return truth.select(
        F.col("event_id").alias("line_id"),
        (F.col("event_ts") + F.expr("INTERVAL 3 SECONDS")).cast("timestamp").alias("received_at"),
        "line")


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(line_id, received_at, line)``: one line per row of the events table.

    The lines are finished before they are dealt out, so that no parser works on the texts' expressions.
    """
    return spread(_lines_of(event_truth(spark, sf_dir)))


def syslog_lines_by_arrival(spark: SparkSession, sf_dir: str, ranges: int) -> DataFrame:
    """``syslog_lines`` in ranges of ``received_at``; no line is moved, since the events are before they have one."""
    return _lines_of(event_truth(spark, sf_dir, ranges))


def iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["customer", "nation", "supplier", "pages", "part", "region"]
    truth = spark.sql(IOC_TRUTH, **{n: table(spark, sf_dir, n) for n in names})
    return truth.select(
        "id", "feed_id", "type", "value", "description",
        F.split("tags_text", ",").alias("tags"), "severity", "reference",
        "first_seen", "last_seen", "active", "created_at")


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = spark.sql(FEED_TRUTH, supplier=table(spark, sf_dir, "supplier"))
    csv = F.col("type") == "csv"
    config = F.struct(
        F.when(csv, True).alias("has_header"),
        F.when(csv, F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")),
                                 (F.col("k") % 3 + 1).cast("int"))).alias("delimiter"),
        F.when(csv, 2).alias("value_column"), F.when(csv, 3).alias("description_column"),
        F.when(csv, 4).alias("tags_column"), F.when(csv, 5).alias("reference_column"),
        F.when(F.col("k") % 8 == 3, "col-b").when(F.col("k") % 16 == 7, "nope").alias("collection_id"),
        F.lit(None).cast("string").alias("version"))
    return truth.select(
        "id", "name", "type", "source_url",
        F.when(F.col("k") % 3 == 0, '{"username": "guest", "password": "guest"}').alias("auth_json"),
        config.cast(PARSER_CONFIG).alias("parser_config"), "enabled", "auto_pull_minutes",
        F.lit(None).cast("timestamp").alias("last_pull"), F.lit(None).cast("string").alias("last_status"),
        F.lit(None).cast("string").alias("last_error"), F.col("deleted_at").cast("timestamp").alias("deleted_at"),
        F.col("created_at").cast("timestamp").alias("created_at"))
