"""Feed payloads, change requests and pull requests derived from the tables.

Payload texts follow the four feed formats. They are SQL expressions over a key
column ``k`` that mean the same in Spark and in an ANSI engine; one payload per
source row, so nothing is gathered into one text.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.schemas import PARSER_CONFIG
from netsight.session import spread
from netsight.sources.derived import _div, _dotted, _hex, _text, table


def _fill(template: str, **values: str) -> str:
    """SQL text expression of a template: ``<name>`` is replaced by the SQL value ``name``."""
    parts = re.split(r"(<\w+>)", template)
    sql = [values[p[1:-1]] if re.fullmatch(r"<\w+>", p) else "'" + p.replace("'", "''") + "'"
           for p in parts if p]
    return " || ".join(sql)


K = _text("k")
PLAIN_IP = f"CASE WHEN k % 2 = 0 THEN {_dotted('(2 * k)')} ELSE {_dotted('(2 * k + 1)')} END"
PLAIN_NET = f"'10.1.' || {_text(_div('k', 15) + ' % 256')} || '.9/24'"
PLAIN_DOMAIN = f"'H' || {K} || '.alpha.example.com'"
PLAIN_URL = f"'http://u' || {K} || '.example.org/p'"
PLAIN_TEXT = _fill(
    "# list <k><n>; v1<n><ip> ; SBL<k><n><n><net><n>bad-line<n>  <domain> # x<r><n><url><n>1.2.3.999<n>//c 9.9.9.9<n>",
    n="chr(10)", r="chr(13)", k=K, ip=PLAIN_IP, net=PLAIN_NET, domain=PLAIN_DOMAIN, url=PLAIN_URL)

CSV_DELIMITER = "CASE k % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END"
CSV_URL = f"'http://e' || {K} || '.example.com/a' || {CSV_DELIMITER} || 'b'"
CSV_IP = f"'10.9.' || {_text(_div('k', 256) + ' % 256')} || '.' || {_text('k % 256')}"
CSV_TEXT = _fill(
    '# comment<n>id<d>ioc<d>desc<d>tags<d>ref<n>'
    '1<d>"<url>"<d>"m ""x"" <k>"<d>"c2, bot"<d>https://r/<k><n>'
    '<n>2<d> "<ip>"<d> none<d><n>3<d>junk<d>z<r><n>'
    '4<d><domain><d>"two<n>lines"<d>t1<d>NULL',
    n="chr(10)", r="chr(13)", d=CSV_DELIMITER, k=K, url=CSV_URL, ip=CSV_IP, domain=PLAIN_DOMAIN)

_URL_OBJECT = (
    '{"type": "indicator", "pattern": "[url:value = \'<url>\']", "description": "page <k>", '
    '"labels": ["m", "c2"], "created": "2024-01-01T00:00:00.000Z", "modified": "2024-01-10T12:30:00.000Z", '
    '"confidence": <c>, "external_references": [{"source_name": "s"}, {"url": "https://r/<k>"}]}')
_OTHER_OBJECTS = (
    '{"type": "indicator", "pattern": "[domain-name:value = \'d<k>.example.com\' OR ipv4-addr:value IN '
    '(\'1.1.1.1\', \'<ip>\')]", "x_severity": "high", "confidence": 5}, "text", '
    '{"type": "ipv6-addr", "value": "2001:db8::<h>", "name": "n<k>"}, {"type": "malware", "name": "x"}, '
    '{"type": "indicator", "pattern": "[file:name = \'x\']"}')
STIX_V6 = f"'2001:db8::' || {_hex('1 + k % 65535')}"
ENVELOPE = '{"objects": [{"type": "indicator", "pattern": "[ipv4-addr:value = \'<ip>\']", "labels": ["<col>"]}]}'


def stix_text(shape: str) -> str:
    """Bundle object (0, 3), bare list (1) or one indicator object (2), by the SQL number ``shape``."""
    values = {"k": K, "url": "url", "c": _text("k % 100"), "ip": CSV_IP, "h": _hex("1 + k % 65535")}
    both = f"{_URL_OBJECT}, {_OTHER_OBJECTS}"
    return (f"CASE {shape} WHEN 1 THEN {_fill('[' + both + ']', **values)} "
            f"WHEN 2 THEN {_fill(_URL_OBJECT, **values)} "
            f"ELSE {_fill('{\"type\": \"bundle\", \"objects\": [' + both + ']}', **values)} END")


def envelope_text(collection: str) -> str:
    return _fill(ENVELOPE, ip=CSV_IP, col=collection)


PULLED_AT = "TIMESTAMP '2024-01-29 06:00:00'"


def _payloads(spark, sf_dir, source, key, text, feed, extra="") -> DataFrame:
    """One payload a row. Few bytes of keys make long texts, so the keys are dealt to all cores first, and
    the texts are finished before they are dealt out, so that no parser works on their expressions."""
    text = text.replace("{", "{{").replace("}", "}}")
    sql = (f"SELECT CAST({feed} AS INT) AS feed_id, k AS payload_id, {text} AS payload{extra} "
           f"FROM (SELECT {key} FROM {{t}}) s")
    names = [c.partition(" ")[0] for c in key.split(", ")]
    texts = spark.sql(sql, t=spread(table(spark, sf_dir, source).select(*names)))
    return spread(texts).withColumn("pulled_at", F.expr(PULLED_AT).cast("timestamp"))


def plain_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plain list per customer."""
    return _payloads(spark, sf_dir, "customer", "c_custkey AS k", PLAIN_TEXT, f"1 + {_div('k', 15)}")


def csv_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited text per part, with its parser settings."""
    df = _payloads(spark, sf_dir, "part", "p_partkey AS k", CSV_TEXT, f"1 + {_div('k', 20)}",
                   f", {CSV_DELIMITER} AS delimiter")
    none = F.lit(None).cast("string")
    config = F.struct(F.lit(True), "delimiter", F.lit(2), F.lit(3), F.lit(4), F.lit(5), none, none)
    return df.withColumn("parser_config", config.cast(PARSER_CONFIG)).drop("delimiter")


def stix_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One STIX document per page, in all shapes."""
    return _payloads(spark, sf_dir, "pages", "page_id AS k, url", stix_text("k % 4"), f"1 + {_div('k', 5)}")


def taxii_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two envelopes, one per collection, for each supplier; a third of them wants a missing one."""
    collection = lambda n, name: F.struct(F.lit(n).alias("n"), F.lit(name).alias("collection_id"))
    keys = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"),
        F.explode(F.array(collection(0, "col-a"), collection(1, "col-b"))).alias("c"),
    ).select("k", "c.collection_id", (2 * F.col("k") + F.col("c.n")).alias("payload_id"))
    wanted = F.when(F.col("k") % 3 == 1, "col-b").when(F.col("k") % 3 == 2, "nope")
    return keys.select(
        (F.col("k") + 1).cast("int").alias("feed_id"), "payload_id", "collection_id",
        F.expr(envelope_text("collection_id")).alias("payload"),
        F.expr(PULLED_AT).cast("timestamp").alias("pulled_at"),
        F.struct(wanted.alias("collection_id")).alias("parser_config"))


SWEEP_SHAPE = _div("k", 4) + " % 4"
SWEEP_URL = f"'http://p' || {_text('s_suppkey')} || '.example.com/'"
SWEEP_TEXT = (
    f"CASE k % 4 WHEN 0 THEN {PLAIN_TEXT} WHEN 1 THEN {CSV_TEXT} "
    f"WHEN 2 THEN CASE WHEN k % 12 = 2 THEN '{{bad' ELSE {stix_text(SWEEP_SHAPE)} END "
    f"ELSE {envelope_text(chr(39) + 'col-a' + chr(39))} END")


def sweep_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per feed, in the format of the feed's type."""
    df = spark.sql(f"SELECT s_suppkey AS k, {SWEEP_URL} AS url FROM {{t}}", t=table(spark, sf_dir, "supplier"))
    return df.select(
        (F.col("k") + 1).cast("int").alias("feed_id"), F.col("k").alias("payload_id"),
        F.expr(SWEEP_TEXT).alias("payload"), F.lit("col-a").alias("collection_id"),
        F.expr(PULLED_AT).cast("timestamp").alias("pulled_at"))


FEED_CHANGES = f"""
SELECT k AS change_id, CASE WHEN k % 3 = 0 THEN 'create' ELSE 'update' END AS op,
  CASE WHEN k % 3 <> 0 THEN CAST(1 + {_div('k', 12)} AS INT) END AS feed_id,
  CASE WHEN k % 6 = 0 THEN '  new-' || {_text(_div('k', 12))} || ' '
       WHEN k % 27 = 3 THEN '   '
       WHEN k % 6 = 3 THEN 'feed-Supplier#' || lpad({_text(_div('k', 15))}, 9, '0')
       WHEN k % 4 = 1 THEN 'ren-' || {_text(_div('k', 2))} END AS name,
  CASE WHEN k % 5 = 0 THEN 'bogus' WHEN k % 3 = 0 THEN 'plain' WHEN k % 7 = 1 THEN 'csv' END AS type,
  CASE WHEN k % 7 = 0 THEN '  ' WHEN k % 2 = 0 THEN 'https://n/' || {K} || ' ' END AS source_url,
  CASE WHEN k % 8 = 5 THEN FALSE WHEN k % 8 = 6 THEN TRUE END AS enabled,
  CASE WHEN k % 4 = 2 THEN CAST(k % 50 AS INT) END AS auto_pull_minutes
FROM (SELECT c_custkey AS k FROM {{customer}}) c
"""

PULL_REQUESTS = f"""
SELECT 1 + k AS id, CAST(1 + k % 40 AS INT) AS feed_id,
  CASE WHEN k % 3 <> 0 THEN TIMESTAMP '2024-01-28 00:00:00' END AS processed_at
FROM (SELECT c_custkey AS k FROM {{customer}}) c
"""

SEED_DEFINITIONS = """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'feed-' ELSE 'new-' END || s_name AS name, 'plain' AS type,
  'https://seed.example/' || CAST(s_suppkey AS VARCHAR(20)) AS source_url, 30 AS auto_pull_minutes
FROM {supplier}
"""


def feed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(FEED_CHANGES, customer=table(spark, sf_dir, "customer"))
    return df.withColumn("auth_json", F.lit(None).cast("string")).withColumn(
        "parser_config", F.lit(None).cast(PARSER_CONFIG))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PULL_REQUESTS, customer=table(spark, sf_dir, "customer"))


def seed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(SEED_DEFINITIONS, supplier=table(spark, sf_dir, "supplier"))
    return df.withColumn("parser_config", F.lit(None).cast(PARSER_CONFIG)).select(
        "name", "type", "source_url", "parser_config", "auto_pull_minutes")
