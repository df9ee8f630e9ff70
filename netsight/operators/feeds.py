"""Landed feed payloads to indicator rows.

Every parser takes ``payloads(feed_id, payload_id, payload)``, plus the feed's
``parser_config`` where it needs it, and returns one row per indicator:
``feed_id, payload_id, pos, type, value, description, tags, severity, reference,
first_seen, last_seen``; ``(payload_id, pos)`` keeps the order of the text. Parsers that
can fail work in outcome rows: indicators, and for a payload that cannot be read one row
with its ``error``, so that one pass over the payloads gives both.
A payload is split inside its own row; everything after the split is row-parallel
and needs no shuffle. A payload above the size cap fails its feed's pull, with
an error text; it is never cut or dropped in silence.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsight.constants import (
    ERROR_TEXT_CHARS, LINE_BREAK_PATTERN, NON_WS, PAYLOAD_CAP_BYTES)
from netsight.functions.csv import csv_fields, csv_records, first_field, has_bare_return
from netsight.functions.indicators import infer_ioc_type, pick_column, split_tags
from netsight.functions.stix import first_reference_url, ioc_type_of_kind, pattern_values, truthy
from netsight.functions.text import clean_value, computed_once, let, nullif_empty, strip
from netsight.operators.registry import enabled_feeds
from netsight.schemas import STIX_OBJECT

INDICATOR_COLUMNS = ["feed_id", "payload_id", "pos", "type", "value", "description", "tags",
                     "severity", "reference", "first_seen", "last_seen"]
OUTCOME_COLUMNS = [*INDICATOR_COLUMNS, "error"]


def _outcome_rows(df: DataFrame, **columns: Column) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    given = {"description": none("string"), "tags": none("array<string>"), "severity": none("string"),
             "reference": none("string"), "first_seen": none("timestamp"),
             "last_seen": none("timestamp"), "error": none("string"), **columns}
    return df.select("feed_id", "payload_id", "pos", *[c.alias(n) for n, c in given.items()]) \
        .select(*OUTCOME_COLUMNS)


def indicators_of(outcomes: DataFrame) -> DataFrame:
    """The indicator rows among outcome rows."""
    return outcomes.filter("error IS NULL").select(*INDICATOR_COLUMNS)


def too_large(payload_id: Column, cap: int) -> Column:
    return F.concat(F.lit(f"feed payload exceeds {cap} bytes: "), payload_id.cast("string"))


def admit_payloads(payloads: DataFrame, content: str = "payload",
                   cap: int = PAYLOAD_CAP_BYTES) -> DataFrame:
    """Binary or text payloads to text: bad UTF-8 replaced, ``error`` set beyond ``cap`` bytes."""
    size = F.octet_length(F.col(content))
    return (payloads.withColumn("n_bytes", size)
            .withColumn("error", F.when(size > cap, too_large(F.col("payload_id"), cap)))
            .withColumn(content, F.when(size <= cap, F.make_valid_utf8(F.col(content).cast("string")))))


def parse_plain(payloads: DataFrame) -> DataFrame:
    """One indicator per line; blank and comment lines, and text after ``;``, are skipped."""
    lines = (payloads.select("feed_id", "payload_id",
                             F.posexplode(F.split("payload", LINE_BREAK_PATTERN)).alias("pos", "line"))
             .withColumn("line", strip(F.col("line")))
             .filter((F.col("line") != "") & ~F.col("line").rlike("^(?:#|;|//)")))
    token = strip(F.split_part("line", F.lit(";"), F.lit(1)))
    first = lines.withColumn("first", F.regexp_extract(token, rf"(?U)^{NON_WS}+", 0))
    typed = computed_once(first, "type", infer_ioc_type(F.col("first"))).filter("type IS NOT NULL")
    return indicators_of(_outcome_rows(typed, type=F.col("type"), value=clean_value(F.col("first"))))


def _csv_split(payloads: DataFrame) -> DataFrame:
    """Payloads cut into raw records, and the ``error`` of those the dialect refuses."""
    delimiter = F.coalesce(F.col("parser_config.delimiter"), F.lit(","))
    split = computed_once(
        payloads.select("feed_id", "payload_id", "payload", F.col("parser_config").alias("cfg"), delimiter.alias("_d")),
        "records", csv_records(F.col("payload"), F.col("_d")))
    error = (F.when(F.length("_d") != 1, '"delimiter" must be a 1-character string')
             .when(has_bare_return(F.col("payload"), F.col("_d")), "new-line character seen in unquoted field"))
    return computed_once(split, "error", error).drop("payload")


def csv_rows(payloads: DataFrame) -> DataFrame:
    """Data records as ``(feed_id, payload_id, pos, cols, cfg, error)``: comments, then the header, dropped.

    A blank line is a record until after the header is gone. A refused payload gives one row with
    its error and no columns.
    """
    cfg, delimiter = F.col("cfg"), F.col("_d")
    comment = lambda r: F.regexp_extract(first_field(r, delimiter), r'(?U)^"?[\s\x1c-\x1f]*[#;]', 0) != ""

    def data(records: Column) -> Column:
        skip = F.when(cfg["has_header"], 1).otherwise(0)
        return let(F.filter(records, lambda r: ~comment(r)), lambda kept: F.slice(
            kept, skip + 1, F.greatest(F.size(kept) - skip, F.lit(0))))

    refused = F.col("error").isNotNull()
    records = _csv_split(payloads).select(
        "feed_id", "payload_id", "cfg", "_d", "error",
        F.posexplode(F.when(refused, F.array(F.lit(None).cast("string"))).otherwise(data(F.col("records")))).alias("pos", "record"))
    return computed_once(records.filter(refused | (strip(F.col("record")) != "")), "cols",
                         csv_fields(F.col("record"), F.col("_d"))).drop("_d", "record")


def csv_outcomes(payloads: DataFrame) -> DataFrame:
    """Delimited rows by the 1-based columns of ``parser_config``; untyped values drop out."""
    pick = lambda index: pick_column(F.col("cols"), index)
    cfg, refused = F.col("cfg"), F.col("error").isNotNull()
    rows = computed_once(csv_rows(payloads), "raw", pick(F.coalesce(cfg["value_column"], F.lit(1))))
    typed = computed_once(rows.filter(refused | F.col("raw").isNotNull()), "type", infer_ioc_type(F.col("raw")))
    return _outcome_rows(
        typed.filter(refused | F.col("type").isNotNull()), type=F.col("type"), value=clean_value(F.col("raw")),
        description=pick(cfg["description_column"]), tags=split_tags(pick(cfg["tags_column"])),
        reference=pick(cfg["reference_column"]), error=F.col("error"))


def parse_csv(payloads: DataFrame) -> DataFrame:
    return indicators_of(csv_outcomes(payloads))


def csv_errors(payloads: DataFrame) -> DataFrame:
    """Payloads the CSV dialect refuses: a bare carriage return in a row, or no single delimiter."""
    return _csv_split(payloads).select("feed_id", "payload_id", "error").filter("error IS NOT NULL")


def stix_objects(payloads: DataFrame) -> DataFrame:
    """Objects of a bundle, of a bare list or of one indicator object, as raw JSON text."""
    text = strip(F.col("payload"))
    bundle = F.from_json(text, "type string, objects array<string>")
    listed = F.from_json(text, T.ArrayType(T.StringType()))

    def of_object(b: Column) -> Column:
        given = F.coalesce(b["objects"], F.array().cast("array<string>"))
        return F.when((F.size(given) == 0) & (b["type"] == "indicator"), F.array(text)).otherwise(given)

    objects = F.when(text.startswith("["), listed).when(text.startswith("{"), let(bundle, of_object))
    return _objects(payloads, objects)


def _objects(payloads: DataFrame, objects: Column) -> DataFrame:
    """(feed_id, payload_id, pos, object, error): JSON objects of payloads; one row with an error if there is no JSON."""
    bad = F.when(F.col("payload").isNotNull() & F.try_parse_json("payload").isNull(), "invalid JSON")
    listed = computed_once(payloads, "_error", bad).select("feed_id", "payload_id", F.col("_error").alias("error"), F.posexplode(
        F.when(F.col("_error").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(objects)).alias("pos", "object"))
    return listed.filter(F.col("error").isNotNull() | F.ltrim("object").startswith("{"))


def stix_errors(payloads: DataFrame) -> DataFrame:
    """Payloads that are no JSON at all."""
    return payloads.filter(F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()).select(
        "feed_id", "payload_id", F.lit("invalid JSON").alias("error"))


def stix_outcomes(objects: DataFrame, severity_property: str = "x_severity") -> DataFrame:
    """Indicator and observable objects to outcome rows; other types are ignored.

    An indicator gives its first (kind, value); the values of the others become
    tags after the labels. Severity is the custom property, else the confidence.
    """
    schema = T.StructType(STIX_OBJECT.fields + [T.StructField("_severity", T.StringType())])
    custom = F.get_json_object("object", f"$.{severity_property}")
    o = F.col("o")
    parsed = (computed_once(objects, "o", F.from_json("object", schema))
              .withColumn("pairs", F.when(o["type"] == "indicator", pattern_values(o["pattern"])))
              .withColumn("kind", ioc_type_of_kind(o["type"])))
    first = F.try_element_at(F.col("pairs"), F.lit(1))
    others = F.transform(F.slice("pairs", F.lit(2), F.greatest(F.size("pairs"), F.lit(1))), lambda p: p["value"])
    no_tags = F.array().cast("array<string>")
    is_indicator = o["type"] == "indicator"
    labels = F.concat(F.coalesce(o["labels"], no_tags), F.coalesce(others, no_tags))
    refused = F.col("error").isNotNull()
    rows = _outcome_rows(
        parsed.filter(refused | is_indicator | F.col("kind").isNotNull()),
        type=F.coalesce(ioc_type_of_kind(first["kind"]), F.col("kind")),
        value=nullif_empty(F.when(is_indicator, first["value"]).otherwise(o["value"])),
        description=F.when(is_indicator, o["description"]).otherwise(
            F.coalesce(nullif_empty(o["name"]), o["description"])),
        tags=F.when(F.size(labels) > 0, labels),
        severity=F.when(is_indicator, F.coalesce(truthy(custom), o["confidence"])),
        reference=first_reference_url(o["external_references"]),
        first_seen=o["created"].try_cast("timestamp"), last_seen=o["modified"].try_cast("timestamp"), error=F.col("error"))
    return rows.filter(F.col("error").isNotNull() | F.col("value").isNotNull())


def parse_stix(payloads: DataFrame, severity_property: str = "x_severity") -> DataFrame:
    return indicators_of(stix_outcomes(stix_objects(payloads), severity_property))


def chosen_collections(payloads: DataFrame) -> DataFrame:
    """Per TAXII feed the collection to read, or the error.

    The configured collection when the server has it, else the first one landed;
    a configured one that is missing is an error.
    """
    wanted = F.first("parser_config.collection_id", ignorenulls=True)
    per_feed = payloads.groupBy("feed_id").agg(
        wanted.alias("wanted"),
        F.min_by("collection_id", "payload_id").alias("first_one"),
        F.coalesce(F.bool_or(F.col("collection_id") == F.col("parser_config.collection_id")),
                   F.lit(False)).alias("found"))
    use_first = F.coalesce(F.col("wanted"), F.lit("")) == ""
    return per_feed.select(
        "feed_id",
        F.when(use_first, F.col("first_one")).when(F.col("found"), F.col("wanted")).alias("chosen"),
        F.when(use_first & F.col("first_one").isNull(), "TAXII server exposes no collections")
        .when(~use_first & ~F.col("found"), F.concat(
            F.lit("collection "), F.col("wanted"), F.lit(" not found on server"))).alias("error"))


def chosen_envelopes(payloads: DataFrame) -> DataFrame:
    """TAXII payloads of each feed's chosen collection; the others are never read."""
    chosen = chosen_collections(payloads).filter("chosen IS NOT NULL").select("feed_id", "chosen")
    return payloads.join(chosen, "feed_id").filter(F.col("collection_id") == F.col("chosen")).drop("chosen")


def taxii_objects(payloads: DataFrame) -> DataFrame:
    """Objects of the envelopes of each feed's chosen collection; lists and scalars hold none."""
    objects = F.when(strip(F.col("payload")).startswith("{"), F.from_json("payload", "objects array<string>")["objects"])
    return _objects(chosen_envelopes(payloads), objects)


def parse_taxii(payloads: DataFrame, severity_property: str = "x_severity") -> DataFrame:
    return indicators_of(stix_outcomes(taxii_objects(payloads), severity_property))


def with_feed(payloads: DataFrame, feeds: DataFrame) -> DataFrame:
    """Payloads of enabled live feeds with the feed's type and parser settings."""
    wanted = enabled_feeds(feeds).select(
        F.col("id").alias("feed_id"), F.col("type").alias("feed_type"), "parser_config")
    return payloads.join(wanted, "feed_id")


def outcomes(payloads: DataFrame, severity_property: str = "x_severity") -> DataFrame:
    """Outcome rows of all feed types in one pass; ``payloads`` comes from :func:`with_feed`.

    A payload that cannot be read, or was not admitted, gives one row with its error; so does a
    TAXII feed without the collection it is to read.
    """
    of = lambda kind: payloads.filter(F.col("feed_type") == kind)
    plain = parse_plain(of("plain")).withColumn("error", F.lit(None).cast("string"))
    rows = (plain.unionByName(csv_outcomes(of("csv")))
            .unionByName(stix_outcomes(stix_objects(of("stix")), severity_property))
            .unionByName(stix_outcomes(taxii_objects(of("taxii")), severity_property)))
    failed = chosen_collections(of("taxii")).select("feed_id", F.lit(None).cast("bigint").alias("payload_id"), "error")
    if "error" in payloads.columns:
        refused = of("taxii").transform(chosen_envelopes).unionByName(payloads.filter("feed_type <> 'taxii'"))
        failed = failed.unionByName(refused.select("feed_id", "payload_id", "error"))
    return rows.unionByName(failed.filter("error IS NOT NULL"), allowMissingColumns=True)


def parse_all(payloads: DataFrame, severity_property: str = "x_severity") -> DataFrame:
    """Indicator rows of all feed types; a payload that cannot be read gives none."""
    return indicators_of(outcomes(payloads, severity_property))


def pull_errors(payloads: DataFrame) -> DataFrame:
    """``(feed_id, payload_id, error)`` of payloads that cannot be read, or were not admitted."""
    return outcomes(payloads).filter("error IS NOT NULL").select("feed_id", "payload_id", "error")


def of_good_pulls(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of feeds whose pull succeeded; a feed with any error keeps nothing of its pull.

    ``results`` has one row per feed of the round.
    """
    return rows.join(results.filter("error IS NOT NULL").select("feed_id"), "feed_id", "left_anti")


def sweep_results(payloads: DataFrame, feeds: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """One row per swept feed: ``n`` indicators written, or the ``error`` that stopped it.

    ``made`` are the payloads' outcome rows, where they are stored. ``n`` counts rows as they
    come, before duplicates merge. One aggregate over the payloads' feeds and their outcomes.
    """
    with_type = with_feed(payloads, feeds)
    swept = with_type.select("feed_id", "pulled_at", F.lit(None).cast("string").alias("error"), F.lit(0).alias("n"))
    rows = (outcomes(with_type) if made is None else made).select(
        "feed_id", F.lit(None).cast("timestamp").alias("pulled_at"), "error", F.when(F.col("error").isNull(), 1).otherwise(0).alias("n"))
    results = swept.unionByName(rows).groupBy("feed_id").agg(
        F.max("pulled_at").alias("pulled_at"), F.min("error").alias("error"), F.sum("n").alias("n"))
    names = feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name"))
    return results.join(names, "feed_id").select(
        "feed_id", "feed_name", "pulled_at", F.when(F.col("error").isNull(), F.col("n")).alias("n"), "error")


def sweep_summary(payloads: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feed name with its count, or ``ERROR: …``."""
    return sweep_results(payloads, feeds).select(
        "feed_name", F.coalesce(F.concat(F.lit("ERROR: "), F.left("error", F.lit(ERROR_TEXT_CHARS))),
                                F.col("n").cast("string")).alias("result"))
