"""Table schemas."""

from pyspark.sql import types as T

_s, _i, _l, _t, _b = (T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.BooleanType())


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def fields_of(schema: T.StructType) -> str:
    """The columns of a schema as DDL text."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


PARSER_CONFIG = _schema(
    has_header=_b, delimiter=_s, value_column=_i, description_column=_i, tags_column=_i,
    reference_column=_i, collection_id=_s, version=_s)

SYSLOG_LINES = _schema(line_id=_l, received_at=_t, line=_s)

EVENTS = _schema(
    id=_l, ts=_t, received_at=_t, host=_s, pri=_i, facility=_s, severity=_s, tag=_s, raw=_s,
    src_ip=_s, dst_ip=_s, src_port=_i, dst_port=_i, proto=_s, action=_s, in_if=_s, out_if=_s,
    msg=_s, hostname=_s)

FEED_PAYLOADS = _schema(feed_id=_i, payload_id=_l, pulled_at=_t, collection_id=_s, payload=_s)

FEEDS = _schema(
    id=_i, name=_s, type=_s, source_url=_s, auth_json=_s, parser_config=PARSER_CONFIG, enabled=_b,
    auto_pull_minutes=_i, last_pull=_t, last_status=_s, last_error=_s, deleted_at=_t, created_at=_t)

IOCS = _schema(
    id=_l, feed_id=_i, type=_s, value=_s, description=_s, tags=T.ArrayType(_s), severity=_s,
    reference=_s, first_seen=_t, last_seen=_t, active=_b, created_at=_t)

DETECTIONS = _schema(
    id=_l, event_id=_l, ioc_id=_l, feed_id=_i, feed_name=_s, match_type=_s, matched_value=_s,
    created_at=_t)

FEED_LOGS = _schema(id=_l, feed_id=_i, ts=_t, level=_s, message=_s)

PULL_REQUESTS = _schema(id=_l, feed_id=_i, requested_at=_t, processed_at=_t, status=_s)

STIX_OBJECT = _schema(
    type=_s, id=_s, pattern=_s, value=_s, name=_s, description=_s, labels=T.ArrayType(_s),
    created=_s, modified=_s, confidence=_s,
    external_references=T.ArrayType(_schema(url=_s)))
