"""SQL that gives the rows of the named queries, for another engine to check.

Expected values come from the columns that generated the lines, indicators and
payloads, not from parsing them again.
"""

from netsight.constants import BUCKETS, FEED_TYPES, SEED_FEEDS
from netsight.sources import derived as D
from netsight.sources import derived_feeds as P

NOW = "TIMESTAMP '2024-01-30 12:00:00'"

_TABLES = {n: n for n in ("events", "customer", "nation", "supplier", "pages", "part", "region")}


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _fill(sql: str) -> str:
    for name in _TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


_TE = _fill(D.EVENT_TRUTH).replace("{header}", "strftime(ts, '%b %d %H:%M:%S')")
_ACCEPTED = f"""SELECT *, event_id AS line_id, line AS raw,
    event_ts + INTERVAL 3 SECOND AS received_at,
    CASE WHEN shape = 'no_header' THEN event_ts + INTERVAL 3 SECOND ELSE date_trunc('second', event_ts) END AS ts,
    CASE pri WHEN 166 THEN 'local4' WHEN 14 THEN 'user' WHEN 29 THEN 'daemon' END AS facility,
    CASE pri WHEN 166 THEN 'info' WHEN 14 THEN 'info' WHEN 29 THEN 'notice' END AS severity
  FROM te WHERE shape IN ('ok', 'no_header')"""
_HITS = """
  SELECT e.id AS event_id, i.id AS ioc_id, i.feed_id, i.feed_name, i.type, 'src' AS match_type,
    e.src_ip AS matched_value, e.received_at AS created_at FROM ev e JOIN ai i ON i.type = 'ip' AND i.value = e.src_ip
  UNION ALL SELECT e.id, i.id, i.feed_id, i.feed_name, i.type, 'dst', e.dst_ip, e.received_at
    FROM ev e JOIN ai i ON i.type = 'ip' AND i.value = e.dst_ip
  UNION ALL SELECT e.id, i.id, i.feed_id, i.feed_name, i.type, 'src', e.src_ip, e.received_at
    FROM ev e JOIN ai i ON i.type = 'cidr' AND e.src_n BETWEEN i.lo AND i.hi
  UNION ALL SELECT e.id, i.id, i.feed_id, i.feed_name, i.type, 'dst', e.dst_ip, e.received_at
    FROM ev e JOIN ai i ON i.type = 'cidr' AND e.dst_n BETWEEN i.lo AND i.hi
  UNION ALL SELECT e.id, i.id, i.feed_id, i.feed_name, i.type, 'src', e.src_ip, e.received_at
    FROM ev e JOIN ai i ON i.g IS NOT NULL AND e.src_g IS NOT NULL
      AND floor(e.src_g / power(2, i.shift)) = floor(i.g / power(2, i.shift))
  UNION ALL SELECT e.id, i.id, i.feed_id, i.feed_name, i.type, 'host', lower(e.hostname), e.received_at
    FROM ev e JOIN ai i ON i.host IS NOT NULL AND e.hostname IS NOT NULL
      AND (lower(e.hostname) = i.host OR ends_with(lower(e.hostname), '.' || i.host))"""
_BUCKET = """CASE WHEN tag = 'kernel' OR (tag IS NULL AND action IS NOT NULL) THEN
      CASE WHEN action LIKE '%DPIA%' THEN 'IPS / DPIA' WHEN action LIKE '%DROP%' THEN 'Firewall · DROP'
           WHEN action LIKE '%ACCEPT%' THEN 'Firewall · ACCEPT' WHEN action IS NOT NULL THEN 'Firewall · Rule'
           ELSE 'Kernel' END
    WHEN tag = 'dnsmasq-dhcp' THEN 'DHCP' WHEN tag = 'dnsmasq' THEN 'DNS' WHEN tag = 'hostapd' THEN 'WLAN'
    WHEN tag = 'pppd' THEN 'WAN' WHEN tag = 'syslog' THEN 'System' ELSE 'Other' END"""

_CTES = {
    "te": _TE,
    "ok": _ACCEPTED,
    "ev": f"SELECT row_number() OVER (ORDER BY received_at, line_id) AS id, *, {_BUCKET} AS bucket FROM ok",
    "ti": _fill(D.IOC_TRUTH),
    "tf": _fill(D.FEED_TRUTH),
    "ai": """SELECT i.*, f.name AS feed_name FROM ti i JOIN tf f ON f.id = i.feed_id
      WHERE i.active AND f.deleted_at IS NULL""",
    "hits": _HITS,
    "td": "SELECT row_number() OVER (ORDER BY event_id, ioc_id, match_type) AS id, * FROM hits",
    "dc": "SELECT event_id, count(*) AS det_count FROM td GROUP BY event_id",
    "bc": f"""SELECT b.bucket, coalesce(c.n, 0) AS n FROM (SELECT unnest({BUCKETS!r}) AS bucket) b
      LEFT JOIN (SELECT bucket, count(*) AS n FROM ev WHERE ts >= date_trunc('day', {NOW}) GROUP BY bucket) c
      ON c.bucket = b.bucket""",
}
_NEEDS = {
    "ok": ["te"], "ev": ["te", "ok"], "ai": ["ti", "tf"], "hits": ["te", "ok", "ev", "ti", "tf", "ai"],
    "td": ["te", "ok", "ev", "ti", "tf", "ai", "hits"],
    "dc": ["te", "ok", "ev", "ti", "tf", "ai", "hits", "td"], "bc": ["te", "ok", "ev"],
}


def _with(names: str, body: str, **more: str) -> str:
    """``WITH`` the named shared tables (and what they need), then ``more``, then ``body``."""
    order = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    ctes = [f"{n} AS (\n{_CTES[n]}\n)" for n in order] + [f"{n} AS (\n{q}\n)" for n, q in more.items()]
    return f"WITH {', '.join(ctes)}\n{body}" if ctes else body


_EVENT_LIST = f"""e.id, {_ts('e.ts')} AS ts, e.host, e.facility, e.severity, e.tag, e.raw, e.src_ip, e.dst_ip,
  CAST(e.src_port AS BIGINT) AS src_port, CAST(e.dst_port AS BIGINT) AS dst_port, e.proto, e.action, e.msg, e.hostname"""


def _events_page(where: str, tail: str) -> str:
    return _with("dc", f"""SELECT {_EVENT_LIST}, d.det_count,
      CAST(coalesce(d.det_count, 0) > 0 AS BIGINT) AS flagged
      FROM (SELECT * FROM ev e WHERE {where} ORDER BY id DESC {tail}) e LEFT JOIN dc d ON d.event_id = e.id""")


_IOC_FIELDS = f"""i.description AS ioc_description, i.tags_text AS ioc_tags, i.severity AS ioc_severity,
  i.reference AS ioc_reference, {_ts('i.first_seen')} AS ioc_first_seen, {_ts('i.last_seen')} AS ioc_last_seen,
  i.value AS ioc_value"""
_EVENT_FIELDS = f"""{_ts('e.ts')} AS event_ts, e.action AS event_action, e.tag AS event_tag, e.src_ip, e.dst_ip,
  e.hostname, CAST(e.src_port AS BIGINT) AS src_port, CAST(e.dst_port AS BIGINT) AS dst_port, e.proto"""


def _detections_page(where: str, tail: str) -> str:
    return _with("td", f"""SELECT d.id, {_ts('d.created_at')} AS created_at, d.match_type, d.matched_value,
      d.feed_name, CAST(d.feed_id AS BIGINT) AS feed_id, d.event_id, {_EVENT_FIELDS}, {_IOC_FIELDS}
      FROM (SELECT * FROM td d WHERE {where} ORDER BY id DESC {tail}) d
      JOIN ev e ON e.id = d.event_id LEFT JOIN ti i ON i.id = d.ioc_id""")


def _hits_of(types: str) -> str:
    return _with("hits", f"""SELECT event_id, ioc_id, feed_name, match_type, matched_value FROM hits
      WHERE type IN ({types})""")


def _iocs_page(where: str, tail: str) -> str:
    return _with("ai", f"""SELECT id, type, value, description, tags_text AS tags, severity, reference,
      {_ts('first_seen')} AS first_seen, {_ts('last_seen')} AS last_seen, CAST(active AS BIGINT) AS active,
      {_ts('created_at')} AS created_at, feed_name FROM ai WHERE {where} ORDER BY id DESC {tail}""")


# -- payload truths -------------------------------------------------------------------

_NO = "CAST(NULL AS VARCHAR)"


def _indicator(pos: int, kind: str, value: str, description=_NO, tags=_NO, severity=_NO, reference=_NO,
               first=_NO, last=_NO) -> str:
    return (f"CAST({pos} AS BIGINT) AS pos, {kind} AS type, {value} AS value, {description} AS description, "
            f"{tags} AS tags, {severity} AS severity, {reference} AS reference, "
            f"{first} AS first_seen, {last} AS last_seen")


def _rows(source: str, feed: str, *rows: str | tuple[str, str]) -> str:
    parts = []
    for row in rows:
        row, where = row if isinstance(row, tuple) else (row, "TRUE")
        parts.append(f"SELECT CAST({feed} AS BIGINT) AS feed_id, k AS payload_id, {row} FROM ({source}) s WHERE {where}")
    return "\nUNION ALL ".join(parts)


_PLAIN = _rows(
    "SELECT c_custkey AS k FROM customer", f"1 + {D._div('k', 15)}",
    _indicator(2, "'ip'", P.PLAIN_IP), _indicator(4, "'cidr'", P.PLAIN_NET),
    _indicator(6, "'domain'", P.PLAIN_DOMAIN), _indicator(7, "'url'", P.PLAIN_URL))
_CSV = _rows(
    "SELECT p_partkey AS k FROM part", f"1 + {D._div('k', 20)}",
    _indicator(0, "'url'", P.CSV_URL, f"'m \"x\" ' || {P.K}", "'c2,bot'", reference=f"'https://r/' || {P.K}"),
    _indicator(2, "'ip'", P.CSV_IP),
    _indicator(4, "'domain'", P.PLAIN_DOMAIN, "'two' || chr(10) || 'lines'", "'t1'"))
_STIX = _rows(
    "SELECT page_id AS k, url FROM pages", f"1 + {D._div('k', 5)}",
    _indicator(0, "'url'", "url", f"'page ' || {P.K}", "'m,c2'", D._text("k % 100"), f"'https://r/' || {P.K}",
               "'2024-01-01 00:00:00.000000'", "'2024-01-10 12:30:00.000000'"),
    (_indicator(1, "'domain'", f"'d' || {P.K} || '.example.com'", tags=f"'1.1.1.1,' || {P.CSV_IP}",
                severity="'high'"), "k % 4 <> 2"),
    (_indicator(3, "'ip'", P.STIX_V6, f"'n' || {P.K}"), "k % 4 <> 2"))

_WANTED = "CASE k % 3 WHEN 1 THEN 'col-b' WHEN 2 THEN 'nope' ELSE 'col-a' END"

_SWEEP = f"""
  SELECT f.id AS feed_id, f.name, f.k,
    CASE WHEN f.k % 4 = 0 THEN 4 WHEN f.k % 4 = 1 THEN 3
         WHEN f.k % 4 = 2 THEN CASE WHEN {P.SWEEP_SHAPE.replace('k', 'f.k')} = 2 THEN 1 ELSE 3 END
         ELSE 1 END AS n,
    CASE WHEN f.k % 12 = 2 THEN 'invalid JSON'
         WHEN f.k % 8 = 3 THEN 'collection col-b not found on server'
         WHEN f.k % 16 = 7 THEN 'collection nope not found on server' END AS error
  FROM tf f WHERE f.enabled AND f.deleted_at IS NULL"""

_PULLED_ROWS = "\nUNION ALL ".join(
    f"SELECT feed_id, '{kind}' AS type, {value} AS value FROM (SELECT feed_id, k, 'http://p' || k || '.example.com/' AS url "
    f"FROM sweep WHERE error IS NULL) s WHERE {where}"
    for kind, value, where in [
        ("ip", P.PLAIN_IP, "k % 4 = 0"), ("cidr", P.PLAIN_NET, "k % 4 = 0"), ("domain", P.PLAIN_DOMAIN, "k % 4 = 0"),
        ("url", P.PLAIN_URL, "k % 4 = 0"), ("url", P.CSV_URL, "k % 4 = 1"), ("ip", P.CSV_IP, "k % 4 = 1"),
        ("domain", P.PLAIN_DOMAIN, "k % 4 = 1"), ("url", "url", "k % 4 = 2"),
        ("domain", f"'d' || {P.K} || '.example.com'", f"k % 4 = 2 AND {P.SWEEP_SHAPE} <> 2"),
        ("ip", P.STIX_V6, f"k % 4 = 2 AND {P.SWEEP_SHAPE} <> 2"), ("ip", P.CSV_IP, "k % 4 = 3")])

_UPSERT = f"""
  SELECT feed_id, type, value, arg_max(struct_pack(description, tags, severity, reference, active), ord) AS last,
    min(first_seen) AS first_seen, max(last_seen) AS last_seen, min(id) AS id, min(created_at) AS created_at,
    min(ord) AS first_ord
  FROM (
    SELECT CAST(feed_id AS BIGINT) AS feed_id, type, value, description, tags_text AS tags, severity, reference, active,
      first_seen, last_seen, id, created_at, CAST(-1 AS BIGINT) AS ord FROM ti
    UNION ALL
    SELECT feed_id, type, value, description, tags, severity, reference, TRUE, {NOW}, {NOW}, NULL, NULL,
      payload_id * 100 + pos FROM batch) u
  GROUP BY feed_id, type, value"""

_SEEDS = f"""
  SELECT name, type, source_url, auto_pull_minutes, CAST(NULL AS BIGINT) AS value_column FROM ({_fill(P.SEED_DEFINITIONS)}) s
  UNION ALL SELECT * FROM (VALUES {', '.join(
      f"('{n}', '{t}', '{u}', {m}, {c.get('value_column', 'NULL')})" for n, t, u, c, m in SEED_FEEDS)}) v"""

_TYPES = ", ".join(f"''{t}''" for t in FEED_TYPES)
_CHANGES = f"""
  SELECT change_id, op, feed_id, type, enabled, auto_pull_minutes,
    CASE WHEN op = 'create' THEN trim(coalesce(name, '')) ELSE name END AS name,
    CASE WHEN op = 'create' THEN trim(coalesce(source_url, '')) ELSE source_url END AS source_url
  FROM ({_fill(P.FEED_CHANGES)}) c"""
_CHECKED_1 = f"""
  SELECT c.*, o.id AS owner,
    CASE WHEN op = 'create' AND c.name = '' THEN 'name is required'
         WHEN op = 'create' AND coalesce(c.type, '') NOT IN ('plain', 'csv', 'stix', 'taxii') THEN 'type must be one of ({_TYPES})'
         WHEN op = 'create' AND c.source_url = '' THEN 'source_url is required'
         WHEN op = 'update' AND l.id IS NULL THEN 'feed not found'
         WHEN op = 'update' AND c.type IS NOT NULL AND c.type NOT IN ('plain', 'csv', 'stix', 'taxii') THEN 'type must be one of ({_TYPES})'
         WHEN o.id IS NOT NULL AND (op = 'create' OR o.id <> c.feed_id) THEN 'a feed named ''' || c.name || ''' already exists'
    END AS reason
  FROM changes c LEFT JOIN (SELECT id, name FROM tf WHERE deleted_at IS NULL) o ON o.name = c.name
  LEFT JOIN (SELECT id FROM tf WHERE deleted_at IS NULL) l ON l.id = c.feed_id"""
_CHECKED = """
  SELECT change_id, op, feed_id, name, type, source_url, enabled, auto_pull_minutes,
    CASE WHEN reason IS NULL AND name IS NOT NULL AND owner IS NULL AND row_number() OVER (
           PARTITION BY name, reason IS NULL AND owner IS NULL ORDER BY change_id) > 1
         THEN 'a feed named ''' || name || ''' already exists' ELSE reason END AS reason
  FROM checked1"""


def _last(c: str) -> str:
    return f"coalesce(arg_max(u.{c}, u.change_id) FILTER (u.{c} IS NOT NULL), any_value(f.{c})) AS {c}"


_FEED_LOG = f"""
  SELECT id, feed_id, TIMESTAMP '2024-01-28 00:00:00' + CAST(id % 7 AS INT) * INTERVAL 1 MINUTE AS ts,
    CASE WHEN id % 2 = 1 THEN 'error' ELSE 'info' END AS level,
    CASE WHEN id % 2 = 1 THEN 'pull failed: timed out' ELSE 'pull ok: ok (' || id || ')' END AS message
  FROM ({_fill(P.PULL_REQUESTS)}) r"""

_DELETED = "SELECT 3 * n_nationkey + 1 AS id FROM nation"


def iso(c: str) -> str:
    """A time as JSON rows write it: a fraction only where there is one."""
    return (f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 <> 0 THEN strftime({c}, '.%f') ELSE '' END || '+00:00'")


def all_oracles() -> dict[str, str]:
    ok = lambda columns, where="TRUE": _with("ok", f"SELECT {columns} FROM ok WHERE {where}")
    port = "CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port"
    pri = "CAST(pri AS BIGINT) AS pri"
    age = f"greatest(0, floor(epoch({NOW}) - epoch(ts)))"
    source = "coalesce(src_ip, hostname)"
    hit = "event_id, ioc_id, feed_name, match_type, matched_value"
    feed_row = "CAST(feed_id AS BIGINT) AS feed_id"
    return {
        "src_syslog_lines": _with("te", "SELECT line, count(*) AS n FROM te GROUP BY line"),
        "src_feed_payloads": """SELECT doc_id AS payload_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
            CASE WHEN octet_length(encode(text)) > 20971520 THEN 'feed payload exceeds 20971520 bytes: ' || doc_id END AS error,
            CASE WHEN octet_length(encode(text)) <= 20971520 THEN CAST(length(text) AS BIGINT) END AS n_chars
            FROM documents""",
        "sink_events": _with("ev", "SELECT id, raw, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM ev"),
        "detections_insert_new": _with("hits", """SELECT event_id, ioc_id, match_type, matched_value FROM hits
            WHERE match_type <> 'dst'"""),
        "events_to_json": _with("ev", """SELECT '{"id":' || id
            || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00"'
            || ',"received_at":"' || strftime(received_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(received_at) % 1000000 <> 0 THEN strftime(received_at, '.%f') ELSE '' END || '+00:00"'
            || ',"src_ip":' || coalesce('"' || src_ip || '"', 'null') || ',"src_port":' || coalesce(CAST(src_port AS VARCHAR), 'null')
            || ',"tag":' || coalesce('"' || tag || '"', 'null') || '}' AS json FROM ev"""),
        "parse_rejects": _with("te", "SELECT event_id AS line_id, line, shape AS reason FROM te WHERE shape NOT IN ('ok', 'no_header')"),
        "parse_header": ok("line_id, host, CAST(shape = 'ok' AS BIGINT) AS has_header"),
        "parse_pri": ok(f"line_id, {pri}, facility, severity"),
        "parse_timestamp": ok(f"line_id, {_ts('ts')} AS ts"),
        "parse_timestamp_zone": ok(
            f"line_id, {_ts('CASE WHEN shape = $$ok$$ THEN ts + INTERVAL 6 HOUR ELSE ts END')} AS ts"),
        "parse_tag": ok("line_id, tag, msg"),
        "parse_kv_fields": ok("line_id, src_ip, dst_ip, proto, in_if, out_if"),
        "parse_action": ok("line_id, action"),
        "parse_dns": ok("line_id, hostname, src_ip", "tag = 'dnsmasq'"),
        "parse_dhcp": ok("line_id, hostname", "tag = 'dnsmasq-dhcp'"),
        "ip_canonical_texts": _with("te", f"""SELECT src_text, CASE WHEN src_text = 'router.local' THEN NULL
            WHEN src_g IS NULL THEN src_text ELSE '2001:db8:0:' || {D._hex('src_g')} || '::' || {D._hex('src_h')} END AS ip,
            count(*) AS n FROM te GROUP BY 1, 2"""),
        "parse_ports": ok(f"line_id, {port}"),
        "parse_events": ok(f"""line_id, {_ts('ts')} AS ts, {_ts('received_at')} AS received_at, host, {pri}, facility,
            severity, tag, raw, src_ip, dst_ip, {port}, proto, action, in_if, out_if, msg, hostname"""),
        "ingest_counters": _with("te hits", """SELECT 'received' AS counter, count(*) AS n FROM te
            UNION ALL SELECT 'parsed', count(*) FROM ok UNION ALL SELECT 'stored', count(*) FROM ok
            UNION ALL SELECT 'errors', count(*) FROM te WHERE shape = 'error'
            UNION ALL SELECT 'detections', count(*) FROM hits"""),
        "ioc_snapshot": _with("ai", f"SELECT id AS ioc_id, {feed_row}, feed_name, type, value FROM ai"),
        "match_ip_exact": _hits_of("'ip'"),
        "match_cidr": _hits_of("'cidr'"),
        "match_domain_suffix": _hits_of("'domain'"),
        "match_url_host": _hits_of("'url'"),
        "url_hostname_pages": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages",
        "detections_all": _with("hits", f"SELECT event_id, ioc_id, {feed_row}, feed_name, match_type, matched_value, {_ts('created_at')} AS created_at FROM hits"),
        "detections_all_by_value": _with("hits", f"SELECT event_id, ioc_id, {feed_row}, feed_name, match_type, matched_value, {_ts('created_at')} AS created_at FROM hits"),
        "detections_all_one_pass": _with("hits", f"SELECT event_id, ioc_id, {feed_row}, feed_name, match_type, matched_value, {_ts('created_at')} AS created_at FROM hits"),
        "ioc_ref_count": _with("ai", "SELECT type, count(*) AS n_refs FROM ai WHERE value <> '100.64.0.0/99' GROUP BY type"),
        "retro_scan": _with("hits", f"""SELECT {hit} FROM hits WHERE match_type <> 'dst' AND event_id IN (
            SELECT id FROM ev WHERE ts >= {NOW} - INTERVAL 240 HOUR AND id > 0)"""),
        "retro_watermark": _with("ev", f"SELECT greatest(0, max(id)) AS watermark FROM ev WHERE ts >= {NOW} - INTERVAL 24 HOUR"),
        "retro_scan_full": _with("hits", f"SELECT {hit} FROM hits WHERE match_type = 'host'"),
        "retro_scan_delta": _with("hits", f"""SELECT {hit} FROM hits WHERE type IN ('domain', 'url') AND event_id IN (
            SELECT id FROM ev WHERE ts >= {NOW} - INTERVAL 240 HOUR)"""),
        "infer_ioc_types": _with("ti", "SELECT id, CASE WHEN value = '100.64.0.0/99' THEN NULL ELSE type END AS type FROM ti"),
        "feed_plain": _PLAIN,
        "feed_csv": _CSV,
        "feed_stix": _STIX,
        "feed_stix_shapes": "SELECT page_id AS payload_id, CAST(CASE page_id % 4 WHEN 2 THEN 1 ELSE 5 END AS BIGINT) AS n_objects FROM pages",
        "stix_pattern_values": f"""SELECT k AS payload_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, 'url' AS kind, url AS value
            FROM (SELECT page_id AS k, url FROM pages) p
            UNION ALL SELECT k, 1, n, kind, CASE n WHEN 0 THEN 'd' || {P.K} || '.example.com' WHEN 1 THEN '1.1.1.1' ELSE {P.CSV_IP} END
            FROM (SELECT page_id AS k FROM pages WHERE page_id % 4 <> 2) p,
              (SELECT 0 AS n, 'domain-name' AS kind UNION ALL SELECT 1, 'ipv4-addr' UNION ALL SELECT 2, 'ipv4-addr') x""",
        "feed_taxii_envelope": f"""SELECT k + 1 AS feed_id, CASE WHEN k % 3 <> 2 THEN {P.CSV_IP} END AS value,
            CASE WHEN k % 3 <> 2 THEN {_WANTED} END AS tags,
            CASE WHEN k % 3 = 2 THEN 'collection nope not found on server' END AS error
            FROM (SELECT s_suppkey AS k FROM supplier) s""",
        "ioc_upsert": _with("ti", f"""SELECT coalesce(id, (SELECT max(id) FROM ti) + row_number() OVER (
                PARTITION BY id IS NULL ORDER BY first_ord, feed_id, type, value)) AS id, feed_id, type, value,
            last.description AS description, last.tags AS tags, last.severity AS severity, last.reference AS reference,
            {_ts('first_seen')} AS first_seen, {_ts('last_seen')} AS last_seen, CAST(last.active AS BIGINT) AS active,
            {_ts(f'coalesce(created_at, {NOW})')} AS created_at FROM merged""", batch=_PLAIN, merged=_UPSERT),
        "feed_seed_upsert": _with("tf", f"""SELECT CAST(f.id AS BIGINT) AS id, f.name, coalesce(s.type, f.type) AS type,
              coalesce(s.source_url, f.source_url) AS source_url,
              CASE WHEN s.name IS NOT NULL THEN s.value_column WHEN f.type = 'csv' THEN 2 END AS value_column,
              CAST(coalesce(s.auto_pull_minutes, f.auto_pull_minutes) AS BIGINT) AS auto_pull_minutes,
              CAST(f.enabled AS BIGINT) AS enabled, {_ts('f.deleted_at')} AS deleted_at, {_ts('f.created_at')} AS created_at
            FROM tf f LEFT JOIN seeds s ON s.name = f.name AND f.deleted_at IS NULL
            UNION ALL SELECT (SELECT max(id) FROM tf) + row_number() OVER (ORDER BY name), name, type, source_url, value_column,
              auto_pull_minutes, 1, NULL, {_ts(NOW)} FROM seeds
            WHERE name NOT IN (SELECT name FROM tf WHERE deleted_at IS NULL)""", seeds=_SEEDS),
        "feed_changes_check": _with("tf", "SELECT change_id, op, name, reason FROM checked",
                                    changes=_CHANGES, checked1=_CHECKED_1, checked=_CHECKED),
        "feed_changes_apply": _with("tf", f"""SELECT CAST(f.id AS BIGINT) AS id, {_last('name')}, {_last('type')}, {_last('source_url')},
              CAST(coalesce(arg_max(u.enabled, u.change_id) FILTER (u.enabled IS NOT NULL), any_value(f.enabled)) AS BIGINT) AS enabled,
              CAST(coalesce(arg_max(u.auto_pull_minutes, u.change_id) FILTER (u.auto_pull_minutes IS NOT NULL), any_value(f.auto_pull_minutes)) AS BIGINT) AS auto_pull_minutes,
              {_ts('any_value(f.created_at)')} AS created_at
            FROM tf f LEFT JOIN (SELECT * FROM checked WHERE op = 'update' AND reason IS NULL) u ON u.feed_id = f.id GROUP BY f.id
            UNION ALL SELECT (SELECT max(id) FROM tf) + row_number() OVER (ORDER BY change_id), name, type, source_url, 1,
              CAST(coalesce(nullif(auto_pull_minutes, 0), 1440) AS BIGINT), {_ts(NOW)} FROM checked WHERE op = 'create' AND reason IS NULL""",
                                    changes=_CHANGES, checked1=_CHECKED_1, checked=_CHECKED),
        "feed_soft_delete": _with("ti tf", f"""SELECT CAST(f.id AS BIGINT) AS id, CAST(f.enabled AND g.id IS NULL AS BIGINT) AS enabled,
              {_ts(f'CASE WHEN g.id IS NOT NULL THEN {NOW} ELSE f.deleted_at END')} AS deleted_at, a.n AS n_active
            FROM tf f LEFT JOIN gone g ON g.id = f.id
            LEFT JOIN (SELECT feed_id, count(*) AS n FROM ti WHERE active AND feed_id NOT IN (SELECT id FROM gone) GROUP BY feed_id) a
              ON a.feed_id = f.id""", gone=_DELETED),
        "feed_pull_log": _with("tf", f"""SELECT CAST(feed_id AS BIGINT) AS feed_id, '2024-01-29 06:00:00.000000' AS ts,
            CASE WHEN error IS NULL THEN 'info' ELSE 'error' END AS level,
            coalesce('pull failed: ' || error, 'pull ok: ok (' || n || ')') AS message FROM sweep""", sweep=_SWEEP),
        "feed_pull_status": _with("tf", f"""SELECT CAST(f.id AS BIGINT) AS id,
            CASE WHEN s.feed_id IS NOT NULL THEN '2024-01-29 06:00:00.000000' END AS last_pull,
            CASE WHEN s.error IS NOT NULL THEN 'error' WHEN s.feed_id IS NOT NULL THEN 'ok (' || s.n || ')' END AS last_status,
            s.error AS last_error FROM tf f LEFT JOIN sweep s ON s.feed_id = f.id""", sweep=_SWEEP),
        "feeds_enabled": _with("tf", "SELECT CAST(id AS BIGINT) AS id, name, type FROM tf WHERE enabled AND deleted_at IS NULL"),
        "pull_request_triage": _with("tf", f"""SELECT r.id, CAST(r.feed_id AS BIGINT) AS feed_id,
            CASE WHEN f.id IS NULL THEN 'skipped (feed unavailable)' ELSE 'pull' END AS status
            FROM (SELECT * FROM ({_fill(P.PULL_REQUESTS)}) q WHERE processed_at IS NULL ORDER BY id LIMIT 20) r
            LEFT JOIN (SELECT id FROM tf WHERE enabled AND deleted_at IS NULL) f ON f.id = r.feed_id"""),
        "pull_requests_add": _with("tf", f"""SELECT id, CAST(feed_id AS BIGINT) AS feed_id, {_ts('processed_at')} AS processed_at,
              CAST(NULL AS VARCHAR) AS requested_at FROM ({_fill(P.PULL_REQUESTS)}) q
            UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY c_custkey), 1 + c_custkey % 150, NULL,
              {_ts(NOW)} FROM customer WHERE 1 + c_custkey % 150 IN (SELECT id FROM tf WHERE deleted_at IS NULL)"""),
        "pull_requests_finish": _with("tf", f"""SELECT q.id, CAST(q.feed_id AS BIGINT) AS feed_id,
              {_ts(f"CASE WHEN d.id IS NOT NULL THEN {NOW} ELSE q.processed_at END")} AS processed_at, d.status
            FROM ({_fill(P.PULL_REQUESTS)}) q LEFT JOIN (
              SELECT r.id, CASE WHEN s.feed_id IS NULL THEN 'skipped (feed unavailable)'
                     WHEN s.error IS NOT NULL THEN 'error: ' || s.error ELSE 'ok (' || s.n || ')' END AS status
              FROM (SELECT * FROM ({_fill(P.PULL_REQUESTS)}) x WHERE processed_at IS NULL ORDER BY id LIMIT 20) r
              LEFT JOIN sweep s ON s.feed_id = r.feed_id) d ON d.id = q.id""", sweep=_SWEEP),
        "sweep_round": _with("ti tf", """SELECT CAST(u.feed_id AS BIGINT) AS feed_id, u.type, count(*) AS n,
              count(*) FILTER (u.active) AS n_active,
              any_value(CASE WHEN s.error IS NOT NULL THEN 'error' WHEN s.feed_id IS NOT NULL THEN 'ok (' || s.n || ')' END) AS last_status
            FROM (SELECT feed_id, type, value, bool_or(active) AS active FROM (
                SELECT feed_id, type, value, active FROM ti UNION ALL SELECT feed_id, type, value, TRUE FROM pulled) x
              GROUP BY 1, 2, 3) u JOIN tf f ON f.id = u.feed_id LEFT JOIN sweep s ON s.feed_id = u.feed_id
            GROUP BY u.feed_id, u.type""", sweep=_SWEEP, pulled=_PULLED_ROWS),
        "feed_sweep_summary": _with("tf", """SELECT name AS feed_name,
            coalesce('ERROR: ' || error, CAST(n AS VARCHAR)) AS result FROM sweep""", sweep=_SWEEP),
        "ioc_version": _with("ti", "SELECT CAST(2 AS BIGINT) AS version, count(*) AS n_iocs FROM ti WHERE active"),
        "stats": _with("td", f"""SELECT 'events_today' AS name, count(*) AS n FROM ev WHERE ts >= date_trunc('day', {NOW})
            UNION ALL SELECT 'events_total', count(*) FROM ev
            UNION ALL SELECT 'detections_24h', count(*) FROM td WHERE created_at >= {NOW} - INTERVAL 24 HOUR
            UNION ALL SELECT 'detections_total', count(*) FROM td
            UNION ALL SELECT 'active_feeds', count(*) FROM tf WHERE enabled AND deleted_at IS NULL
            UNION ALL SELECT 'feeds_total', count(*) FROM tf WHERE deleted_at IS NULL
            UNION ALL SELECT 'iocs_active', count(*) FROM ti WHERE active
            UNION ALL SELECT 'iocs_total', count(*) FROM ti"""),
        "events_browse": _events_page("TRUE", "LIMIT 100 OFFSET 20"),
        "events_flows": _events_page("src_ip IS NOT NULL OR dst_ip IS NOT NULL", "LIMIT 500"),
        "events_search": _events_page(
            """raw ILIKE '%10.0.0.1_/32%' OR hostname ILIKE '%10.0.0.1_/32%'
               OR src_ip || CASE WHEN src_ip LIKE '%:%' THEN '/128' ELSE '/32' END ILIKE '%10.0.0.1_/32%'
               OR dst_ip || '/32' ILIKE '%10.0.0.1_/32%'""", "LIMIT 500"),
        "events_since_ts": _events_page("ts >= TIMESTAMP '2024-01-30 00:00:00'", "LIMIT 500"),
        "event_detail": _with("td", f"""SELECT {_EVENT_LIST}, coalesce((SELECT string_agg(
              d.id || ':' || d.ioc_id || ':' || d.match_type || ':' || d.matched_value, ',' ORDER BY d.id)
              FROM td d WHERE d.event_id = 25), '') AS detections FROM ev e WHERE e.id = 25"""),
        "detections_browse": _detections_page("TRUE", "LIMIT 200 OFFSET 10"),
        "detections_by_feed": _detections_page("feed_id = 2", "LIMIT 500"),
        "detections_search": _detections_page(
            "(matched_value ILIKE '%ALPHA.example%' OR feed_name ILIKE '%ALPHA.example%') AND created_at >= TIMESTAMP '2024-01-05 00:00:00'",
            "LIMIT 500"),
        "detection_detail": _with("td", f"""SELECT d.id, d.event_id, d.ioc_id, CAST(d.feed_id AS BIGINT) AS feed_id, d.feed_name,
              d.match_type, d.matched_value, {_ts('d.created_at')} AS created_at, e.raw AS event_raw, e.host AS event_host,
              {_EVENT_FIELDS}, {_IOC_FIELDS}, i.type AS ioc_type
            FROM td d LEFT JOIN ev e ON e.id = d.event_id LEFT JOIN ti i ON i.id = d.ioc_id WHERE d.id = 42"""),
        "feeds_list": _with("ti tf", f"""SELECT CAST(f.id AS BIGINT) AS id, f.name, f.type, f.source_url,
              CASE WHEN f.k % 3 = 0 THEN '***' END AS auth_json, CAST(f.enabled AS BIGINT) AS enabled,
              CAST(f.auto_pull_minutes AS BIGINT) AS auto_pull_minutes, {_ts('f.created_at')} AS created_at,
              (SELECT count(*) FROM ti i WHERE i.feed_id = f.id AND i.active) AS ioc_count
            FROM tf f WHERE f.deleted_at IS NULL"""),
        "iocs_browse": _iocs_page("type = 'cidr'", "LIMIT 300 OFFSET 5"),
        "iocs_search": _iocs_page("value ILIKE '%SAMPLE 4%' OR description ILIKE '%SAMPLE 4%'", "LIMIT 500"),
        "ioc_detail": _with("ti tf", f"""SELECT i.id, CAST(i.feed_id AS BIGINT) AS feed_id, i.type, i.value, i.description,
              i.tags_text AS tags, i.severity, i.reference, {_ts('i.first_seen')} AS first_seen, {_ts('i.last_seen')} AS last_seen,
              CAST(i.active AS BIGINT) AS active, {_ts('i.created_at')} AS created_at, f.name AS feed_name
            FROM ti i JOIN tf f ON f.id = i.feed_id WHERE i.id = 16"""),
        "feed_logs": f"""SELECT id, CAST(feed_id AS BIGINT) AS feed_id, {_ts('ts')} AS ts, level, message FROM (
            SELECT * FROM ({_FEED_LOG}) l WHERE feed_id = 6 ORDER BY ts DESC, id DESC LIMIT 50) x""",
        "event_buckets": _with("ev", "SELECT id, bucket FROM ev"),
        "bucket_totals": _with("bc", "SELECT bucket, n FROM bc UNION ALL SELECT '_total', CAST(sum(n) AS BIGINT) FROM bc"),
        "bucket_share": _with("bc", """SELECT bucket, n, CAST(CASE WHEN t > 0 THEN floor(n / t * 100 + 0.5) ELSE 0 END AS BIGINT) AS pct
            FROM bc, (SELECT CAST(sum(n) AS DOUBLE) AS t FROM bc) x"""),
        "bucket_totals_daily": _with("ev", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, bucket, count(*) AS n FROM ev GROUP BY 1, 2"),
        "events_since_id": _with("dc", f"""SELECT {_EVENT_LIST}, d.det_count FROM (
            SELECT * FROM ev WHERE id > 300 ORDER BY id LIMIT 200) e LEFT JOIN dc d ON d.event_id = e.id"""),
        "detections_since_id": _with("td", f"""SELECT d.id, {_ts('d.created_at')} AS created_at, d.match_type, d.matched_value,
              d.feed_name, e.src_ip, e.dst_ip, e.hostname, e.action AS event_action
            FROM (SELECT * FROM td WHERE id > 150 ORDER BY id LIMIT 100) d JOIN ev e ON e.id = d.event_id"""),
        "max_ids": _with("td", """SELECT 'events' AS name, coalesce(max(id), 0) AS m FROM ev
            UNION ALL SELECT 'detections', coalesce(max(id), 0) FROM td"""),
        "event_labels": _with("ev", f"""SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS time_text,
              CASE WHEN {age} < 60 THEN CAST(CAST({age} AS BIGINT) AS VARCHAR) || 's ago'
                   WHEN {age} < 3600 THEN CAST(CAST(floor({age} / 60) AS BIGINT) AS VARCHAR) || 'm ago'
                   WHEN {age} < 86400 THEN CAST(CAST(floor({age} / 3600) AS BIGINT) AS VARCHAR) || 'h ago'
                   ELSE CAST(CAST(floor({age} / 86400) AS BIGINT) AS VARCHAR) || 'd ago' END AS age,
              CASE WHEN {source} IS NOT NULL THEN {source} || coalesce('→' || dst_ip, '') ELSE left(msg, 34) END AS label, bucket
            FROM ev"""),
        "live_snapshot": _with("dc bc", f"""SELECT 'event' AS kind, {_EVENT_LIST}, e.bucket, d.det_count, CAST(NULL AS BIGINT) AS n,
              {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in ('created_at', 'match_type', 'matched_value', 'feed_name', 'event_action'))}
            FROM ev e LEFT JOIN dc d ON d.event_id = e.id WHERE e.id > (SELECT max(id) FROM ev) - 10
            UNION ALL BY NAME SELECT 'detection' AS kind, d.id, e.src_ip, e.dst_ip, e.hostname, {_ts('d.created_at')} AS created_at,
              d.match_type, d.matched_value, d.feed_name, e.action AS event_action
            FROM td d JOIN ev e ON e.id = d.event_id WHERE d.id > (SELECT max(id) FROM td) - 5
            UNION ALL BY NAME SELECT 'bucket' AS kind, bucket, n FROM bc
            UNION ALL BY NAME SELECT 'bucket' AS kind, '_total' AS bucket, CAST(sum(n) AS BIGINT) AS n FROM bc"""),
        "events_per_minute": _with("ev", f"""SELECT {_ts('w')} AS window_end, count(*) AS n FROM (
            SELECT time_bucket(INTERVAL 10 SECOND, received_at) + o * INTERVAL 10 SECOND AS w
            FROM ev, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS o) x) y GROUP BY w"""),
        "stream_ingest": _with("ev", f"SELECT raw, {_ts('ts')} AS ts, tag, src_ip, dst_ip, hostname FROM ev"),
        "stream_detections": _with("hits", "SELECT ioc_id, match_type, matched_value, count(*) AS n FROM hits GROUP BY 1, 2, 3"),
        "stream_live_updates": _with("dc", f"""SELECT 'event' AS kind, e.raw, {iso('e.ts')} AS ts, e.src_ip, e.dst_ip, e.hostname, e.action, e.bucket,
              {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in ('created_at', 'match_type', 'matched_value', 'feed_name', 'event_action'))},
              d.det_count, CAST(NULL AS BIGINT) AS n
            FROM ev e LEFT JOIN dc d ON d.event_id = e.id
            UNION ALL BY NAME SELECT 'detection' AS kind, e.src_ip, e.dst_ip, e.hostname, {iso('d.created_at')} AS created_at,
              d.match_type, d.matched_value, d.feed_name, e.action AS event_action FROM td d JOIN ev e ON e.id = d.event_id
            UNION ALL BY NAME SELECT 'buckets' AS kind, bucket, n FROM today
            UNION ALL BY NAME SELECT 'buckets' AS kind, '_total' AS bucket, CAST(sum(n) AS BIGINT) AS n FROM today""",
            today=f"""SELECT b.bucket, coalesce(c.n, 0) AS n FROM (SELECT unnest({BUCKETS!r}) AS bucket) b LEFT JOIN (
              SELECT bucket, count(*) AS n FROM ev WHERE CAST(ts AS DATE) = (SELECT CAST(max(received_at) AS DATE) FROM ev) GROUP BY bucket) c
              ON c.bucket = b.bucket"""),
        "stream_daily_buckets": _with("ev", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, bucket, count(*) AS n FROM ev GROUP BY 1, 2"),
        "stream_arrival_rate": _with("te", f"""SELECT {_ts('w')} AS window_end, count(*) AS n FROM (
            SELECT time_bucket(INTERVAL 10 SECOND, event_ts + INTERVAL 3 SECOND) + o * INTERVAL 10 SECOND AS w
            FROM te, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS o) x) y GROUP BY w"""),
    }
