"""Texts, patterns and limits that results depend on.

Everything in this file is a fixed value. The patterns are Java regular
expressions: ``(?U)`` gives the classes their Unicode meaning, ``(?d)`` makes
``\\n`` the only line end, and ``WS`` also covers the four ASCII separators
that Unicode white space leaves out.
"""

WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"
# the same white space as single characters
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
            "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# -- syslog line ------------------------------------------------------------
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
FACILITY_NAMES = ["kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news",
                  "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console",
                  "solaris-cron", "local0", "local1", "local2", "local3", "local4",
                  "local5", "local6", "local7"]
SEVERITY_NAMES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]

LINE_END_PATTERN = r"[\r\n]+\z"
HEADER_PATTERN = (
    rf"(?U)(?d)^(?:<([0-9]{{1,3}})>)?([A-Z][a-z]{{2}}){WS}+([0-9]{{1,2}}){WS}+"
    rf"([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}}){WS}+({NON_WS}+){WS}+(.*)$"
)
TAG_PATTERN = rf"(?U)(?d)^([^:\s\x1c-\x1f]+):{WS}?(.*)$"
PID_PATTERN = r"\[[0-9]+\]$"
DAEMON_PATTERN = r"^(kernel|dnsmasq-dhcp|dnsmasq|hostapd|pppd|ubios|unifi|network|syslog)(?:\[[0-9]+\])?:"
FIELD_PATTERN = (
    rf"(?U)(?d)\b(?:SRC|DST|SPT|DPT|PROTO|IN|OUT){WS}*={WS}*[^\s\x1c-\x1f=]+(?={WS}+\w+=|{WS}*$)"
)
ACTION_PATTERN = r"\[([A-Za-z][A-Za-z0-9_.-]*)\]"
DNS_QUERY_PATTERN = rf"(?U)query\[(?:[A-Za-z0-9]+)\]{WS}+({NON_WS}+){WS}+from{WS}+({NON_WS}+)"
DHCP_ACK_PATTERN = rf"(?U)DHCPACK\(\w+\){WS}+{NON_WS}+{WS}+{NON_WS}+{WS}+({NON_WS}+)"

# -- traffic buckets, in display order --------------------------------------
BUCKETS = ["Firewall · DROP", "Firewall · ACCEPT", "Firewall · Rule", "IPS / DPIA",
           "DNS", "DHCP", "WLAN", "WAN", "System", "Kernel", "Other"]
SYSTEM_TAGS = ["ubios", "unifi", "network", "syslog"]

# -- feeds and indicators ---------------------------------------------------
FEED_TYPES = ["plain", "csv", "stix", "taxii"]
PAYLOAD_CAP_BYTES = 20 * 1024 * 1024
DEFAULT_PULL_MINUTES = 1440
ERROR_TEXT_CHARS = 500
URL_HOST_PATTERN = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]+)"
DOMAIN_PATTERN = r"(?d)^[a-zA-Z0-9*_-]+(\.[a-zA-Z0-9*_-]+)+\.?$"
DOTTED_QUAD_PATTERN = r"(?U)(?d)^\d+\.\d+\.\d+\.\d+$"
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
STIX_KINDS = {"ipv4-addr": "ip", "ipv6-addr": "ip", "domain-name": "domain", "url": "url"}
STIX_EQUALS_PATTERN = (
    rf"(?U)(ipv4-addr|ipv6-addr|domain-name|url)(?::value)?{WS}*={WS}*'([^']+)'"
)
STIX_IN_PATTERN = (
    rf"(?U)(ipv4-addr|ipv6-addr|domain-name|url)(?::value)?{WS}+IN{WS}*\(([^)]*)\)"
)
SEED_FEEDS = [
    # name, type, source_url, parser_config, auto_pull_minutes
    ("Abuse.ch ThreatFox (recent)", "csv",
     "https://threatfox.abuse.ch/export/csv/recent/",
     {"has_header": False, "delimiter": ",", "value_column": 3,
      "description_column": 6, "tags_column": 5}, 60),
    ("Abuse.ch URLhaus (recent)", "csv",
     "https://urlhaus.abuse.ch/downloads/csv_recent/",
     {"has_header": False, "delimiter": ",", "value_column": 3,
      "description_column": 6, "tags_column": 7, "reference_column": 8}, 60),
    ("Abuse.ch Feodo IP blocklist", "plain",
     "https://feodotracker.abuse.ch/downloads/ipblocklist_recommended.txt", {}, 360),
    ("Spamhaus DROP/EDROP", "plain",
     "https://www.spamhaus.org/drop/drop.txt", {}, 360),
]

# -- paging and windows -----------------------------------------------------
PAGE_DEFAULT = 50
PAGE_MAX = 500
EVENTS_SINCE_LIMIT = 200
DETECTIONS_SINCE_LIMIT = 100
PENDING_PULLS_LIMIT = 20
SNAPSHOT_EVENTS = 10
SNAPSHOT_DETECTIONS = 5
