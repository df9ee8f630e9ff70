"""Events joined to active indicators.

Every indicator has one text *key* and every event value has a few *probe keys*,
so exact address, network containment and domain suffix are all the same equi-join:

=========  ==========================  ============================================
indicator  key                         probe keys of an event value
=========  ==========================  ============================================
ip         ``ip/<text>``               the address text
cidr       ``<ver>/<len>/<bits>``      one per prefix length present in the snapshot
domain     ``host/<name>``             every label suffix of the host name
url        ``host/<host of the URL>``  as for domain
=========  ==========================  ============================================

Two exact ways to run the join:

* by value (default): the distinct values are matched, then joined back to the
  events. Hot addresses collapse in the map-side half of the distinct step, the
  costly key work is done once per value, and adaptive execution broadcasts the
  matched values when they turn out small or else splits skewed partitions of the
  shuffled join. It reads the three value columns twice.
* one pass: every event makes its own probes, about twice the work; the way for
  streams, which it works on too. IPv4 lengths that lie close together share a probe, since
  each probe moves its event once: see ``probed_heads``.

Networks are found by binary search over the prefix lengths when there are many of
them: an address needs at most 8 look-ups for 129 lengths, in place of one probe for
each. A network leaves a marker at each length where a search for it must go on to
longer ones, and a node, network or marker, knows all networks that hold it; the last
node that an address hits therefore names every network of the address.

Neither hints a join: Spark broadcasts the indicator keys if their measured bytes
are below its own limit, and shuffles both sides otherwise.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.functions.indicators import host_key, url_hostname
from netsight.functions.ip import ip_bits, ip_version, network_key, parse_network
from netsight.functions.text import computed_once

DETECTION_KEY = ["event_id", "ioc_id", "match_type"]


def active_indicators(iocs: DataFrame, feeds: DataFrame) -> DataFrame:
    """Active indicators of feeds that are not deleted; disabled feeds still count."""
    live = feeds.filter("deleted_at IS NULL").select(
        F.col("id").alias("feed_id"), F.col("name").alias("feed_name"))
    return (iocs.filter("active").select(F.col("id").alias("ioc_id"), "feed_id", "type", "value")
            .join(live, "feed_id"))


def indicator_keys(indicators: DataFrame) -> DataFrame:
    """Indicators with their join key; unusable ones (bad network, URL without host) drop out."""
    value, kind = F.col("value"), F.col("type")
    host = (F.when(kind == "domain", F.lower(value))
            .when(kind == "url", host_key(url_hostname(value))))
    parsed = computed_once(indicators, "_net", F.when(kind == "cidr", parse_network(value)))
    keyed = computed_once(parsed, "key", F.when(kind == "ip", F.concat(F.lit("ip/"), value))
                          .when(kind == "cidr", F.col("_net.key"))
                          .otherwise(F.concat(F.lit("host/"), host)))
    return keyed.filter("key IS NOT NULL").select(
        "ioc_id", "feed_id", "feed_name", "type", "key",
        F.col("_net.ver").alias("ver"), F.col("_net.prefix_len").alias("prefix_len"), F.col("_net.bits").alias("bits"))


#: Up to this many prefix lengths of a version, one probe for each takes less than a search.
PROBED_LENGTHS = 16


@dataclass(frozen=True)
class Snapshot:
    """Prepared indicators: join keys, prefix lengths per version, and what a search by length needs."""

    keys: DataFrame
    prefix_lens: DataFrame
    nodes: DataFrame | None = None
    lengths: dict[int, list[int]] | None = None
    grouped: DataFrame | None = None
    heads: list[int] | None = None


def prepare_snapshot(indicators: DataFrame, persist: bool = False, probed_lengths: int = PROBED_LENGTHS) -> Snapshot:
    """Derive join keys and prefix lengths; ``persist`` keeps the keys for many matches.

    The prefix lengths, two rows, are looked at to choose between probes and the search.
    """
    keys = indicator_keys(indicators)
    if persist:
        keys = keys.persist()
    lens = (keys.filter("prefix_len IS NOT NULL")
            .groupBy("ver").agg(F.sort_array(F.collect_set("prefix_len")).alias("lens")))
    lengths = {r["ver"]: r["lens"] for r in lens.collect()}
    nodes = search_nodes(keys, lengths) if any(len(own) > probed_lengths for own in lengths.values()) else None
    heads = probed_heads(lengths.get(4, []))
    return Snapshot(keys.drop("ver", "prefix_len", "bits"), lens, nodes, lengths if nodes is not None else None,
                    grouped_keys(keys, heads) if heads else None, heads)


#: An address is looked up once for this many bits past a length, and at most 4 networks share a key.
SHARED_BITS = 2


def probed_heads(lengths: list[int]) -> list[int]:
    """The IPv4 lengths to probe: each stands for those up to ``SHARED_BITS`` longer too."""
    heads: list[int] = []
    for n in sorted(lengths):
        if not heads or n > heads[-1] + SHARED_BITS:
            heads.append(n)
    return heads


def grouped_keys(keys: DataFrame, heads: list[int]) -> DataFrame:
    """Indicators with the key of the probe that meets them, and what the address bits behind it must be.

    ``tail`` are the network's bits past its head; ``drop`` says how many of a probe's do not count.
    Other indicators have none: all 0.
    """
    n, own = F.col("bits.n"), F.col("prefix_len")
    head = F.coalesce(*[F.when(own >= h, F.lit(h)) for h in reversed(heads)])
    is_net = F.col("ver") == 4
    tail = F.call_function("shiftright", n, 32 - own).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), own - head) - 1)
    return keys.select("ioc_id", "feed_id", "feed_name", "type",
                       F.when(is_net, network_key(F.col("bits"), head)).otherwise(F.col("key")).alias("key"),
                       F.coalesce(F.when(is_net, tail), F.lit(0)).cast("int").alias("tail"),
                       F.coalesce(F.when(is_net, head + F.least(F.lit(SHARED_BITS), 32 - head) - own), F.lit(SHARED_BITS)).cast("int").alias("drop"))


def marker_lengths(lengths: list[int]) -> dict[int, list[int]]:
    """For each length, the shorter ones at which a binary search for it goes on to longer ones."""
    out = {}
    for i, own in enumerate(lengths):
        low, high, marks = 0, len(lengths) - 1, []
        while (middle := (low + high) // 2) != i:
            if middle < i:
                marks.append(lengths[middle])
                low = middle + 1
            else:
                high = middle - 1
        out[own] = marks
    return out


def search_nodes(keys: DataFrame, lengths: dict[int, list[int]]) -> DataFrame:
    """(node, chain): every network and marker key, with the keys of all networks that hold it.

    Made once for a snapshot, from the networks alone: 8 markers at most each, and a look-up of
    the lengths up to a marker's own.
    """
    ints = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    by_version = lambda make: F.coalesce(*[F.when(F.col("ver") == v, make(own)) for v, own in lengths.items()])
    marked = lambda own: F.element_at(F.create_map(*[x for n, marks in marker_lengths(own).items() for x in (F.lit(n), ints(marks))]), F.col("prefix_len"))
    networks = keys.filter("prefix_len IS NOT NULL").select("ver", "prefix_len", "bits", "key")
    nodes = (networks.select("ver", "bits", F.explode(F.array_append(by_version(marked), F.col("prefix_len"))).alias("n"))
             .withColumn("node", network_key(F.col("bits"), F.col("n"))).dropDuplicates(["node"]))
    upto = F.filter(by_version(ints), lambda n: n <= F.col("n"))
    held = (nodes.select("node", F.explode(F.transform(upto, lambda n: network_key(F.col("bits"), n))).alias("key"))
            .join(networks.select("key").distinct(), "key"))
    return (nodes.select("node").join(held, "node", "left").groupBy("node")
            .agg(F.collect_list("key").alias("chain")))


def network_keys_of(values: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Rows of ``values`` (value: distinct canonical addresses) once for each network ``key`` that holds them.

    One join for each step of the search. An address whose search has ended takes a key of its
    own, which meets nothing, so that no join has a hot one.
    """
    pick = lambda index: F.coalesce(*[F.when(F.col("_ver") == v, F.get(F.array(*[F.lit(n) for n in own]).cast("array<int>"), index))
                                      for v, own in snapshot.lengths.items()])
    most = lambda: F.coalesce(*[F.when(F.col("_ver") == v, F.lit(len(own) - 1)) for v, own in snapshot.lengths.items()], F.lit(-1))
    state = (values.withColumns({"_ver": ip_version(F.col("value")), "_bits": ip_bits(F.col("value"))})
             .withColumns({"_low": F.lit(0), "_high": most(), "_chain": F.array().cast("array<string>")}))
    for _ in range(max(len(own) for own in snapshot.lengths.values()).bit_length()):
        middle = F.floor((F.col("_low") + F.col("_high")) / 2).cast("int")
        probed = F.when(F.col("_low") <= F.col("_high"), network_key(F.col("_bits"), pick(middle)))
        asked = state.withColumn("_middle", middle).withColumn("_key", F.coalesce(probed, F.concat(F.lit("none/"), F.col("value"))))
        found = snapshot.nodes.select(F.col("node").alias("_key"), F.col("chain").alias("_found"))
        hit = F.col("_found").isNotNull()
        state = asked.join(found, "_key", "left").select(
            *values.columns, "_ver", "_bits", F.when(hit, F.col("_middle") + 1).otherwise(F.col("_low")).alias("_low"),
            F.when(hit, F.col("_high")).otherwise(F.col("_middle") - 1).alias("_high"), F.coalesce("_found", "_chain").alias("_chain"))
    return state.select(*values.columns, F.explode("_chain").alias("key"))


def event_values(events: DataFrame, created_at: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-empty source address, destination address and host name.

    The day of events that are stored by day comes along, so that a detection tells where its event lies;
    so do the columns of ``also``.
    """
    item = lambda kind, column: F.struct(
        F.lit(kind).alias("match_type"), F.nullif(F.col(column), F.lit("")).alias("value"))
    items = F.filter(F.array(item("src", "src_ip"), item("dst", "dst_ip"), item("host", "hostname")),
                     lambda v: v["value"].isNotNull())
    stamp = F.current_timestamp() if created_at is None else created_at
    kept = [*[c for c in ("event_date",) if c in events.columns], *also]
    return events.select(F.col("id").alias("event_id"), stamp.alias("created_at"), *kept,
                         F.explode(items).alias("v")).select("event_id", "created_at", *kept, "v.*")


def matched_value(match_type: Column, value: Column) -> Column:
    """Address text as it is; host name lower-cased, without trailing dots, then without port."""
    return F.when(match_type == "host", F.split_part(host_key(value), F.lit(":"), F.lit(1))) \
        .otherwise(value)


def label_suffixes(host: Column) -> Column:
    """``a.b.c`` to ``[a.b.c, b.c, c]``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def probe_keys(values: DataFrame, prefix_lens: DataFrame) -> DataFrame:
    """Add ``key``, one row per probe, to rows with ``match_type`` and ``value``.

    The prefix lengths are two rows at most, with up to 33 and 129 numbers.
    """
    is_host = F.col("match_type") == "host"
    matched = F.col("matched_value")
    nets = F.transform(F.col("lens"), lambda n: network_key(F.col("_bits"), n))
    ip_probes = F.concat(F.array(F.concat(F.lit("ip/"), matched)),
                         F.coalesce(nets, F.array().cast("array<string>")))
    host_probes = F.transform(label_suffixes(matched), lambda s: F.concat(F.lit("host/"), s))
    return (
        values.withColumn("matched_value", matched_value(F.col("match_type"), F.col("value")))
        .withColumn("_ver", F.when(~is_host, ip_version(F.col("value"))))
        .join(F.broadcast(prefix_lens.withColumnRenamed("ver", "_ver")), "_ver", "left")
        .withColumn("_bits", F.when(~is_host & F.col("lens").isNotNull(), ip_bits(F.col("value"))))
        .withColumn("key", F.explode(F.when(is_host, host_probes).otherwise(ip_probes)))
        .drop("_ver", "_bits", "lens"))


def grouped_probes(values: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``probe_keys`` with one probe for each of the snapshot's heads: (key, bits) has the address bits past it."""
    is_host, matched = F.col("match_type") == "host", F.col("matched_value")
    n, head_key = F.col("_bits.n"), lambda h: network_key(F.col("_bits"), F.lit(h))
    probe = lambda key, bits=None: F.struct(key.alias("key"), (F.lit(0) if bits is None else bits).cast("int").alias("bits"))

    def past(h: int) -> Column:
        width = min(SHARED_BITS, 32 - h)
        return F.call_function("shiftright", n, F.lit(32 - h - width)).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    v4 = F.array(*[probe(head_key(h), past(h)) for h in snapshot.heads])
    v6 = F.transform(F.coalesce("lens", F.array().cast("array<int>")), lambda n: probe(network_key(F.col("_bits"), n)))
    hosts = F.transform(label_suffixes(matched), lambda s: probe(F.concat(F.lit("host/"), s)))
    nets = F.when(n.isNotNull(), v4).otherwise(v6)
    versioned = (
        values.withColumn("matched_value", matched_value(F.col("match_type"), F.col("value")))
        .withColumn("_ver", F.when(~is_host, ip_version(F.col("value"))))
        .join(F.broadcast(snapshot.prefix_lens.withColumnRenamed("ver", "_ver")), "_ver", "left"))
    return (
        computed_once(versioned, "_bits", F.when(~is_host & F.col("lens").isNotNull(), ip_bits(F.col("value"))))
        .withColumn("_probe", F.explode(F.when(is_host, hosts).otherwise(
            F.concat(F.array(probe(F.concat(F.lit("ip/"), matched))), nets))))
        .select(*values.columns, "matched_value", "_probe.key", "_probe.bits"))


def _match_one_pass(values: DataFrame, snapshot: Snapshot) -> DataFrame:
    if not snapshot.heads:
        return probe_keys(values, snapshot.prefix_lens).join(snapshot.keys, "key")
    met = grouped_probes(values, snapshot).join(snapshot.grouped, "key")
    return met.filter(F.call_function("shiftright", F.col("bits"), F.col("drop")) == F.col("tail"))


def _keyed_values(values: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The distinct (is_host, value) of event values, with ``matched_value``, once for each ``key`` that may be theirs."""
    kind = (F.col("match_type") == "host").alias("is_host")
    distinct = values.select(kind, "value").distinct()
    searched = snapshot.nodes is not None
    lens = snapshot.prefix_lens.limit(0) if searched else snapshot.prefix_lens
    keyed = probe_keys(distinct.withColumn("match_type", F.when(F.col("is_host"), "host").otherwise("ip")), lens).drop("match_type")
    if searched:
        networks = network_keys_of(distinct.filter("NOT is_host"), snapshot)
        keyed = keyed.unionByName(networks.withColumn("matched_value", F.col("value")))
    return keyed


def _match_by_value(values: DataFrame, snapshot: Snapshot) -> DataFrame:
    hits = _keyed_values(values, snapshot).join(snapshot.keys, "key")
    return values.withColumn("is_host", F.col("match_type") == "host").join(hits, ["is_host", "value"])


def hit_counts(events: DataFrame, snapshot: Snapshot, group: Column) -> DataFrame:
    """(part, n): how many hits the events of each ``group`` (over ``event_id``) have, without making them.

    Each key counts its indicators, each value its keys, so the work grows with events and
    indicators and not with what they give together.
    """
    values = event_values(events, F.lit(None).cast("timestamp")).select(group.alias("part"), (F.col("match_type") == "host").alias("is_host"), "match_type", "value")
    held = snapshot.keys.groupBy("key").agg(F.count("*").alias("n"))
    of_value = _keyed_values(values, snapshot).join(held, "key").groupBy("is_host", "value").agg(F.sum("n").alias("n"))
    return values.join(of_value, ["is_host", "value"]).groupBy("part").agg(F.sum("n").alias("n"))


def hit_runs(events: DataFrame, snapshot: Snapshot, keys: DataFrame, created_at: Column | None = None,
             also: tuple[str, ...] = ()) -> DataFrame:
    """The hits of ``match_events``, once for each (event, match type, key) in place of each indicator.

    ``keys`` (key, …) names every key that has indicators once; its other columns come along, as do
    those of ``also`` from the events. There is one row for each probe that hits, however many
    indicators share its key.
    """
    values = event_values(events, created_at, also)
    hits = _keyed_values(values, snapshot).join(keys, "key")
    found = values.withColumn("is_host", F.col("match_type") == "host").join(hits, ["is_host", "value"])
    return found.drop("is_host", "value", "key")


def match_events(events: DataFrame, snapshot: Snapshot, created_at: Column | None = None,
                 one_pass: bool | None = None) -> DataFrame:
    """All (event, indicator, match type) hits with feed attribution.

    ``created_at`` is an expression over ``events`` (default: now). ``one_pass``
    overrides the choice, which is by value unless ``events`` is a stream; both
    ways give the same rows. ``events`` should be a stored table.
    """
    values = event_values(events, created_at)
    one_pass = events.isStreaming if one_pass is None else one_pass
    hits = (_match_one_pass if one_pass else _match_by_value)(values, snapshot)
    return detection_columns(hits)


def detection_columns(hits: DataFrame) -> DataFrame:
    return hits.select("event_id", "ioc_id", "feed_id", "feed_name", "match_type", "matched_value", "created_at",
                       *[c for c in ("event_date",) if c in hits.columns])


def only_type(indicators: DataFrame, *types: str) -> DataFrame:
    return indicators.filter(F.col("type").isin(*types))


def reference_counts(indicators: DataFrame) -> DataFrame:
    """Usable indicators per type: bad networks and URLs without host are not counted."""
    return indicator_keys(indicators).groupBy("type").agg(F.count(F.lit(1)).alias("n_refs"))


def new_detections(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits not yet stored: do-nothing insert on (event, indicator, match type).

    Stored ones go first: what is left lies by key already, so that only it is made distinct, without a shuffle.
    """
    return hits.join(stored.select(*DETECTION_KEY), DETECTION_KEY, "left_anti").dropDuplicates(DETECTION_KEY)


def added_keys(now: Snapshot, before: Snapshot) -> Snapshot:
    """What a snapshot has that an earlier one had not: the only keys that can give new hits."""
    fresh = now.keys.join(before.keys.select("ioc_id", "key"), ["ioc_id", "key"], "left_anti")
    return Snapshot(fresh, now.prefix_lens)


def stored_values(events: DataFrame) -> DataFrame:
    """The values of events as a narrow table to keep beside them: (event_id, ts, event_date, match_type, value)."""
    return event_values(events, F.col("ts")).withColumnRenamed("created_at", "ts")


def retro_scan_added(values: DataFrame, added: Snapshot, stored: DataFrame, created_at: Column) -> DataFrame:
    """New detections that added keys give among ``stored_values``: the delta of a full re-match.

    Events that were matched with the snapshot before hit its keys already, so their values meet
    the added keys alone. ``stored`` needs to hold no detections but those of the added indicators,
    which have some if they were active before.
    """
    hits = _match_by_value(values.drop("ts").withColumn("created_at", created_at), added)
    return new_detections(detection_columns(hits), stored)


def retro_candidates(events: DataFrame, now: Column, hours: int, watermark: int | None) -> DataFrame:
    """Stored events a retro-scan looks at: recent ones, above the watermark unless it is None."""
    since = now - F.make_dt_interval(hours=F.lit(hours))
    recent = events.filter(F.col("ts") >= since)
    if "event_date" in events.columns:  # older day folders are not opened
        recent = recent.filter(F.col("event_date") >= F.to_date(since))
    return recent if watermark is None else recent.filter(F.col("id") > watermark)


def retro_scan(events: DataFrame, stored: DataFrame, snapshot: Snapshot, now: Column,
               hours: int = 24, watermark: int | None = 0,
               created_at: Column | None = None) -> DataFrame:
    """New detections for stored events under a new snapshot.

    With a ``watermark`` only events above it are rechecked (default mode);
    ``watermark=None`` rechecks the whole window.
    """
    scanned = retro_candidates(events, now, hours, watermark)
    known = stored if watermark is None else stored.filter(F.col("event_id") > watermark)
    return new_detections(match_events(scanned, snapshot, created_at), known)


def next_watermark(events: DataFrame, now: Column, hours: int, watermark: int) -> DataFrame:
    """One row: the watermark after a scan, never lower than before."""
    return retro_candidates(events, now, hours, watermark).agg(
        F.greatest(F.lit(watermark).cast("bigint"), F.max("id")).alias("watermark"))
