"""Headline queries, timed: prints one JSON line.

``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``$BENCH_CPUS`` (default 8).
``parse``, ``ingest`` and ``detect`` are the heavy jobs, the last two writing a table; the other
entries read those tables. Every entry runs to a full write of its result; the
first of ``$BENCH_RUNS`` (default 2) runs warms up and the best one counts.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netsight.operators import match
from netsight.operators.ingest import parse_lines
from netsight.plans.catalog import all_queries
from netsight.plans.stored import stored
from netsight.session import work_path
from netsight.sources import derived, storage

HEADLINE = [
    "ioc_snapshot", "detections_all", "detections_all_one_pass", "match_ip_exact", "match_cidr",
    "match_domain_suffix", "match_url_host", "retro_scan_full", "retro_scan_delta", "detections_insert_new", "ioc_upsert",
    "feed_plain", "feed_csv", "feed_stix", "feed_sweep_summary", "stats", "events_browse", "events_search",
    "detections_browse", "bucket_totals", "bucket_totals_daily", "events_per_minute", "live_snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("netsight-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    tables = stored(spark, sf_dir)

    lines_path = work_path(spark, "lines")
    derived.syslog_lines(spark, sf_dir).repartition(int(cpus)).write.parquet(lines_path)
    n_lines = spark.read.parquet(lines_path).count()

    def parse():
        parse_lines(spark.read.parquet(lines_path)).write.format("noop").mode("overwrite").save()

    def ingest():
        storage.append_events(spark.read.parquet(lines_path), work_path(spark, "events"))

    def detect():
        hits = match.match_events(tables.events, tables.snapshot, F.col("received_at"))
        storage.append_detections(hits, work_path(spark, "detections"))

    def named(name):
        def run():
            all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return run

    jobs = {"parse": parse, "ingest": ingest, "detect": detect, **{name: named(name) for name in HEADLINE}}
    _ = tables.detections  # builds the stored tables
    seconds = {}
    for name, job in jobs.items():
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "lines_per_second_ingest": round(n_lines / seconds["ingest"]),
    }))


if __name__ == "__main__":
    main()
