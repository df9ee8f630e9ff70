"""A pull round from landed payloads to the next published version."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.operators import feeds as feed_ops
from netsight.operators import registry
from netsight.operators.ids import assign_ids, max_id
from netsight.schemas import FEED_LOGS
from netsight.session import path_exists, stage_scope, written_once


def sweep(payloads: DataFrame, root: str, now: Column, severity_property: str = "x_severity") -> int:
    """Work through ``payloads`` of all enabled live feeds and publish the outcome.

    Reads the current version under ``root``, merges the indicators of the feeds whose pull
    succeeded, records status and log of every feed pulled, and returns the version. It goes up
    only if a pull succeeded. Payloads are parsed once, into a table that counts and merge read.
    """
    spark = payloads.sparkSession
    with stage_scope(spark):
        return _sweep(payloads, root, now, severity_property)


def _sweep(payloads: DataFrame, root: str, now: Column, severity_property: str) -> int:
    spark = payloads.sparkSession
    iocs, feeds = registry.read_version(spark, root, registry.current_version(spark, root))
    typed = feed_ops.with_feed(payloads, feeds)
    made = written_once(feed_ops.outcomes(typed, severity_property), "outcomes")
    results = written_once(feed_ops.sweep_results(payloads, feeds, made), "results")
    good = results.filter("error IS NULL").limit(1).count() > 0
    merged = registry.upsert_iocs(iocs, feed_ops.of_good_pulls(feed_ops.indicators_of(made), results), now) if good else iocs
    version = registry.publish_version(merged, registry.record_pulls(feeds, results), root, raise_version=good)
    append_log(registry.pull_log_rows(results), f"{root}/logs")
    return version


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows with ids that go up by feed and time."""
    spark = rows.sparkSession
    start = max_id(spark.read.parquet(path)).first()[0] if path_exists(spark, path) else 0
    numbered = assign_ids(rows, ["feed_id", "ts"], start)
    numbered.select(*[F.col(f.name).cast(f.dataType) for f in FEED_LOGS.fields]).write.mode("append").parquet(path)
