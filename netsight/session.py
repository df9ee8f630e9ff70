"""Session settings and the shared work folder."""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}
_scopes = threading.local()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on: days and clock texts are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="netsight-")
    return _local_root[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder; within a ``stage_scope`` it goes when that ends."""
    path = f"{shared_root(spark)}/netsight-{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables made within it; the final write must be within it too."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(*sessions: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends, and not when the driver next collects its garbage."""
    before = [(s, s.conf.get(_CLEANUP, None)) for s in sessions]
    try:
        for s in sessions:
            s.conf.set(_CLEANUP, "true")
        yield
    finally:
        for s, was in before:
            if was is None:
                s.conf.unset(_CLEANUP)
            else:
                s.conf.set(_CLEANUP, was)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later uses do not compute it again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores; a file of few row groups would keep most of them idle."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))
