"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. Broadcasts are left to Spark's own size checks
# (statistics at planning time, real shuffle sizes under AQE), so no side is forced.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.ansi.enabled": "true",
}


# Temporary folders of sessions without executors elsewhere, by application.
_LOCAL: dict[str, str] = {}


def build_session(app_name: str = "martloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that outlives executors and that all of them see, from ``spark.checkpoint.dir``.

    Only a session whose executors run in this process may go without one; it gets a temporary folder, once. On a
    cluster a missing folder is an error, since executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="martloom-")
    return _LOCAL[sc.applicationId]


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/martloom-{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled is deleted as the query ends.

    Spark otherwise keeps it until the driver happens to collect garbage, so the shuffles of all earlier jobs lie on disk beside a job's own.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def copied(df: DataFrame, label: str) -> DataFrame:
    """``df`` read back from a copy in the shared folder; nothing that was shuffled for it stays."""
    path = scratch_folder(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
