"""Spark session helpers.

Cluster settings (shuffle partitions, executor memory, checkpoint dir) come
from the cluster; the defaults here only apply when nothing is configured,
as in tests and the local bench.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# static settings, safe anywhere: no web UI, no console bars, and checkpoint
# files (segmented scan) removed once their data is no longer referenced
_STATIC = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# SQL defaults for local runs; applied only where the cluster's configuration
# (spark-submit --conf, spark-defaults.conf) does not set the key itself
_SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# widths for one machine; never set on a cluster
_LOCAL_WIDTHS = {
    "spark.sql.shuffle.partitions": "8",
    # file listing runs as a Spark job of up to 10,000 tasks by default; locally a few suffice
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "16",
}


def is_local(spark: SparkSession) -> bool:
    """Does the session run in one JVM on this machine (``local`` or ``local[n]``, not ``local-cluster``)?"""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def get_spark(master: str | None = None, app_name: str = "reelcat", **conf: str) -> SparkSession:
    """Return the active session, or build one.

    Explicit ``conf`` always applies.  The SQL defaults above fill in only
    keys the cluster configuration leaves unset, so a cluster's shuffle
    partitions, time zone or AQE choices are never overridden.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        for key, value in conf.items():
            active.conf.set(key, value)  # raises for settings that a running session can't change
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        # otherwise the master comes from spark-submit, or PySpark's local default
        builder = builder.master(master)
    for key, value in {**_STATIC, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    configured = spark.sparkContext.getConf()
    for key, value in (_SQL_DEFAULTS | _LOCAL_WIDTHS if is_local(spark) else _SQL_DEFAULTS).items():
        if key not in conf and not configured.contains(key):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; a private folder is
    set only when it is unset (local tests), never over a cluster setting.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # local runs only: a private folder on this machine
        current = tempfile.mkdtemp(prefix="reelcat-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current
