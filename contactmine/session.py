"""Session settings the jobs are designed for.

Nothing here is required: every function works with the session it is given.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # run-time re-planning: merge small shuffle partitions, split skewed ones,
    # switch to a broadcast join only once the other side has been measured
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # state of streaming de-duplication lives on disk, not in the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "contactmine", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with SETTINGS; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
