"""Keep the base URLs a probe found alive.

Executors make no requests: the caller supplies ``[base_url, status]`` from a
probe of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _alive(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status") == 200).select(F.col("base_url").alias("value"))


def live_only(base_urls: DataFrame, status: DataFrame) -> DataFrame:
    """Base URLs with a 200 status."""
    return base_urls.join(_alive(status), "value", "left_semi")


def dead_log(base_urls: DataFrame, status: DataFrame) -> DataFrame:
    """Base URLs without one: another status, or never probed."""
    return base_urls.join(_alive(status), "value", "left_anti")
