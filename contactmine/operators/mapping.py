"""Group values under a key without ever holding an unbounded group.

A key's values come as sorted arrays of about ``max_per_row`` values each; keys
with more get several rows, numbered by ``part``.  Which row a value belongs to
follows from its hash, so the rows are the same in every run.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.fixed_values import MAPPING_JOINER

MAX_PER_ROW = 10_000


def _hash_slot(value: Column, slots: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint") % slots


def collect_by_key(
    pairs: DataFrame, keys: list[str], value: str, name: str, max_per_row: int = MAX_PER_ROW
) -> DataFrame:
    """``[*keys, part, name]`` from the distinct ``[*keys, value]`` pairs without nulls.

    Group sizes are counted first, from the same shuffle.  Only keys over the limit are joined back (there
    are at most pairs / limit of them); adaptive execution broadcasts them when
    they are few and splits the big groups' partitions when not.
    """
    whole = reduce(and_, [F.col(column).isNotNull() for column in [*keys, "_value"]])
    distinct = pairs.select(*keys, F.col(value).alias("_value")).filter(whole).distinct()
    large = (
        distinct.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > max_per_row)
        .select(*keys, F.ceil(F.col("_n") / max_per_row).cast("bigint").alias("_slots"))
    )
    placed = distinct.join(large, keys, "left").withColumn(
        "part",
        F.when(F.col("_slots").isNull(), F.lit(0).cast("bigint")).otherwise(
            _hash_slot(F.col("_value"), F.col("_slots"))
        ),
    )
    return placed.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("_value")).alias(name))


def url_map(base_urls: DataFrame, key: str, max_per_row: int = MAX_PER_ROW) -> DataFrame:
    """``[key, part, urls]`` for base URLs grouped under their root, subdomain or themselves."""
    pairs = base_urls.select(F.col(key).alias("key"), F.col("value").alias("url"))
    return collect_by_key(pairs, ["key"], "url", "urls", max_per_row)


def mapping_csv_rows(url_map: DataFrame) -> DataFrame:
    """``[key, part, urls]`` with the URLs joined into one cell."""
    return url_map.withColumn("urls", F.array_join("urls", MAPPING_JOINER))


def mapping_json_rows(url_map: DataFrame) -> DataFrame:
    """``[key, part, json]`` with the URLs as a JSON array."""
    return url_map.select("key", "part", F.to_json("urls").alias("json"))
