"""Global de-duplication, first sightings, and differences with earlier output.

All of them combine on the map side before the shuffle, so a value that makes up
a third of the input arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(contacts: DataFrame, casefold: bool = False) -> DataFrame:
    """Distinct ``[kind, value]``; with ``casefold`` the smallest spelling of each."""
    if not casefold:
        return contacts.select("kind", "value").distinct()
    return (
        contacts.groupBy("kind", F.lower("value").alias("_folded"))
        .agg(F.min("value").alias("value"))
        .drop("_folded")
    )


def reading_order(contacts: DataFrame) -> list[str]:
    """Columns that order contacts as they stand in their sources; lines have a ``place``."""
    return ["source_id", *(["place"] if "place" in contacts.columns else []), "pos"]


def first_source(contacts: DataFrame) -> DataFrame:
    """Each value with the source that shows it first, by ``(source_id, place, pos)``."""
    first = F.min(F.struct(*reading_order(contacts)))
    return contacts.groupBy("kind", "value").agg(first.alias("_first")).select(
        "kind", "value", F.col("_first.source_id").alias("source_id"), F.col("_first.pos").alias("pos")
    )


def first_per_key(contacts: DataFrame, key: Column, name: str = "host") -> DataFrame:
    """The first value of each key, by ``(source_id, place, pos, value)``."""
    first = F.min(F.struct(*reading_order(contacts), "value"))
    return contacts.groupBy(key.alias(name)).agg(first.alias("_first")).select(
        name, F.col("_first.value").alias("value"), F.col("_first.source_id").alias("source_id")
    )


def smallest_per_key(values: DataFrame, key: str, value: str = "value") -> DataFrame:
    """The smallest value of each non-null key."""
    return values.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def new_values(values: DataFrame, exported: DataFrame, on: tuple[str, ...] = ("value",)) -> DataFrame:
    """Rows of ``values`` not in ``exported``."""
    return values.join(exported.select(*on).distinct(), list(on), "left_anti")


def skip_processed(files: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Inputs not yet in the ledger of processed ones."""
    return files.join(ledger.select(key), key, "left_anti")


def union_values(*frames: DataFrame) -> DataFrame:
    """Distinct ``[kind, value]`` over several contact frames."""
    merged = frames[0].select("kind", "value")
    for frame in frames[1:]:
        merged = merged.unionByName(frame.select("kind", "value"))
    return merged.distinct()


def last_n(events: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` latest rows: top-n per task, then one merge."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)
