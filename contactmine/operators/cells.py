"""Scan the string cells of any table, one text per cell."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def cells(df: DataFrame, key: str, table: str) -> DataFrame:
    """``[source_id, column, text]`` for each non-null string cell; other types are skipped.

    ``source_id`` is ``table-key``.  One scan reads the key and the string columns.
    """
    columns = [c for c in string_columns(df) if c != key]
    source = F.concat(F.lit(table + "-"), F.col(key).cast("string"))
    cell = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in columns]
    if not cell:
        empty = df.select(source.alias("source_id"), F.lit("").alias("column"), F.lit("").alias("text"))
        return empty.filter(F.lit(False))
    return df.select(source.alias("source_id"), F.inline(F.array(*cell))).filter(
        F.col("text").isNotNull()
    )


def cells_of_tables(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Cells of several tables, given as ``{name: (frame, key column)}``."""
    parts = [
        cells(df, key, name).withColumn("table", F.lit(name)) for name, (df, key) in tables.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
