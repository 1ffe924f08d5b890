"""Output folders that grow by batches, each of which appears whole or not at all.

A batch writes a folder of its own below each table, ``<table>/batch=<name>``, and at last one
row below ``commits``.  Readers take the batches that have such a row.  A batch that died on
the way is run again under its name and replaces what it left; one that is committed is
never run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F

COMMIT = "seq bigint, tables array<string>, buckets array<int>, batch string"


def existing(read: Callable[[str], DataFrame], *paths: str) -> DataFrame | None:
    """What ``read`` gives, or None if nothing is there."""
    try:
        return read(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Commits:
    """The batches of one output folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        found = existing(spark.read.schema(COMMIT).json, f"{self.folder}/commits")
        rows = found.collect() if found is not None else []  # a row for each batch
        self.rows = {r.batch: r for r in sorted(rows, key=lambda r: r.seq)}

    def __contains__(self, batch: str) -> bool:
        return batch in self.rows

    def path(self, table: str, batch: str) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def with_table(self, table: str) -> list[str]:
        """The committed batches that wrote to a table, in their order."""
        return [name for name, r in self.rows.items() if table in r.tables]

    def write(self, batch: str, tables: dict[str, Callable[[DataFrameWriter, str], None]], frames: dict[str, DataFrame]) -> None:
        """Write each frame as the batch's part of its table, replacing what an earlier attempt left."""
        for table, save in tables.items():
            save(frames[table].write.mode("overwrite"), self.path(table, batch))

    def commit(self, batch: str, tables: list[str], buckets: list[int] | None = None) -> None:
        seq = max((r.seq for r in self.rows.values()), default=0) + 1
        row = {"seq": seq, "tables": tables, "buckets": buckets or []}
        frame = self.spark.range(1).select(F.lit(json.dumps(row)).alias("value"))
        frame.coalesce(1).write.mode("overwrite").text(f"{self.folder}/commits/batch={batch}")
        self.rows[batch] = Row(batch=batch, **row)

    def read(self, table: str, reader: Callable[..., DataFrame], schema: str) -> DataFrame:
        """The committed rows of a table, with ``batch``; an empty frame of ``schema`` before the first."""
        batches = self.with_table(table)
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch string")
        return reader(f"{self.folder}/{table}").filter(F.col("batch").isin(batches))
