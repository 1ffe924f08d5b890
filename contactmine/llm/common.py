"""Helpers that several of the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# documents can be long: few rows to an Arrow batch bound what a Python worker holds
BATCH_ROWS = "500"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, as in tests, it is set to a folder in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: later steps neither
    repeat its work nor depend on the executors that did it."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark drops an action's shuffle files when it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``at`` in their group and its ``size``, without a task that sees a whole group.

    ``order`` has to tell rows apart, or a key that many bear would be one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    placed = placed.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_row", 33))
    placed = saved(placed, "placed")
    starts = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    mine = Window.partitionBy(group)  # a row per partition and group
    before = F.sum("_n").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(group, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(mine).alias("size"))
    found = placed.join(starts, [group, "_part"]).withColumn("at", F.col("_row") - F.col("_first") + F.col("_before"))
    return found.drop("_row", "_part", "_first", "_before")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``key``, a number of its own for each row, in order of doc_id: doc_id itself where all rows have
    one that no other has, else the place among all rows, for which the rows are written once more.

    Rows that share a doc_id, or have none, are in order of their texts' hashes; those without come first."""
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return rows.withColumn(key, F.col("doc_id"))
    whole = F.struct("*").alias("whole")  # no column of the rows can clash
    tied = rows.select(whole, "doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"), F.lit(0).alias("all"))
    placed = ranked(saved(tied, "tied"), "all", ["doc_id", "hash", "tie"])
    return saved(placed.select("whole.*", F.col("at").alias(key)), "numbered")


def texts(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """``[key, text]`` alone, null texts as empty ones; other columns can't clash."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(F.col(key), F.coalesce(F.col(column), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII texts take the byte-wise way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however many expressions use it:
    those in lambdas and conditions would else each compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def bitmap_of(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """``[part, bits]``: a bitmap with the bits set that the low ``bits`` bits of the keys name, in rows
    of 4 KB: 2^(bits - 3) bytes in all, whatever the input."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    return (
        keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )


def in_bitmap(rows: DataFrame, column: str, bitmap: DataFrame, bits: int, inside: bool = True) -> DataFrame:
    """The rows whose key may be among the bitmap's keys, or those whose key is not. The rows stay
    in their tasks; the bitmap, of fixed size, goes to each."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    parts = bitmap.select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))
    marked = rows.withColumn("_part", F.bitmap_bucket_number(slot)).join(F.broadcast(parts), "_part", "left")
    return marked.where(is_set if inside else ~is_set).drop("_part", "_bits")
