"""Exact de-duplication by an extendible-hash index, in DataFrame operations alone.

The index holds one entry per 64-bit key of the normalised texts. Its directory starts with
one slot; as long as a bucket holds more than ``capacity`` keys the directory doubles and the
overfull buckets split by the next bit of the key, the others keep their local depth. Bucket
by bucket, in key order, the entries lie in shared files, so that the tasks that write and read
them own ranges of keys. Keys that more than one row bears are chained: their texts meet under
the key and are compared byte by byte, so texts that merely collide stay apart.

Texts of keys that one row bears never leave their scan: a bitmap of fixed size, built from
the entries, lets only the others (and a few that share a bit with them) pass. Copies are
combined in each task before the shuffle, so a group of any size arrives as one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import ascii_lower, bitmap_of, in_bitmap, saved, texts

CAPACITY = 1 << 16
FILTER_BITS = 22
SPARE_BITS = 4


def _directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """``([cell, bucket, depth], bits)``: for each cell, that is the first ``bits`` bits of a
    key, the bucket it belongs to (its first cell) and the bucket's local depth.

    A few bits more than even keys need are counted; what is still overfull then stays one
    bucket with a longer chain."""
    bits = max(1, (max(1, keys.count()) // capacity).bit_length() + SPARE_BITS)
    cells = keys.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.count("*").alias("n"))
    closed = []
    for depth in range(bits + 1):
        cells = saved(cells, "cells")
        bucket = F.shiftleft(F.shiftrightunsigned("cell", bits - depth), bits - depth)
        sizes = cells.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("size"))
        sized = cells.withColumn("bucket", bucket).join(sizes, "bucket")
        fits = (F.col("size") <= capacity) | F.lit(depth == bits)
        closed.append(sized.where(fits).select("cell", "bucket", F.lit(depth).alias("depth")))
        cells = sized.where(~fits).select("cell", "n")
        if cells.isEmpty():
            break
    return saved(reduce(DataFrame.unionAll, closed), "directory"), bits


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``[bucket, depth, h, n]``: the key ``h`` of ``n`` rows, as files ordered by bucket and key."""
    keys = saved(rows.groupBy("h").agg(F.count("*").alias("n")), "keys")
    directory, bits = _directory(keys, capacity)
    placed = keys.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)).join(directory, "cell")
    return saved(
        placed.select("bucket", "depth", "h", "n").repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"),
        "index",
    )


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``[doc_id, keep_id, group_size, kept, text_sha256]`` for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z. Null texts count as empty and form
    one group. The row with the largest doc_id stays. Rows without doc_id stay only where no
    row of the group has one (keep_id is then null). Rows that repeat both doc_id and text are
    the same document: all are returned, counted, and share the verdict. An empty table gives an
    empty result; other columns are ignored."""
    normal = texts(docs).select("doc_id", ascii_lower(F.col("text")).alias("text"))
    rows = normal.select("doc_id", "text", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("text_sha256"))
    index = build_index(rows.select("h"), capacity)
    chains = (
        in_bitmap(rows, "h", bitmap_of(index.where("n > 1"), "h", filter_bits), filter_bits)
        .groupBy("h", "text")
        .agg(F.max("doc_id").alias("last_id"), F.count("*").alias("n"), F.first("text_sha256").alias("text_sha256"))
        .select("h", "text_sha256", "last_id", "n")
    )
    chains = saved(chains.where("n > 1"), "chains")
    # texts that were equal byte by byte have one digest: it names the chain's member
    found = rows.drop("text").join(chains, ["h", "text_sha256"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
