"""First sightings over all runs: a table in hash buckets, merged by minimum.

Each key has the row of its smallest source, whichever run brought it, so any order of runs
gives the same table.  A batch reads and writes anew only the buckets that its keys fall into.
A bucket's current rows are those of the last committed batch that wrote it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.operators.verdicts import KEPT
from contactmine.sinks.commits import Commits

BUCKETS = 256
TABLE = "sightings"
ROW = "kind string, key string, source_id string, value string, reason string, bucket int"


def sighted(candidates: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``[kind, key, source_id, value, reason, bucket]``: the first row of each key of a run's candidates."""
    given = candidates.columns
    value, none = F.col("value"), F.lit(None).cast("string")
    rows = candidates.select(
        "kind", F.coalesce("key", value).alias("key") if "key" in given else value.alias("key"),
        F.col("source_id") if "source_id" in given else none.alias("source_id"), "value",
        F.col("reason") if "reason" in given else F.lit(KEPT).alias("reason"),
    )
    bucket = F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int").alias("bucket")
    return first(rows.select("*", bucket))


def first(rows: DataFrame) -> DataFrame:
    """One row a key: the smallest by source and value."""
    least = F.min(F.struct("source_id", "value", "reason")).alias("_least")
    return rows.groupBy("kind", "key", "bucket").agg(least).select("kind", "key", "_least.*", "bucket")


def current(commits: Commits, buckets: list[int] | None = None) -> DataFrame:
    """The sightings in the given buckets, or in all."""
    last = {bucket: name for name in commits.with_table(TABLE) for bucket in commits.rows[name].buckets}
    wanted = sorted(last) if buckets is None else [b for b in buckets if b in last]
    paths = [f"{commits.path(TABLE, last[b])}/bucket={b}" for b in wanted]  # one for each bucket at most
    if not paths:
        return commits.spark.createDataFrame([], ROW)
    rows = commits.spark.read.schema(f"{ROW}, batch string").option("basePath", f"{commits.folder}/{TABLE}").parquet(*paths)
    return rows.drop("batch")


def merge(commits: Commits, batch: str, new: DataFrame) -> tuple[DataFrame, list[int]]:
    """Write the buckets that ``new`` falls into, with the earlier sightings, as a batch's part of the table.

    Returns the rows of ``new`` whose keys are seen for the first time, and the buckets written."""
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    earlier = current(commits, touched)
    if touched:
        merged = first(earlier.unionByName(new)).repartition(len(touched), "bucket")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(commits.path(TABLE, batch))
    return new.join(earlier, ["kind", "key"], "left_anti"), touched


def expire(commits: Commits) -> None:
    """Remove bucket folders that later batches have replaced, so that the table's size follows its keys.

    Only for folders that nobody reads meanwhile: a run expires what runs before it replaced."""
    jvm, conf = commits.spark._jvm, commits.spark._jsc.hadoopConfiguration()
    last = {bucket: name for name in commits.with_table(TABLE) for bucket in commits.rows[name].buckets}
    for name in commits.with_table(TABLE):
        for bucket in commits.rows[name].buckets:
            if last[bucket] != name:
                path = jvm.org.apache.hadoop.fs.Path(f"{commits.path(TABLE, name)}/bucket={bucket}")
                path.getFileSystem(conf).delete(path, True)
