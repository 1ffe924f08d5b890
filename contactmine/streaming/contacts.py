"""Contacts from a stream of texts: each value written once, as soon as it is seen.

The checkpoint folder holds what the stream has read, written and seen; a restart
with the same folder goes on where the last run stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactmine.functions.urls import host_to_slash
from contactmine.operators.extract import EMAIL


def _combine(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = table.append_column("_row", pa.array(range(len(table)), pa.int64()))
            first = rows.group_by(keys, use_threads=False).aggregate([("_row", "min")])["_row_min"]
            yield from table.take(first.combine_chunks().sort()).to_batches()

    return run


def first_seen(
    contacts: DataFrame,
    keys: list[str],
    event_time: str | None = None,
    delay: str | None = None,
    combine: bool = True,
) -> DataFrame:
    """The first row of each key over the life of the stream.

    With ``event_time`` and ``delay`` keys are forgotten ``delay`` after their last
    sighting, which bounds the state: a later copy comes out again.  ``combine`` drops the copies
    within each Arrow batch before the shuffle, so a key that makes up much of the
    stream does not flood the one task that owns it.
    """
    if combine:
        contacts = contacts.mapInArrow(_combine(keys), contacts.schema)
    if event_time and delay:
        return contacts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return contacts.dropDuplicates(keys)


def by_host(contacts: DataFrame) -> DataFrame:
    """Add ``key``: the address, or the link's host."""
    value = F.col("value")
    return contacts.withColumn(
        "key", F.when(F.col("kind") == EMAIL, value).otherwise(host_to_slash(value))
    )


def start(
    contacts: DataFrame,
    checkpoint: str,
    output: str | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Append to parquet files under ``output``, or hand each batch to ``on_batch``.

    Files are written exactly once.  ``on_batch`` may see a batch again after a
    failure, under the same batch number.  The number of contacts per batch is
    observed as ``contacts``.
    """
    observed = contacts.observe(
        "contacts",
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.col("kind") == EMAIL).alias("n_emails"),
    )
    writer = observed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if on_batch is not None:
        return writer.foreachBatch(on_batch).start()
    return writer.format("parquet").option("path", output).start()
