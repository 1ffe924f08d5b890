"""Live totals of a stream of contacts: how many values of each kind were kept or dropped, and why.

Each value counts once, in the window of the event time in which it is first seen; verdicts that depend on
a list are joins with a snapshot of it, a static table.  State is bounded by the watermark: of first
sightings, and of windows that can still change.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactmine.fixed_values import FORBIDDEN_WORDS
from contactmine.functions import emails as E
from contactmine.functions import urls as U
from contactmine.operators.extract import EMAIL
from contactmine.operators.verdicts import KEPT
from contactmine.streaming.contacts import first_seen


def snapshot_verdicts(
    contacts: DataFrame, disposable: DataFrame, blocked_hosts: DataFrame, words: Sequence[str] = FORBIDDEN_WORDS
) -> DataFrame:
    """Add ``reason`` to a stream of cleaned addresses and links, by lists ``[entry]`` as they are now.

    Addresses: file names, numeric hosts, forbidden words, disposable domains.  Links: no valid host, a
    host listed.  A value is looked up once: both lists are one table."""
    value, address = F.col("value"), F.col("kind") == EMAIL
    domain = E.bare_domain(E.email_domain(value))
    lookup = F.when(address, F.concat(F.lit("d:"), domain)).otherwise(F.concat(F.lit("h:"), U.link_host(value)))
    entry = F.col("entry")
    listed = disposable.select(F.concat(F.lit("d:"), entry).alias("_entry")).unionByName(
        blocked_hosts.select(F.concat(F.lit("h:"), entry).alias("_entry"))
    )
    listed = listed.filter(F.col("_entry").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    joined = contacts.withColumn("_key", lookup).join(listed, F.col("_key") == F.col("_entry"), "left")
    hit = F.coalesce("_hit", F.lit(False))
    of_address = (
        F.when(~F.contains(value, F.lit("@")), "no_at").when(E.looks_like_file(value), "file_ext")
        .when(E.digit_after_at(value), "digit").when(E.has_forbidden_word(value, words), "forbidden")
        .when(hit, "disposable").otherwise(KEPT)
    )
    of_link = F.when(~U.is_valid_url(value), "invalid").when(hit, "blocked_host").otherwise(KEPT)
    return joined.withColumn("reason", F.when(address, of_address).otherwise(of_link)).drop("_key", "_entry", "_hit")


def totals_by_reason(verdicts: DataFrame, event_time: str, delay: str, window: str) -> DataFrame:
    """``[window, kind, reason, n_values]``: distinct values by the window of their first sighting.

    Rows later than ``delay`` behind the latest event don't count; a value that comes back after
    more than ``delay`` counts again."""
    first = first_seen(verdicts, ["kind", "value"], event_time, delay)
    return first.groupBy(F.window(event_time, window), "kind", "reason").agg(F.count(F.lit(1)).alias("n_values"))


def start(
    totals: DataFrame,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    name: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand the totals that a batch changed to ``on_batch``, or keep them in memory as the table ``name``."""
    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return (writer.foreachBatch(on_batch) if on_batch else writer.format("memory")).start()
