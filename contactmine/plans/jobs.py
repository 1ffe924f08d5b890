"""A whole run: file tree in, result tables out, repeatable.

The files of a run come from Structured Streaming's file source: its log, in the output folder,
knows which files earlier runs have read, so that a run lists the tree, reads what is new, and
stops.  Text files are streamed by line and split over tasks, files that need a reader one by one.
Every micro-batch writes all its outputs and then one commit (``sinks.commits``): a run that
dies is simply run again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmine.functions.text import normalize_extension
from contactmine.operators.domains import with_domains
from contactmine.operators.extract import EMAIL, URL
from contactmine.operators.mapping import MAX_PER_ROW, url_map
from contactmine.operators.sightings import TABLE, current, expire, merge, sighted
from contactmine.operators.summary import count_by_reason, totals
from contactmine.operators.verdicts import KEPT
from contactmine.sinks.commits import Commits
from contactmine.sinks.tables import write_mapping_csv, write_mapping_json, write_sorted_values
from contactmine.sources.binary import TEXTS, FileReader, read_files
from contactmine.sources.files import include_exclude, numbered, stream_files, stream_text_lines
from contactmine.sources.ingest import DEFAULT_READERS, row_limit, with_reader, without_reader

Find = Callable[[DataFrame], DataFrame]

# Files of one micro-batch of a source.
PASS_FILES = 20_000

LEDGER, BAD = "path string", "source_id string, error string"


def _save(kind: str):
    return lambda writer, path: getattr(writer, kind)(path)


_FORMATS = {
    "emails": _save("text"), "urls": _save("text"), "provenance": _save("csv"), "ledger": _save("parquet"),
    "bad_sources": _save("parquet"), "arrivals": _save("parquet"),
}


class _Run:
    """One run over ``root`` into ``out``."""

    def __init__(self, spark: SparkSession, root: str, out: str, find: Find, include, exclude):
        self.spark, self.root, self.out, self.find = spark, root, out.rstrip("/"), find
        self.include, self.exclude = include, exclude
        self.commits, self.found = Commits(spark, out), []
        choice = json.dumps([sorted(map(normalize_extension, x or ())) for x in (include, exclude)])
        self.choice = hashlib.sha256(choice.encode()).hexdigest()[:8]

    def chosen(self, files: DataFrame, path: str) -> DataFrame:
        return include_exclude(files, self.include, self.exclude, path)

    def drain(self, name: str, rows: DataFrame, write: Callable[[DataFrame, str], None]) -> None:
        """Hand what is new in a stream to ``write``, by micro-batches named after the stream."""
        name = f"{name}-{self.choice}"

        def batch(found: DataFrame, number: int) -> None:
            if (one := f"{name}-{number:06d}") not in self.commits:
                write(found, one)

        writer = rows.writeStream.option("checkpointLocation", f"{self.out}/streams/{name}").trigger(availableNow=True)
        query = writer.foreachBatch(batch).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    def finish(self, batch: str, frames: dict[str, DataFrame], buckets: list[int] | None = None) -> None:
        self.commits.write(batch, {t: _FORMATS[t] for t in frames}, frames)
        self.commits.commit(batch, [*frames, *([TABLE] if buckets else [])], buckets)

    def results(self, texts: DataFrame, batch: str) -> tuple[dict[str, DataFrame], list[int]]:
        """What the texts hold that no earlier batch wrote, by table; the sightings are written."""
        kept_at = f"{self.out}/candidates/batch={batch}"
        self.find(texts).write.mode("overwrite").parquet(kept_at)
        found = self.spark.read.parquet(kept_at)
        self.found.append(kept_at)
        fresh, buckets = merge(self.commits, batch, sighted(found))
        new_at = f"{self.out}/new_values/batch={batch}"  # three tables come from it
        fresh.filter(F.col("reason") == KEPT).select("kind", "value", "source_id").write.mode("overwrite").parquet(new_at)
        fresh = self.spark.read.parquet(new_at)
        frames = {
            "emails": fresh.filter(F.col("kind") == EMAIL).select("value"),
            "urls": fresh.filter(F.col("kind") == URL).select("value"),
        }
        if "source_id" in found.columns:
            frames["provenance"] = fresh.select("value", "source_id")
        return frames, buckets

    def arrived(self, files: DataFrame, batch: str) -> None:
        self.finish(batch, {"arrivals": files})

    def lines(self, lines: DataFrame, batch: str) -> None:
        self.finish(batch, *self.results(numbered(lines), batch))

    def opened(self, files: DataFrame, batch: str, readers: Mapping[str, FileReader], max_depth: int | None) -> None:
        """Read each file once; its texts are a table that all outputs are made from."""
        kept_at = f"{self.out}/binary_texts/batch={batch}"
        read_files(files, readers, max_depth, mark=True).write.mode("overwrite").parquet(kept_at)
        texts = self.spark.read.schema(TEXTS).parquet(kept_at)
        readable = texts.filter(F.col("text").isNotNull()).select("source_id", "text")
        frames, buckets = self.results(readable, batch)
        is_file = F.col("text").isNull() & F.col("error").isNull()
        frames["ledger"] = texts.filter(is_file).select(F.col("source_id").alias("path"))
        frames["bad_sources"] = texts.filter(F.col("error").isNotNull()).select("source_id", "error")
        self.finish(batch, frames, buckets)

    def settle(self, opened: list[str], closed: list[str]) -> None:
        """Enter the files that arrived: read ones into the ledger, unread ones into ``bad_sources``.

        Comes after all streams, so that a file is in the ledger only when its values are written."""
        arrivals = self.commits.read("arrivals", self.spark.read.parquet, "path string, ext string, length bigint")
        limit = row_limit(self.spark)
        for name in self.commits.with_table("arrivals"):
            if (batch := f"settled-{name}") in self.commits:
                continue
            files = arrivals.filter(F.col("batch") == name)
            is_opened, large = F.col("ext").isin(opened), F.col("length") > limit
            error = F.when(is_opened, F.concat(F.lit("file of "), F.col("length").cast("string"), F.lit(" bytes is too large")))
            unread = files.filter(F.col("ext").isin(closed) | (is_opened & large))
            read = files.filter(~F.col("ext").isin(opened + closed))
            self.finish(batch, {
                "ledger": read.select("path"),
                "bad_sources": unread.select(
                    F.col("path").alias("source_id"), F.coalesce(error, F.concat(F.lit("no reader for "), "ext")).alias("error")
                ),
            })


def run(
    spark: SparkSession,
    root: str,
    out: str,
    find: Find,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    readers: Mapping[str, FileReader] | None = None,
    max_depth: int | None = None,
    encoding: str = "UTF-8",
) -> None:
    """Extract ``root`` with ``find`` and add the results to the folder ``out``.

    ``find`` takes ``[source_id, text]``, of text files with ``place``, to ``[kind, value]`` with an optional
    ``reason`` (only ``kept`` values are written, all are counted), an optional ``source_id`` and an
    optional ``key`` (of the links, their host: one link per host is written over all runs):
    one of ``plans.variants`` with its lists filled in.  Under ``out``, by batch: ``emails`` and
    ``urls`` (text) and ``provenance`` (CSV, with ``source_id``) of values no earlier batch wrote,
    ``candidates`` (parquet, all that ``find`` gave), ``new_values``, ``binary_texts``, ``bad_sources``, ``ledger`` and
    ``sightings`` (parquet, see ``operators.sightings``); and ``summary`` (JSON, with ``reason``), this
    run's counts.  ``commits`` says which batches count: no table holds a line twice, whenever a run was killed.

    Only one run at a time may write to ``out``.  Files of a kind without reader are reported once; a later
    run that has a reader reads them.  Another ``include`` or ``exclude`` is another stream: it reads what
    it chooses from the start, and only values that are new are written.
    """
    job = _Run(spark, root, out, find, include, exclude)
    expire(job.commits)
    own = {normalize_extension(e): reader for e, reader in (readers or {}).items()}
    opened, closed = with_reader(own), without_reader(own)
    place = job.chosen(stream_files(spark, root, PASS_FILES), "path")
    job.drain("arrivals", place.select("path", "ext", "length"), job.arrived)
    job.drain("lines", stream_text_lines(
        spark, root, PASS_FILES, encoding,
        lambda files: job.chosen(files, "source_id").filter(~F.col("ext").isin(opened + closed)),
    ).select("source_id", "block", "text"), job.lines)
    # a caller's reader has a stream of its own, so that it also reads what came before it was given
    every, limit = {**DEFAULT_READERS, **own}, row_limit(spark)
    for name, kinds in {"files": [e for e in opened if e not in own], **{f"files{e}": [e] for e in own}}.items():
        files = place.filter(F.col("ext").isin(kinds) & (F.col("length") <= limit)).select("path", "content")
        job.drain(name, files, partial(job.opened, readers=every, max_depth=max_depth))
    job.settle(opened, closed)
    if job.found:
        found = spark.read.option("mergeSchema", True).parquet(*job.found)
        if "reason" in found.columns:
            name = "key" if "key" in found.columns else "value"
            count_by_reason(found.dropDuplicates(["kind", name])).write.mode("overwrite").json(f"{out}/summary")


def export(
    spark: SparkSession, out: str, rules: list[str] | DataFrame, mode: str = "root", max_per_row: int = MAX_PER_ROW
) -> None:
    """Write what all runs into ``out`` have found, for readers of plain files.

    ``sorted_emails`` and ``sorted_urls`` (text), ``totals`` and ``totals_by_reason`` (JSON), and the links by
    ``mode`` (``root`` or ``subdomain``) as ``mapping_json`` and ``mapping_csv``; each replaces what was there."""
    seen = current(Commits(spark, out))
    kept = seen.filter(F.col("reason") == KEPT)
    links = kept.filter(F.col("kind") == URL).select("kind", "value")
    write_sorted_values(kept.filter(F.col("kind") == EMAIL), f"{out}/sorted_emails")
    write_sorted_values(links, f"{out}/sorted_urls")
    totals(seen).write.mode("overwrite").json(f"{out}/totals")
    count_by_reason(seen).write.mode("overwrite").json(f"{out}/totals_by_reason")
    grouped = url_map(with_domains(links, rules), mode, max_per_row)
    write_mapping_json(grouped, f"{out}/mapping_json")
    write_mapping_csv(grouped, f"{out}/mapping_csv")
