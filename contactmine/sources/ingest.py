"""Any file tree → ``[source_id, text, error]``: each extension has its reader."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmine.fixed_values import (
    ARCHIVE_EXTENSIONS,
    COMPATIBLE_EXTENSIONS,
    OFFICE_EXTENSIONS,
    TEXT_EXTENSIONS,
)
from contactmine.sources.binary import (
    TEXTS,
    FileReader,
    read_files,
    read_message,
    read_office,
)
from contactmine.sources.files import include_exclude, read_text_lines, scan_files
from contactmine.sources.tables import csv_cells

DEFAULT_READERS: dict[str, FileReader] = {
    ".eml": read_message, **dict.fromkeys(OFFICE_EXTENSIONS, read_office)
}


def with_reader(readers: Mapping[str, FileReader] | None = None) -> list[str]:
    """The extensions of files that are opened whole, by a reader or as archives."""
    return [*{**DEFAULT_READERS, **(readers or {})}, *ARCHIVE_EXTENSIONS]


def without_reader(readers: Mapping[str, FileReader] | None = None) -> list[str]:
    """The known binary extensions that ``ingest`` reports as unread with these readers."""
    read = {*with_reader(readers), *TEXT_EXTENSIONS, ".csv"}
    return [e for e in COMPATIBLE_EXTENSIONS if e not in read]


def ingest(
    spark: SparkSession,
    root: str,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    readers: Mapping[str, FileReader] | None = None,
    max_depth: int | None = None,
    encoding: str = "UTF-8",
    paths: Sequence[str] | None = None,
    keep_in: str | None = None,
) -> DataFrame:
    """Text files line by line, CSV files cell by cell, messages, office files and archives whole.

    ``readers`` adds ``bytes → str`` readers by extension or replaces the built-in ones.
    A known binary extension without a reader gives a row with ``error``; any other
    unknown extension is read as text.  The branches read disjoint sets of files:
    their extension tests prune the listing, before any file is opened, as does ``paths``,
    the files to read.  Lines have a ``place`` in their file.  Binary files above what a row
    holds give a row with ``error``.  With ``keep_in`` the texts of binary files are written
    there and read back, so that each is opened once, however often the result is used.
    """
    chosen = {**DEFAULT_READERS, **(readers or {})}
    opened = with_reader(readers)
    closed = without_reader(readers)
    none = F.lit(None).cast("string")

    def wanted(listed: DataFrame, path: str) -> DataFrame:
        if paths is not None:
            listed = listed.filter(F.col(path).isin(list(paths)))
        return include_exclude(listed, include, exclude, path)

    files = wanted(scan_files(spark, root), "path")
    is_opened, fits = F.col("ext").isin(opened), F.col("length") <= row_limit(spark)
    binary = read_files(files.filter(is_opened & fits), chosen, max_depth)
    if keep_in is not None:
        binary.write.mode("overwrite").parquet(keep_in)
        binary = spark.read.schema(TEXTS).parquet(keep_in)
    no_reader = F.concat(F.lit("no reader for "), "ext")
    too_large = F.concat(F.lit("file of "), F.col("length").cast("string"), F.lit(" bytes is too large"))
    unread = files.filter(F.col("ext").isin(closed) | (is_opened & ~fits)).select(
        F.col("path").alias("source_id"), none.alias("text"),
        F.when(is_opened, too_large).otherwise(no_reader).alias("error"),
    )
    lines = read_text_lines(
        spark, root, encoding,
        lambda listed: wanted(listed, "source_id").filter(~F.col("ext").isin([*opened, *closed, ".csv"])),
    ).select("source_id", "place", "text", none.alias("error"))
    if ".csv" not in opened:
        cells = csv_cells(
            spark, root, True, lambda listed: wanted(listed, "source_id").filter(F.col("ext") == ".csv")
        )
        lines = lines.unionByName(cells.select("source_id", "place", "text", none.alias("error")))
    return lines.unionByName(binary, allowMissingColumns=True).unionByName(unread, allowMissingColumns=True)


def row_limit(spark: SparkSession) -> int:
    """Bytes of the largest file that a row can hold."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
