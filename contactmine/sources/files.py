"""File trees as ``[path, …]`` rows and as ``[source_id, text]`` corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from contactmine.fixed_values import COMPATIBLE_EXTENSIONS
from contactmine.functions.text import (
    decode_ignoring_errors,
    file_extension,
    normalize_extension,
)

_WORK_FOLDER = "_temp_extract"


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``[path, modificationTime, length, content, ext]`` of every file below ``root``.

    ``path`` and ``ext`` come from file metadata: filters on them choose files before
    any is opened, and ``content`` is read only by plans that use it.  ``glob`` prunes
    while listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return located(reader.load(root), "path").select(
        "path", "modificationTime", "length", "content", "ext"
    )


def stream_files(spark: SparkSession, root: str, per_batch: int) -> DataFrame:
    """``scan_files`` as a stream: each file once over the life of a checkpoint, at most ``per_batch`` in a micro-batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = _stream_reader(spark, per_batch).format("binaryFile").schema(schema)
    return located(reader.load(root), "path").select("path", "modificationTime", "length", "content", "ext")


def _stream_reader(spark: SparkSession, per_batch: int) -> DataStreamReader:
    # files count as new whatever their age: the log goes by path
    options = {"recursiveFileLookup": True, "maxFilesPerTrigger": per_batch, "maxFileAge": "36500d"}
    return spark.readStream.options(**options)


def located(files: DataFrame, name: str) -> DataFrame:
    """Add the file's URI as ``name`` and its extension as ``ext``; skip work folders."""
    path = F.col("_metadata.file_path")
    return files.filter(~F.contains(path, F.lit(_WORK_FOLDER))).withColumns(
        {name: path, "ext": file_extension(path)}
    )


def compatible(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with an extension that can be read."""
    return files.filter(file_extension(F.col(path)).isin(COMPATIBLE_EXTENSIONS))


def include_exclude(
    files: DataFrame,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    path: str = "path",
) -> DataFrame:
    """Keep the included extensions, then drop the excluded; dots and case do not matter."""
    ext = file_extension(F.col(path))
    if include:
        files = files.filter(ext.isin([normalize_extension(e) for e in include]))
    if exclude:
        files = files.filter(~ext.isin([normalize_extension(e) for e in exclude]))
    return files


def text_corpus(files: DataFrame) -> DataFrame:
    """``[source_id, text]`` of scanned files, one row per file, undecodable bytes left out."""
    return files.select(
        F.col("path").alias("source_id"), decode_ignoring_errors(F.col("content")).alias("text")
    )


def read_text_lines(
    spark: SparkSession,
    root: str,
    encoding: str = "UTF-8",
    choose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``[source_id, place, text, ext]``, one row per line, ``place`` rising along a file.

    No built-in finder matches across a line end, so the distinct values per file are
    those of the whole text, while a file of any size is split over many tasks.
    ``choose`` filters files by ``source_id`` and ``ext`` before any is opened; a filter on
    the result would come after the lines have been numbered, with all files read.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    return numbered(_lines(reader, root, encoding, choose))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``place``, that rises along a file, instead of the block they are in: not for streams, but for their batches."""
    place = F.struct(F.col("block").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return lines.select("source_id", place.alias("place"), *(c for c in lines.columns if c not in ("source_id", "block")))


def stream_text_lines(
    spark: SparkSession,
    root: str,
    per_batch: int,
    encoding: str = "UTF-8",
    choose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``[source_id, block, text, ext]``: ``read_text_lines`` as a stream, see ``stream_files``; for ``numbered``."""
    return _lines(_stream_reader(spark, per_batch), root, encoding, choose)


def _lines(reader: DataFrameReader | DataStreamReader, root: str, encoding: str, choose: Callable | None) -> DataFrame:
    if encoding.upper() != "UTF-8":
        reader = reader.option("encoding", encoding)
    lines = located(reader.text(root), "source_id").withColumn("block", F.col("_metadata.file_block_start"))
    if choose is not None:
        lines = choose(lines)
    return lines.select("source_id", "block", decode_ignoring_errors(F.col("value")).alias("text"), "ext")


def read_whole_texts(spark: SparkSession, root: str) -> DataFrame:
    """``[source_id, text, ext]``, one row per file, for patterns that span lines."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return located(files, "source_id").select(
        "source_id", decode_ignoring_errors(F.col("value")).alias("text"), "ext"
    )


def corpus_from_column(df: DataFrame, key: str, column: str, prefix: str) -> DataFrame:
    """``[source_id, text]`` from one text column of a table."""
    return df.select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("source_id"),
        F.col(column).alias("text"),
    )
