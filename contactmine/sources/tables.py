"""CSV files of any size as cells, also where quoted cells hold line ends.

Files are read by line and split over tasks. Whether a line starts inside a quoted cell depends on
all lines before it, but each line says what it makes of either state: it ends outside or inside
whatever came before, or it keeps the state, or it turns it. Such functions compose, so every block of
a file is summed up by itself, the blocks' start states follow from their sums, a row for each,
and the lines of a block from its start state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactmine.functions.text import decode_ignoring_errors
from contactmine.sources.files import located

# One whole cell, quoted or not, and the start of a quoted one that doesn't end.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|(?=,|$))'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+$'
_OPENS = rf"(?s)^(?:{_CELL},)*+{_OPEN}"
_CLOSES = r'(?s)^[^"]*+(?:""[^"]*+)*+"(?!")'


def _state(kind: Column, turned: Column, order: Window, before: Column) -> Column:
    """Whether the rows before the current one leave a quoted cell open: after the last row that
    decides by itself (``kind`` is not null), as often turned as rows turn it; ``before`` is what holds at the start."""
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(turned.cast("int")).over(earlier), F.lit(0))
    upto = F.sum(turned.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), upto.alias("turns"))), ignorenulls=True).over(earlier)
    since = (turns - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    return F.coalesce(last["kind"], before) != since


def csv_records(lines: DataFrame) -> DataFrame:
    """``[source_id, place, record]`` from ``[source_id, block, line, text]``: lines joined where a quoted cell goes on.

    A record has to fit a row. A quote that is never closed makes the rest of its file one record."""
    text = F.col("text")
    opens = text.rlike(_OPENS)
    rest = F.regexp_replace(text, rf"{_CLOSES}[^,]*+,?", "")
    closes = text.rlike(_CLOSES)
    inside = F.when(closes, rest.rlike(_OPENS)).otherwise(F.lit(True))
    marked = lines.select(
        "source_id", "block", "line", "text",
        F.when(opens == inside, opens).alias("kind"), (opens & ~inside).alias("turned"),
    )
    # a block decides by itself if one of its lines does
    turns_after = F.max_by(F.struct("kind", "line"), F.when(F.col("kind").isNotNull(), F.col("line")))
    blocks = marked.groupBy("source_id", "block").agg(turns_after.alias("last"), F.sum(F.col("turned").cast("int")).alias("turns"))
    joined = marked.join(blocks.select("source_id", "block", F.col("last.line").alias("last_line")), ["source_id", "block"])
    after = joined.filter(F.col("last_line").isNull() | (F.col("line") > F.col("last_line")))
    since = after.groupBy("source_id", "block").agg(F.sum(F.col("turned").cast("int")).alias("since"))
    blocks = blocks.join(since, ["source_id", "block"], "left").withColumn("odd", F.coalesce("since", F.lit(0)) % 2 == 1)
    blocks = blocks.withColumns({
        "kind": F.when(F.col("last.kind").isNotNull(), F.col("last.kind") != F.col("odd")),
        "turned": F.col("last.kind").isNull() & F.col("odd"),
    })
    in_file = Window.partitionBy("source_id").orderBy("block")  # a row for each block
    starts = blocks.select("source_id", "block", _state(F.col("kind"), F.col("turned"), in_file, F.lit(False)).alias("before"))
    in_block = Window.partitionBy("source_id", "block").orderBy("line")
    stated = marked.join(starts, ["source_id", "block"]).withColumn(
        "goes_on", _state(F.col("kind"), F.col("turned"), in_block, F.col("before"))
    )
    # a line belongs to the last one that starts a record: in its block, or in an earlier one
    place = F.struct("block", "line")
    first = F.last(F.when(~F.col("goes_on"), place), ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stated = stated.withColumn("first", first)
    ends = stated.groupBy("source_id", "block").agg(F.max(F.when(~F.col("goes_on"), place)).alias("last_first"))
    earlier = F.last("last_first", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("source_id", "block", earlier.alias("earlier"))
    placed = stated.join(ends, ["source_id", "block"]).withColumn("place", F.coalesce("first", "earlier"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "text")))
    return placed.groupBy("source_id", "place").agg(
        F.array_join(F.transform(parts, lambda part: part["text"]), "\n").alias("record")
    )


def csv_lines(spark: SparkSession, root: str, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``[source_id, block, line, text]`` of CSV files, ``line`` rising along a block."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    lines = located(reader.text(root), "source_id").withColumn("block", F.col("_metadata.file_block_start"))
    if choose is not None:
        lines = choose(lines)
    return lines.select(
        "source_id", "block", F.monotonically_increasing_id().alias("line"), decode_ignoring_errors(F.col("value")).alias("text")
    )


def cells_of(record: Column) -> Column:
    """The cells of a record, of any number: raw strings, quotes and the line's end taken off."""
    every = F.concat(F.lit(","), F.regexp_replace(record, r"\r$", ""))  # so that each cell follows a comma
    raw = F.regexp_extract_all(every, F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'), F.lit(1))
    quoted = lambda cell: F.replace(F.regexp_extract(cell, r'(?s)^"(.*)"\s*$', 1), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda cell: F.when(cell.startswith('"'), quoted(cell)).otherwise(F.rtrim(cell)))


def csv_cells(
    spark: SparkSession, root: str, multi_line: bool = False, choose: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``[source_id, place, column, text]`` of all cells of CSV files, header cells included.

    Rows may differ in width. Cells stay raw strings, empty ones are left out. ``multi_line`` is needed
    where quoted cells hold line ends; either way a file of any size is read by many tasks. ``choose``
    filters files by ``source_id`` and ``ext`` before any is opened."""
    lines = csv_lines(spark, root, choose)
    if multi_line:
        records = csv_records(lines)
    else:
        records = lines.select("source_id", F.struct("block", "line").alias("place"), F.col("text").alias("record"))
    place = F.struct(F.col("place.block").alias("_block"), F.col("place.line").alias("_line")).alias("place")
    cells = records.select("source_id", place, F.posexplode(cells_of(F.col("record"))).alias("_at", "text"))
    return cells.select("source_id", "place", F.concat(F.lit("c"), F.col("_at").cast("string")).alias("column"), "text").filter(
        F.col("text") != ""
    )
