"""Write results.  Every sink writes from all tasks; none gathers rows in one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.fixed_values import MAPPING_CSV_HEADER
from contactmine.operators.mapping import mapping_csv_rows


def write_values(
    values: DataFrame, path: str, mode: str = "append", header: str | None = None
) -> None:
    """One value per line; with ``header`` a CSV whose single column has that name."""
    if header:
        values.select(F.col("value").alias(header)).write.mode(mode).csv(path, header=True)
    else:
        values.select("value").write.mode(mode).text(path)


def write_sorted_values(values: DataFrame, path: str) -> None:
    """Replace ``path`` by the values in code-point order.

    The order runs on from one part file to the next: reading them by name gives the
    sorted whole.
    """
    values.select("value").orderBy("value").write.mode("overwrite").text(path)


def write_provenance(first: DataFrame, path: str, mode: str = "append") -> None:
    """``value,source`` lines without a header."""
    first.select("value", "source_id").write.mode(mode).csv(path, header=False)


def write_mapping_json(url_map: DataFrame, path: str) -> None:
    """One ``{"key": …, "part": …, "urls": […]}`` object per line."""
    url_map.select("key", "part", "urls").write.mode("overwrite").json(path)


def write_mapping_csv(url_map: DataFrame, path: str) -> None:
    """``Domain/Subdomain,URLs,part`` with the URLs joined by ``"; "``; a key with very many has several parts."""
    rows = mapping_csv_rows(url_map).select("key", "urls", "part").toDF(*MAPPING_CSV_HEADER, "part")
    rows.write.mode("overwrite").csv(path, header=True)


def append_ledger(files: DataFrame, path: str, key: str = "path") -> None:
    """Add the processed inputs to the ledger table."""
    files.select(key).write.mode("append").parquet(path)


def bad_sources(texts: DataFrame) -> DataFrame:
    """``[source_id, error]`` of the inputs that could not be read."""
    return texts.filter(F.col("error").isNotNull()).select("source_id", "error")


def write_bad_sources(texts: DataFrame, path: str) -> None:
    bad_sources(texts).write.mode("append").parquet(path)
