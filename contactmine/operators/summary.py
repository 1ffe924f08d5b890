"""Counts about a run.

Values are made distinct first (map-side combined, then hashed on the value), and
counted after that: no ``count distinct`` ever expands the raw contacts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.fixed_values import COMPATIBLE_EXTENSIONS
from contactmine.functions.text import file_extension
from contactmine.operators.dedup import distinct_values, first_source
from contactmine.operators.extract import EMAIL, URL, Finder, extract_contacts
from contactmine.operators.mapping import MAX_PER_ROW, collect_by_key
from contactmine.operators.verdicts import KEPT


def count_by_reason(values: DataFrame) -> DataFrame:
    """Distinct values per ``[kind, reason]``; input is distinct values with a verdict."""
    return values.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n_values"))


def totals(values: DataFrame) -> DataFrame:
    """Candidates and survivors per kind; input is distinct values with a verdict."""
    return values.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_found"),
        F.count_if(F.col("reason") == KEPT).alias("n_kept"),
    )


def sources_with_hits(contacts: DataFrame) -> DataFrame:
    """Number of sources showing any contact."""
    return contacts.select("source_id").distinct().agg(F.count(F.lit(1)).alias("n_sources"))


def sources_with_new_hits(contacts: DataFrame) -> DataFrame:
    """Number of sources that show some value first."""
    return sources_with_hits(first_source(contacts))


def file_counts(files: DataFrame) -> DataFrame:
    """All files, and those with an extension that can be read."""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(file_extension(F.col("path")).isin(COMPATIBLE_EXTENSIONS)).alias("n_compatible"),
    )


def hits_per_source(contacts: DataFrame, max_per_row: int = MAX_PER_ROW) -> DataFrame:
    """``[source_id, kind, part, values]``: what each source holds."""
    return collect_by_key(contacts, ["source_id", "kind"], "value", "values", max_per_row)


def as_metrics(row: DataFrame, names: list[str]) -> DataFrame:
    """One row of counters as ``[metric, value]`` rows."""
    pairs: list[Column] = []
    for name in names:
        pairs += [F.lit(name), F.col(name).cast("bigint")]
    return row.select(F.stack(F.lit(len(names)), *pairs).alias("metric", "value"))


def run_metrics(corpus: DataFrame, *finders: Finder) -> DataFrame:
    """``[metric, value]``: texts read, distinct addresses and links found.

    The texts are counted without reading any of their columns.
    """
    texts = corpus.agg(F.count(F.lit(1)).alias("texts"))
    found = distinct_values(extract_contacts(corpus, *finders)).agg(
        F.count_if(F.col("kind") == EMAIL).alias("emails"),
        F.count_if(F.col("kind") == URL).alias("urls"),
    )
    return as_metrics(texts, ["texts"]).unionByName(as_metrics(found, ["emails", "urls"]))
