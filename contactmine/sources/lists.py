"""Read reference lists from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactmine.operators.lists import list_entries, suffix_rules, wildcard_entries


def load_list(spark: SparkSession, path: str) -> DataFrame:
    """``[entry]``: lower-cased, without blanks and ``#`` comments."""
    return list_entries(spark.read.text(path))


def load_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """As ``load_list``, but a line that starts with ``#`` is an entry too."""
    return list_entries(spark.read.text(path), comment=None)


def load_wildcards(spark: SparkSession, path: str) -> DataFrame:
    """``[entry]`` with ``*`` wildcards, case kept."""
    return wildcard_entries(spark.read.text(path))


def load_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Public-suffix ``[rule]`` rows from a file in the public list's format."""
    return suffix_rules(spark.read.text(path))
