"""Reference lists as ``[entry]`` rows: disposable domains, blocklists, suffix rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.functions.text import strip
from contactmine.operators.matching import Entries


def _entries(lines: DataFrame, entry: Column, comment: str | None) -> DataFrame:
    out = lines.select(entry.alias("entry")).filter(F.col("entry") != "")
    if comment:
        out = out.filter(~F.startswith("entry", F.lit(comment)))
    return out.distinct()


def list_entries(lines: DataFrame, column: str = "value", comment: str | None = "#") -> DataFrame:
    """Stripped, lower-cased entries without blanks and comment lines."""
    return _entries(lines, F.lower(strip(F.col(column))), comment)


def wildcard_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped entries without blanks and comments; case is kept, matching ignores it."""
    return _entries(lines, strip(F.col(column)), "#")


def normalize_entry(entry: Column) -> Column:
    """Lower-cased, stripped, without leading ``*`` and ``.``."""
    return F.ltrim(F.lower(strip(entry)), F.lit("*."))


def substring_entries(entries: Entries) -> Entries:
    """Blocklist entries in the form the substring test looks for."""
    if isinstance(entries, DataFrame):
        return _entries(entries, normalize_entry(F.col("entry")), "#")
    plain = {e.lower().strip().lstrip("*.") for e in entries}
    return sorted(e for e in plain if e and not e.startswith("#"))


def unsearchable_entries(entries: Entries) -> Entries:
    """The entries ``substring_entries`` leaves out: nothing to search for, like ``*.``.

    Any other entry that equals a host is also found in it.
    """
    if isinstance(entries, DataFrame):
        plain = normalize_entry(F.col("entry"))
        return entries.select("entry").filter((plain == "") | F.startswith(plain, F.lit("#")))
    return [e for e in entries if not substring_entries([e])]


def suffix_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """Public-suffix rules ``[rule]``: first word of each line, ``//`` comments dropped."""
    rule = F.lower(F.element_at(F.split(strip(F.col(column)), r"\s+"), 1))
    return (
        lines.select(rule.alias("rule"))
        .filter((F.col("rule") != "") & ~F.startswith("rule", F.lit("//")))
        .distinct()
    )
