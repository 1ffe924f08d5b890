"""Why a contact is kept or dropped: each function adds a ``reason`` column.

The first test that fails names the reason; ``kept`` means none did.  The tests
depend on the value (or its host) alone, so they run on distinct values: a list
join is then as large as the number of distinct values, and with literal lists
Catalyst moves the test below the de-duplication, in front of the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.fixed_values import FORBIDDEN_LOCAL_WORDS, FORBIDDEN_WORDS
from contactmine.functions import emails as E
from contactmine.functions import urls as U
from contactmine.operators.extract import EMAIL, URL
from contactmine.operators.lists import substring_entries, unsearchable_entries
from contactmine.operators.matching import (
    Entries,
    flag_equal,
    flag_equal_each,
    flag_substring,
    flag_suffix,
    flag_wildcard,
)

KEPT = "kept"


def _strict_reason(value: Column, require_at: bool) -> Column:
    chain = F.when(F.lit(require_at) & ~F.contains(value, F.lit("@")), "no_at")
    return chain.when(E.looks_like_file(value), "file_ext").when(E.digit_after_at(value), "digit")


def _filtered_reason(
    value: Column, disposable: Column, words: Sequence[str], require_at: bool
) -> Column:
    return (
        _strict_reason(value, require_at)
        .when(E.has_forbidden_word(value, words), "forbidden")
        .when(disposable, "disposable")
        .otherwise(KEPT)
    )


def strict_verdicts(values: DataFrame, require_at: bool = True) -> DataFrame:
    """Cleaned addresses: file look-alikes and digits after the ``@``.

    Cleaning can eat the ``@`` (``_@x.com`` → ``x.com``); such values get ``no_at``
    unless ``require_at`` is off.
    """
    return values.withColumn("reason", _strict_reason(F.col("value"), require_at).otherwise(KEPT))


def _disposable_key(value: Column) -> Column:
    return E.bare_domain(E.email_domain(value))


def filtered_verdicts(
    values: DataFrame,
    disposable: Entries,
    words: Sequence[str] = FORBIDDEN_WORDS,
    require_at: bool = True,
) -> DataFrame:
    """As ``strict_verdicts``, then forbidden words, then disposable domains."""
    value = F.col("value")
    flagged = flag_equal(values, _disposable_key(value), disposable, "_disposable")
    reason = _filtered_reason(value, F.col("_disposable"), words, require_at)
    return flagged.withColumn("reason", reason).drop("_disposable")


def classify_emails(
    values: DataFrame, disposable: Entries, words: Sequence[str] = FORBIDDEN_WORDS
) -> DataFrame:
    """Add ``category``: forbidden, disposable or valid, first match wins."""
    value = F.col("value")
    flagged = flag_equal(values, _disposable_key(value), disposable, "_disposable")
    return flagged.withColumn(
        "category",
        F.when(E.has_forbidden_word(value, words), "forbidden")
        .when(F.col("_disposable"), "disposable")
        .otherwise("valid"),
    ).drop("_disposable")


def _part_key(value: Column, legacy_www: bool) -> Column:
    """What the substring test looks at."""
    return U.strip_www_chars(F.lower(U.netloc(value))) if legacy_www else U.link_host(value)


def _link_reason(value: Column, part: Column, exact: Column, legacy_www: bool) -> Column:
    return (
        F.when(~U.is_valid_url(value) | U.has_only_www(value, legacy_www), "invalid")
        .when(part, "blocked_part")
        .when(exact, "blocked_host")
        .otherwise(KEPT)
    )


def blocklist_verdicts(values: DataFrame, blocked: Entries, legacy_www: bool = False) -> DataFrame:
    """Invalid links, hosts holding a blocked text, hosts listed exactly.

    ``legacy_www`` strips every leading ``w`` and ``.`` before the substring test
    instead of one ``www.``.
    """
    value = F.col("value")
    key = _part_key(value, legacy_www)
    flagged = flag_substring(values, key, substring_entries(blocked), "_part")
    exact = blocked if legacy_www else unsearchable_entries(blocked)
    flagged = flag_equal(flagged, U.link_host(value), exact, "_exact")
    reason = _link_reason(value, F.col("_part"), F.col("_exact"), legacy_www)
    return flagged.withColumn("reason", reason).drop("_part", "_exact")


def advanced_verdicts(
    values: DataFrame,
    disposable: Entries,
    blocked: Entries,
    words: Sequence[str] = FORBIDDEN_WORDS,
    require_at: bool = True,
    legacy_www: bool = False,
) -> DataFrame:
    """``filtered_verdicts`` for addresses and ``blocklist_verdicts`` for links, in one pass."""
    value = F.col("value")
    address, link = F.col("kind") == EMAIL, F.col("kind") == URL
    key = _part_key(value, legacy_www)
    exact = blocked if legacy_www else unsearchable_entries(blocked)
    flagged = flag_equal_each(values, [
        ("_disposable", F.when(address, _disposable_key(value)), disposable),
        ("_exact", F.when(link, U.link_host(value)), exact),
    ])
    flagged = flag_substring(flagged, F.when(link, key), substring_entries(blocked), "_part")
    reason = F.when(
        address, _filtered_reason(value, F.col("_disposable"), words, require_at)
    ).otherwise(_link_reason(value, F.col("_part"), F.col("_exact"), legacy_www))
    return flagged.withColumn("reason", reason).drop("_disposable", "_part", "_exact")


def bounded_verdicts(
    keys: DataFrame,
    disposable: Entries,
    blocked: Entries,
    words: Sequence[str] = FORBIDDEN_LOCAL_WORDS,
    dot_boundary: bool = False,
) -> DataFrame:
    """Verdicts on ``[kind, key]``: the key is the address, or the link's host.

    Addresses: forbidden words in the local part, disposable suffixes, image names.
    Links: no host, host matching a wildcard entry.
    """
    key = F.col("key")
    address, link = F.col("kind") == EMAIL, F.col("kind") == URL
    flagged = flag_suffix(
        keys, F.when(address, E.email_domain(key)), disposable, "_disposable", dot_boundary
    )
    flagged = flag_wildcard(flagged, F.when(link, key), blocked, "_blocked")
    reason = (
        F.when(address & E.has_forbidden_local(key, words), "forbidden")
        .when(F.col("_disposable"), "disposable")
        .when(address & E.looks_like_image(key), "image")
        .when(link & (key == ""), "invalid")
        .when(F.col("_blocked"), "blocked")
        .otherwise(KEPT)
    )
    return flagged.withColumn("reason", reason).drop("_disposable", "_blocked")


def kept(values: DataFrame) -> DataFrame:
    return values.filter(F.col("reason") == KEPT).drop("reason")
