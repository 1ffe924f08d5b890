"""The five ways to run an extraction, each as one plan over ``[source_id, text]``.

Every plan scans the corpus once, finds all kinds of contact in that scan, and
shuffles the contacts once, after combining them on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.fixed_values import FORBIDDEN_LOCAL_WORDS, FORBIDDEN_WORDS
from contactmine.functions import emails as E
from contactmine.functions import urls as U
from contactmine.operators.dedup import distinct_values, reading_order, skip_processed
from contactmine.operators.domains import with_domains
from contactmine.operators.extract import (
    BOUNDED_EMAILS,
    CLEAN_EMAILS,
    EMAIL,
    LOOSE_EMAILS,
    OVERLAPPING_URLS,
    SEGMENTED_URLS,
    SERVICE_URLS,
    URL,
    Finder,
    extract_contacts,
    keyed,
    mapped,
)
from contactmine.operators.mapping import MAX_PER_ROW, url_map
from contactmine.operators.matching import Entries, flag_equal
from contactmine.operators.verdicts import (
    advanced_verdicts,
    bounded_verdicts,
    filtered_verdicts,
    kept,
    strict_verdicts,
)

MODES = {"root": "root", "subdomain": "subdomain", "all": "value"}


def _values(corpus: DataFrame, *finders: Finder) -> DataFrame:
    return distinct_values(extract_contacts(corpus, *finders))


def simple(corpus: DataFrame, require_at: bool = True) -> DataFrame:
    """Distinct addresses that are neither file names nor under a numeric host."""
    return kept(strict_verdicts(_values(corpus, CLEAN_EMAILS), require_at))


def filtered(
    corpus: DataFrame, disposable: Entries, words: Sequence[str] = FORBIDDEN_WORDS
) -> DataFrame:
    """``simple`` without forbidden words and disposable domains."""
    return kept(filtered_verdicts(_values(corpus, CLEAN_EMAILS), disposable, words))


def advanced_candidates(
    corpus: DataFrame,
    disposable: Entries,
    blocked: Entries,
    words: Sequence[str] = FORBIDDEN_WORDS,
    legacy_www: bool = False,
) -> DataFrame:
    """Distinct addresses and links with the reason each is kept or dropped."""
    values = _values(corpus, CLEAN_EMAILS, SEGMENTED_URLS)
    return advanced_verdicts(values, disposable, blocked, words, legacy_www=legacy_www)


def advanced(
    corpus: DataFrame,
    disposable: Entries,
    blocked: Entries,
    words: Sequence[str] = FORBIDDEN_WORDS,
    legacy_www: bool = False,
) -> DataFrame:
    """``filtered`` addresses and links whose host is not blocked."""
    return kept(advanced_candidates(corpus, disposable, blocked, words, legacy_www))


def bounded_candidates(
    corpus: DataFrame,
    disposable: Entries,
    blocked: Entries,
    words: Sequence[str] = FORBIDDEN_LOCAL_WORDS,
    dot_boundary: bool = False,
    trim_trailing_dot: bool = False,
) -> DataFrame:
    """One row per address and per link host: first value, its source, and the reason."""
    emails = BOUNDED_EMAILS
    if trim_trailing_dot:
        emails = mapped(emails, E.trim_trailing_dot)
    contacts = extract_contacts(
        corpus, keyed(emails, lambda address: address), keyed(OVERLAPPING_URLS, U.host_to_slash)
    )
    first = contacts.groupBy("kind", "key").agg(
        F.min(F.struct(*reading_order(contacts), "value")).alias("_first")
    )
    return bounded_verdicts(first, disposable, blocked, words, dot_boundary).select(
        "kind", "key", F.col("_first.value").alias("value"),
        F.col("_first.source_id").alias("source_id"), "reason",
    )


def bounded(
    corpus: DataFrame,
    disposable: Entries,
    blocked: Entries,
    words: Sequence[str] = FORBIDDEN_LOCAL_WORDS,
    dot_boundary: bool = False,
    trim_trailing_dot: bool = False,
) -> DataFrame:
    """Addresses with full hosts, one link per host, each with its first source."""
    candidates = bounded_candidates(
        corpus, disposable, blocked, words, dot_boundary, trim_trailing_dot
    )
    return kept(candidates).select("kind", "value", "source_id")


def service_values(
    corpus: DataFrame,
    rules: Sequence[str] | DataFrame,
    status: DataFrame | None = None,
    email_finder: Finder = LOOSE_EMAILS,
    url_finder: Finder = SERVICE_URLS,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Distinct addresses and base URLs with ``n_texts``, the latter with ``root`` and ``subdomain``.

    With ``status`` (``[base_url, status]``) only base URLs that answered 200 stay; with
    ``ledger`` (``[source_id]``) only what other sources hold: contacts, not texts, meet it.
    """
    contacts = extract_contacts(
        corpus,
        mapped(email_finder, E.idna_email),
        mapped(url_finder, U.base_url, keep=U.is_valid_url),
    )
    if ledger is not None:
        contacts = skip_processed(contacts, ledger, "source_id")
    value, address = F.col("value"), F.col("kind") == EMAIL
    values = contacts.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_texts"))
    if status is not None:
        alive = status.filter(F.col("status") == 200).select(F.col("base_url").alias("entry"))
        values = flag_equal(values, F.when(F.col("kind") == URL, value), alive, "_alive")
        values = values.filter(F.col("_alive") | address).drop("_alive")
    return with_domains(values, rules)


def service(corpus: DataFrame, mode: str = "root", **options) -> DataFrame:
    """Addresses, and base URLs reduced to one per root, one per subdomain, or all."""
    values = service_values(corpus, **options)
    if mode == "all":
        return values.select("kind", "value")
    key = F.when(F.col("kind") == EMAIL, F.col("value")).otherwise(F.col(MODES[mode]))
    # the count keeps this test above the first aggregation, on distinct base URLs
    return (
        values.withColumn("key", F.when(F.col("n_texts") > 0, key))
        .filter(F.col("key").isNotNull())
        .groupBy("kind", "key")
        .agg(F.min("value").alias("value"))
        .drop("key")
    )


def service_map(
    corpus: DataFrame, mode: str = "root", max_per_row: int = MAX_PER_ROW, **options
) -> DataFrame:
    """``[key, part, urls]``: the base URLs under each root, subdomain or URL."""
    values = service_values(corpus, **options).filter(F.col("kind") == URL)
    if mode == "all":  # distinct values, each a key with itself
        return values.select(
            F.col("value").alias("key"), F.lit(0).cast("bigint").alias("part"), F.array("value").alias("urls")
        )
    return url_map(values, MODES[mode], max_per_row)
