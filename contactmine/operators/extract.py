"""Corpus ``[source, text]`` → contacts ``[source, kind, pos, value]``.

Both finders run in one projection over one scan; the text column is never
carried past it.  ``pos`` counts the distinct values of one kind in one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.functions import emails, urls

EMAIL, URL = "email", "url"


@dataclass(frozen=True)
class Finder:
    """``find(text)`` gives the distinct values of ``kind``.

    A text without ``marker`` holds no value; the test on the bare column is
    pushed into the scan, so such texts never reach the regular expression.  With ``key``
    the rows get a ``key`` column, computed once per value like ``mapped`` changes.
    """

    kind: str
    find: Callable[[Column], Column]
    marker: str | None = None
    key: Callable[[Column], Column] | None = None


STRICT_EMAILS = Finder(EMAIL, emails.strict_emails, "@")
BOUNDED_EMAILS = Finder(EMAIL, emails.bounded_emails, "@")
LOOSE_EMAILS = Finder(EMAIL, emails.loose_emails, "@")
SEGMENTED_URLS = Finder(URL, urls.segmented_urls, "://")
OVERLAPPING_URLS = Finder(URL, urls.overlapping_urls, "://")
SERVICE_URLS = Finder(URL, urls.service_urls, "://")


def mapped(
    finder: Finder,
    change: Callable[[Column], Column],
    keep: Callable[[Column], Column] | None = None,
) -> Finder:
    """The finder with each value changed (after dropping those ``keep`` is false for).

    The change is made once per value, inside the text's array; made on the rows instead,
    Catalyst would copy it into every later test that it moves below the projection.
    """

    def find(text: Column) -> Column:
        found = finder.find(text)
        if keep is not None:
            found = F.filter(found, keep)
        return F.array_distinct(F.transform(found, change))

    return replace(finder, find=find)


def keyed(finder: Finder, key: Callable[[Column], Column]) -> Finder:
    return replace(finder, key=key)


CLEAN_EMAILS = mapped(STRICT_EMAILS, emails.clean_email)


def custom_email_finder(pattern: str, group: int = 0) -> Finder:
    return Finder(EMAIL, partial(emails.custom_emails, pattern=pattern, group=group))


def custom_url_finder(pattern: str) -> Finder:
    return Finder(URL, partial(urls.custom_urls, pattern=pattern))


def _hits(finder: Finder, text: Column) -> Column:
    """Array of ``kind, pos, value`` structs."""

    def hit(value: Column, pos: Column) -> Column:
        fields = [F.lit(finder.kind).alias("kind"), pos.alias("pos"), value.alias("value")]
        if finder.key is not None:
            fields.append(finder.key(value).alias("key"))
        return F.struct(*fields)

    return F.transform(finder.find(text), hit)


def extract_contacts(
    corpus: DataFrame, *finders: Finder, text: str = "text", keep: tuple[str, ...] = ("source_id",)
) -> DataFrame:
    """One row per distinct value of each text, with the ``keep`` columns and the text's ``place``, if it has one."""
    if "place" in corpus.columns:
        keep = (*keep, "place")
    column = F.col(text)
    if all(f.marker for f in finders):
        guard = F.contains(column, F.lit(finders[0].marker))
        for f in finders[1:]:
            guard = guard | F.contains(column, F.lit(f.marker))
        corpus = corpus.filter(guard)
    else:
        corpus = corpus.filter(column.isNotNull())
    found = [_hits(f, column) for f in finders]
    hits = found[0] if len(found) == 1 else F.flatten(F.array(*found))
    return corpus.select(*keep, F.inline(hits))


def emails_of(contacts: DataFrame) -> DataFrame:
    return contacts.filter(F.col("kind") == EMAIL)


def urls_of(contacts: DataFrame) -> DataFrame:
    return contacts.filter(F.col("kind") == URL)
