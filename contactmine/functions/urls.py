"""Column functions that find, cut and test web links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmine.fixed_values import (
    NETLOC_LOOKALIKES,
    OVERLAPPING_MIN_LENGTH,
    OVERLAPPING_STOPS,
    OVERLAPPING_TRAIL,
    SEGMENTED_STOPS,
    SEGMENTED_TRAIL,
    SERVICE_MIN_LENGTH,
    SERVICE_STOPS,
    SERVICE_TRAIL,
    URL_START,
)
from contactmine.functions.emails import has_non_ascii, to_ascii_host

# A link runs over characters that end no link; an "h" only where no other link starts.
# \s misses the four separators; possessive groups keep the match loop off the stack.
_SPACE = r"\s\x1c-\x1f"


def _up_to_next(stops: str) -> str:
    return rf"(?U){URL_START}(?:[^{stops}{_SPACE}h]++|h(?!ttps?://))"


_SEGMENTED = _up_to_next(SEGMENTED_STOPS) + "*+"
_SERVICE = _up_to_next(SERVICE_STOPS) + "++"
# Taking only the "h" lets the next match begin inside this one.
_OVERLAPPING = rf"h(?=(ttps?://[^{OVERLAPPING_STOPS}]*+))"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _trimmed(found: Column, trail: str, min_length: int = 0) -> Column:
    links = F.transform(found, lambda u: F.rtrim(u, F.lit(trail)))
    if min_length:
        links = F.filter(
            links, lambda u: (F.length(u) >= min_length) & F.contains(u, F.lit("."))
        )
    return F.array_distinct(links)


def segmented_urls(text: Column) -> Column:
    """Links cut at the next link start or stop character."""
    return _trimmed(_found(text, _SEGMENTED), SEGMENTED_TRAIL)


def overlapping_urls(text: Column) -> Column:
    """Links read from every link start, across later starts glued to them."""
    found = F.transform(_found(text, _OVERLAPPING, 1), lambda u: F.concat(F.lit("h"), u))
    return _trimmed(found, OVERLAPPING_TRAIL, OVERLAPPING_MIN_LENGTH)


def service_urls(text: Column) -> Column:
    """Segmented links with the wider stop set and the length and dot test."""
    return _trimmed(_found(text, _SERVICE), SERVICE_TRAIL, SERVICE_MIN_LENGTH)


def custom_urls(text: Column, pattern: str) -> Column:
    """Whole matches of the caller's (Java) pattern, trimmed and length-tested."""
    return _trimmed(_found(text, pattern), SERVICE_TRAIL, SERVICE_MIN_LENGTH)


def netloc(url: Column) -> Column:
    """User info, host and port: between ``//`` and the first of ``/ ? #``."""
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def host_to_slash(url: Column) -> Column:
    """Lower-cased text between the link start and the next slash."""
    return F.lower(F.regexp_extract(url, r"https?://([^/]+)", 1))


def strip_www(host: Column) -> Column:
    """Drop one leading ``www.``."""
    return F.regexp_replace(host, r"^www\.", "")


def link_host(url: Column) -> Column:
    """``strip_www`` of the lower-cased network location, in one pass."""
    return F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?([^/?#]*)", 1)


def has_only_www(url: Column, chars: bool = False) -> Column:
    """Nothing is left of the location without ``www.`` (with ``chars``: without ``w`` and ``.``)."""
    cut = "[wW.]*" if chars else r"(?i:www\.)?"
    return url.rlike(rf"^https?://{cut}(?:[/?#]|\z)")


def strip_www_chars(host: Column) -> Column:
    """Drop every leading ``w`` and ``.`` (``www.web.com`` → ``eb.com``)."""
    return F.ltrim(host, F.lit("w."))


# An ASCII location without brackets; or else one free of look-alike separators, with no
# brackets or with both kinds.
_VALID = (
    r"^https?://(?:[^/?#\[\]\x{80}-\x{10ffff}]++(?:[/?#]|\z)"
    rf"|(?=[^/?#])(?![^/?#]*[{NETLOC_LOOKALIKES}])"
    r"(?:(?![^/?#]*[\[\]])|(?=[^/?#]*\[)(?=[^/?#]*\])))"
)


def is_valid_url(url: Column) -> Column:
    """There is a network location, its brackets pair up, no look-alike separators."""
    return url.rlike(_VALID)


_USER = r"https?://(?:[^/?#]*@)?"
_HOST = r"(?:\[[^\]/?#]*\]|[^/?#:]*)"


def base_url(url: Column) -> Column:
    """``scheme://netloc`` with an internationalised host in ASCII form."""
    converted = F.concat(
        F.regexp_extract(url, rf"^({_USER})", 1),
        to_ascii_host(F.regexp_extract(url, rf"^{_USER}({_HOST})", 1)),
        F.regexp_extract(url, rf"^{_USER}{_HOST}([^/?#]*)", 1),
    )
    return F.when(has_non_ascii(url), converted).otherwise(
        F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)
    )


def url_host(url: Column) -> Column:
    """Lower-cased host: no user info, port or final dots."""
    host = F.regexp_extract(F.lower(url), rf"^{_USER}({_HOST})", 1)
    return F.rtrim(host, F.lit("."))
