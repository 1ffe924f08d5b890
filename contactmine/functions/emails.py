"""Column functions that find, clean and test e-mail addresses.

The finders return the distinct matches of one text in order of appearance.
Their patterns are linear in the text: a run of address characters is entered
only at its beginning (or where the previous match ended) and crossed once,
however many places inside it could start a match.  The plain forms, which
re-scan a run from each of its characters, are in ``fixed_values``.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmine.fixed_values import (
    FORBIDDEN_LOCAL_WORDS,
    FORBIDDEN_WORDS,
    IMAGE_EXTENSIONS,
    LOOKALIKE_EXTENSIONS,
    PUNCTUATION,
)
from contactmine.functions.idna import to_ascii
from contactmine.functions.text import any_of

# Classes list their characters: the regex engine tests those by one table lookup.
_LETTERS = string.ascii_letters
_LABEL = rf"[{_LETTERS}{string.digits}\-]"
_HOST = rf"[{_LETTERS}{string.digits}.\-]"
_LOCAL = rf"[{_LETTERS}{string.digits}_.+\-]"
_RUN_START = rf"(?:(?<!{_LOCAL})|\G)"

# The look-ahead checks everything from the "@" on, so the lazy skip to the first
# permitted start runs at most once per run.  (?U): \b and \w follow Unicode.
_STRICT_TAIL = rf"@{_LABEL}+\.[{_LETTERS}]{{2,}}+\b"
_STRICT = rf"(?U){_RUN_START}(?={_LOCAL}+{_STRICT_TAIL}){_LOCAL}*?\b({_LOCAL}+{_STRICT_TAIL})"
_BOUNDED_TAIL = rf"@{_LABEL}+\.{_HOST}++(?![\w.-])"
_BOUNDED = (
    rf"(?U){_RUN_START}(?={_LOCAL}+{_BOUNDED_TAIL})"
    rf"{_LOCAL}*?(?<![\w.-])({_LOCAL}+{_BOUNDED_TAIL})"
)
_LOOSE = rf"{_RUN_START}{_LOCAL}+@{_LABEL}+\.{_HOST}+"


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def strict_emails(text: Column) -> Column:
    """Addresses whose host is one label and an alphabetic ending."""
    return _matches(text, _STRICT, 1)


def bounded_emails(text: Column) -> Column:
    """Addresses with full hosts, not glued to a word, dot or hyphen."""
    return _matches(text, _BOUNDED, 1)


def loose_emails(text: Column) -> Column:
    """Addresses with full hosts wherever they stand."""
    return _matches(text, _LOOSE, 0)


def custom_emails(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of the caller's (Java) pattern; ``group`` picks a capture group."""
    return _matches(text, pattern, group)


def clean_email(value: Column) -> Column:
    """Cut ASCII punctuation off both ends."""
    return F.btrim(value, F.lit(PUNCTUATION))


def trim_trailing_dot(value: Column) -> Column:
    return F.rtrim(value, F.lit("."))


def email_local(value: Column) -> Column:
    """Lower-cased part before the first ``@`` (all of it when there is none)."""
    return F.substring_index(F.lower(value), "@", 1)


def email_domain(value: Column) -> Column:
    """Lower-cased part after the first ``@`` ('' when there is none)."""
    at = F.instr(value, "@")
    return F.when(at > 0, F.lower(F.substr(value, at + 1))).otherwise(F.lit(""))


def bare_domain(domain: Column) -> Column:
    """Domain without port and path."""
    return F.substring_index(F.substring_index(domain, ":", 1), "/", 1)


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7f]")


def to_ascii_host(host: Column) -> Column:
    """Internationalised host in the ASCII form of IDNA 2003, as links have it; unchanged where that fails."""
    ascii_form = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(has_non_ascii(host), F.coalesce(ascii_form, host)).otherwise(host)


def idna_email(value: Column) -> Column:
    """Address with its host (after the last ``@``) in the ASCII form of IDNA 2008; unchanged where it has none."""
    host = F.substring_index(value, "@", -1)
    local = F.substr(value, F.lit(1), F.length(value) - F.length(host))
    return F.when(
        has_non_ascii(host) & F.contains(value, F.lit("@")), F.coalesce(F.concat(local, to_ascii(host)), value)
    ).otherwise(value)


def looks_like_file(value: Column) -> Column:
    """The part after the ``@`` ends like a file name (``logo@2x.png``)."""
    return F.lower(value).rlike(rf"(?s)@.*{any_of(LOOKALIKE_EXTENSIONS)}\z")


def looks_like_image(value: Column) -> Column:
    return value.rlike(rf"(?i)\.{any_of(IMAGE_EXTENSIONS)}\z")


def digit_after_at(value: Column) -> Column:
    return value.rlike(r"(?U)@\d")


def has_forbidden_word(value: Column, words: Sequence[str] = FORBIDDEN_WORDS) -> Column:
    """A word stands anywhere in the local part or in the domain."""
    if not words:
        return F.lit(False)
    if any("@" in word for word in words):  # must not match across the first @
        parts = (email_local(value), email_domain(value))
        return parts[0].rlike(any_of(words)) | parts[1].rlike(any_of(words))
    return F.lower(value).rlike(any_of(words))


def has_forbidden_local(value: Column, words: Sequence[str] = FORBIDDEN_LOCAL_WORDS) -> Column:
    """A word stands in the local part."""
    return email_local(value).rlike(any_of(words)) if words else F.lit(False)
