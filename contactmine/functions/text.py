"""Column functions on raw text and paths."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmine.fixed_values import WHITESPACE

# two noncharacters, which no text for exchange holds
_SET_ASIDE = "\U0010ffff\U0010fffe"


def decode_ignoring_errors(content: Column) -> Column:
    """UTF-8 text of ``content`` with undecodable bytes left out.

    A U+FFFD that the content itself holds stays: it is set aside while the broken bytes,
    which become one, are removed.
    """
    mark, broken = F.lit(_SET_ASIDE), F.lit("\ufffd")
    aside = F.replace(content.cast("string"), broken, mark)
    return F.replace(F.replace(F.make_valid_utf8(aside), broken, F.lit("")), mark, broken)


def strip(value: Column) -> Column:
    """Cut white space (all of Unicode's) off both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def split_list(value: Column) -> Column:
    """``"a, b,,c"`` → ``["a","b","c"]``."""
    return F.filter(F.transform(F.split(value, ","), strip), lambda part: part != "")


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def normalize_extension(ext: str) -> str:
    ext = ext.strip().lower()
    return ext if ext.startswith(".") else "." + ext


def rate(count: Column, elapsed: Column) -> Column:
    """``count / elapsed``, 0 where nothing elapsed."""
    return F.when(elapsed > 0, count / elapsed).otherwise(F.lit(0.0))


def any_of(texts: Iterable[str]) -> str:
    """Java pattern for any of the literal texts; '' for none.

    A test of the first character spares most positions the walk over the alternatives.
    """
    texts = list(texts)
    alternatives = "(?:" + "|".join(literal(text) for text in texts) + ")" if texts else ""
    if not all(texts) or len(texts) < 2:
        return alternatives
    first = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({text[0] for text in texts}))
    return f"(?=[{first}]){alternatives}"


def literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def once(expression: Column, use: Callable[[Column], Column]) -> Column:
    """``use(expression)`` with the expression evaluated one time, however often it is used.

    Catalyst copies an expression into each place that refers to it when it moves a filter
    below a projection; a lambda variable is not copied.
    """
    return F.element_at(F.transform(F.array(expression), use), 1)
