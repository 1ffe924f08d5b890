"""Finders: literal cases, and random texts against the plain patterns in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contactmine import fixed_values as X
from contactmine.functions import emails as E
from contactmine.functions import urls as U
from contactmine.operators import extract


def find(corpus, function, text):
    return corpus(text).select(function(F.col("text")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, strict, bounded, loose",
    [
        ("mail a.b@mail.shop.co.uk now", ["a.b@mail.shop"], ["a.b@mail.shop.co.uk"], ["a.b@mail.shop.co.uk"]),
        ("end at joe@x.com.", ["joe@x.com"], ["joe@x.com."], ["joe@x.com."]),
        ("éjohn@x.com", [], [], ["john@x.com"]),
        ("jane@x.comé", [], [], ["jane@x.com"]),
        ("a@b.com_c@d.com", ["b.com_c@d.com"], ["b.com_c@d.com"], ["a@b.com", "_c@d.com"]),
        ("a@b.com a@b.com", ["a@b.com"], ["a@b.com"], ["a@b.com"]),
        ("no address", [], [], []),
    ],
)
def test_email_finders(corpus, text, strict, bounded, loose):
    assert find(corpus, E.strict_emails, text) == strict
    assert find(corpus, E.bounded_emails, text) == bounded
    assert find(corpus, E.loose_emails, text) == loose


@pytest.mark.parametrize(
    "text, segmented, overlapping, service",
    [
        (
            "http://a.comhttps://b.org/x)..",
            ["http://a.com", "https://b.org/x"],
            ["http://a.comhttps://b.org/x", "https://b.org/x"],
            ["http://a.com", "https://b.org/x"],
        ),
        (
            "see http://www.web.com/$q now",
            ["http://www.web.com/"], ["http://www.web.com/$q"], ["http://www.web.com/"],
        ),
        ("http:// x", ["http://"], [], []),
        ("http://a.b", ["http://a.b"], ["http://a.b"], []),
    ],
)
def test_url_finders(corpus, text, segmented, overlapping, service):
    assert find(corpus, U.segmented_urls, text) == segmented
    assert find(corpus, U.overlapping_urls, text) == overlapping
    assert find(corpus, U.service_urls, text) == service


def test_custom_finders(corpus):
    text = "to joe@shop.com, see https://shop.com/x). http://a.b"
    found = extract.extract_contacts(
        corpus(text, None),
        extract.custom_email_finder(r"(\w+)@(\w+)\.com", 2),
        extract.custom_url_finder(r"https?://\S+"),
    )
    assert {(r.kind, r.value) for r in found.collect()} == {
        ("email", "shop"), ("url", "https://shop.com/x"),
    }


# --- random texts ----------------------------------------------------------------------

ALPHABET = ["a", "B", "7", "@", "@", ".", ".", "-", "_", "+", " ", "é", "\n", "com", "a@b.co", "x.com"]
LINK_ALPHABET = [
    "http://", "https://", "http://", "a", ".com", "/", "?", "$", " ", "'", '"', "<", ")", "]", "[",
    "{", "|", ",", ";", ".", "!", "\x1c", " ", "\t", "😀", "h", "é",
]


def texts(alphabet, count=1500, longest=14):
    pick = random.Random(7)
    return ["".join(pick.choices(alphabet, k=pick.randint(1, longest))) for _ in range(count)]


def distinct(found):
    return list(dict.fromkeys(found))


def check(corpus, function, expected, samples):
    rows = corpus(*samples).select("text", function(F.col("text")).alias("v")).collect()
    wrong = [(r.text, r.v, expected(r.text)) for r in rows if r.v != expected(r.text)]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize(
    "function, pattern",
    [
        (E.strict_emails, X.STRICT_EMAIL),
        (E.bounded_emails, X.BOUNDED_EMAIL),
        (E.loose_emails, X.LOOSE_EMAIL),
    ],
)
def test_emails_equal_plain_pattern(corpus, function, pattern):
    check(corpus, function, lambda t: distinct(re.findall(pattern, t)), texts(ALPHABET))


def links_from_starts(text, stops, trail, overlapping, minimum=0):
    """Brute force: from every start to the first stop, and to the next start unless overlapping."""
    starts = [m.start() for m in re.finditer(X.URL_START, text)]
    found = []
    for start, following in zip(starts, [*starts[1:], len(text)]):
        end = len(text) if overlapping else following
        link = re.match(f"[^{stops}]*", text[start:end]).group().rstrip(trail)
        if not minimum or (len(link) >= minimum and "." in link):
            found.append(link)
    return distinct(found)


@pytest.mark.parametrize(
    "function, stops, trail, overlapping, minimum",
    [
        (U.segmented_urls, X.SEGMENTED_STOPS, X.SEGMENTED_TRAIL, False, 0),
        (U.overlapping_urls, X.OVERLAPPING_STOPS, X.OVERLAPPING_TRAIL, True, X.OVERLAPPING_MIN_LENGTH),
        (U.service_urls, X.SERVICE_STOPS, X.SERVICE_TRAIL, False, X.SERVICE_MIN_LENGTH),
    ],
)
def test_links_equal_brute_force(corpus, function, stops, trail, overlapping, minimum):
    check(
        corpus, function,
        lambda t: links_from_starts(t, stops, trail, overlapping, minimum),
        texts(LINK_ALPHABET),
    )


def test_long_runs_are_linear(corpus):
    """Runs without an ``@`` and links without a stop, a megabyte each."""
    size = 1 << 20
    runs = ["a." * (size // 2), "+-" * (size // 2), "a" * size, "@" * size, "a@" * (size // 2)]
    rows = corpus(*runs).select(
        *[F.size(f(F.col("text"))).alias(f.__name__) for f in (E.strict_emails, E.bounded_emails, E.loose_emails)]
    ).collect()
    assert {tuple(r) for r in rows} == {(0, 0, 0)}
    link = corpus("http://" + "a😀" * (size // 2)).select(
        F.size(U.segmented_urls(F.col("text"))).alias("a"), F.size(U.service_urls(F.col("text"))).alias("b")
    ).first()
    assert (link.a, link.b) == (1, 0)
