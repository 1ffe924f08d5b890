"""Functions on addresses, links, paths and list entries."""

import os
import random
import string
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from contactmine.functions import emails as E
from contactmine.functions import text as T
from contactmine.functions import urls as U
from contactmine.functions.idna import to_ascii


@pytest.fixture
def apply(spark):
    def run(function, *inputs):
        rows = [(i, v) for i, v in enumerate(inputs)]
        frame = spark.createDataFrame(rows, "i int, value string").select(
            "i", function(F.col("value")).alias("out")
        )
        return [r.out for r in sorted(frame.collect(), key=lambda r: r.i)]

    return run


def test_clean_and_split(apply):
    assert apply(E.clean_email, "_jo_@x.com", "_@x.com", string.punctuation) == ["jo_@x.com", "x.com", ""]
    assert apply(E.email_local, "A.b@C.d@e", "none") == ["a.b", "none"]
    assert apply(E.email_domain, "A.b@C.d@e", "none") == ["c.d@e", ""]
    assert apply(E.bare_domain, "a.b:80/c", "a.b/c:1") == ["a.b", "a.b"]
    assert apply(E.trim_trailing_dot, "joe@x.com.") == ["joe@x.com"]


def test_email_tests(apply):
    assert apply(E.looks_like_file, "icon@2x.PNG", "pdf@x.com", "a.pdf", "a@x.pdf.org") == [True, False, False, False]
    assert apply(E.looks_like_image, "a@x.JPEG", "a@x.svg", "a@xpng") == [True, False, False]
    assert apply(E.digit_after_at, "z@9x.org", "z9@x9.org") == [True, False]
    assert apply(E.has_forbidden_word, "latest@shop.net", "a@my-demo.org", "a@b.org") == [True, True, False]
    assert apply(E.has_forbidden_local, "a@my-demo.org", "Demo1@b.org") == [False, True]
    assert apply(lambda v: E.has_forbidden_word(v, ["b@c", "x"]), "ab@cd.org", "a@b@cd.org") == [False, True]
    assert apply(lambda v: E.has_forbidden_word(v, []), "test@x.com") == [False]


def test_idna(apply):
    assert apply(E.idna_email, "joe@Shop.com", "jö@bücher.de", "a@b@bücher.de", "none") == [
        "joe@Shop.com", "jö@xn--bcher-kva.de", "a@b@xn--bcher-kva.de", "none"
    ]
    assert apply(
        U.base_url, "http://bücher.de/x", "https://u@bücher.de:8080?q", "http://a..b/c",
        "http://é..b/c", "http://A.com#x", "http://[::1]:80/é",
    ) == [
        "http://xn--bcher-kva.de", "https://u@xn--bcher-kva.de:8080", "http://a..b",
        "http://é..b", "http://A.com", "http://[::1]:80",
    ]


LINKS = [
    "http://[bad/x", "http://bad]/x", "http://[::1]/x", "http:///x", "http://", "http://x", "http://?q",
    "https://u:p@h.com:80/p?q#f", "http://h.com?q=http://z", "http://a／b.com/", "http://a.com/／",
    "http://#", "http://a..b/c",
]


def test_netloc_and_validity_follow_urlparse(apply):
    def expected(link):
        try:
            return urlparse(link).netloc
        except ValueError:
            return None

    located = [None if not ok else loc for ok, loc in zip(apply(U.is_valid_url, *LINKS), apply(U.netloc, *LINKS))]
    assert located == [expected(u) or None for u in LINKS]


def test_hosts(apply):
    assert apply(U.host_to_slash, "http://A.com?q=1/x", "http:///http://b.org") == ["a.com?q=1", "b.org"]
    assert apply(U.strip_www, "www.web.com", "wow.net") == ["web.com", "wow.net"]
    assert apply(U.strip_www_chars, "www.web.com", "wow.net") == ["eb.com", "ow.net"]
    assert apply(
        U.url_host, "http://U@A.com.:80/x", "http://[::1]:80", "http://h.com?x", "http://10.0.0.5/"
    ) == ["a.com", "[::1]", "h.com", "10.0.0.5"]


PATHS = [
    "a/b.TXT", "a/.bashrc", "a/.b.c", "a.d/e", "x.tar.gz", "a.", "...", "..b", "a/..b.c", "..", "noext", "a/b c.Md",
]


def test_extensions_follow_splitext(apply):
    assert apply(T.file_extension, *PATHS) == [os.path.splitext(p)[1].lower() for p in PATHS]
    assert T.normalize_extension(" TXT ") == ".txt"


def test_texts(apply, spark):
    assert apply(T.split_list, " a, b ,, c", "") == [["a", "b", "c"], []]
    assert apply(T.strip, "　\t a b\x1c ") == ["a b"]
    raw = spark.createDataFrame([(b"jo\xffhn@x.com \xc3",)], "c binary")
    assert raw.select(T.decode_ignoring_errors(F.col("c")).alias("t")).first().t == "john@x.com "
    rates = spark.createDataFrame([(6, 2.0), (6, 0.0)], "n int, s double")
    assert [r[0] for r in rates.select(T.rate(F.col("n"), F.col("s"))).collect()] == [3.0, 0.0]


def test_replacement_characters_of_the_text_stay(spark):
    raw = spark.createDataFrame([(bytearray("ab\ufffdcd@x.com".encode() + b"\xff!"),)], "c binary")
    assert raw.select(T.decode_ignoring_errors(F.col("c")).alias("t")).first().t == "ab\ufffdcd@x.com!"


def test_idna_equals_the_rules_of_2008(spark):
    """Against a library that follows the same rules, on labels of many scripts, allowed and not."""
    library = pytest.importorskip("idna")
    pick = random.Random(1)
    pools = [
        "abcxyz0189-", "äöüßéèñçø", "αβγδςσόϊ", "абвгдежя", "אבגדהוז", "ابتثجحخ", "٠١٢٣", "۰۱۲", "漢字仮名", "ひらがなカタカナ・",
        "हिन्दीक्षत्", "한국어", "ÄÉ", "l·", "e\u0301", "\u200c\u200d", "_ !",
    ]
    hosts = [
        "straße.de", "βόλος.gr", "Bücher.de", "bücher.DE", "a_b.é.com", "é..com", "é.com.", "é。com", "xn--bcher-kva.é", "-é.com", "é-.com",
        "ab--é.com", "é" * 60 + ".com", "مثال.إختبار", "l·l.cat", "l·.cat", "क्\u200dष.in", "カ・タ.jp", "a・b.jp", "e\u0301.com", "אa.com", "ﬁ.com", "é",
    ]
    for _ in range(2000):
        scripts = pick.sample(pools, pick.choice([1, 1, 2]))
        labels = ["".join(pick.choice(pick.choice(scripts)) for _ in range(pick.randint(1, 9))) for _ in range(pick.choice([1, 1, 2]))]
        hosts.append(".".join(labels) + pick.choice([".com", ""]))
    hosts = sorted({h for h in hosts if not h.isascii()})

    def expected(host):
        try:
            return library.encode(host).decode()
        except Exception:
            return None

    frame = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", to_ascii(F.col("host")).alias("coded"))
    assert {r.host: r.coded for r in frame.collect()} == {h: expected(h) for h in hosts}
