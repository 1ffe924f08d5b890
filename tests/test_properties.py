"""Properties that hold for any input."""

import random
import string

from helpers import values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactmine.fixed_values import LOOSE_EMAIL, STRICT_EMAIL
from contactmine.functions import emails as E
from contactmine.functions.text import any_of
from contactmine.operators import extract
from contactmine.operators.domains import DEFAULT_RULES
from contactmine.plans import variants

TEXTS = [
    f"{w}{i}@{h} see http://{h}/{i % 7} https://www.{h}:80/{w}"
    for i in range(60)
    for w, h in (("joe", "shop.com"), ("Joe", "a.shop.com"), ("demo", "b.web.co.uk"), ("_", "web.com"))
]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_order_and_partitioning_do_not_matter(spark):
    frame = spark.createDataFrame([(f"s{i:03}", t) for i, t in enumerate(TEXTS)], "source_id string, text string")
    shuffled = frame.orderBy(F.xxhash64("text")).repartition(13)
    for find in (
        lambda c: variants.advanced_candidates(c, ["shop.com"], ["web.co"]),
        lambda c: variants.bounded(c, ["b.web.co.uk"], ["a.*"]),
        lambda c: variants.service(c, "root", rules=DEFAULT_RULES),
        lambda c: variants.service(c, "subdomain", rules=DEFAULT_RULES),
        lambda c: variants.service_map(c, "root", max_per_row=2, rules=DEFAULT_RULES).withColumn("urls", F.array_join("urls", " ")),
    ):
        assert rows(find(frame)) == rows(find(shuffled))


def test_doubling_the_corpus_changes_no_value(spark):
    frame = spark.createDataFrame([("s", t) for t in TEXTS], "source_id string, text string")
    double = frame.unionByName(frame)
    for find in (variants.simple, lambda c: variants.advanced(c, [], []), lambda c: variants.service(c, "all", rules=DEFAULT_RULES)):
        assert rows(find(frame)) == rows(find(double))


def test_cleaning_twice_changes_nothing(corpus):
    pick = random.Random(5)
    texts = ["".join(pick.choices(string.punctuation + "ab@.", k=12)) for _ in range(300)]
    once = E.clean_email(F.col("text"))
    assert all(r.a == r.b for r in corpus(*texts).select(once.alias("a"), E.clean_email(once).alias("b")).collect())


def test_simple_keeps_addresses_only(corpus):
    assert all("@" in v for v in values(variants.simple(corpus(*TEXTS, "_@x.com _jo_@x.com"))))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB1@.-_+ é\n", max_size=30), min_size=1, max_size=40))
def test_finders_on_any_text(corpus, texts):
    import re

    for finder, pattern in ((extract.STRICT_EMAILS, STRICT_EMAIL), (extract.LOOSE_EMAILS, LOOSE_EMAIL)):
        found = extract.extract_contacts(corpus(*texts), finder)
        expected = {(f"s{i}", v) for i, t in enumerate(texts) for v in re.findall(pattern, t)}
        assert {(r.source_id, r.value) for r in found.collect()} == expected


def test_any_of_takes_texts_literally(corpus):
    words = [r"a\Eb", "[x", "^", "-", "]", "&&", "\\", "é"]
    texts = [*words, "ab", "x", "", "&"]
    found = corpus(*texts).filter(F.col("text").rlike(any_of(words)))
    assert values(found, "text") == sorted(words)
