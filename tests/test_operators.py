"""List matching, verdicts, de-duplication, maps and summaries on small inputs."""

import random
import re

import pytest
from helpers import values
from pyspark.sql import functions as F

from contactmine.operators import cells, dedup, domains, extract, lists, mapping, matching
from contactmine.operators import summary as S
from contactmine.operators import verdicts as V

# --- lists: one expression for short ones, joins for all others ------------------------


def hosts(count=300):
    pick = random.Random(3)
    parts = ["a", "web", "www", "w", "shop", "gov", "co", "uk", "x-1", "mail"]
    return [".".join(pick.choices(parts, k=pick.randint(1, 4))) for _ in range(count)]


HOSTS = [*hosts(), "", None, "A.gov", "a[b", "x" * 500 + "web.gov" + "y" * 500 + ".shop.co", "é😀web", "m" * 100, "SPAM-farm.GOV", "\u017fpam", "ÉCOLE.uk"]
ENTRIES = ["web", ".gov", "shop.co", "mail", "w.a", "zzz", "uk", "a[b", "longer-than-any-host-name"]
PATTERNS = ["*.gov", "w*p", "Mail.*.uk", "a[b", "co.uk", "zz*", "spam*", "école"]


def rule_equal(host, entries):
    return host in entries


def rule_suffix(host, entries):
    return any(host.endswith(e) for e in entries)


def rule_suffix_at_dot(host, entries):
    return any(host == e or host.endswith("." + e) for e in entries)


def rule_substring(host, entries):
    return any(e in host for e in entries)


def rule_wildcard(host, entries):
    return any(re.search(re.escape(e).replace(r"\*", ".*"), host, re.I) for e in entries)


def suffix_at_dot(*args):
    return matching.flag_suffix(*args, dot_boundary=True)


CASES = [
    (matching.flag_equal, rule_equal, ENTRIES),
    (matching.flag_suffix, rule_suffix, ENTRIES),
    (suffix_at_dot, rule_suffix_at_dot, ENTRIES),
    (matching.flag_substring, rule_substring, ENTRIES),
    (matching.flag_wildcard, rule_wildcard, PATTERNS),
    (matching.flag_wildcard, rule_wildcard, ["*"]),
]


@pytest.mark.parametrize("flag, rule, entries", CASES)
@pytest.mark.parametrize("form", ["sequence", "frame", "long sequence"])
def test_matching_equals_brute_force(spark, monkeypatch, flag, rule, entries, form):
    # wildcards ignore case, so their keys keep it
    keys = HOSTS if flag is matching.flag_wildcard else [h.lower() if h else h for h in HOSTS]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, host string")
    listed = entries
    if form == "frame":
        listed = spark.createDataFrame([(e,) for e in [*entries, *entries]], "entry string")
    elif form == "long sequence":
        monkeypatch.setattr(matching, "LITERAL_LIMIT", 0)
    found = flag(df, F.col("host"), listed, "hit").select("i", "hit").collect()
    expected = {i: h is not None and rule(h, entries) for i, h in enumerate(keys)}
    assert {r.i: r.hit for r in found} == expected and len(found) == len(keys)


@pytest.mark.parametrize("entry", ["istan*", "İSTAN", "straße", "STRASSE*x", "ſpam*", "Ka*ı", "σ*σ", "ǆ", "ﬁ*", "b*\u0345"])
def test_wildcards_do_not_depend_on_the_length_of_the_list(spark, entry):
    """Letters whose cases differ in length, in short lists and long ones."""
    keys = ["İstan-x.com", "istan", "ıstan", "STRAẞE", "strasse-x", "Straße.de", "SPAM", "ſpam", "\u212aai", "kaI", "ΣΑΣ", "ςας", "ǅ", "Ǆ", "ﬁ", "FI", "b\nx\u0399", "B-ι", None, ""]
    df = spark.createDataFrame([(k,) for k in keys], "host string")
    more = [f"none{i}*never" for i in range(matching.LITERAL_LIMIT + 1)]
    got = [{r.host: r.hit for r in matching.flag_wildcard(df, F.col("host"), entries, "hit").collect()} for entries in ([entry], [entry, *more])]
    assert got[0] == got[1] and any(got[0].values())


@pytest.mark.parametrize("flag", [matching.flag_substring, matching.flag_wildcard, matching.flag_suffix])
def test_long_lists_by_rarest_gram(spark, flag):
    """Entries of many lengths that share endings, against a plain loop."""
    pick = random.Random(3)
    word = lambda n: "".join(pick.choices("abcde", k=n))
    keys = [f"{word(pick.randint(1, 12))}.{word(2)}.com" for _ in range(400)] + ["", "a", "x" * 70 + ".com", "é😀.com", None]
    ends = [".com", "", "é", "😀.com", ".a"] + ([f"*{word(2)}", f"*.{word(1)}*"] if flag is matching.flag_wildcard else [])
    entries = sorted({word(pick.randint(1, 9)) + pick.choice(ends) for _ in range(250)})
    df = spark.createDataFrame([(k,) for k in keys], "host string")
    rule = {matching.flag_substring: rule_substring, matching.flag_wildcard: rule_wildcard, matching.flag_suffix: rule_suffix}[flag]
    frame = spark.createDataFrame([(e,) for e in entries], "entry string")
    for given in (entries[:5], entries, frame):
        listed = entries[:5] if given == entries[:5] else entries
        got = {r.host: r.hit for r in flag(df, F.col("host"), given, "hit").collect()}
        assert got == {k: k is not None and rule(k, listed) for k in keys}


def test_long_lists_cut_a_key_once_for_each_position(spark):
    keys = spark.createDataFrame([("abcdefgh",)], "_key string").withColumn("_id", F.col("_key"))
    listed = spark.createDataFrame([("cd" * n,) for n in range(2, 40)], "entry string")
    grams, _ = matching._index(matching._whole(listed), keys)
    assert grams.count() == 6


@pytest.mark.parametrize("flag", [c[0] for c in CASES[:5]])
def test_empty_lists_match_nothing(spark, flag):
    df = spark.createDataFrame([("a",), ("",)], "host string")
    for nothing in ([], spark.createDataFrame([], "entry string")):
        assert not any(r.hit for r in flag(df, F.col("host"), nothing, "hit").collect())


def test_bounded_list(spark):
    entries = spark.createDataFrame([("b",), ("a",), ("a",)], "entry string")
    assert matching.bounded_list(entries) == ["a", "b"]
    assert matching.bounded_list(entries, 1) is entries


def test_list_lines(spark):
    lines = ["# note", "  *.GOV.pk ", "", " \t", "Web.com", "web.com", "*.", "a/*b"]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    assert values(lists.list_entries(frame), "entry") == ["*.", "*.gov.pk", "a/*b", "web.com"]
    assert values(lists.list_entries(frame, comment=None), "entry")[0] == "# note"
    assert values(lists.wildcard_entries(frame), "entry") == ["*.", "*.GOV.pk", "Web.com", "a/*b", "web.com"]
    entries = lists.list_entries(frame)
    assert values(lists.substring_entries(entries), "entry") == ["a/*b", "gov.pk", "web.com"]
    assert lists.substring_entries(["*.GOV.pk", "*.", "#x", "a"]) == ["a", "gov.pk"]
    rules = spark.createDataFrame([("// note",), ("com",), (" *.ck  text",), ("",)], "value string")
    assert values(lists.suffix_rules(rules), "rule") == ["*.ck", "com"]


# --- verdicts ---------------------------------------------------------------------------


def as_values(spark, kind, *items):
    return spark.createDataFrame([(kind, v) for v in items], "kind string, value string")


def reasons(frame):
    return {r.value: r.reason for r in frame.collect()}


def test_email_reasons(spark):
    found = as_values(
        spark, "email", "x.com", "icon@2x.png", "z@9x.org", "latest@shop.net", "a@mailinator.com",
        "a@notmailinator.com", "Joe@Shop.org",
    )
    expected = {
        "x.com": "no_at", "icon@2x.png": "file_ext", "z@9x.org": "digit", "latest@shop.net": "forbidden",
        "a@mailinator.com": "disposable", "a@notmailinator.com": "kept", "Joe@Shop.org": "kept",
    }
    assert reasons(V.filtered_verdicts(found, ["mailinator.com"])) == expected
    frame = spark.createDataFrame([("mailinator.com",)], "entry string")
    assert reasons(V.filtered_verdicts(found, frame)) == expected
    assert reasons(V.strict_verdicts(found, require_at=False))["x.com"] == "kept"
    categories = {r.value: r.category for r in V.classify_emails(found, ["mailinator.com"]).collect()}
    assert categories["latest@shop.net"] == "forbidden" and categories["a@mailinator.com"] == "disposable"
    assert categories["icon@2x.png"] == "valid"


def test_link_reasons(spark):
    found = as_values(
        spark, "url", "http://[bad", "http://", "http://www.", "http://www.web.com/a", "http://a.gov.pk",
        "http://wow.net", "http://q.com",
    )
    blocked = ["*.gov.pk", "web.com", "q.com"]
    assert reasons(V.blocklist_verdicts(found, blocked)) == {
        "http://[bad": "invalid", "http://": "invalid", "http://www.": "invalid",
        "http://www.web.com/a": "blocked_part", "http://a.gov.pk": "blocked_part",
        "http://wow.net": "kept", "http://q.com": "blocked_part",
    }
    legacy = reasons(V.blocklist_verdicts(found, blocked, legacy_www=True))
    assert legacy["http://www.web.com/a"] == "blocked_host"  # eb.com passes the first test only


def test_bounded_reasons(spark):
    keys = spark.createDataFrame(
        [("email", "demo@x.com"), ("email", "a@notmailinator.com"), ("email", "a@x.png"), ("email", "a@demo.com"),
         ("url", ""), ("url", "blog.x.com"), ("url", "demo.com")], "kind string, key string",
    )
    found = V.bounded_verdicts(keys, ["mailinator.com"], ["BLOG.*"])
    assert [r.reason for r in sorted(found.collect(), key=lambda r: (r.kind, r.key))] == [
        "kept", "disposable", "image", "forbidden", "invalid", "blocked", "kept"
    ]
    at_dot = V.bounded_verdicts(keys, ["mailinator.com"], [], dot_boundary=True)
    assert at_dot.filter("key = 'a@notmailinator.com'").first().reason == "kept"


# --- de-duplication ----------------------------------------------------------------------


@pytest.fixture
def sightings(spark):
    rows = [
        ("s2", "email", 0, "b@x"), ("s1", "email", 1, "b@x"), ("s1", "email", 0, "A@x"),
        ("s2", "email", 1, "a@x"), ("s1", "url", 0, "http://h/2"), ("s1", "url", 1, "http://h/1"),
        ("s3", "url", 0, "http://g/1"),
    ]
    return spark.createDataFrame(rows, "source_id string, kind string, pos int, value string")


def test_distinct_and_first(sightings):
    assert values(dedup.distinct_values(sightings))[:3] == ["A@x", "a@x", "b@x"]
    assert values(dedup.distinct_values(sightings, casefold=True))[:2] == ["A@x", "b@x"]
    first = {r.value: (r.source_id, r.pos) for r in dedup.first_source(sightings).collect()}
    assert first["b@x"] == ("s1", 1) and first["a@x"] == ("s2", 1)
    by_host = dedup.first_per_key(extract.urls_of(sightings), F.substring("value", 8, 1))
    assert {(r.host, r.value) for r in by_host.collect()} == {("h", "http://h/2"), ("g", "http://g/1")}
    assert S.sources_with_hits(sightings).first().n_sources == 3
    assert S.sources_with_new_hits(sightings.filter("source_id <> 's3'")).first().n_sources == 2
    assert S.sources_with_new_hits(sightings.filter("value = 'b@x'")).first().n_sources == 1


def test_differences(spark, sightings):
    old = sightings.filter("source_id = 's1'")
    assert values(dedup.new_values(dedup.distinct_values(sightings), old)) == ["a@x", "http://g/1"]
    ledger = spark.createDataFrame([("s1",), ("s1",)], "source_id string")
    assert set(values(dedup.skip_processed(sightings, ledger, "source_id"), "source_id")) == {"s2", "s3"}
    assert values(dedup.last_n(sightings, 2, "value")) == ["http://h/1", "http://h/2"]


# --- domains ------------------------------------------------------------------------------


def test_registrable_domains(spark):
    cases = {
        "a.co.uk": "a.co.uk", "b.a.co.uk": "a.co.uk", "example.net": "example.net", "www.ck": "www.ck",
        "m.www.ck": "www.ck", "x.y.ck": "x.y.ck", "y.ck": None, "ck": None, "co.uk": None,
        "localhost": None, "foo.localhost": None, "10.0.0.5": None, "com": None,
    }
    urls = as_values(spark, "url", *[f"http://u@{h.upper()}.:8080" for h in cases])
    rules = spark.createDataFrame([(r,) for r in domains.DEFAULT_RULES], "rule string")
    for given in (domains.DEFAULT_RULES, rules):
        found = domains.with_domains(urls, given)
        got = {r.value[9:-6].lower(): (r.root, r.subdomain) for r in found.collect()}
        assert got == {h: (root, h if root else None) for h, root in cases.items()}


# --- maps ----------------------------------------------------------------------------------


def test_large_groups_are_split_and_whole(spark):
    pairs = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("key"),
        F.concat(F.lit("http://"), F.col("id")).alias("url"),
    )
    rows = mapping.collect_by_key(pairs.union(pairs), ["key"], "url", "urls", 100).collect()
    hot = [r for r in rows if r.key == "hot"]
    assert len(hot) == 40 and sorted(u for r in hot for u in r.urls) == sorted(f"http://{i}" for i in range(4000))
    assert max(len(r.urls) for r in hot) < 200
    assert all(r.part == 0 and r.urls == sorted(r.urls) for r in rows if r.key != "hot")
    assert sum(len(r.urls) for r in rows) == 5000


def test_map_rows(spark):
    urls = spark.createDataFrame(
        [("url", "http://b.x.com", "x.com"), ("url", "http://a.x.com", "x.com"), ("url", "http://10.0.0.5", None)],
        "kind string, value string, root string",
    )
    found = mapping.url_map(urls, "root")
    assert [tuple(r) for r in mapping.mapping_csv_rows(found).collect()] == [("x.com", 0, "http://a.x.com; http://b.x.com")]
    assert mapping.mapping_json_rows(found).first().json == '["http://a.x.com","http://b.x.com"]'


# --- cells and summaries ----------------------------------------------------------------------


def test_cells(spark):
    df = spark.createDataFrame(
        [(1, "a@b.co", 5, None), (2, None, 6, "see c@d.co")], "id int, x string, n int, `y.z` string"
    )
    found = cells.cells_of_tables({"t": (df, "id"), "numbers": (df.select("id", "n"), "id")})
    assert {(r.source_id, r.column, r.text) for r in found.collect()} == {
        ("t-1", "x", "a@b.co"), ("t-2", "y.z", "see c@d.co")
    }


def test_hits_and_metrics(spark, sightings, corpus):
    hits = {(r.source_id, r.kind): r["values"] for r in S.hits_per_source(sightings).collect()}
    assert hits[("s1", "email")] == ["A@x", "b@x"] and len(hits) == 4
    metrics = S.run_metrics(corpus("a@b.co http://x.com", None, "a@b.co"), extract.STRICT_EMAILS, extract.SEGMENTED_URLS)
    assert {r.metric: r.value for r in metrics.collect()} == {"texts": 3, "emails": 1, "urls": 1}


def test_reasons_partition_the_candidates(spark, corpus):
    from contactmine.plans import variants

    texts = [f"x{i}@{d}.com http://{d}.com/{i} test{i}@{d}.net" for i in range(40) for d in ("a", "web", "mailinator")]
    found = variants.advanced_candidates(corpus(*texts), ["mailinator.com"], ["web.com"])
    rows = found.collect()
    assert len(rows) == len({(r.kind, r.value) for r in rows}) == 360
    kept = variants.advanced(corpus(*texts), ["mailinator.com"], ["web.com"])
    assert {(r.kind, r.value) for r in kept.collect()} == {(r.kind, r.value) for r in rows if r.reason == "kept"}
    totals = {r.kind: (r.n_found, r.n_kept) for r in S.totals(found).collect()}
    assert totals == {"email": (240, 80), "url": (120, 80)}
