"""Every operator as a query over the given tables: ``name → (spark, folder) → DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmine.functions import emails as E
from contactmine.functions import text as T
from contactmine.functions import urls as U
from contactmine.operators import cells, dedup, domains, extract, lists, liveness, mapping, matching
from contactmine.operators import summary as S
from contactmine.operators import verdicts as V
from contactmine.operators.domains import DEFAULT_RULES
from contactmine.plans import tables as D
from contactmine.plans import variants
from contactmine.sources.files import compatible, include_exclude

Query = Callable[[SparkSession, str], DataFrame]

CUSTOM_EMAIL = r"[A-Za-z0-9._]+@([a-z0-9.-]+\.[a-z]{2,})"
CUSTOM_URL = r"https?://[a-z0-9.-]+(?::[0-9]+)?/[^ ""<>]*"

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- inputs shared by several queries ---------------------------------------------


def _found(spark: SparkSession, sf: str, *finders: extract.Finder) -> DataFrame:
    return extract.extract_contacts(D.corpus(spark, sf), *finders)


def _values(spark: SparkSession, sf: str, *finders: extract.Finder) -> DataFrame:
    return dedup.distinct_values(_found(spark, sf, *finders))


def _strict(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct cleaned strict addresses ``[kind, value]``."""
    return _values(spark, sf, extract.CLEAN_EMAILS)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf, extract.SEGMENTED_URLS)


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct base URLs ``[kind, value, n_texts, root, subdomain]``."""
    return extract.urls_of(variants.service_values(D.corpus(spark, sf), DEFAULT_RULES))


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned strict addresses and segmented links with their sources."""
    return _found(spark, sf, extract.CLEAN_EMAILS, extract.SEGMENTED_URLS)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return variants.advanced_candidates(D.corpus(spark, sf), D.DISPOSABLE, D.BLOCKED)


def value() -> Column:
    return F.col("value")


# --- scans ---------------------------------------------------------------------------


@query
def ext_allowlist(spark, sf):
    return compatible(D.files(spark, sf)).select("path", T.file_extension(F.col("path")).alias("ext"))


@query
def ext_include_exclude(spark, sf):
    return include_exclude(D.files(spark, sf), ["TXT", ".html", "gz"], [".Gz"]).select("path")


@query
def corpus_from_column(spark, sf):
    corpus = D.corpus(spark, sf)
    return corpus.select("source_id", F.length("text").cast("bigint").alias("n_chars"))


@query
def cell_scan(spark, sf):
    found = cells.cells(D.table(spark, sf, "pages"), "page_id", "pages")
    finders = (extract.LOOSE_EMAILS, extract.SEGMENTED_URLS)
    return extract.extract_contacts(found, *finders, keep=("source_id", "column")).drop("pos")


@query
def cell_scan_multi_table(spark, sf):
    keys = {
        "pages": "page_id", "documents": "doc_id", "customer": "c_custkey",
        "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey",
        "region": "r_regionkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
        "events": "event_id", "conversations": "conv_id", "benchmark": "item_id",
    }
    found = cells.cells_of_tables({t: (D.table(spark, sf, t), k) for t, k in keys.items()})
    finders = (extract.LOOSE_EMAILS, extract.SEGMENTED_URLS)
    return extract.extract_contacts(
        found, *finders, keep=("table", "source_id", "column")
    ).drop("pos")


@query
def skip_processed(spark, sf):
    cards = D.cards(spark, sf)
    return dedup.skip_processed(cards, D.ledger(spark, sf), "source_id").select("source_id")


@query
def split_list(spark, sf):
    parts = T.split_list(F.col("text"))
    return D.documents(spark, sf).select(
        "source_id", F.size(parts).cast("bigint").alias("n_parts"),
        F.array_join(parts, "|").alias("parts"),
    )


# --- finders -------------------------------------------------------------------------


@query
def email_extract_strict(spark, sf):
    return _found(spark, sf, extract.STRICT_EMAILS).select("source_id", "value")


@query
def email_extract_bounded(spark, sf):
    return _found(spark, sf, extract.BOUNDED_EMAILS).select("source_id", "value")


@query
def email_extract_loose(spark, sf):
    return _found(spark, sf, extract.LOOSE_EMAILS).select("source_id", "value")


@query
def email_extract_custom(spark, sf):
    return _found(spark, sf, extract.custom_email_finder(CUSTOM_EMAIL, 1)).select(
        "source_id", "value"
    )


@query
def url_extract_segmented(spark, sf):
    return _found(spark, sf, extract.SEGMENTED_URLS).select("source_id", "value")


@query
def url_extract_overlapping(spark, sf):
    return _found(spark, sf, extract.OVERLAPPING_URLS).select("source_id", "value")


@query
def url_extract_service(spark, sf):
    return _found(spark, sf, extract.SERVICE_URLS).select("source_id", "value")


@query
def url_extract_custom(spark, sf):
    return _found(spark, sf, extract.custom_url_finder(CUSTOM_URL)).select("source_id", "value")


@query
def contacts_extract(spark, sf):
    found = _found(spark, sf, extract.STRICT_EMAILS, extract.SEGMENTED_URLS)
    return found.withColumn("pos", F.col("pos").cast("bigint"))


# --- scalar functions ------------------------------------------------------------------


@query
def email_clean(spark, sf):
    values = _values(spark, sf, extract.STRICT_EMAILS)
    return values.select("value", E.clean_email(value()).alias("cleaned"))


@query
def email_parts(spark, sf):
    return _values(spark, sf, extract.LOOSE_EMAILS).select(
        "value",
        E.email_local(value()).alias("local"),
        E.email_domain(value()).alias("domain"),
        E.bare_domain(E.email_domain(value())).alias("bare_domain"),
    )


@query
def email_idna(spark, sf):
    """Addresses as they are, and under labels of other scripts."""
    values = _values(spark, sf, extract.LOOSE_EMAILS)
    host = F.substring_index("value", "@", -1)
    local = F.substr("value", F.lit(1), F.length("value") - F.length(host))
    labels = F.explode(F.array(F.lit(""), *map(F.lit, D.LABELS))).alias("label")
    values = values.select(local.alias("local"), host.alias("host"), labels).select(F.concat("local", "label", "host").alias("value"))
    return values.select("value", E.idna_email(value()).alias("idna"))


@query
def url_netloc(spark, sf):
    return _links(spark, sf).select("value", U.netloc(value()).alias("netloc"))


@query
def url_host_slash(spark, sf):
    values = _values(spark, sf, extract.OVERLAPPING_URLS)
    return values.select("value", U.host_to_slash(value()).alias("host"))


@query
def url_strip_www(spark, sf):
    host = F.lower(U.netloc(value()))
    return _links(spark, sf).select(
        "value", U.strip_www(host).alias("host"), U.strip_www_chars(host).alias("legacy_host")
    )


@query
def url_base(spark, sf):
    valid = _values(spark, sf, extract.SERVICE_URLS).filter(U.is_valid_url(value()))
    return valid.select("value", U.base_url(value()).alias("base_url"))


@query
def url_root_domain(spark, sf):
    return _bases(spark, sf).select("value", "root")


@query
def url_root_domain_join(spark, sf):
    """The same by an equality join with a rule table."""
    rules = D.rules(spark)
    values = variants.service_values(D.corpus(spark, sf), rules=rules)
    return extract.urls_of(values).select("value", "root")


@query
def urls_without_root(spark, sf):
    """Base URLs that the rules give no root, by the ending of their host."""
    return domains.without_root(_bases(spark, sf))


@query
def url_subdomain(spark, sf):
    return _bases(spark, sf).select("value", "subdomain")


@query
def normalize_blocklist(spark, sf):
    entry = F.col("entry")
    raw = D.raw_list_lines(spark, sf).withColumnRenamed("line", "entry")
    return raw.select("entry", lists.normalize_entry(entry).alias("normalized")).filter(
        F.col("normalized") != ""
    ).distinct()


@query
def list_entries(spark, sf):
    return lists.list_entries(D.raw_list_lines(spark, sf), "line")


@query
def wildcard_to_regex(spark, sf):
    entries = lists.wildcard_entries(D.raw_list_lines(spark, sf), "line")
    return entries.select("entry", matching.wildcard_pattern(F.col("entry")).alias("pattern"))


@query
def throughput(spark, sf):
    """Events of each user per second between the first and the last."""
    seen = D.table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.unix_micros(F.max("ts").cast("timestamp_ltz"))
         - F.unix_micros(F.min("ts").cast("timestamp_ltz"))).alias("elapsed_us"),
    )
    return seen.select(
        "user_id", "n_events", T.rate(F.col("n_events") * 1e6, F.col("elapsed_us")).alias("rate")
    )


# --- filters -----------------------------------------------------------------------------


@query
def email_not_file(spark, sf):
    return _strict(spark, sf).filter(~E.looks_like_file(value())).select("value")


@query
def email_not_image(spark, sf):
    values = _values(spark, sf, extract.BOUNDED_EMAILS)
    return values.filter(~E.looks_like_image(value())).select("value")


@query
def email_no_digit_domain(spark, sf):
    return _strict(spark, sf).filter(~E.digit_after_at(value())).select("value")


@query
def email_forbidden_any(spark, sf):
    forbidden = E.has_forbidden_word(value())
    return _strict(spark, sf).filter(~forbidden).select("value")


@query
def email_forbidden_local(spark, sf):
    values = _values(spark, sf, extract.BOUNDED_EMAILS)
    return values.filter(~E.has_forbidden_local(value())).select("value")


@query
def email_disposable_exact(spark, sf):
    key = E.bare_domain(E.email_domain(value()))
    flagged = matching.flag_equal(_strict(spark, sf), key, D.DISPOSABLE, "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def email_disposable_exact_join(spark, sf):
    key = E.bare_domain(E.email_domain(value()))
    flagged = matching.flag_equal(_strict(spark, sf), key, D.segment_domains(spark, sf), "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def email_disposable_suffix(spark, sf):
    values = _values(spark, sf, extract.BOUNDED_EMAILS)
    flagged = matching.flag_suffix(values, E.email_domain(value()), D.DISPOSABLE, "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def email_disposable_suffix_join(spark, sf):
    values = _values(spark, sf, extract.BOUNDED_EMAILS)
    entries = D.segment_domains(spark, sf)
    flagged = matching.flag_suffix(values, E.email_domain(value()), entries, "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def email_disposable_suffix_at_dot(spark, sf):
    values = _values(spark, sf, extract.LOOSE_EMAILS)
    flagged = matching.flag_suffix(
        values, E.email_domain(value()), D.segment_domains(spark, sf), "hit", dot_boundary=True
    )
    return flagged.select("value", "hit")


@query
def url_block_substring(spark, sf):
    host = U.strip_www(F.lower(U.netloc(value())))
    entries = lists.substring_entries(D.BLOCKED)
    flagged = matching.flag_substring(_links(spark, sf), host, entries, "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def url_block_substring_legacy(spark, sf):
    host = U.strip_www_chars(F.lower(U.netloc(value())))
    entries = lists.substring_entries(D.BLOCKED)
    flagged = matching.flag_substring(_links(spark, sf), host, entries, "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def url_block_substring_join(spark, sf):
    host = U.strip_www(F.lower(U.netloc(value())))
    entries = lists.substring_entries(D.page_blocklist(spark, sf))
    flagged = matching.flag_substring(_links(spark, sf), host, entries, "hit")
    return flagged.select("value", "hit")


@query
def url_block_wildcard(spark, sf):
    values = _values(spark, sf, extract.OVERLAPPING_URLS)
    flagged = matching.flag_wildcard(values, U.host_to_slash(value()), D.WILDCARDS, "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def url_block_wildcard_join(spark, sf):
    values = _values(spark, sf, extract.OVERLAPPING_URLS)
    entries = D.page_blocklist(spark, sf)
    flagged = matching.flag_wildcard(values, U.host_to_slash(value()), entries, "hit")
    return flagged.select("value", "hit")


@query
def url_block_exact(spark, sf):
    host = U.strip_www(F.lower(U.netloc(value())))
    flagged = matching.flag_equal(_links(spark, sf), host, D.BLOCKED, "hit")
    return flagged.filter(~F.col("hit")).select("value")


@query
def url_valid(spark, sf):
    return _links(spark, sf).filter(U.is_valid_url(value())).select("value")


@query
def email_classify(spark, sf):
    return V.classify_emails(_strict(spark, sf), D.DISPOSABLE).select("value", "category")


@query
def email_reason(spark, sf):
    return V.filtered_verdicts(_strict(spark, sf), D.DISPOSABLE).select("value", "reason")


@query
def url_reason(spark, sf):
    return V.blocklist_verdicts(_links(spark, sf), D.BLOCKED).select("value", "reason")


@query
def url_live_only(spark, sf):
    return liveness.live_only(_bases(spark, sf).select("value"), D.status(spark, sf))


@query
def url_dead_log(spark, sf):
    return liveness.dead_log(_bases(spark, sf).select("value"), D.status(spark, sf))


# --- distinct, first sightings, differences ------------------------------------------------


@query
def emails_distinct(spark, sf):
    return _values(spark, sf, extract.STRICT_EMAILS).select("value")


@query
def emails_distinct_casefold(spark, sf):
    found = _found(spark, sf, extract.LOOSE_EMAILS)
    return dedup.distinct_values(found, casefold=True).select("value")


@query
def urls_distinct(spark, sf):
    return _links(spark, sf).select("value")


@query
def url_one_per_host(spark, sf):
    found = _found(spark, sf, extract.OVERLAPPING_URLS)
    return dedup.first_per_key(found, U.host_to_slash(value()))


@query
def first_source(spark, sf):
    found = dedup.first_source(_contacts(spark, sf))
    return found.select("kind", "value", "source_id")


@query
def emails_union_sources(spark, sf):
    found = [
        extract.extract_contacts(part(spark, sf), extract.LOOSE_EMAILS)
        for part in (D.cards, D.documents, D.page_html)
    ]
    return dedup.union_values(*found).select("value")


def _exported(spark, sf):
    # contacts, not texts, meet the ledger
    found = extract.extract_contacts(D.cards(spark, sf), extract.STRICT_EMAILS)
    return found.join(D.ledger(spark, sf), "source_id", "left_semi")


@query
def new_values_only(spark, sf):
    values = _values(spark, sf, extract.STRICT_EMAILS).select("value")
    return dedup.new_values(values, _exported(spark, sf))


@query
def new_values_sorted(spark, sf):
    found = _found(spark, sf, extract.STRICT_EMAILS).select("source_id", "value")
    return dedup.new_values(found, _exported(spark, sf)).select("source_id", "value").orderBy(
        "source_id", "value"
    )


@query
def sorted_values(spark, sf):
    return _values(spark, sf, extract.LOOSE_EMAILS).select("value").orderBy("value")


@query
def recent_events(spark, sf):
    events = D.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return dedup.last_n(events, 50, "ts", "event_id").select("event_id", "event_type")


# --- maps ----------------------------------------------------------------------------------


def _joined(url_map: DataFrame) -> DataFrame:
    return mapping.mapping_csv_rows(url_map)


@query
def map_root_urls(spark, sf):
    return _joined(variants.service_map(D.corpus(spark, sf), "root", rules=DEFAULT_RULES))


@query
def map_root_urls_split(spark, sf):
    """Groups over three URLs go to several rows."""
    return _joined(variants.service_map(D.corpus(spark, sf), "root", rules=DEFAULT_RULES, max_per_row=3))


@query
def map_subdomain_urls(spark, sf):
    return _joined(variants.service_map(D.corpus(spark, sf), "subdomain", rules=DEFAULT_RULES))


@query
def map_all_urls(spark, sf):
    return _joined(variants.service_map(D.corpus(spark, sf), "all", rules=DEFAULT_RULES))


@query
def mapping_json(spark, sf):
    return mapping.mapping_json_rows(variants.service_map(D.corpus(spark, sf), "root", rules=DEFAULT_RULES))


@query
def mapping_csv(spark, sf):
    rows = mapping.mapping_csv_rows(variants.service_map(D.corpus(spark, sf), "subdomain", rules=DEFAULT_RULES))
    return rows.select(F.col("key").alias("Domain/Subdomain"), "part", F.col("urls").alias("URLs"))


@query
def urls_mode_root(spark, sf):
    return dedup.smallest_per_key(_bases(spark, sf), "root").select("root", "value")


@query
def urls_mode_subdomain(spark, sf):
    return dedup.smallest_per_key(_bases(spark, sf), "subdomain").select("subdomain", "value")


@query
def urls_mode_all(spark, sf):
    return _bases(spark, sf).select("value")


# --- summaries -----------------------------------------------------------------------------


@query
def summary_totals(spark, sf):
    return S.totals(_verdicts(spark, sf))


@query
def summary_by_reason(spark, sf):
    counted = S.count_by_reason(V.filtered_verdicts(_strict(spark, sf), D.DISPOSABLE))
    return counted.select("reason", "n_values")


@query
def url_summary_by_reason(spark, sf):
    counted = S.count_by_reason(V.blocklist_verdicts(_links(spark, sf), D.BLOCKED))
    return counted.select("reason", "n_values")


@query
def sources_with_hits(spark, sf):
    return S.sources_with_hits(_contacts(spark, sf))


@query
def sources_with_new_hits(spark, sf):
    return S.sources_with_new_hits(_contacts(spark, sf))


@query
def file_counts(spark, sf):
    return S.file_counts(D.files(spark, sf))


@query
def metrics_table(spark, sf):
    counters = S.run_metrics(
        D.corpus(spark, sf), extract.STRICT_EMAILS, extract.SEGMENTED_URLS
    )
    return counters


@query
def hits_per_source(spark, sf):
    hits = S.hits_per_source(_contacts(spark, sf))
    return hits.select("source_id", "kind", "part", F.array_join("values", " ").alias("values"))


# --- the five variants -------------------------------------------------------------------------


@query
def contacts_simple(spark, sf):
    return variants.simple(D.corpus(spark, sf))


@query
def contacts_filtered(spark, sf):
    return variants.filtered(D.corpus(spark, sf), D.DISPOSABLE)


@query
def contacts_advanced(spark, sf):
    return variants.advanced(D.corpus(spark, sf), D.DISPOSABLE, D.BLOCKED)


@query
def contacts_advanced_join(spark, sf):
    """The same with lists that are tables, and the reasons of all candidates."""
    return variants.advanced_candidates(D.corpus(spark, sf), D.segment_domains(spark, sf), D.page_blocklist(spark, sf))


@query
def contacts_advanced_summary(spark, sf):
    return S.count_by_reason(_verdicts(spark, sf))


@query
def contacts_bounded(spark, sf):
    return variants.bounded(D.corpus(spark, sf), D.DISPOSABLE, D.WILDCARDS)


@query
def contacts_service_root(spark, sf):
    return variants.service(D.corpus(spark, sf), "root", rules=DEFAULT_RULES)


@query
def contacts_service_subdomain(spark, sf):
    return variants.service(D.corpus(spark, sf), "subdomain", rules=DEFAULT_RULES)


@query
def contacts_service_all(spark, sf):
    return variants.service(D.corpus(spark, sf), "all", rules=DEFAULT_RULES)


@query
def contacts_service_live(spark, sf):
    """All base URLs that answered, of the sources an earlier run did not see."""
    return variants.service(
        D.corpus(spark, sf), "all", rules=DEFAULT_RULES, status=D.status(spark, sf), ledger=D.ledger(spark, sf)
    )
