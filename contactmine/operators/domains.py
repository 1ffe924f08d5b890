"""Registrable domain and subdomain of hosts, by public-suffix rules.

Rules follow the public-suffix notation: ``com``, ``co.uk``, ``*.ck`` (any label
under ck), ``!www.ck`` (exception to it).  DEFAULT_RULES covers common endings only;
load a full list for real use (``without_root`` shows what it misses), as a sequence (tested against in-memory sets inside
the expression: no join, no shuffle) or as a DataFrame ``[rule]`` (equality join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.functions.text import once
from contactmine.functions.urls import url_host
from contactmine.operators.settle import settle

DEFAULT_RULES = [
    "com", "net", "org", "info", "biz", "edu", "gov", "mil", "int", "io",
    "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "de", "fr", "es", "it", "nl",
    "au", "com.au", "net.au", "org.au", "jp", "co.jp", "in", "co.in",
    "br", "com.br", "pk", "com.pk", "gov.pk", "us", "ca", "ck", "*.ck", "!www.ck",
]

# An exception outranks every other rule; among those the one with most labels wins.
_EXCEPTION = 1 << 20
_ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$"


def _n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _last_labels(host: Column, n: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -n)


def _sizes(host: Column) -> Column:
    return F.sequence(F.lit(1), _n_labels(host))


def _named(host: Column) -> Column:
    """The host can have a root: it is no IP address."""
    return (host != "") & ~host.rlike(_ADDRESS)


def _root_from_score(host: Column, score: Column) -> Column:
    """``score`` is the suffix's number of labels, plus _EXCEPTION for an exception."""
    size = F.when(score > _EXCEPTION // 2, score - _EXCEPTION).otherwise(score)
    return F.when(_n_labels(host) > size, _last_labels(host, size + 1))


def root_domain(host: Column, rules: Sequence[str]) -> Column:
    """One label and the public suffix; null for an IP or where no rule fits."""
    exact = [r for r in rules if r[:1] not in ("*", "!")]
    any_label = [r[2:] for r in rules if r.startswith("*.")]
    exceptions = [r[1:] for r in rules if r.startswith("!")]

    def score(name: Column, n: Column) -> Column:
        ending = _last_labels(name, n)
        chain = F.when(ending.isin(exact), n)
        if any_label:
            chain = F.when(ending.isin(any_label) & (_n_labels(name) > n), n + 1).when(
                ending.isin(exact), n
            )
        if exceptions:
            chain = F.when(ending.isin(exceptions), n - 1 + _EXCEPTION).otherwise(chain)
        return chain

    def root(name: Column) -> Column:
        best = F.array_max(F.transform(_sizes(name), lambda n: score(name, n)))
        return F.when(_named(name), once(best, lambda s: _root_from_score(name, s)))

    return once(host, root)


def match_rules(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Distinct ``[host, root]`` of the hosts that have a root, by an equality join."""
    name = F.col("host")
    distinct = hosts.select(F.col(host).alias("host")).filter(_named(name)).distinct()

    def candidates(n: Column) -> Column:
        ending = _last_labels(name, n)
        return F.array(
            F.struct(n.alias("score"), ending.alias("rule")),
            F.struct((n + 1).alias("score"), F.concat(F.lit("*."), ending).alias("rule")),
            F.struct(
                (n - 1 + _EXCEPTION).alias("score"), F.concat(F.lit("!"), ending).alias("rule")
            ),
        )

    matched = (
        distinct.select("host", F.inline(F.flatten(F.transform(_sizes(name), candidates))))
        .join(rules.select("rule"), "rule")
        .filter((F.col("score") <= _n_labels(name)) | (F.col("score") > _EXCEPTION // 2))
    )
    best = matched.groupBy("host").agg(F.max("score").alias("score"))
    return best.select("host", _root_from_score(name, F.col("score")).alias("root")).filter(
        F.col("root").isNotNull()
    )


def with_domains(
    urls: DataFrame, rules: Sequence[str] | DataFrame, column: str = "value"
) -> DataFrame:
    """Add ``root`` and ``subdomain`` (the whole host), null where there is no root."""
    hosted = urls.withColumn("host", url_host(F.col(column)))
    if isinstance(rules, DataFrame):
        hosted = settle(hosted)  # read by the join and by the bypass of rows without a host
        named = hosted.filter(F.col("host") != "")
        rooted = named.join(match_rules(named, rules), "host", "left").unionByName(
            hosted.filter(F.col("host") == "").withColumn("root", F.lit(None).cast("string"))
        )
    else:
        rooted = hosted.withColumn("root", root_domain(F.col("host"), rules))
    return rooted.withColumn(
        "subdomain", F.when(F.col("root").isNotNull(), F.col("host"))
    ).drop("host")


def without_root(urls: DataFrame) -> DataFrame:
    """``[ending, n_values]``: values that no rule gives a root, by the last label of their
    host; '' where the host is missing or an IP address."""
    host = url_host(F.col("value"))
    ending = F.when(_named(host), _last_labels(host, F.lit(1))).otherwise("")
    rootless = urls.filter(F.col("root").isNull())
    return rootless.groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("n_values"))
