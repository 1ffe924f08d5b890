"""The given tables, and the corpora and lists the registered queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmine.operators.domains import DEFAULT_RULES
from contactmine.sources.files import corpus_from_column

# Contact cards written from the customer table; both Spark SQL and ANSI SQL read this text.
CARD_SOURCE = "'cust-' || CAST(c_custkey AS VARCHAR(20))"
CARD_TEXT = """
 'Contact ' || CASE WHEN c_custkey % 7 = 0 THEN 'test.' ELSE '' END || 'acct' || CAST(c_custkey % 100 AS VARCHAR(20)) || '@' ||
 CASE c_custkey % 6 WHEN 0 THEN lower(c_mktsegment) || '.com' WHEN 1 THEN lower(c_mktsegment) || '.net'
  WHEN 2 THEN 'mail.' || lower(c_mktsegment) || '.co.uk' WHEN 3 THEN 'mailinator.com' WHEN 4 THEN 'sub.tempmail.com'
  ELSE lower(c_mktsegment) || '.example' END ||
 CASE c_custkey % 9 WHEN 0 THEN ' see logo@2x.png and pic.a@scan.pdf'
  WHEN 1 THEN ' reply to Joe.B@Shop-One.org.' WHEN 2 THEN ' _@x.com _jo_@x.com'
  WHEN 3 THEN ' visit http://www.web.com/a?b=1http://m.' || lower(c_mktsegment) || '.co.uk/x).'
  WHEN 4 THEN ' https://api.' || lower(c_mktsegment) || '.com:8080/p/$q?z=1, http://10.0.0.5/adm http://localhost/'
  WHEN 5 THEN ' (https://u@' || lower(c_mktsegment) || '.gov.pk/path;v=1) "http://wow.' || lower(c_mktsegment) || '.net"'
  WHEN 6 THEN ' http://[bad/x http://a..b/c http://x'
  WHEN 7 THEN ' noreply@' || lower(c_mktsegment) || '.com latest@' || lower(c_mktsegment) || '.net'
  ELSE ' or z@9x.org' END
"""

# File names for the documents, so that file operators have paths to work on.
FILE_PATH = """
 source || '/' || lang || '/' || CAST(doc_id AS VARCHAR(20)) ||
 CASE WHEN n_chars < 300 THEN '.TXT' WHEN n_chars < 1000 THEN '.html' WHEN n_chars < 3000 THEN '.tar.gz'
  WHEN n_chars < 6000 THEN '.exe' WHEN n_chars < 9000 THEN '' ELSE '.pdf' END
"""

DISPOSABLE = ["mailinator.com", "tempmail.com"]
BLOCKED = ["*.gov.pk", ".org", "spam-farm", "web.com"]
WILDCARDS = ["*.gov.pk", "blog.*", "spam-farm*"]


# Declared, so that building a plan reads no file footers.
SCHEMAS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.expr(CARD_SOURCE).alias("source_id"), F.expr(CARD_TEXT).alias("text")
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_from_column(table(spark, sf, "documents"), "doc_id", "text", "doc-")


def page_html(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_from_column(table(spark, sf, "pages"), "page_id", "html", "html-")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_from_column(table(spark, sf, "pages"), "page_id", "url", "page-")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat_ws("-", F.lit("conv"), "conv_id", "turn")
    return table(spark, sf, "conversations").select(source.alias("source_id"), "text")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_from_column(table(spark, sf, "benchmark"), "item_id", "text", "bench-")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of every table."""
    parts = [f(spark, sf) for f in (cards, documents, page_html, page_links, turns, benchmark)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.expr(FILE_PATH).alias("path"), "n_chars")


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of an earlier run: the cards of customers with an urgent finished order."""
    orders = table(spark, sf, "orders").filter(
        "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"
    )
    return orders.select(
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("source_id")
    ).distinct()


def status(spark: SparkSession, sf: str) -> DataFrame:
    """Probe results ``[base_url, status]`` of the page hosts: encrypted ones answer."""
    base = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    return table(spark, sf, "pages").select(
        base.alias("base_url"), F.when(F.startswith("url", F.lit("https://")), 200).otherwise(404).alias("status")
    ).distinct()


def segment_domains(spark: SparkSession, sf: str) -> DataFrame:
    """A disposable list as long as the customer table has market segments, ``[entry]``."""
    return table(spark, sf, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit(".net")).alias("entry")
    ).distinct()


def page_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    """A blocklist ``[entry]`` with a wildcard entry for the host of every linked page section."""
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    return (
        table(spark, sf, "pages").filter(F.contains("url", F.lit("#")))
        .select(F.concat(F.lit("*."), F.upper(F.substring_index(host, ".", -3))).alias("entry"))
        .distinct()
    )


# Lines as they stand in a list file: blanks, comments, odd spacing and case.
LIST_LINE = """
 CASE WHEN url LIKE 'https%' THEN '# ' || url WHEN url LIKE '%#%' THEN '  '
  ELSE '  *.' || upper(substring(url, 8)) || ' ' || chr(9) END
"""


def raw_list_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.expr(LIST_LINE).alias("line"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in DEFAULT_RULES], "rule string")

# Host labels and what they are in ASCII; the last two have no such form.
LABELS = {
    "bücher.": "xn--bcher-kva.",
    "straße.": "xn--strae-oqa.",
    "βόλος.": "xn--nxasmm1c.",
    "例え.": "xn--r8jz45g.",
    "مثال.": "xn--mgbh0fb.",
    "हिन्दी.": "xn--j2bd4cyah0f.",
    "Bücher.": None,
    "ﬁx.": None,
}
