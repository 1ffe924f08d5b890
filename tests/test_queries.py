"""Registered queries against their SQL twins, and the shape of their plans."""

import re

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from __spark_entry__ import entry
from contactmine.plans.catalog import QUERIES
from contactmine.plans.oracles import ORACLES
from contactmine.operators import matching

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    _, difference = compare(spark, connection, FOLDER, QUERIES[name], ORACLES[name])
    assert not difference


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_product_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert word not in text
    # only the one-row totals of whole runs meet in one task
    if "SinglePartition" in text:
        assert name in {
            "sources_with_hits", "sources_with_new_hits", "file_counts", "metrics_table", "recent_events"
        }


@pytest.mark.parametrize(
    "name, exchanges",
    [
        ("email_extract_strict", 0), ("contacts_extract", 0), ("contacts_simple", 1),
        ("contacts_filtered", 1), ("contacts_advanced", 1), ("contacts_bounded", 1),
        ("contacts_service_all", 1), ("contacts_service_root", 2), ("first_source", 1),
    ],
)
def test_shuffles(spark, name, exchanges):
    frame = QUERIES[name](spark, FOLDER)
    assert len(re.findall(r"\bExchange\b", plan(frame))) == exchanges
    assert plan(frame).count("FileScan parquet") == 6  # one scan of each text


def test_guard_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["contacts_simple"](spark, FOLDER))
    assert "StringContains(text,@)" in text and "StringContains(html,@)" in text
    assert "ReadSchema: struct<html:string>" in text


def test_grouping_finds_its_pairs_once(spark):
    frame = QUERIES["map_root_urls_split"](spark, FOLDER)
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet") == 6


def test_short_lists_need_no_join(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("host"))
    for flag in (matching.flag_equal, matching.flag_suffix, matching.flag_substring, matching.flag_wildcard):
        assert "Join" not in plan(flag(df, F.col("host"), ["1", "2"], "hit"))
