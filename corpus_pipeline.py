"""Training-data pipeline over ``documents``: five stages, each over all that the one before kept.

Every stage judges rows, not ids: where rows share a doc_id or have none, each gets a number of its
own, in order of doc_id, under which the stage's operator runs and its verdicts are applied. So
copies and leaks without doc_id leave too, and a clean row never leaves with another of its
doc_id. Null texts count as empty and have no letter, so the first stage rejects them. Extra
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmine.llm import bpe, decontamination, exact, language, simhash
from contactmine.llm.common import numbered, saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


KEY = "_pipeline_row"
SURE = 0.35  # the least score of a language prediction that counts as one


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with KEY, and ``[doc_id, text]`` with KEY as doc_id."""
    rows = numbered(docs, KEY)
    return rows, rows.select(F.col(KEY).alias("doc_id"), "text")


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    rejected = saved(rejected.select(F.col("doc_id").alias(KEY)).distinct(), "rejected")
    return rows.join(rejected, KEY, "left_anti").drop(KEY)


def with_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language the model tells: those without a letter go, and those for which no language
    gets SURE of the probability. If nothing could be learned, only the former go."""
    rows, texts = _keyed(docs)
    model = language.train(docs.where(~language.held_out()).select("doc_id", "text", "lang"))
    unsure = (F.col("score") < SURE) & (F.col("lang_pred") != language.NO_MODEL)
    return _without(rows, language.identify(texts, model).where(unsure))


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    rows, texts = _keyed(docs)
    return _without(rows, exact.exact_duplicates(texts).where("not kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of a group of near copies the document with the smallest doc_id stays."""
    rows, texts = _keyed(docs)
    return _without(rows, simhash.near_duplicates(texts).where("doc_id <> component_id"))


def without_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no test item."""
    rows, texts = _keyed(docs)
    return _without(rows, decontamination.contaminated(texts, table(spark, folder, "benchmark")))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language", with_language),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("byte-level BPE", encoded),
]
ORACLE_SQL = None  # a learned language model, fingerprints and tokens are out of SQL's reach


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, folder)
