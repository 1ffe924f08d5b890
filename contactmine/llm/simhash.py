"""Near-duplicates by SimHash and multi-index hashing.

Fingerprints are made in Python, row by row in Arrow batches; all that follows is joins over
distinct fingerprints. A fingerprint has two segments of 32 bits. Of three differing bits at
most one lies in one of the segments, so two linked fingerprints agree in a segment up to one
bit: each looks itself up under its segment's own value and under all values at one bit's
distance, and the complete distance is verified in the join. Only zero bits are flipped, for of
two segments that differ in a bit one has a zero there, so every link is met from one side.

Values of a segment that many fingerprints share (``crowded``) are looked up together with a
16-bit quarter of the other segment, again up to one bit: three differing bits leave one of
the two quarters with at most one. That way is exact too and reads no list of all members.

Spark takes an exploded table to be as large as the one it comes from, and a written one to be
as large as its compressed files. Joins whose sides grow with the documents are therefore
hinted as merge joins: none of them is sent to the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import saved, texts
from contactmine.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
CROWDED = 256
PART = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()  # of bytes: A-Z alone, and white space of ASCII alone
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    last = (ends[shingle - 1:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), PART):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[i:i + PART], last[i:i + PART])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        signed = np.array(found, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``[doc_id, fp]``, fp as a signed long, for every row."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def _flips(value: Column, bits: int, zeros_only: bool) -> Column:
    """The value and those at one bit's distance."""
    places = F.sequence(F.lit(0), F.lit(bits - 1))
    if zeros_only:
        places = F.filter(places, lambda i: F.getbit(value, i) == 0)
    one = F.lit(1).cast("bigint")
    return F.concat(F.array(value), F.transform(places, lambda i: value.bitwiseXOR(F.call_function("shiftleft", one, i))))


def _segments() -> Column:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), high.alias("value"), low.alias("other")),
        F.struct(F.lit(1).alias("seg"), low.alias("value"), high.alias("other")),
    ))


def _quarters(df: DataFrame, flipped: bool) -> DataFrame:
    quarter = [F.shiftrightunsigned("other", 16), F.col("other").bitwiseAND(F.lit(0xFFFF))]
    made = [F.struct(F.lit(i).alias("part"), (_flips(q, 16, False) if flipped else F.array(q)).alias("qs")) for i, q in enumerate(quarter)]
    wide = df.select("*", F.explode(F.array(*made)).alias("x")).select("*", "x.part", F.explode("x.qs").alias("q"))
    return wide.drop("x")


def _verified(index: DataFrame, probes: DataFrame, on: list[str], distance: int) -> DataFrame:
    """Links between index and probes; equal segments are met from both sides, so once."""
    a, b = index.select(*on, F.col("fp").alias("a")), probes.select(*on, F.col("fp").alias("b"), "own")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    same = [F.col(f"i.{c}") == F.col(f"p.{c}") for c in on]
    return a.alias("i").join(b.alias("p").hint("merge"), [*same, near, once]).select("a", "b")


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``[a, b]``: every two distinct fingerprints ``[fp]`` with at most three differing bits."""
    index = saved(fps.select("fp", _segments().alias("s")).select("fp", "s.*"), "segments")
    probes = index.select("fp", "seg", "other", F.col("value").alias("was"), F.explode(_flips(F.col("value"), 32, True)).alias("value"))
    probes = probes.withColumn("own", F.col("value") == F.col("was")).drop("was")
    full = saved(index.groupBy("seg", "value").count().where(F.col("count") > crowded).select("seg", "value"), "crowded")
    key = ["seg", "value"]
    few = _verified(index.join(full, key, "left_anti"), probes.join(full, key, "left_anti"), key, DISTANCE)
    many_i = _quarters(index.join(full, key, "left_semi"), False)
    many_p = _quarters(probes.join(full, key, "left_semi"), True)
    return few.unionAll(_verified(many_i, many_p, [*key, "part", "q"], DISTANCE)).distinct()


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``[doc_id, fingerprint, component_id]`` for every row of ``docs``.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like
    any other. Rows with equal texts, and rows that repeat a doc_id, each get a row. A row
    without doc_id counts as a member; it never names a component, so component_id is null
    only where all members lack an id. An empty table gives an empty result."""
    rows = saved(fingerprints(docs), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes.select("fp"), crowded))
    placed = classes.join(roots.hint("merge"), classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = saved(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # few classes are in components of more than one: only they need the join
    named = placed.join(ids.hint("merge"), "root").select("fp", "component_id")
    return rows.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
