"""Removal of repeated substrings: what a 100-byte string covers that also starts earlier.

Windows of WINDOW bytes are told apart in two steps. First, every window is assigned to an
anchor: the place in it whose GRAM-byte string has the smallest hash, the leftmost on a tie.
Equal windows have equal anchors, so they can only be found under the same anchor hash. The
windows of one anchor make one stretch of text, a mini. Only hashes of anchors and minis, a row
for about 35 bytes of text, are shuffled; whole minis that occurred before are repeats.

Second, minis of one anchor that differ can still share windows. These alone are gathered as
text, each cut out of the document that has it first, and in tasks that own anchor hashes
joined to a text whose Burrows-Wheeler transform is made. Intervals of suffixes are extended
backwards, breadth first: those of strings of length l give the common prefixes of value l, so
the values come in increasing order, and the expansion stops at WINDOW. Where no value below it
was assigned, neighbouring suffixes share a window. Anchors with more than CROWDED different
minis, as at the edges of a passage that very many documents hold, are dealt out again by the
contents of each window.

Joins, not bitmaps, choose what goes from one step to the next: a bitmap of fixed size fills up
as the input grows and then lets all pass. They are hinted as merge joins, for both sides grow
with the documents. The files of a step's shuffles go when its table is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import bitmap_of, in_bitmap, numbered, saved, shuffles_dropped, texts

WINDOW, GRAM = 100, 32
PLACES = WINDOW - GRAM + 1
CROWDED = 2000
BLOCK, CHUNK = 1 << 18, 1 << 22
FILTER_BITS = 24
MIXED = np.uint64(0x9E3779B97F4A7C15)
ANCHOR = "h bigint, g bigint, doc bigint, first int, more int"
SPAN = "doc bigint, a int, b int"
DELTAS = {"parquet.writer.version": "v2"}  # places that rise along a text take a byte or two


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes (a power of two), by doubling."""
    table = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)
    h, size, factor = table[data], 1, MIXED
    while size < GRAM:
        h = h[:-size] * factor + h[size:]
        size, factor = size * 2, factor ^ (factor << np.uint64(7)) | np.uint64(1)
    h = (h ^ (h >> np.uint64(31))) * MIXED
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(document, first window, last window, anchor hash)`` of each mini of documents that lie one
    after the other in ``data`` and end at ``ends``."""
    out = []
    for low in range(0, max(0, len(data) - WINDOW + 1), CHUNK):
        part = data[low:low + CHUNK + WINDOW - 1]
        h = _gram_hashes(part)
        low24 = np.uint64((1 << 24) - 1)
        least = (h & ~low24) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= PLACES:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        rest = PLACES - size
        least = np.minimum(least[:-rest], least[rest:]) if rest else least
        at = (least & low24).astype(np.int64)
        starts = np.arange(low, low + len(at))
        doc = np.searchsorted(ends, starts, side="right")
        good = np.flatnonzero(starts + WINDOW <= ends[doc])
        if len(good):
            at, doc, starts = at[good], doc[good], starts[good]
            new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(doc) != 0)])
            out.append((doc[new], starts[new], starts[np.r_[new[1:] - 1, len(at) - 1]], h[at[new]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _minis(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each batch: ids, bytes, starts of the documents, and the minis as a frame."""
    for batch in batches:
        bodies = batch.column("text").cast(pa.binary()).to_pylist()
        ids = np.array(batch.column("doc").to_pylist(), np.int64)
        body = b"".join(bodies)
        ends = np.cumsum([len(b) for b in bodies]).astype(np.int64)
        doc, first, last, h = anchors(np.frombuffer(body, np.uint8), ends)
        g = [xxhash.xxh64_intdigest(body[a:b + WINDOW]) for a, b in zip(first.tolist(), last.tolist())]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        frame = pd.DataFrame({"row": doc, "h": h.view(np.int64), "g": np.array(g, np.uint64).view(np.int64)})
        yield ids, body, starts, first, last, frame


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, starts, first, last, frame in _minis(batches):
        again = frame.duplicated().to_numpy()  # within its document: g is null
        row = frame["row"].to_numpy()
        yield pa.RecordBatch.from_arrays([
            pa.array(frame["h"]), pa.array(frame["g"].to_numpy(), mask=again), pa.array(ids[row]),
            pa.array((first - starts[row]).astype(np.int32)), pa.array((last - first).astype(np.int32)),
        ], ["h", "g", "doc", "first", "more"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, places = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places")
        row = pc.list_parent_indices(places).to_numpy()
        h, place, minis = places.flatten().flatten()
        first, more = place.to_numpy() >> 32, place.to_numpy() & 0xFFFFFFFF
        cut = [bodies[r][a:b] for r, a, b in zip(row.tolist(), first.tolist(), (first + more + WINDOW).tolist())]
        yield pa.RecordBatch.from_arrays(
            [h, minis, batch.column("doc").take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(cut, pa.binary())],
            ["h", "minis", "doc", "first", "mini"],
        )


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``[h, minis, doc, first, mini]``: the bytes of each mini of ``[h, minis, first_doc, place]``."""
    places = wanted.groupBy("first_doc").agg(F.collect_list(F.struct("h", "place", "minis")).alias("places"))
    found = rows.join(places.hint("merge"), F.col("doc") == F.col("first_doc")).select("doc", "text", "places")
    return found.mapInArrow(_cut_out, "h bigint, minis bigint, doc bigint, first int, mini binary")


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, key in order)``, stable, for keys of at most ``bits`` bits."""
    low = len(key).bit_length()
    if bits + low > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = key << low | np.arange(len(key))  # sorting numbers is several times faster than sorting places by them
    both.sort()
    return both & ((1 << low) - 1), both >> low


def _ranks(key: np.ndarray, bits: int) -> np.ndarray:
    """The place of each key among the distinct ones."""
    order, key = _sorted(key, bits)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(0, np.diff(key) != 0)) if len(key) else key
    return rank


def shared_windows(data: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(suffixes, same)``: the places of ``data`` in order of what follows, and whether each follows
    one that starts with the same ``size`` symbols. Symbols of 256 and more are separators, in no string.

    ``same`` comes from the Burrows-Wheeler transform alone, by backward extension."""
    n = len(data)
    key = np.zeros(n, np.int64)
    for i in range(4):  # four symbols of nine bits make the first key
        key <<= 9
        key[:max(0, n - i)] |= data[i:].astype(np.int64) + 1
    rank, reach = _ranks(key, 36), 4
    while reach < size:  # orders by the first 128 symbols at least
        after = np.zeros(n, np.int64)
        after[:max(0, n - reach)] = rank[reach:] + 1
        rank, reach = _ranks(rank * (n + 1) + after, 2 * (n + 1).bit_length()), reach * 2
    suffixes = _sorted(rank, n.bit_length())[0]
    bwt = data[suffixes - 1]
    to = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    to[np.argsort(bwt, kind="stable")] = np.arange(n)
    prefix = np.full(n + 1, -1, np.int16)
    prefix[[0, n]] = 0
    low, count = np.array([0]), np.array([n])
    for value in range(size):
        if not len(low):
            break
        inside = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        symbol = bwt[inside].astype(np.int64)
        key = np.repeat(np.arange(len(low)), count) * 512 + symbol
        known = symbol < 256
        key, inside = key[known], inside[known]
        order, key = _sorted(key, len(low).bit_length() + 9)
        inside = inside[order]
        head = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(key)])
        low = to[inside[head]]
        fresh = prefix[low + count] < 0
        prefix[(low + count)[fresh]] = value
        low, count = low[fresh], count[fresh]
    return suffixes, prefix[:n] < 0


def _repeats(minis: list[bytes], docs: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Spans of windows that another mini, or an earlier place, has before."""
    sizes = np.array([len(m) for m in minis])
    data = np.frombuffer(b"\0".join(minis) + b"\0", np.uint8).astype(np.int16)
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = 256
    suffixes, same = shared_windows(data)
    mini = np.searchsorted(ends, suffixes)
    whole = suffixes + WINDOW <= ends[mini]
    same &= whole & np.r_[False, whole[:-1]]
    group = np.cumsum(~same)
    group = np.where(whole, group, -1)
    at, mini, group = suffixes[whole], mini[whole], group[whole]
    place = firsts[mini] + at - (ends[mini] - sizes[mini])
    order = np.lexsort((place, docs[mini], group))
    doc, place, group = docs[mini][order], place[order], group[order]
    later = np.flatnonzero(np.r_[False, np.diff(group) == 0])
    later = later[np.lexsort((place[later], doc[later]))]
    if len(later):
        doc, place = doc[later], place[later]
        new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(place) != 1)])
        yield from zip(doc[new].tolist(), place[new].tolist(), (place[np.r_[new[1:] - 1, len(place) - 1]] + WINDOW).tolist())


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeats in rows that come ordered by ``h``, whole anchors at a time."""
    held, size = [], 0

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        if rows:
            found = list(_repeats([r[3] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)))
        columns = list(zip(*found)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["doc", "a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "first", "mini"))):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield spans(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    yield spans(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (mini[i:i + WINDOW], doc, first + i)
            for doc, first, mini in zip(*(batch.column(c).to_pylist() for c in ("doc", "first", "mini")))
            for i in range(len(mini) - WINDOW + 1)
        ]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32()))], ["w", "doc", "a"])


def _crowded(minis: DataFrame) -> DataFrame:
    """Spans for minis of crowded anchors: their windows, grouped by their bytes, keep the first place.

    Windows of one document are combined first, so a place is a document and its first start."""
    rows = minis.select("doc", "first", "mini").mapInArrow(_windows, "w binary, doc bigint, a int")
    digest = F.substring(F.unhex(F.sha2("w", 256)), 1, 16)  # as many bits as h and g have
    rows = saved(rows.select(digest.alias("w"), "doc", "a"), "windows")
    firsts = rows.groupBy("w").agg(F.min("doc").alias("first_doc"), F.min_by("a", F.struct("doc", "a")).alias("first_a"), F.count("*").alias("n"))
    found = rows.join(firsts.where("n > 1"), "w").where("doc <> first_doc OR a <> first_a")
    return found.select("doc", "a", (F.col("a") + WINDOW).alias("b"))


def repeated_spans(rows: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``[doc, a, b]``: byte spans of ``[doc, text]`` covered by windows that start earlier too. Spans may overlap."""
    spark = rows.sparkSession
    marks = saved(rows.mapInArrow(_hashes, ANCHOR), "anchors", **DELTAS)
    span = (F.col("first").alias("a"), (F.col("first") + F.col("more") + WINDOW).alias("b"))
    local = marks.where("g IS NULL").select("doc", *span)
    firsts = marks.where("g IS NOT NULL")
    # an anchor of one mini needs no more
    seen = saved(firsts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "seen")
    again = saved(firsts.join(seen.hint("merge"), "h", "left_semi"), "again", **DELTAS)
    place = F.shiftleft(F.col("first").cast("bigint"), 32).bitwiseOR(F.col("more").cast("bigint"))
    groups = again.groupBy("h", "g").agg(F.min("doc").alias("first_doc"), F.min_by(place, "doc").alias("place"), F.count("*").alias("n"))
    groups = saved(groups, "groups")
    copied = groups.where("n > 1").select("h", "g", "first_doc")
    whole = again.join(copied.hint("merge"), ["h", "g"]).where("doc <> first_doc").select("doc", *span)
    # anchors whose minis differ; the earliest place of each mini stands for it
    differ = saved(groups.groupBy("h").agg(F.count("*").alias("minis")).where("minis > 1"), "differ")
    wanted = groups.join(differ.hint("merge"), "h").select("h", "minis", "first_doc", "place")
    minis = saved(_texts_of(rows, wanted), "minis")
    few = minis.where(F.col("minis") <= crowded).select("h", "doc", "first", "mini")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    expanded = few.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_expand, SPAN)
    return local.unionAll(whole).unionAll(expanded).unionAll(_crowded(minis.where(F.col("minis") > crowded)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, body, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            kept, at, removed, runs = [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > at or not runs:
                    runs += 1
                    kept.append(body[at:a])
                    removed, at = removed + b - a, b
                elif b > at:
                    removed, at = removed + b - at, b
            kept.append(body[at:])
            rows.append((doc_id, len(body), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``[doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept]`` of every row; ``kept`` has the bytes left.

    Null and empty texts have no bytes. Rows without doc_id come before all others. Rows that
    share a doc_id, or have none, are documents each, in order of their texts' hashes: of rows that repeat one
    keeps its bytes. An empty table gives an empty result; other columns are ignored."""
    with shuffles_dropped(docs.sparkSession):
        rows = numbered(texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc")
        spans = saved(repeated_spans(rows.select("doc", "text"), crowded), "spans")
        spans = saved(spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "doc_spans")
    # documents without a span never leave their scan
    bits = bitmap_of(spans.select(F.xxhash64("doc").alias("h")), "h", FILTER_BITS)
    marked = rows.withColumn("h", F.xxhash64("doc"))
    some = in_bitmap(marked, "h", bits, FILTER_BITS).select("doc", "doc_id", "text").join(spans, "doc", "left")
    none = in_bitmap(marked, "h", bits, FILTER_BITS, False).select("doc_id", "text").withColumn("spans", F.lit(None).cast("array<struct<a:int,b:int>>"))
    cut = some.select("doc_id", "text", "spans").unionAll(none)
    return cut.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
