"""Phrase collocations by set-oriented mining over sorted occurrence relations.

The relation of length 1 holds, for each document in order, the places of its words and their
keys, sorted by piece and place: places count on within a piece and skip one between pieces, so
neighbours in a piece, and only they, differ by one. It is written once, without the words that are too
rare for any phrase. The relation of the next length is the merge join of one occurrence with the one that starts
a place later; its groups are counted, and the occurrences of frequent groups alone are written
as the relation that is extended next. Joins read a document's rows in order where they lie: what is
shuffled is counts of groups, combined in each task, never occurrences or texts.

A word's key is a 64-bit hash of language and word. Counted words are checked for keys that
two of them share, and then hashed anew. Frequent groups go to the tasks as a bitmap, sized by
their number up to 2^BITS; occurrences of others that pass it are seen through by the next count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmine.llm.common import bitmap_of, saved

LEAST, LONGEST, TOP = 10, 3, 2000
SHARE = 50  # of its occurrences, in percent, at which a phrase is part of a longer one
UNKNOWN = "und"
BITS = 27
SLICE, ROW, HELD = 1 << 20, 50_000, 300_000
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
CUT = re.compile(rb"[ \n]")


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` in lower case, pieces divided by line feeds and words by spaces, in slices that end at a word's end."""
    text, start = text.translate(PLAIN), 0
    while start < len(text):
        found = CUT.search(text, start + SLICE)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    langs = batch.column("lang").to_pylist()
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        yield langs[i], text.as_py()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def counted() -> pa.RecordBatch:
        langs = [lang for lang, counts in held.items() for _ in counts]
        words, counts = [w for c in held.values() for w in c], [n for c in held.values() for n in c.values()]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"]
        )

    for batch in batches:
        for lang, text in _columns(batch):
            for part in _slices(text):
                held.setdefault(lang, Counter()).update(part.split())
                if sum(map(len, held.values())) > HELD:
                    yield counted()
    yield counted()


def _key(salt: str, *values: Column) -> Column:
    return F.xxhash64(F.lit(salt), *values)


def _seed(salt: str, lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(salt.encode(), 42))


class Bitmap:
    """Which keys, folded to one, may be among those of frequent groups."""

    def __init__(self, groups: DataFrame, keys: list[str]):
        self.bits = min(BITS, max(15, groups.count().bit_length() + 4))
        self.data = np.zeros(1 << self.bits - 3, np.uint8)
        for part in bitmap_of(groups.select(_folded([F.col(k) for k in keys]).alias("h")), "h", self.bits).collect():  # 16 MB at most
            at = (part.part - 1) * 4096
            self.data[at:at + 4096] = np.frombuffer(part.bits, np.uint8)

    def __contains__(self, key: int) -> bool:
        slot = key & ((1 << self.bits) - 1)
        return bool(self.data[slot >> 3] >> (slot & 7) & 1)

    def among(self, keys: list[np.ndarray]) -> np.ndarray:
        folded = keys[0]
        for key in keys[1:]:
            folded = (folded << 13 | (folded.view(np.uint64) >> np.uint64(51)).view(np.int64)) ^ key
        slot = folded & ((1 << self.bits) - 1)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _folded(keys: list[Column]) -> Column:
    return reduce(lambda x, key: F.shiftleft(x, 13).bitwiseOR(F.shiftrightunsigned(x, 51)).bitwiseXOR(key), keys)


class _Keys(dict):
    """Keys of a language's words; 0 for those that no phrase can hold."""

    def __init__(self, salt: str, lang: str, frequent: Bitmap):
        self.seed, self.frequent = _seed(salt, lang), frequent

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh64_intdigest(word, self.seed)
        found = key - (1 << 64) if key >> 63 else key
        found = found if found in self.frequent else 0
        if len(self) < HELD:
            self[word] = found
        return found


def _relation_schema(length: int) -> str:
    return ", ".join(["own int", "at array<int>", *(f"w{i} array<bigint>" for i in range(1, length + 1))])


def _occurrences(salt: str, frequent: Bitmap, longest: int):
    """Rows of the relation of length 1: a document's, or ROW ``own`` ones of a long document and the few that follow."""

    def rows(lang_keys: _Keys, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at, keys, next_at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for part in _slices(text):
            words = [piece.split() for piece in part.split(b"\n")]
            sizes = np.array([len(w) for w in words])
            n = int(sizes.sum())
            found = np.fromiter(map(lang_keys.__getitem__, chain.from_iterable(words)), np.int64, n)
            places = np.arange(n) + np.repeat(np.arange(len(words)), sizes) + next_at
            next_at += n + len(words) - 1
            known = found != 0
            at, keys = np.concatenate([at, places[known]]), np.concatenate([keys, found[known]])
            while len(at) >= ROW + longest - 1:
                yield ROW, at[:ROW + longest - 1], keys[:ROW + longest - 1]
                at, keys = at[ROW:], keys[ROW:]
        if len(at):
            yield len(at), at, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Keys] = {}
        for batch in batches:
            found = []
            for lang, text in _columns(batch):
                if lang not in known:
                    known[lang] = _Keys(salt, lang, frequent)
                for row in rows(known[lang], text):
                    found.append(row)
                    if len(found) == 200:
                        yield _nested(found)
                        found = []
            yield _nested(found)

    return run


def _nested(rows: list[tuple]) -> pa.RecordBatch:
    owns, *columns = zip(*rows) if rows else ((), (), ())
    ends = np.r_[0, np.cumsum([len(a) for a in columns[0]])].astype(np.int32)
    flat = [np.concatenate(c) if rows else np.zeros(0, np.int64) for c in columns]
    return _relation(np.array(owns, np.int32), ends, flat[0], flat[1:])


def _relation(own: np.ndarray, ends: np.ndarray, at: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), *(pa.ListArray.from_arrays(ends, pa.array(k)) for k in keys)]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *lists], ["own", "at", *(f"w{i}" for i in range(1, len(keys) + 1))])


def _joined(batch: pa.RecordBatch, length: int) -> tuple:
    """Row, place, first and last key columns, and whether it starts in its row's own part, of each occurrence of
    ``length`` words that is followed by one a place later in the same row."""
    own = batch.column("own").to_numpy()
    at = batch.column("at")
    sizes = at.value_lengths().to_numpy()
    at = at.flatten().to_numpy()
    keys = [batch.column(f"w{i}").flatten().to_numpy() for i in range(1, length + 1)]
    row = np.repeat(np.arange(len(own)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = np.flatnonzero((np.diff(at) == 1) & (np.diff(row) == 0))
    return row[hit], at[hit], [k[hit] for k in keys] + [keys[-1][hit + 1]], inside[hit] < own[row[hit]], len(own)


def _groups(length: int):
    """The keys of each occurrence of ``length + 1`` words, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, keys, own, _ = _joined(batch, length)
            yield pa.RecordBatch.from_arrays([pa.array(k[own]) for k in keys], [f"w{i}" for i in range(1, length + 2)])

    return run


def _extended(length: int, frequent: Bitmap):
    """The relation of ``length + 1``: occurrences of frequent groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, keys, own, rows = _joined(batch, length)
            keep = frequent.among(keys)
            row, at, keys, own = row[keep], at[keep], [k[keep] for k in keys], own[keep]
            sizes, owns = np.bincount(row, minlength=rows), np.bincount(row, weights=own, minlength=rows)
            used = np.flatnonzero(sizes)
            yield _relation(owns[used].astype(np.int32), np.r_[0, np.cumsum(sizes[used])].astype(np.int32), at, keys)

    return run


def _frequent(relation: DataFrame, length: int, least: int) -> DataFrame:
    keys = [f"w{i}" for i in range(1, length + 2)]
    groups = relation.mapInArrow(_groups(length), ", ".join(f"{k} bigint" for k in keys))
    return saved(groups.groupBy(*keys).agg(F.count("*").alias("a")).where(F.col("a") >= least), f"phrases{length + 1}")


def _mined(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, dict[int, DataFrame]]:
    """Words with their counts, languages with theirs, and by length the frequent phrases' keys and counts."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    texts = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), "text").where("text IS NOT NULL")
    words = texts.mapInArrow(_count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words, salt = saved(words, "words"), 0
    while True:
        keyed = words.withColumn("w", _key(str(salt), F.col("lang"), F.col("word")))
        shared = keyed.groupBy("w").agg(F.count("*").alias("words"), F.max("n").alias("n")).where((F.col("n") >= least) & ((F.col("words") > 1) | (F.col("w") == 0)))
        if shared.isEmpty():
            break
        salt += 1
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = saved(keyed.where(F.col("n") >= least), "frequent")
    relation = texts.mapInArrow(_occurrences(str(salt), Bitmap(words, ["w"]), longest), _relation_schema(1))
    phrases, relation = {}, saved(relation, "relation1")
    for length in range(2, longest + 1):
        phrases[length] = _frequent(relation, length - 1, least)
        if length < longest:
            frequent = Bitmap(phrases[length], [f"w{i}" for i in range(1, length + 1)])
            relation = saved(relation.mapInArrow(_extended(length - 1, frequent), _relation_schema(length)), f"relation{length}")
    return words, totals, phrases


def _scored(phrases: dict[int, DataFrame], words: DataFrame, length: int) -> DataFrame:
    """Phrases of a length with ``l``, ``r`` and ``score`` of their lowest-scoring cut."""
    counts = {1: words.select(F.col("w").alias("w1"), F.col("n").alias("a")), **phrases}
    found = phrases[length]
    for k in range(1, length):
        for name, first, size in (("l", 1, k), ("r", k + 1, length - k)):
            part = counts[size].select(*(F.col(f"w{i}").alias(f"w{first + i - 1}") for i in range(1, size + 1)), F.col("a").alias(f"{name}{k}"))
            found = found.join(part, [f"w{i}" for i in range(first, first + size)])
    exact = lambda name: F.col(name).cast("decimal(18,0)")
    cuts = []
    for k in range(1, length):
        found = found.withColumn(f"up{k}", exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn(f"down{k}", exact(f"l{k}") * exact(f"r{k}"))
        cuts.append(F.struct(F.expr(f"up{k} div down{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return found.withColumn("best", best).select(
        *(f"w{i}" for i in range(1, length + 1)), "a", "best.l", "best.r", "best.score"
    )


def _independent(phrases: dict[int, DataFrame], scored: DataFrame, length: int, share: int) -> DataFrame:
    """Without the phrases that a longer one holds in ``share`` percent of their occurrences."""
    keys, longer = [f"w{i}" for i in range(1, length + 1)], []
    for size, found in phrases.items():
        for first in range(1, size - length + 2) if size > length else ():
            longer.append(found.select(*(F.col(f"w{first + i}").alias(key) for i, key in enumerate(keys)), F.col("a").alias("most")))
    if not longer:
        return scored
    most = reduce(DataFrame.unionAll, longer).groupBy(*keys).agg(F.max("most").alias("most"))
    exact = lambda name: F.col(name).cast("decimal(20,0)")
    return scored.join(most, keys, "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("a") * share)).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """``[lang, rank, phrase, a, l, r, n, score]``: each language's ``top`` phrases of ``[lang, text]``.

    A phrase has 2 to ``longest`` words and stands ``a`` times, at least ``least``, within pieces; ``l`` and ``r`` count
    the two parts of the cut whose share of a million, a * a / (l * r), is lowest; ``n`` counts the language's words. Null
    langs count as ``und``, null and empty texts have no words. Rows that repeat count as often as they stand
    there, with or without doc_id. Of phrases equal in score and count the first by its bytes comes first. An
    empty table gives an empty result; other columns are ignored."""
    words, totals, phrases = _mined(docs, least, longest)
    found = []
    for length in range(2, longest + 1):
        left = _independent(phrases, _scored(phrases, words, length), length, share)
        more = [F.lit(None).cast("bigint").alias(f"w{i}") for i in range(length + 1, longest + 1)]
        found.append(left.select(*(f"w{i}" for i in range(1, length + 1)), *more, "a", "l", "r", "score"))
    known = words.select(F.col("w").alias("w1"), "lang")
    every = saved(reduce(DataFrame.unionAll, found).join(known, "w1"), "scored")
    # the score that each language's last phrase has, from a row for each score
    sizes = every.groupBy("lang", "score").agg(F.count("*").alias("size"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    sizes = sizes.withColumn("before", F.sum("size").over(down) - F.col("size"))
    last = saved(sizes.where(F.col("before") < top).groupBy("lang").agg(F.min("score").alias("last")), "last")  # their size is known
    best = every.join(last, "lang").where(F.col("score") >= F.col("last")).drop("last")
    for i in range(1, longest + 1):
        best = best.join(words.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *(f"word{i}" for i in range(1, longest + 1))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", F.row_number().over(order).cast("bigint"))
    return best.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
