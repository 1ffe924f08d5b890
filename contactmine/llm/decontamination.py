"""Benchmark decontamination: rare word n-grams seed, Smith-Waterman alignment decides.

Every n-gram of a test item is a seed, so any run of SEED words that a document shares with an
item holds one, however much stands edited around it. What shares shorter runs only (edits in every
third word or closer) isn't aligned, whatever it would score. One pass over the documents looks
for the seeds and aligns the words around each hit with the item: first around the seeds that fewest
items hold, then the others, as long as the item's words that stand there could still
score more. A row per document and item tells the best alignment that reaches ``similarity``.
Items are taken in blocks of BLOCK_WORDS words, so what goes to each task has a bound; larger
benchmarks take more passes. Passes are row by row: no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import saved, texts

SEED = 3
MATCH, MISS, GAP = 2, -1, -1
SIMILARITY = 0.5
BLOCK_WORDS = 1 << 20
WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Items:
    """A block of test items, with their words as numbers."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.number = [r[0] for r in rows], {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(t)], np.int64) for _, t in rows]
        grams: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.words):
            codes = self.codes(item, min(SEED, len(item))) if len(item) else item
            for place, code in enumerate(codes.tolist()):
                grams.setdefault(code, []).append((i, place))
        self.lengths = sorted({min(SEED, len(w)) for w in self.words if len(w)})
        self.places, self.keys = grams, np.array(sorted(grams), np.int64)
        self.bearers = {code: len({i for i, _ in places}) for code, places in grams.items()}

    def codes(self, numbers: np.ndarray, length: int) -> np.ndarray:
        """One number per n-gram; n-grams of other lengths or with unknown words never equal it."""
        n = max(0, len(numbers) - length + 1)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(length):
            part = numbers[i:i + n]
            code, known = (code << 21) | part, known & (part > 0)
        return np.where(known, code, -1)

    def numbers(self, text: str) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def hits(self, numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document and positions in ``keys`` of the n-grams found there."""
        places, found = [], []
        if len(keys):
            for length in self.lengths:
                codes = self.codes(numbers, length)
                at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == codes)
                places.append(hit)
                found.append(at[hit])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64),) * 2


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score of two number sequences, and where in ``text`` it ends (exclusive)."""
    steps = np.arange(len(text) + 1) * -GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        fresh = np.zeros(len(text) + 1, np.int64)
        fresh[1:] = np.maximum(row[:-1] + np.where(text == word, MATCH, MISS), row[1:] + GAP)
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _matches(items: Items, text: str, similarity: float) -> Iterator[tuple[int, float, int, int]]:
    numbers = items.numbers(text)
    by_item: dict[int, list[tuple[int, int]]] = {}
    for place, key in zip(*(x.tolist() for x in items.hits(numbers, items.keys))):
        code = int(items.keys[key])
        for item, offset in items.places[code]:
            by_item.setdefault(item, []).append((place - offset, items.bearers[code]))
    for item, starts in sorted(by_item.items()):
        wanted = items.words[item]
        size, best, spans = len(wanted), (0, 0, 0), []
        for start, bearers in sorted(starts):
            # hits whose surroundings overlap are aligned together
            low, high = start - size // 2, start + size + size // 2
            if spans and low <= spans[-1][2]:
                spans[-1] = (min(bearers, spans[-1][0]), spans[-1][1], high)
            else:
                spans.append((bearers, low, high))
        for _, low, high in sorted(spans):
            low = max(0, low)
            part = numbers[low:high]
            # no alignment scores more than the item's words that are there at all
            most = int(np.isin(wanted, part).sum())
            if most < similarity * size or most * MATCH < best[0]:
                continue
            score, end = align(wanted, part)
            if score > best[0] or score == best[0] and low < best[1]:
                best = (score, low, low + end)
        score, low, end = best
        if score >= similarity * MATCH * size and score:
            back, length = align(wanted[::-1], numbers[low:end][::-1])
            yield item, score / (MATCH * size), end - length, end - 1


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks whose words together stay near BLOCK_WORDS, or single items beyond."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // (2 * BLOCK_WORDS) + 1
    for block in range(n):
        found = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        yield Items(sorted(((r.item_id, r.text) for r in found), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def _finder(items: Items, similarity: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, items.ids[item], score, first, last)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for item, score, first, last in _matches(items, text, similarity)
            ]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in FOUND.split(", ")])

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``[doc_id, item_id, score, first_word, last_word]``: a row for each document (row) and test item whose
    best alignment scores at least ``similarity`` of a verbatim copy, with the place of the words aligned.

    Words are runs of letters and digits in lower case. Null and empty texts and items match
    nothing; items shorter than a seed are sought as a whole. Rows that repeat are each reported,
    also those without doc_id; equal items each match. Empty tables give an empty result; other columns are ignored."""
    rows, found = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")), None
    for items in _blocks(benchmark):
        # each block's result is written before the next block's items are read
        block = saved(rows.mapInArrow(_finder(items, similarity), FOUND), "contaminated")
        found = block if found is None else found.unionAll(block)
    return found
