"""Quality classifier: quadratic discriminant analysis with shrinkage covariances.

A document's statistics are one pass over its whole text, in slices, so that a text of any length
takes bounded memory. Each class has a mean and a covariance, made of sums that Spark adds up over
all labelled rows: every one is learned from, and only a matrix per class comes to the driver. A
covariance is drawn towards its own diagonal and towards that of both classes, so that it
stays invertible with few rows or constant statistics. A score is the logistic function of the difference
of log densities, from Mahalanobis distances by the classes' Cholesky factors, which are made once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import saved, texts

SLICE, STRETCH = 1 << 20, 1000
SHRINK, POOL, FLOOR = 0.05, 0.1, 1e-3
PREDICTED = 0.3
HOLD_OUT = 5
FIXED = 1 << 20  # statistics as whole numbers of this fraction, so that sums don't depend on their order
CUT = re.compile(rb"[\x20\n]")

UPPER, LOWER, DIGIT, SPACE, LINE, PUNCTUATION, SYMBOL, CONTROL, WIDE = range(9)
CLASSES = np.full(256, CONTROL, np.uint8)
CLASSES[ord("A"):ord("Z") + 1], CLASSES[ord("a"):ord("z") + 1], CLASSES[ord("0"):ord("9") + 1] = UPPER, LOWER, DIGIT
CLASSES[[9, 32]], CLASSES[[10, 11, 12, 13]], CLASSES[128:] = SPACE, LINE, WIDE
CLASSES[list(b".,;:!?'\"()-")], CLASSES[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = PUNCTUATION, SYMBOL
NAMES = (
    "length", "words", "word_length", "upper", "digit", "space", "line", "punctuation", "symbol", "control", "wide",
    "entropy", "distinct", "common", "repeated_lines",
)


def _slices(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        found = CUT.search(text, start + SLICE)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def statistics(text: str) -> np.ndarray:
    """The statistics of NAMES: counts as logarithms, shares as the logistic's inverse. Empty texts have those of no bytes."""
    body = text.encode()
    counts, words, letters, distinct, common, stretches = np.zeros(256, np.int64), 0, 0, 0.0, 0.0, 0
    lines = np.zeros(0, np.int64)
    for part in _slices(body):
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        found = part.split()
        words, letters = words + len(found), letters + sum(map(len, found))
        for i in range(0, len(found), STRETCH):
            stretch = found[i:i + STRETCH]
            kinds: dict[bytes, int] = {}
            for word in stretch:
                kinds[word] = kinds.get(word, 0) + 1
            # a stretch counts by its words, and kinds against what its length allows
            distinct += len(kinds) / math.sqrt(len(stretch))
            common += max(kinds.values())
            stretches += 1
        lines = np.concatenate([lines, np.array([xxhash.xxh64_intdigest(line) >> 1 for line in part.split(b"\n") if line.strip()], np.int64)])
    size, total = len(body), max(1, len(body))
    by_class = np.bincount(CLASSES, weights=counts, minlength=9)
    share = lambda n, of: math.log((n + 0.5) / (of - n + 0.5))
    p = counts[counts > 0] / total
    return np.array([
        math.log1p(size), math.log1p(words), math.log1p(letters / max(1, words)),
        *(share(by_class[k], size) for k in (UPPER, DIGIT, SPACE, LINE, PUNCTUATION, SYMBOL, CONTROL, WIDE)),
        float(-(p * np.log2(p)).sum()) if size else 0.0, math.log1p(distinct / max(1, stretches)),
        math.log((common + 0.5) / (words + 0.5)), share(len(lines) - len(np.unique(lines)), len(lines)),
    ])


class Model:
    """Class means and the Cholesky factors of their shrunk covariances; ``sums`` has by class (number, sums, sums of products)."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in sums.values())
        means = {k: s / n for k, (n, s, _) in sums.items()}
        within = {k: p / n - np.outer(means[k], means[k]) for k, (n, _, p) in sums.items()}
        pooled = sum(sums[k][0] * within[k] for k in sums) / total
        self.classes = {}
        for k, (n, _, _) in sums.items():
            drawn = (1 - POOL) * within[k] + POOL * pooled
            drawn = (1 - SHRINK) * drawn + SHRINK * np.diag(np.diag(drawn)) + FLOOR * np.eye(len(drawn))
            factor = np.linalg.cholesky(drawn)
            constant = math.log(n / total) - np.log(np.diag(factor)).sum()
            self.classes[k] = means[k], np.linalg.inv(factor), constant

    def densities(self, x: np.ndarray, k: int) -> np.ndarray:
        """Log density and log prior of each row of ``x`` in a class, but for a constant."""
        mean, inverse, constant = self.classes[k]
        return constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.densities(x, 0) - self.densities(x, 1), -500, 500)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.round(statistics(t.as_py()) * FIXED).astype(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.int64()))], ["doc_id", "x"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by class: at ``-1, -1`` the number of rows, at ``i, -1`` sums, at ``i, j`` sums of products."""
    size, held = len(NAMES), {}
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, size)
        y = batch.column("y").to_numpy()
        for k in (0, 1):
            part = x[y == k]
            if len(part):
                made = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()]).astype(object)
                held[k] = held[k] + made if k in held else made
    at = [(-1, -1), *((i, -1) for i in range(size)), *((i, j) for i in range(size) for j in range(size))]
    rows = [(k, *at[i], str(v)) for k, made in held.items() for i, v in enumerate(made)]
    columns = list(zip(*rows)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(),) * 3 + (pa.string(),))], ["y", "i", "j", "v"])


def measure(docs: DataFrame) -> DataFrame:
    """``[doc_id, x]``: the statistics of every row's text, in units of 1 / FIXED."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(texts(docs).mapInArrow(_measured, f"doc_id {kind}, x array<bigint>"), "statistics")


def train(measured: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the rows that ``[doc_id, quality]`` labels 0 or 1; None without rows of both.

    A doc_id labelled twice alike counts once, one labelled both ways not at all."""
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most"))
    learn = measured.join(known.where("y = most").select("doc_id", F.col("y").cast("int").alias("y")), "doc_id").select("x", "y")
    sums = learn.mapInArrow(_summed, "y int, i int, j int, v string").groupBy("y", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    size, made = len(NAMES), {}
    for r in sums.collect():  # a row for each class and pair of statistics
        n, s, p = made.setdefault(r.y, ([0], np.zeros(size), np.zeros((size, size))))
        if r.j >= 0:
            p[r.i, r.j] = float(r.v) / FIXED**2
        elif r.i >= 0:
            s[r.i] = float(r.v) / FIXED
        else:
            n[0] = int(r.v)
    return Model({k: (n[0], s, p) for k, (n, s, p) in made.items()}) if len(made) == 2 else None


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is kept from learning; so is one without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, predicted: float = PREDICTED) -> DataFrame:
    """``[doc_id, held_out, score, predicted]`` of every row of ``[doc_id, text]``: how likely its label is 1.

    Null texts count as empty and are scored as such. Rows that repeat are each scored, and those with a label
    each learned from; rows without doc_id have no label. Without labels of both kinds every score is 0.5. An empty
    table gives an empty result; other columns are ignored."""
    measured = measure(docs)
    model = train(measured.where(~held_out()), labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)) / FIXED
            found = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = measured.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= predicted).cast("int").alias("predicted"))
