"""Language identification: sparse multinomial logistic regression on TF-IDF of character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, then calibrated
by one temperature.

Document frequencies are counted over all documents to learn from. The regression is fitted on
at most ``sample`` of them per language (those with the smallest hashes); that many hashed
vectors, and no texts, come to the driver. The model is a table of 2^16 n-gram buckets by
languages. Prediction is row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmine.llm.common import BATCH_ROWS, saved, texts

BITS, ORDERS = 16, (1, 2, 3)
SAMPLE = 800
PIECES, PIECE = 2, 40
SCALE = 100.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.02, 4
CALIBRATE = 5
CHUNK = 1 << 18
UNKNOWN, NO_MODEL = "und", "no model"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    """Code points in lower case between spaces; ASCII other than letters counts as a space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    plain = (points < 128) & ((points < 97) | (points > 122))
    return np.where(plain, np.uint64(32), points)


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    n = max(0, len(points) - order + 1)  # a last chunk can be shorter
    key = np.full(n, order, np.uint64)
    for i in range(order):
        key = (key << np.uint64(21)) ^ points[i:i + n]
    return ((key * MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their share of the text's n-grams."""
    points, counts = _points(text), np.zeros(1 << BITS, np.int64)
    for i in range(0, len(points), CHUNK):
        for order in ORDERS:
            counts += np.bincount(_buckets(points[i:i + CHUNK + order - 1], order), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's documents each bucket is, and at -1 their number."""
    found, documents = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            points, seen = _points(text), np.zeros(1 << BITS, bool)
            for order in ORDERS:
                seen[_buckets(points, order)] = True
            found += seen
            documents += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], documents), pa.int64())], ["bucket", "n"]
    )


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of each text and of short pieces of it, so that short texts are learned too."""
    for batch in batches:
        rows = []
        for lang, order, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "order", "text"))):
            starts = [(order >> 8 * i) % max(1, len(text) - PIECE) for i in range(PIECES)]
            for piece in [text, *(text[s:s + PIECE] for s in starts)]:
                at, share = vector(piece)
                rows.append((lang, order, at.tobytes(), share.tobytes()))
        columns = list(zip(*rows)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "order", "at", "share"])


class Model:
    """Weights of (n-gram bucket, language) with IDF folded in, biases, temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf.astype(np.float64), 1.0
        self.table, self.bias = np.zeros((len(idf), len(languages)), np.float32), np.zeros(len(languages))

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        k = len(self.languages)
        z, n = np.zeros((len(self.idf) + 1, k)), np.zeros((len(self.idf) + 1, k))  # the last row is the bias

        def weights(at: np.ndarray) -> np.ndarray:
            za, na = z[at], n[at]
            w = -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2)
            return np.where(np.abs(za) <= L1, 0.0, w)

        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                y, at, share = rows[i]
                at, x = np.append(at, len(self.idf)), np.append(share * self.idf[at] * SCALE, 1.0)
                w = weights(at)
                p = _softmax((x @ w)[None])[0]
                p[y] -= 1
                g = x[:, None] * p
                square = g * g
                z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
                n[at] += square
        w = weights(np.arange(len(self.idf) + 1))
        self.table, self.bias = (w[:-1] * self.idf[:, None] * SCALE).astype(np.float32), w[-1]

    def calibrate(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The temperature at which held-back rows are likeliest, on a grid of powers."""
        if not rows:
            return
        scores = np.array([share @ self.table[at] + self.bias for _, at, share in rows])
        truth = np.array([y for y, _, _ in rows])
        grid = 2.0 ** np.arange(-6, 6.01, 0.125)
        losses = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def predict(self, text: str) -> tuple[str, float]:
        points, total, n = _points(text), np.zeros(len(self.languages)), 0
        for i in range(0, len(points), CHUNK):
            for order in ORDERS:
                at = _buckets(points[i:i + CHUNK + order - 1], order)
                total += self.table[at].sum(axis=0, dtype=np.float64)
                n += len(at)
        p = _softmax(((total / n + self.bias) / self.temperature)[None])[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _learnable(rows: DataFrame) -> DataFrame:
    return rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("doc_id").alias("order"), "text")


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """``[lang, order, text]`` of the ``sample`` rows of each language whose hashes ``order`` are the smallest, read unsigned.

    About twice as many of each language pass its hash's threshold, however many rows there are; those are ranked."""
    learn = _learnable(rows).withColumn("share", F.shiftrightunsigned("order", 1) / float(2**63))
    sizes = saved(learn.groupBy("lang").agg(F.count("*").alias("rows")), "languages")  # a row each: their size is known
    near = learn.join(sizes, "lang").where(F.col("share") * F.col("rows") < 2 * sample)
    first = Window.partitionBy("lang").orderBy("share", "text")
    return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample).select("lang", "order", "text")


def train(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``[doc_id, text, lang]``; None if there is no row with text and lang."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    counts = _learnable(rows).select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n"))
    counted = dict(tuple(r) for r in counts.collect())  # a row per bucket: 2^16 and one at most
    documents = counted.pop(-1, 0)
    if not documents:
        return None
    found = np.zeros(1 << BITS)
    found[list(counted)] = list(counted.values())
    vectors = sampled(rows, sample).mapInArrow(_vectors, "lang string, order bigint, at binary, share binary").collect()
    languages = sorted({v.lang for v in vectors})
    made = [(v.order, languages.index(v.lang), np.frombuffer(v.at, np.int32), np.frombuffer(v.share, np.float32)) for v in vectors]
    made.sort(key=lambda v: (v[0], v[1], len(v[2]), v[2].tobytes()))
    model = Model(languages, np.log((1 + documents) / (1 + found)) + 1)
    model.fit([v[1:] for v in made if v[0] % CALIBRATE])
    model.calibrate([v[1:] for v in made if v[0] % CALIBRATE == 0])
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``[doc_id, lang_pred, score]`` of every row; with score 0 ``und`` where a text is
    null or has no letter, and ``no model`` for the others if none could be learned."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (UNKNOWN, 0.0) if not letters else model.predict(text) if model else (NO_MODEL, 0.0)
                for letters, text in zip(batch.column("letters").to_pylist(), batch.column("text").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = texts(docs).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning; so is one without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``[doc_id, held_out, lang_pred, score]`` of every row of ``[doc_id, text, lang]``, learned from the
    rows that aren't held out.

    Rows that repeat are each predicted; null langs are never learned; rows without doc_id are
    held out. An empty table gives an empty result; other columns are ignored."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"), sample)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
