"""Byte-level BPE in Spark: higher-order functions fold ranked merges over the bytes of words.

A text is cut into pieces by the tokenizer's pattern. A piece's bytes are an array of tokens,
written in hexadecimal, with the rank of each neighbouring pair; a fold merges the pair of the
lowest rank, the leftmost on a tie, and looks up the two pairs that this makes. The ranks are a
literal of the plan, an array of small maps by hash, so that a look-up doesn't scan them all.

Distinct pieces are counted over all documents. The commonest ``frequent`` of them are folded
that way, once, and their ids go to every task: a table of bounded size. A fold costs 0.2 ms a
piece, far too much for each of the rare pieces, whose number grows with the input. They are
merged where they stand, by the same rule in Python, and each worker remembers the first KEPT
of them. So no word of a text is ever shuffled, and every piece is encoded whole.

Decoding looks up each id's bytes in a literal and concatenates the pieces.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import saved, texts
from contactmine.llm.literals import literal

SLOTS = 1 << 13
FREQUENT = 1 << 17
LONG, SHORT = 200, 64
KEPT = 600_000
NONE = 2**31 - 1
# White space of Unicode, as it stands in a character class.
SPACE = r"\t-\r \x85\xA0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def java_pattern(pattern: str) -> str:
    """The pattern with all white space of Unicode, which Java's own \\s leaves out."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def _slot(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 42) & (SLOTS - 1)  # as Spark's xxhash64


def _hashed(entries: dict[str, object]) -> list[dict[str, object]]:
    slots: list[dict[str, object]] = [{} for _ in range(SLOTS)]
    for key, value in entries.items():
        slots[_slot(key.encode())][key] = value
    return slots


def _get(slots: Column, key: Column) -> Column:
    """The key's value in a literal made by ``_hashed``; null if it has none."""
    return F.get(slots, F.xxhash64(key).bitwiseAND(F.lit(SLOTS - 1)).cast("int"))[key]


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _merged(table: Column, code: Column) -> Column:
    """The ids, joined by commas, of a piece's bytes in hexadecimal: whole if it is a token."""
    return _let(table, lambda ranks: _fold(ranks, code))  # the literal stands in the plan once


def _fold(ranks: Column, code: Column) -> Column:
    rank = lambda pair: F.coalesce(_get(ranks, pair), F.lit(NONE))
    n = (F.length(code) / 2).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(F.substring(code, i * 2 + 1, F.lit(4)))))
    start = F.struct(tokens.alias("t"), F.coalesce(pairs, F.array().cast("array<int>")).alias("r"))

    def merge(s: Column, at: Column) -> Column:
        """``s`` with the tokens at the 1-based place ``at`` and after it as one."""
        t, r = s["t"], s["r"]
        one = F.concat(F.get(t, at - 1), F.get(t, at))
        return _let(one, lambda m: F.struct(
            F.concat(F.slice(t, F.lit(1), at - 1), F.array(m), F.slice(t, at + 2, F.size(t))).alias("t"),
            F.concat(
                F.when(at > 1, F.concat(F.slice(r, F.lit(1), at - 2), F.array(rank(F.concat(F.get(t, at - 2), m))))).otherwise(F.array().cast("array<int>")),
                F.when(at < F.size(r), F.concat(F.array(rank(F.concat(m, F.get(t, at + 1)))), F.slice(r, at + 2, F.size(r)))).otherwise(F.array().cast("array<int>")),
            ).alias("r"),
        ))

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s["r"]), lambda low: F.when(
            low < NONE, _let(F.array_position(s["r"], low).cast("int"), lambda at: merge(s, at))
        ).otherwise(s))

    fold = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.array_join(F.transform(s["t"], lambda t: _get(ranks, t).cast("string")), ","))
    return F.coalesce(_get(ranks, code).cast("string"), fold)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece by the same merges; with a heap of pairs if it is long."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return _merge_long(piece, ranks)
    tokens, get = [piece[i:i + 1] for i in range(len(piece))], ranks.get
    pairs = [get(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < NONE:
        i = pairs.index(low)
        tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(tokens[i - 1] + tokens[i], NONE)
        if i < len(pairs):
            pairs[i] = get(tokens[i] + tokens[i + 1], NONE)
    return [ranks[t] for t in tokens]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    left, right, ends = list(range(-1, len(piece) - 1)), list(range(1, len(piece) + 1)), list(range(1, len(piece) + 1))
    live, heap = [True] * len(piece), []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(piece) and (rank := ranks.get(piece[i:ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(len(piece)):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = right[i]
        if not live[i] or j >= len(piece) or ends[j] != end:
            continue  # one of the two has been merged since
        live[j], ends[i], right[i] = False, end, right[j]
        if right[i] < len(piece):
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [ranks[piece[i:ends[i]]] for i in range(len(piece)) if live[i]]


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def _hex(piece: Column) -> Column:
    return F.hex(piece.cast("binary"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's distinct pieces with their numbers."""
    for batch in batches:
        found = pc.value_counts(batch.column("pieces").values)
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["piece", "n"])


def frequent_pieces(cut: DataFrame, ranks: Column, limit: int = FREQUENT) -> dict[str, str]:
    """Ids of the ``limit`` commonest pieces of all ``[pieces]``, each folded once."""
    counted = cut.select("pieces").mapInArrow(_counts, "piece string, n bigint").where(F.octet_length("piece") <= LONG)
    # those met once could only fill up a short list
    counts = counted.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "piece").limit(limit)
    folded = saved(counts.select("piece").repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "frequent")
    return dict(map(tuple, folded.select("piece", _merged(ranks, _hex(F.col("piece"))).alias("ids")).collect()))


class Kept:
    """The pieces that this worker has met, with their ids, for one run over all its tasks."""

    run, pieces = "", {}

    @classmethod
    def of(cls, run: str, known: dict[str, str]) -> dict[str, str]:
        if cls.run != run:
            cls.run, cls.pieces = run, dict(known)
        return cls.pieces


def _assembler(known: dict[str, str], ranks: dict[bytes, int]):
    run, met = uuid.uuid4().hex, len(known) + KEPT

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept.of(run, known)
        for batch in batches:
            pieces = batch.column("pieces")
            coded = pieces.values.dictionary_encode()  # each distinct piece is looked up once a batch
            found = []
            for p in coded.dictionary.to_pylist():
                ids = kept.get(p)
                if ids is None:
                    ids = ",".join(map(str, merge(p.encode(), ranks)))
                    if len(kept) < met and len(p) <= SHORT:
                        kept[p] = ids
                found.append(ids)
            ids = pa.array(found, pa.large_string()).take(coded.indices)
            rows = pc.binary_join(pa.ListArray.from_arrays(pieces.offsets, ids), pa.scalar(",", pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows.cast(pa.string())], ["doc_id", "ids"])

    return assemble


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """``[doc_id, ids]`` of every row: token ids in order, joined by commas; no special tokens."""
    table = literal(_hashed({token.hex().upper(): rank for token, rank in ranks.items()}), "array<map<string,int>>")
    cut = texts(docs).select("doc_id", _pieces(F.col("text"), pattern).alias("pieces"))
    known = frequent_pieces(cut, table, frequent)
    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(_assembler(known, ranks), f"doc_id {kind}, ids string")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``[doc_id, ids, decoded]``: the bytes of each row's ids, one after the other."""
    tokens = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.hex().upper()
    names = literal(tokens, "array<string>")
    pieces = F.transform(F.split("ids", ","), lambda i: F.get(names, i.cast("int")))
    decoded = F.when(F.col("ids") == "", F.lit(b"")).otherwise(F.unhex(F.array_join(pieces, "")))
    return encoded.select("doc_id", "ids", decoded.alias("decoded"))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """``[doc_id, n_tokens, ids_sha256, decoded_sha256, ids]`` of every row.

    Null and empty texts have no ids and decode to nothing. Rows that repeat, or lack an id, are
    each encoded. An empty table gives an empty result; other columns are ignored."""
    decoded = decode(encode(docs, ranks, pattern, frequent), ranks)
    commas = F.length("ids") - F.length(F.replace("ids", F.lit(","), F.lit("")))
    return decoded.select(
        "doc_id", F.when(F.col("ids") == "", 0).otherwise(commas + 1).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids",
    )
