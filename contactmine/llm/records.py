"""Token ids as length-delimited binary records with an offset index.

A frame is the payload's length (unsigned 64 bits), the masked CRC-32 of those eight bytes, the
payload, and its masked CRC-32; all numbers are little-endian. The payload is one document:
whether it has an id, the id, the number of ids before it in its file, the bytes of a token id
(2, or 4 for vocabularies beyond 65,536), then its token ids. The mask (rotated right by 15, plus a constant) keeps the checksum of
data that holds checksums from being trivial.

Files are in ascending doc_id order, one per range of ids; the index, a table of its own, has
file, offset and length of each record, so any order of reading needs one range read a record,
or fewer where neighbours are wanted.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmine.llm.common import saved, shared_folder, texts
from contactmine.llm.files import Output, read_ranges

END_ID = 1
MASK = 0xA282EAD8
CACHED, CACHED_LENGTH = 1_200_000, 48
# what never changes how the word before it is cut; no apostrophe, which starts 's and the like
TAIL = b'.,;:!?"*#$%&|)]}'
INDEX = "doc_id bigint, part int, file string, offset bigint, length bigint, before bigint, n_tokens bigint"
HEAD = "<?qqB"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame; ValueError if anything in it isn't as written."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked(data[:8]):
        raise ValueError("record length is damaged")
    payload = data[12:-4]
    if struct.unpack_from("<Q", data)[0] != len(payload) or struct.unpack_from("<I", data, len(data) - 4)[0] != masked(payload):
        raise ValueError("record is damaged")
    return payload


class Encoder:
    """Encodes texts with a tokenizer that drops white space and lower-cases: pieces between
    ASCII white space are encoded apart, and so are a word and the punctuation after it.
    The ids of the first CACHED short pieces that this worker meets are kept."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.endings = Tokenizer.from_file(path), {}, {}
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This worker's encoder: the file is loaded once."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the pieces, by the library; all but long ones are kept while there is room."""
        cut, kind = self.tokenizer.model.tokenize, self.kind
        # a word of a-z alone is what the model gets in the end: nothing to normalise or to split
        plain = [p for p in pieces if p.isalpha() and p.islower()]
        new = {p: array(kind, [t.id for t in cut(p.decode())]).tobytes() for p in plain}
        rest = [p for p in pieces if p not in new]
        made = self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)
        new |= {p: array(kind, x.ids).tobytes() for p, x in zip(rest, made)}
        self._keep(new)
        return new

    def _ends_in_letter(self, stem: str) -> bool:
        """Whether what follows the stem is cut off from it: a mark that normalising leaves at its end (as of ``İ``)
        would join punctuation."""
        if stem.isascii() or not stem.isalnum():
            return stem.isalnum()
        last, found = stem[-1], self.endings.get(stem[-1])
        if found is None:
            normal = self.tokenizer.normalizer.normalize_str(last) if self.tokenizer.normalizer else last
            found = self.endings[last] = normal[-1:].isalnum()
        return found

    def _keep(self, new: dict[bytes, bytes]) -> None:
        if len(self.known) < CACHED:
            self.known.update((p, ids) for p, ids in new.items() if len(p) <= CACHED_LENGTH)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of 16 bits, or 32 for larger vocabularies."""
        known, split = self.known, [t.split() for t in texts]
        missing: set[bytes] = set()
        for pieces in split:
            missing.update([p for p in pieces if p not in known])
        parts = {}
        for p in missing:
            low = p if b"<|" in p else p.lower()  # a special token counts as it is written
            stem = low.rstrip(TAIL)
            whole = len(stem) in (0, len(low)) or not self._ends_in_letter(stem.decode())
            parts[p] = (low,) if whole else (stem, low[len(stem):])
        needed = {q for qs in parts.values() for q in qs}
        new = {q: known[q] for q in needed & known.keys()}
        new |= self._learn(list(needed - new.keys()))
        joined = {p: b"".join([new[q] for q in qs]) for p, qs in parts.items()}
        self._keep(joined)
        out = []
        for pieces in split:
            try:
                out.append(b"".join([known[p] for p in pieces]))
            except KeyError:  # a long piece, or no room for it
                out.append(b"".join([joined[p] if p in joined else known[p] for p in pieces]))
        return out


def _writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, before = None, 0
        for batch in batches:
            encoder, rows = Encoder.of(tokenizer), []
            width, end = array(encoder.kind).itemsize, array(encoder.kind, [END_ID]).tobytes()
            encoded = encoder.encode(batch.column("text").cast(pa.binary()).to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                out, ids = out or Output(folder, ".rec"), ids + end
                offset, length = out.append(frame(struct.pack(HEAD, doc_id is not None, doc_id or 0, before, width) + ids))
                rows.append((doc_id, out.part, out.path, offset, length, before, len(ids) // width))
                before += len(ids) // width
            names = ("doc_id", "part", "file", "offset", "length", "before", "n_tokens")
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))
        if out:
            out.close()

    return write


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` and return the index, INDEX and ``start``: the number of ids
    of all documents before. Each range of doc_ids is sorted, encoded and written by one task."""
    folder = folder or shared_folder(docs.sparkSession, "records")
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = saved(rows.mapInArrow(_writer(folder, tokenizer), INDEX), "record_index")
    # one row a file: only these running sums meet in one task
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return index.join(files, "file").withColumn("start", F.col("base") + F.col("before")).drop("base")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for row, data in zip(rows, read_ranges([(r["file"], r["offset"], r["length"]) for r in rows])):
            payload = unframe(data)
            has_id, doc_id, before, width = struct.unpack_from(HEAD, payload)
            ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4").tobytes()
            out.append((doc_id if has_id else None, row["start"] - row["before"] + before, ids))
        doc_ids, starts, ids = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"]
        )


def read_records(index: DataFrame, seed: int | None = None) -> DataFrame:
    """``[doc_id, start, ids]`` (ids as little-endian unsigned 32-bit integers) of the records that ``index`` lists: in file
    order, or shuffled by ``seed``. Every checksum is verified; a damaged record fails the read."""
    spark = index.sparkSession
    wanted = index.select("doc_id", "part", "file", "offset", "length", "before", "start")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if seed is None:
        order = ["part", "file", "offset"]
    else:
        wanted = wanted.withColumn("_order", F.xxhash64("file", "offset", F.lit(seed)))
        order = ["_order"]
    ordered = wanted.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_order")
    return ordered.mapInArrow(_reader, "doc_id bigint, start bigint, ids binary")


def token_records(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``[doc_id, start, n_tokens, ids_crc32]`` of every row, read back from the files written.

    Null texts count as empty: their only id is the end. Rows without doc_id come first; rows
    that repeat a doc_id are written one after the other, in order of their texts. An empty
    table writes no file and gives an empty result; other columns are ignored."""
    read = read_records(write_records(docs, tokenizer))
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
