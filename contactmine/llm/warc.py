"""Pages as WARC archives with a two-level capture index.

Archives are gzip members, one per record, in one file per writing task. The index lists
every record under its reversed-host key (``com,example,www)/path``), page and place. It is
sorted over all tasks, cut into compressed blocks of BLOCK lines, and each of its files ends
with a sparse directory: the first key and the place of each block. A look-up finds the file
by the list of first keys (one per file), the block by binary search in that file's directory,
and the record by binary search in the block; then it reads just the record's range.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import BATCH_ROWS, saved, shared_folder
from contactmine.llm.files import Output, read_range, read_ranges, store

MIN_REVISIT = 100
BLOCK = 512
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id bigint, file string, offset bigint, length bigint"
SHARD = "file string, first_key string, first_id bigint, footer_offset bigint, footer_length bigint"


def surt(url: str) -> str:
    """The reversed-host key of an URL: ``http://www.A.org:80/x?y`` is ``org,a,www:80)/x?y``."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    rest = url.strip().split("://", 1)[-1]
    path = re.sub(r"^[^/?#]*", "", rest)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (path or "/")


def _named(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of ``refers_to`` without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_named(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_named(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of a record;
    ValueError if the payload isn't what the header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: int(n) if (n := fields[name][len("<urn:page:"):-1]) else None
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), size, digest, "revisit", number("WARC-Refers-To")
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return number("WARC-Record-ID"), size, digest, "response", None


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names.split())


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, "key page_id file offset length", [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])


def _archiver(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                out = out or Output(folder, ".warc.gz")
                place = out.append(gzip.compress(record(page_id, url, payload, digest, refers_to), LEVEL, mtime=0))
                rows.append((surt(url), page_id, out.path, *place))
            yield _entries(rows)
        if out:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``[page_id, url, html]`` and return ENTRY rows."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # only payloads that more than one page has are joined; counts are combined before the shuffle
    firsts = (
        rows.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    repeats = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))
    rows = rows.join(saved(firsts, "firsts"), "digest", "left").select("page_id", "url", "payload", "digest", repeats.alias("refers_to"))
    return saved(rows.mapInArrow(_archiver(folder), ENTRY), "captures")


def _place(key: str, page_id: int | None) -> tuple:
    return key.encode(), page_id is not None, page_id or 0


def _indexer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, directory = None, [], []

        def flush() -> None:
            block = zlib.compress("\n".join(json.dumps(line) for line in lines).encode())
            directory.append([*lines[0][:2], *out.append(block)])
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                out = out or Output(folder, ".cdx")
                lines.append(row)
                if len(lines) == BLOCK:
                    flush()
        if out:
            if lines:
                flush()
            place = out.append(zlib.compress(json.dumps(directory).encode()))
            out.close()
            yield _batch([(out.path, *directory[0][:2], *place)], "file first_key first_id footer_offset footer_length",
                         [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])

    return write


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures into index files; returns SHARD, a row for each file. Key and page
    make up the order, so a host with any number of captures is cut into many ranges."""
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return saved(ordered.mapInArrow(_indexer(folder), SHARD), "shards")


def _json(path: str, offset: int, length: int) -> bytes:
    return zlib.decompress(read_range(path, offset, length))


def _finder(shards: list[tuple]):
    shards = sorted(shards, key=lambda s: _place(s[1], s[2]))
    firsts = [_place(s[1], s[2]) for s in shards]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"shard": None, "block": None}  # keys come sorted: each block is read once a task

        def block(shard: int, number: int) -> list:
            if held["shard"] != shard:
                directory = json.loads(_json(shards[shard][0], shards[shard][3], shards[shard][4]))
                held.update(shard=shard, block=None, directory=directory, starts=[_place(*d[:2]) for d in directory])
            if held["block"] != number:
                lines = [json.loads(x) for x in _json(shards[shard][0], *held["directory"][number][2:]).split(b"\n")]
                held.update(block=number, lines=lines, places=[_place(*x[:2]) for x in lines])
            return held["lines"]

        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()):
                place = _place(key, page_id)
                shard = bisect.bisect_right(firsts, place) - 1
                if shard < 0:
                    continue
                block(shard, 0) if held["shard"] != shard else None
                # the first block that can hold it: records of equal keys may fill several
                number = max(0, bisect.bisect_left(held["starts"], place) - 1)
                while number < len(held["starts"]) and held["starts"][number] <= place:
                    lines = block(shard, number)
                    i = bisect.bisect_left(held["places"], place)
                    while i < len(lines) and held["places"][i] == place:
                        rows.append(tuple(lines[i]))
                        i += 1
                    number += 1
            yield _entries(rows)

    return find


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [surt(u) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("page_id")], ["key", "page_id"])


def look_up(wanted: DataFrame, shards: DataFrame) -> DataFrame:
    """ENTRY rows of every record of the wanted ``[page_id, url]``.

    The list of shards has a row for each index file: at most spark.sql.shuffle.partitions rows."""
    named = wanted.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    keys = named.mapInArrow(_keys, "key string, page_id bigint").distinct()
    ordered = keys.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(_finder([tuple(s) for s in shards.collect()]), ENTRY)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
        rows = [parse(gzip.decompress(data)) for data in read_ranges(wanted)]
        yield _batch(rows, "page_id payload_bytes payload_digest record_type refers_to",
                     [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])


def read_archives(entries: DataFrame) -> DataFrame:
    """The records at the places of ``entries``, read in the order of the files."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and an index, then find and read every record again:
    ``[page_id, payload_bytes, payload_digest, record_type, refers_to]`` of each row.

    Null html is an empty payload; null urls have no target and the empty key. A row without
    page_id is a response. Rows that repeat a page_id with equal payloads are all responses or
    all revisits. An empty table writes nothing; other columns are ignored."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, folder), folder)
    return read_archives(look_up(pages, shards))
