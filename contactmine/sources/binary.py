"""Text out of binary files: messages, archives, office documents.

Spark reads and spreads the files; small helpers open one file at a time inside
``mapInPandas``.  A file that cannot be read gives a row with ``error`` set, and the
job goes on (``sinks.tables.write_bad_sources`` stores those rows).
"""

from __future__ import annotations

import email
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from contactmine.fixed_values import ARCHIVE_EXTENSIONS, OFFICE_EXTENSIONS

TEXTS = "source_id string, text string, error string"
MEMBERS = "path string, content binary, error string"

# What a column value can hold, less some room; larger members are reported as errors, not cut.
MAX_MEMBER_BYTES = (1 << 31) - (1 << 20)

FileReader = Callable[[bytes], str]
_Member = tuple[str, bytes | None, str | None]


def read_text(content: bytes) -> str:
    return content.decode("utf-8", errors="ignore")


def read_message(content: bytes) -> str:
    """The plain-text parts of a multipart message, else the only payload; no headers."""
    message = email.message_from_string(read_text(content))
    parts = [message]
    if message.is_multipart():
        parts = [p for p in message.walk() if p.get_content_type() == "text/plain"]
    return "".join(read_text(p.get_payload(decode=True)) for p in parts)


def _named(root: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if e.tag.rpartition("}")[2] == tag]


def _text_of(node: ElementTree.Element, tag: str) -> str:
    return "".join(e.text or "" for e in _named(node, tag))


def _xml_parts(archive: zipfile.ZipFile, prefix: str) -> list[ElementTree.Element]:
    names = sorted(n for n in archive.namelist() if n.startswith(prefix) and n.endswith(".xml"))
    return [ElementTree.fromstring(archive.read(n)) for n in names]


def _sheet_strings(archive: zipfile.ZipFile) -> list[str]:
    """String cells: shared, inline, or the stored result of a text formula."""
    shared = [
        _text_of(item, "t")
        for part in _xml_parts(archive, "xl/sharedStrings")
        for item in _named(part, "si")
    ]
    texts = []
    for sheet in _xml_parts(archive, "xl/worksheets/sheet"):
        for cell in _named(sheet, "c"):
            kind = cell.get("t")
            if kind == "s":
                texts.append(shared[int(_text_of(cell, "v"))])
            elif kind == "str":
                texts.append(_text_of(cell, "v"))
            elif kind == "inlineStr":
                texts.append(_text_of(cell, "t"))
    return texts


def read_office(content: bytes) -> str:
    """Paragraphs, string cells or slide text of a zip-based office file, one per line."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = archive.namelist()
    if any(n.startswith("xl/") for n in names):
        return "\n".join(_sheet_strings(archive))
    if any(n.startswith("word/") for n in names):
        parts, text_tag = _xml_parts(archive, "word/document"), "t"
    elif any(n.startswith("ppt/") for n in names):
        parts, text_tag = _xml_parts(archive, "ppt/slides/slide"), "t"
    else:
        paragraphs = _named(ElementTree.fromstring(archive.read("content.xml")), "p")
        return "\n".join("".join(p.itertext()) for p in paragraphs)
    return "\n".join(_text_of(p, text_tag) for part in parts for p in _named(part, "p"))


def _describe(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure}"


def _extension(path: str) -> str:
    head, dot, tail = path.rpartition("/")[2].rpartition(".")
    return (dot + tail).lower() if head.strip(".") else ""


def _files_inside(content: bytes) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    """``(name, size, read)`` of the files in a zip or tar; an error for other content."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        archive = zipfile.ZipFile(io.BytesIO(content))
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, info.file_size, lambda i=info: archive.read(i)
        return
    archive = tarfile.open(fileobj=io.BytesIO(content), mode="r:*")
    for info in archive:
        if info.isfile():
            yield info.name, info.size, lambda i=info: archive.extractfile(i).read()


def _members(path: str, content: bytes, levels: int | None) -> Iterator[_Member]:
    """Members as ``archive!/member``, archives among them opened ``levels`` deep or all."""
    if levels == 0:
        yield path, None, "archive nested too deeply"
        return
    try:
        for name, size, read in _files_inside(content):
            member = f"{path}!/{name}"
            if size > MAX_MEMBER_BYTES:
                yield member, None, f"member of {size} bytes is too large"
                continue
            try:
                inner = read()
            except Exception as failure:  # one damaged member
                yield member, None, _describe(failure)
                continue
            if _extension(name) in ARCHIVE_EXTENSIONS:
                yield from _members(member, inner, levels and levels - 1)
            else:
                yield member, inner, None
    except Exception as failure:  # damaged archive
        yield path, None, _describe(failure)


def expand_archives(archives: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``[path, content, error]``: one row per file in each archive; nothing goes to disk.

    Archives in archives are opened, at most ``max_depth`` levels down; deeper ones are reported.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for member in _members(path, content, max_depth):
                    yield pd.DataFrame([member], columns=["path", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, MEMBERS)


def read_files(
    files: DataFrame, readers: Mapping[str, FileReader], max_depth: int | None = None, mark: bool = False
) -> DataFrame:
    """``[source_id, text, error]`` of binary files and of the members of archives.

    ``readers`` maps an extension to ``bytes → str``; other members are read as text.  With
    ``mark`` each file also has a row of its own, without text and error, once it has been read.
    """
    readers = dict(readers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = [(path, content, None)]
                if _extension(path) in ARCHIVE_EXTENSIONS and _extension(path) not in readers:
                    found = _members(path, content, max_depth)
                for name, data, error in found:
                    text = None
                    if error is None:
                        try:
                            text = readers.get(_extension(name), read_text)(data)
                        except Exception as failure:  # any damaged file
                            error = _describe(failure)
                    yield pd.DataFrame(
                        [(name, text, error)], columns=["source_id", "text", "error"]
                    )
                if mark:
                    yield pd.DataFrame([(path, None, None)], columns=["source_id", "text", "error"])

    return files.select("path", "content").mapInPandas(run, TEXTS)


def message_bodies(files: DataFrame) -> DataFrame:
    """``[source_id, text, error]``: the plain-text body of each e-mail message."""
    return read_files(files, {".eml": read_message})


def office_text(files: DataFrame) -> DataFrame:
    """``[source_id, text, error]`` of word, sheet and slide files (zip containers)."""
    return read_files(files, dict.fromkeys(OFFICE_EXTENSIONS, read_office))
