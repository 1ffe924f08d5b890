"""Files that tasks write to and read from the shared folder, by any path that Arrow can open."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext

CHUNK, GAP = 8 << 20, 64 << 10


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Output:
    """A new file of this task. A second attempt at the task writes another file; only what
    the attempt that counts has listed is ever read."""

    def __init__(self, folder: str, suffix: str):
        self.part = TaskContext.get().partitionId()
        self.path = f"{folder}/{self.part:06d}-{uuid.uuid4().hex}{suffix}"
        files, path = store(self.path)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.size = files.open_output_stream(path, compression=None), 0

    def append(self, data: bytes) -> tuple[int, int]:
        """``(offset, length)`` of the data in the file."""
        place = self.size, len(data)
        self.stream.write(data)
        self.size += len(data)
        return place

    def close(self) -> None:
        self.stream.close()


def read_range(path: str, offset: int, length: int) -> bytes:
    files, name = store(path)
    with files.open_input_file(name) as file:
        return file.read_at(length, offset)


def read_ranges(wanted: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of each ``(path, offset, length)``, in the order given; neighbours in a
    file are fetched by one read of up to CHUNK bytes (or of one longer range)."""
    i, opened, file = 0, None, None
    while i < len(wanted):
        path, start, length = wanted[i]
        end, j = start + length, i + 1
        while j < len(wanted) and wanted[j][0] == path and end <= wanted[j][1] <= end + GAP and wanted[j][1] + wanted[j][2] - start <= CHUNK:
            end, j = wanted[j][1] + wanted[j][2], j + 1
        if path != opened:
            if file is not None:
                file.close()
            files, name = store(path)
            opened, file = path, files.open_input_file(name)
        data = memoryview(file.read_at(end - start, start))
        for _, offset, size in wanted[i:j]:
            yield bytes(data[offset - start:offset - start + size])
        i = j
    if file is not None:
        file.close()
