"""Files in the shared folder that Python workers write and read by byte range."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Roll:
    """Appends records to files of about `most` bytes below a folder.

    Every attempt of a task writes files of its own; those of a lost attempt are never listed, so nobody reads them.
    """

    def __init__(self, folder: str, suffix: str, most: int = 64 << 20):
        self.system, self.folder = opened(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.suffix, self.most, self.name, self.out, self.at = suffix, most, "", None, 0

    def write(self, record: bytes) -> tuple[str, int]:
        """The file's name and the record's offset in it."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out, self.at = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
        offset = self.at
        self.out.write(record)
        self.at += len(record)
        return self.name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def ranges(offsets: list[int], lengths: list[int], gap: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Sorted byte ranges coalesced: (first record, end record, offset, length), holes of at most `gap` bytes read over."""
    i = 0
    while i < len(offsets):
        j, end = i + 1, offsets[i] + lengths[i]
        while j < len(offsets) and offsets[j] - end <= gap and offsets[j] + lengths[j] - offsets[i] <= most:
            end = max(end, offsets[j] + lengths[j])
            j += 1
        yield i, j, offsets[i], end - offsets[i]
        i = j
