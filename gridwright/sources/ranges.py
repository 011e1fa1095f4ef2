"""Files that are read in ranges: opened where they are needed, on the driver or in a task, and never loaded whole."""

from __future__ import annotations

import io
from urllib.parse import unquote

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_file(path: str):
    """A seekable file; `size()` is its length."""
    store, at = file_system(path)
    return store.open_input_file(at)


def read_range(file, start: int, size: int) -> bytes:
    """Bytes from a place on; ValueError where the file ends before."""
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"file ends within {size} bytes at {start}")
    return data


class Within(io.RawIOBase):
    """A stretch of a seekable file as a file of its own: a stored member of an archive, read in place."""

    def __init__(self, file, start: int, length: int):
        self.file, self.start, self.length, self.at = file, start, length, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def size(self) -> int:
        return self.length

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + {0: 0, 1: self.at, 2: self.length}[whence]
        return self.at

    def read(self, size: int = -1) -> bytes:
        left = max(0, self.length - self.at)
        size = left if size < 0 else min(size, left)
        self.file.seek(self.start + self.at)
        data = self.file.read(size)
        self.at += len(data)
        return data
