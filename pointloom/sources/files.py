"""Ranged and sequential reads of large files, on local disks or in stores that pyarrow's file systems know by URI."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[str]:
    """The file itself, or the files with the suffix in a folder, by name; URIs stay URIs."""
    system, inside = located(path)
    if system.get_file_info(inside).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inside)) if i.type == fs.FileType.File and i.base_name.endswith(suffix))
    return [f"{path.rstrip('/')}/{n}" for n in names]


class Source:
    """One open file: parts of it by place, or all of it in order. It never holds more than is asked for."""

    def __init__(self, path: str):
        system, inside = located(path)
        self.file = system.open_input_file(inside)
        self.size = self.file.size()
        self.taken = 0  # bytes read by place

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, place: int, n: int) -> bytes:
        data = self.file.read_at(n, place)
        self.taken += len(data)
        return data

    def many(self, places: list[tuple[int, int]], workers: int = 16) -> list[bytes]:
        """Many small parts at once, as a store answers each only after a while."""
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(lambda p: self.at(*p), places))

    def stream(self) -> io.BufferedReader:
        return io.BufferedReader(self.file, 1 << 20)


def grouped(parts: Iterable[tuple[int, object]], most: int) -> Iterator[list]:
    """Parts (size, what) in lists of about `most` bytes, in their order."""
    held, size = [], 0
    for n, what in parts:
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(what)
        size += n
    if held:
        yield held
