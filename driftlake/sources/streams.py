"""Forward-only and random reads of files in any store, by the scheme of their path."""

from __future__ import annotations

import io
from collections.abc import Callable
from urllib.request import Request, urlopen

from .fetch import RangeReader

#: Bytes of a range, and ranges read at once.
CHUNK, WORKERS = 16 << 20, 4


def http_ranges(url: str, open_url: Callable = urlopen) -> tuple[Callable[[int, int], bytes], int]:
    """(fetch of bytes first..last, length) of a URL whose server answers ranges."""
    with open_url(Request(url, method="HEAD")) as answer:
        total = int(answer.headers["Content-Length"])

    def fetch(first: int, last: int) -> bytes:
        with open_url(Request(url, headers={"Range": f"bytes={first}-{last}"})) as answer:
            return answer.read()

    return fetch, total


def file_ranges(path: str) -> tuple[Callable[[int, int], bytes], int]:
    """The same of a file in a store that Arrow opens (local, s3://, gs://, hdfs://)."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    total = store.get_file_info(name).size
    if total is None:
        raise FileNotFoundError(path)

    def fetch(first: int, last: int) -> bytes:
        with store.open_input_file(name) as f:
            return f.read_at(last - first + 1, first)

    return fetch, total


#: Schemes and who answers for them; more can be registered.
OPENERS: dict[str, Callable[[str], tuple[Callable[[int, int], bytes], int]]] = {"http": http_ranges, "https": http_ranges}


def ranges(path: str) -> tuple[Callable[[int, int], bytes], int]:
    return OPENERS.get(path.partition("://")[0], file_ranges)(path)


def open_stream(path: str, chunk: int = CHUNK, workers: int = WORKERS) -> io.BufferedReader:
    """A forward-only stream: ranges are read ahead by several workers and delivered in order, so memory is bounded whatever the file's size."""
    fetch, total = ranges(path)
    return io.BufferedReader(RangeReader(fetch, total, chunk, workers), 1 << 20)
