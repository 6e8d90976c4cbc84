"""Fetching on the driver: whole files with checks and retries, and ranges read ahead in order."""

from __future__ import annotations

import hashlib
import io
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.error import HTTPError
from urllib.request import urlopen


def download(url: str, to: Path, tries: int = 5, open_url: Callable = urlopen, sleep: Callable = time.sleep) -> int:
    """Bytes written. A file shorter than its stated length is fetched anew; waits grow by five seconds up to thirty."""
    for attempt in range(1, tries + 1):
        try:
            with open_url(url) as answer, open(to, "wb") as f:
                stated = answer.headers.get("Content-Length")
                size = 0
                while data := answer.read(1 << 20):
                    f.write(data)
                    size += len(data)
            if stated is None or size == int(stated):
                return size
            problem: Exception = OSError(f"{url}: {size} of {stated} bytes")
        except HTTPError as e:
            if e.code == 404:
                raise
            problem = e
        except OSError as e:
            problem = e
        if attempt < tries:
            sleep(min(5 * attempt, 30))
    raise problem


def fetch_all(urls: dict[str, str], folder: Path, endings: tuple[str, ...] = (), **args) -> dict[str, int]:
    """Sizes by name. Files that are there stay; with `endings`, a 404 tries the next one."""
    folder.mkdir(parents=True, exist_ok=True)
    out = {}
    for name, url in urls.items():
        for k, ending in enumerate(endings or ("",)):
            path = folder / (name + ending)
            try:
                out[path.name] = path.stat().st_size if path.exists() else download(url + ending, path, **args)
                break
            except HTTPError as e:
                path.unlink(missing_ok=True)
                if e.code != 404 or k == len(endings or ("",)) - 1:
                    raise
    return out


def verify_md5(path: Path, wanted: str) -> None:
    found = hashlib.file_digest(open(path, "rb"), "md5").hexdigest()
    if found != wanted.lower():
        raise ValueError(f"{path}: md5 {found}, not {wanted}")


class RangeReader(io.RawIOBase):
    """A forward-only stream over ranges fetched by several workers, delivered in order; at most twice as many ranges as workers are held."""

    def __init__(self, fetch: Callable[[int, int], bytes], total: int, chunk: int = 16 << 20, workers: int = 4, tries: int = 10, sleep: Callable = time.sleep):
        self.fetch, self.total, self.chunk, self.tries, self.sleep = fetch, total, chunk, tries, sleep
        self.pool, self.most = ThreadPoolExecutor(workers), 2 * workers
        self.ahead: deque = deque()
        self.next, self.left = 0, b""

    def readable(self) -> bool:
        return True

    def _one(self, start: int, end: int) -> bytes:
        for attempt in range(1, self.tries + 1):
            try:
                data = self.fetch(start, end)
                if len(data) == end - start + 1:
                    return data
                problem: Exception = OSError(f"{len(data)} bytes of range {start}-{end}")
            except OSError as e:
                problem = e
            if attempt < self.tries:
                self.sleep(min(5 * attempt, 30))
        raise problem

    def readinto(self, buffer) -> int:
        while self.next < self.total and len(self.ahead) < self.most:
            end = min(self.next + self.chunk, self.total) - 1
            self.ahead.append(self.pool.submit(self._one, self.next, end))
            self.next = end + 1
        if not self.left and self.ahead:
            self.left = self.ahead.popleft().result()
        n = min(len(buffer), len(self.left))
        buffer[:n] = self.left[:n]
        self.left = self.left[n:]
        return n

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)
        super().close()
