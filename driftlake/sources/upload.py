"""Resumable uploads in parts to a pluggable store, from any stream of ranges."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Protocol

PART = 50 << 20


class Store(Protocol):
    """What an object store has to offer; parts are numbered from 1."""

    def unfinished(self, key: str) -> str | None:
        """The number of an upload of this key that was begun and not completed."""

    def begin(self, key: str) -> str: ...

    def parts(self, key: str, upload: str) -> list[tuple[int, int, str]]:
        """(number, size, tag) of the parts that are there, in any order."""

    def put(self, key: str, upload: str, number: int, data: bytes) -> str:
        """The part's tag."""

    def complete(self, key: str, upload: str, parts: list[tuple[int, str]]) -> None: ...


def plan(total: int, part: int, there: dict[int, int]) -> list[tuple[int, int, int]]:
    """(number, first, last byte) of the parts that are missing or have another size."""
    out = []
    for number, first in enumerate(range(0, total, part), 1):
        last = min(first + part, total) - 1
        if there.get(number) != last - first + 1:
            out.append((number, first, last))
    return out


def upload(store: Store, key: str, fetch: Callable[[int, int], bytes], total: int, part: int = PART, workers: int = 6, report: Callable[[int, int], None] = lambda done, total: None) -> int:
    """Parts sent in this run. An upload that broke off goes on where parts are missing; at most `workers` parts are in memory."""
    if total <= 0:
        raise ValueError("nothing to upload")
    number = store.unfinished(key)
    there = {n: (size, tag) for n, size, tag in store.parts(key, number)} if number else {}
    number = number or store.begin(key)
    missing = plan(total, part, {n: size for n, (size, _) in there.items()})
    tags = {n: tag for n, (_, tag) in there.items()}
    done = total - sum(last - first + 1 for _, first, last in missing)

    def send(n: int, first: int, last: int) -> tuple[int, str, int]:
        return n, store.put(key, number, n, fetch(first, last)), last - first + 1

    left = iter(missing)
    with ThreadPoolExecutor(workers) as pool:
        running = {pool.submit(send, *m) for _, m in zip(range(workers), left)}
        while running:
            ended, running = wait(running, return_when=FIRST_COMPLETED)
            for f in ended:
                n, tags[n], size = f.result()
                done += size
                report(done, total)
                if (m := next(left, None)) is not None:
                    running.add(pool.submit(send, *m))
    count = -(-total // part)
    store.complete(key, number, [(n, tags[n]) for n in range(1, count + 1)])
    return len(missing)


class S3Store:
    """A bucket, by boto3 (not part of this package's requirements)."""

    def __init__(self, bucket: str, profile: str | None = None):
        try:
            import boto3
        except ImportError as e:
            raise RuntimeError("uploads to s3 need the package boto3") from e
        self.bucket, self.client = bucket, boto3.Session(profile_name=profile).client("s3")

    def unfinished(self, key: str) -> str | None:
        found = [u["UploadId"] for page in self.client.get_paginator("list_multipart_uploads").paginate(Bucket=self.bucket, Prefix=key) for u in page.get("Uploads", []) if u["Key"] == key]
        return found[-1] if found else None

    def begin(self, key: str) -> str:
        return self.client.create_multipart_upload(Bucket=self.bucket, Key=key)["UploadId"]

    def parts(self, key: str, upload: str) -> list[tuple[int, int, str]]:
        pages = self.client.get_paginator("list_parts").paginate(Bucket=self.bucket, Key=key, UploadId=upload)
        return [(p["PartNumber"], p["Size"], p["ETag"]) for page in pages for p in page.get("Parts", [])]

    def put(self, key: str, upload: str, number: int, data: bytes) -> str:
        return self.client.upload_part(Bucket=self.bucket, Key=key, UploadId=upload, PartNumber=number, Body=data)["ETag"]

    def complete(self, key: str, upload: str, parts: list[tuple[int, str]]) -> None:
        self.client.complete_multipart_upload(Bucket=self.bucket, Key=key, UploadId=upload, MultipartUpload={"Parts": [{"PartNumber": n, "ETag": t} for n, t in parts]})
