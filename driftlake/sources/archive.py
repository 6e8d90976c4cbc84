"""Members of gzip-compressed tar archives as rows, read forward and one at a time."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import member_key
from .streams import open_stream

MEMBERS = "archive string, name string, content binary"
#: A list of wanted keys up to this size goes to the tasks, so that they can stop early.
LISTED = 1_000_000


def members(path: str, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, str, bytes]]:
    """(archive, name, content) of the members whose name ends in `suffix`; with `wanted` (names without folder and suffix) these alone, and reading stops when all have come."""
    left = set(wanted or ())
    with open_stream(path) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
        for member in tar:
            key = member.name.rsplit("/", 1)[-1].removesuffix(suffix)
            if not member.isfile() or not member.name.endswith(suffix) or (wanted is not None and key not in left):
                continue
            yield path, member.name, tar.extractfile(member).read()
            left.discard(key)
            if wanted is not None and not left:
                return


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any store of Spark; comma-separated ones and URLs as they are."""
    out = []
    for one in pattern.split(","):
        if one.startswith(("http://", "https://")):
            out.append(one)
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = store.globStatus(path) or []
        for status in found:
            inside = store.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += [s.getPath().toString() for s in inside if s.isFile()]
    return sorted(out)


def read_archives(spark: SparkSession, path: str, suffix: str, wanted: DataFrame | None = None) -> DataFrame:
    """archive, name, key, content of the members whose name ends in `suffix`; with `wanted` (key), of these only.

    A task for each archive, of any size: it is streamed, a member at a time, and
    a task stops as soon as it has all that is wanted.
    """
    paths = files(spark, path)
    keys = None
    if wanted is not None:
        few = [r[0] for r in wanted.select("key").distinct().limit(LISTED + 1).collect()]
        keys = frozenset(few) if len(few) <= LISTED else None  # more are joined below

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where in batch["path"]:
                for row in members(where, suffix, keys):
                    yield pd.DataFrame([row], columns=["archive", "name", "content"])

    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "at int, path string")
    rows = listed.repartitionById(max(1, len(paths)), "at").select("path").mapInPandas(expand, MEMBERS)
    keyed = rows.withColumn("key", member_key(F.col("name"), suffix)).where(F.col("key").isNotNull())
    return keyed.join(wanted.select("key").distinct(), "key", "left_semi") if wanted is not None else keyed


class TarMembers(DataSource):
    """spark.read.format("tar_members").option("paths", "a.tar.gz,b.tar.gz").option("suffix", ...).load()

    A task for each archive; `wanted` (comma-separated keys, a short list) lets
    it stop when it has all.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.suffix = options.get("suffix", "")
        self.wanted = frozenset(w for w in options.get("wanted", "").split(",") if w) or None

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        yield from members(partition.path, self.suffix, self.wanted)
