"""Shared pieces of the training-data operators.

Words are runs of bytes other than 0x20 and 0x09-0x0D everywhere; `bytes.split()`
splits at exactly those bytes, and they never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import contextlib
import gc
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


BLANK_BYTES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words_of(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """All texts' words, with A-Z lower-cased: the number of each one among the different words; these; and where each text's words start (one more at the end)."""
    import pyarrow as pa

    data = [x.encode() for x in texts]
    raw = np.frombuffer(b"\n".join(data).translate(ASCII_LOWER), np.uint8)
    text_at = np.cumsum([0, *(len(x) + 1 for x in data)])
    at = np.flatnonzero(~BLANK_BYTES[raw])
    start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    offsets = np.append(start, len(at)).astype(np.int32)
    letters = np.ascontiguousarray(raw[at])
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist(), np.searchsorted(at[start], text_at)


class Kept(dict):
    """What a worker has computed, in two generations of at most `most` entries: full, the older one goes.

    `compute(key)` is called for keys in neither; keys longer than 64 are not
    kept. With short values that is some 200 bytes an entry, 40 MB a generation.
    """

    def __init__(self, compute, most: int = 200_000):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


_HELD: dict = {}


def held(key: object, make):
    """What one operator keeps in a worker between tasks. Another key, of this or another operator, drops it."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Workers are used again by later stages: what earlier ones held goes, and free memory back to the system."""
    if _HELD:
        _HELD.clear()
        trim()


def trim() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long, so Python workers get fewer of them at once than Spark's default of 10,000; other settings stay."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")

        found = "file://" + tempfile.mkdtemp(prefix="driftlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def clean(spark: SparkSession) -> None:
    """Lets Spark see which shuffled data nothing refers to any more; it removes them in the background.

    The last references go with the events of the job, a little after its end.
    """
    gc.collect()
    for _ in range(3):
        time.sleep(1)
        spark.sparkContext._jvm.java.lang.System.gc()


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z only; `lower` alone would change other letters too."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def file_bytes(path: str, most: int = 64 << 20) -> bytes:
    """A vocabulary file, small enough to be broadcast."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return data
