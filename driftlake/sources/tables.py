"""Readers of the text tables: lineages, representative flags, family lists, manifests."""

from __future__ import annotations

import codecs
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RANKS, rank_of
from .streams import open_stream, ranges


def parse_lineages(rows: DataFrame, lineage: str = "lineage") -> DataFrame:
    """rows with a column for each rank; a missing rank is the empty string."""
    return rows.select("*", *[rank_of(F.col(lineage), p).alias(name) for name, p in RANKS.items()]).drop(lineage)


def read_taxonomy(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """accession, source and ranks from `accession<TAB>lineage` files, gzip or not; paths by source name."""
    out = None
    for source, path in paths.items():
        text = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("v")).where("v <> ''")
        rows = text.select(F.substring_index("v", "\t", 1).alias("accession"), F.lit(source).alias("source"), F.regexp_extract("v", r"^[^\t]*\t(.*)$", 1).alias("lineage"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no taxonomy files")
    return parse_lineages(out)


class _Lines:
    """A member of a streamed archive as text, for a reader that only goes forward."""

    def __init__(self, member):
        self.member, self.decode = member, codecs.getincrementaldecoder("utf-8")().decode

    def read(self, size: int = -1) -> str:
        data = self.member.read(size)
        return self.decode(data, not data)

    def __iter__(self):
        return iter(lambda: self.read(1 << 16), "")


def read_metadata(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a tab-separated file with a header, gzip or the first .tsv member of a .tar.gz; all strings, nothing inferred."""
    if not path.endswith(".tar.gz"):
        return spark.read.option("sep", "\t").option("header", "true").csv(path).select(*columns)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where in batch["path"]:
                with open_stream(where) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                    member = next(m for m in tar if m.name.endswith(".tsv"))
                    lines = _Lines(tar.extractfile(member))
                    for part in pd.read_csv(lines, sep="\t", usecols=columns, dtype=str, keep_default_na=False, chunksize=100_000):
                        yield part[columns]

    return spark.createDataFrame([(path,)], "path string").mapInPandas(expand, ", ".join(f"`{c}` string" for c in columns))


def representatives(metadata: DataFrame) -> DataFrame:
    """accession of the rows flagged t, each once."""
    return metadata.where(F.col("gtdb_representative") == "t").select("accession").distinct()


def read_family_ids(spark: SparkSession, path: str) -> DataFrame:
    """family: first tab-separated field of the lines that aren't blank, each once."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.substring_index("value", "\t", 1).alias("family")).distinct()


def first_existing(spark: SparkSession, stem: str, endings: tuple[str, ...] = (".tsv.gz", ".tar.gz")) -> str:
    """The path with the first ending that exists, in any store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for ending in endings:
        p = jvm.org.apache.hadoop.fs.Path(stem + ending)
        if p.getFileSystem(conf).exists(p):
            return stem + ending
    raise FileNotFoundError(f"no file for {stem} (tried {', '.join(endings)})")


def read_matrix(spark: SparkSession, path: str, ids: DataFrame, block: int = 50_000) -> DataFrame:
    """position, embedding of a two-dimensional .npy file, with the columns of ids (position, ...) joined by position; counts must agree."""
    import numpy as np

    fetch, total = ranges(path)
    head = io.BytesIO(fetch(0, min(total, 1 << 16) - 1))
    version = np.lib.format.read_magic(head)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 2 or by_column:
        raise ValueError(f"{path}: not a matrix by rows")
    first, (n, width) = head.tell(), shape
    size = width * dtype.itemsize

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, _ = ranges(path)
        for batch in batches:
            for at in batch["id"]:
                rows = min(block, n - at)
                part = np.frombuffer(read(first + at * size, first + (at + rows) * size - 1), dtype).reshape(rows, width).astype(np.float64)
                yield pd.DataFrame({"position": np.arange(at, at + rows), "embedding": list(part)})

    # each task reads its own rows
    matrix = spark.range(0, max(n, 1), block, max(1, -(-n // block))).where(F.col("id") < n).mapInPandas(expand, "position long, embedding array<double>")
    m = ids.count()
    if n != m:
        raise ValueError(f"{n} vectors, but {m} ids")
    return ids.join(matrix, "position")
