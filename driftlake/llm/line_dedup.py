"""Operator 3: line dedup by levelled sorted runs of line hashes.

A run is a written table of (hash, documents that hold it), bucketed and sorted
by hash. Documents come in batches. A batch's keys are counted and merge-anti-
joined with every run's keys that enough documents have already; the rest is the
batch's own run. As soon as two runs stand on one level they are merged into one
of the next, by a merge join that adds up their counts. Runs have equal buckets
in order, so neither these joins nor the merges move or sort a run again. At the
end all runs are merged, and lines whose key enough documents have go.

Hashes are two independent 64-bit values of the line's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, ascii_lower, free

SPACE = " \t\n\x0b\f\r"
HASH = ("h1", "h2")


def keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class Runs:
    """The state: levels of bucketed, sorted runs in the shared folder."""

    def __init__(self, scratch: Scratch, least: int, buckets: int | None = None):
        self.scratch, self.least, self.spark = scratch, least, scratch.spark
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []
        self.names: dict[int, str] = {}
        # a bucket is one file, so its order is known
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _write(self, rows: DataFrame) -> DataFrame:
        self.scratch.count += 1
        path, name = f"{self.scratch.root}/run-{self.scratch.count}", f"run_{self.scratch.root.rsplit('-', 1)[-1]}_{self.scratch.count}"
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        out.scratch_path, out.run_name = path, name
        return out

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.run_name}")
        self.scratch.drop(run)

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def admit(self, keys: DataFrame) -> None:
        """keys: h1, h2, n of a batch. Those that no run tells to be in enough documents need counting still: their run is added."""
        fresh = keys
        for run in self.runs():
            full = run.where(F.col("n") >= self.least).select(*HASH)
            fresh = fresh.join(full.hint("merge"), list(HASH), "left_anti")
        run = self._write(fresh.repartition(self.buckets, *HASH))
        level = 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._merged(self.levels[level], run), None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        n = F.coalesce(F.col("a.n"), F.lit(0)) + F.coalesce(F.col("b.n"), F.lit(0))
        both = a.alias("a").join(b.alias("b").hint("merge"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
        out = self._write(both.select(*[F.coalesce(f"a.{h}", f"b.{h}").alias(h) for h in HASH], n.alias("n")))
        self._drop(a)
        self._drop(b)
        return out

    def compact(self) -> DataFrame:
        """One run of all that was added."""
        whole = None
        for run in self.runs():
            whole = run if whole is None else self._merged(whole, run)
        self.levels = [whole]
        return whole

    def full(self) -> DataFrame:
        """h1, h2 of the keys that enough documents hold."""
        return self.compact().where(F.col("n") >= self.least).select(*HASH)


def lines_of(docs: DataFrame, shortest: int, doc_id: str, text: str) -> DataFrame:
    """doc, th (hash of the text), h1, h2, at (line numbers): a row for each row of docs and different key of enough code points."""
    own = keys(F.coalesce(F.col(text), F.lit("")))
    long_enough = F.filter(F.transform(own, lambda k, i: F.struct(F.char_length(k).alias("n"), hashed(k).alias("h"), i.alias("i"))), lambda x: x["n"] >= shortest)
    return docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("th"), long_enough.alias("l"))


def marked(docs: DataFrame, least_docs: int, shortest: int, batch_bytes: int, doc_id: str, text: str) -> DataFrame:
    """doc, th, bad (line numbers that go): a row for each row of docs that loses lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    batches = max(4, -(-size // batch_bytes))
    flat = lines_of(docs, shortest, doc_id, text).select("doc", "th", F.explode("l").alias("l")).select("doc", "th", F.col("l.h.h1").alias("h1"), F.col("l.h.h2").alias("h2"), F.col("l.i").alias("i"), F.pmod(F.xxhash64("doc", "th"), F.lit(batches)).cast("int").alias("batch"))
    lines = scratch.write(flat, "batch")
    runs = Runs(scratch, least_docs)
    for b in range(batches):
        # a document is told by its id and text; a key counts once in each
        once = lines.where(F.col("batch") == b).groupBy("doc", "th", *HASH).agg(F.lit(1))
        runs.admit(once.groupBy(*HASH).agg(F.count("*").alias("n")))
    # not a run: Spark may broadcast it, or split a line that very many documents have
    hit = lines.join(scratch.write(runs.full()), list(HASH), "left_semi")
    return hit.groupBy("doc", "th").agg(F.array_sort(F.collect_set("i")).alias("bad"))


def dedup_lines(docs: DataFrame, least_docs: int = 10, shortest: int = 1, batch_bytes: int = 256 << 30, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` less its repeated lines; all columns stay, and n_lines and n_dropped come in a struct `__lines` (a column of that name is replaced).

    A key (line without ASCII white space at its ends, A-Z lower-cased) of at
    least `shortest` code points that occurs in at least `least_docs` documents
    loses all its lines in every document. A null text counts as empty: one
    empty line. Rows with the same doc_id (or none) and the same text are one
    document for the count, and all of them lose the lines; rows with the same
    doc_id and other texts are other documents. Empty tables give no rows.
    """
    key, bad = free(docs, "__key"), free(docs, "__bad")
    own = docs.withColumn("__lines", F.struct(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("th")))
    found = marked(docs, least_docs, shortest, batch_bytes, doc_id, text).select(F.struct("doc", "th").alias(key), F.col("bad").alias(bad))
    both = own.join(found, F.col("__lines")["doc"].eqNullSafe(F.col(key)["doc"]) & (F.col("__lines")["th"] == F.col(key)["th"]), "left")
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(bad)), lambda i: F.get(split, i))
    whole = F.col(bad).isNull()
    stats = F.struct(F.size(split).cast("long").alias("n_lines"), F.coalesce(F.when(~whole, F.size(bad)), F.lit(0)).cast("long").alias("n_dropped"))
    return both.withColumn("__lines", stats).withColumn(text, F.when(whole, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n"))).drop(key, bad)


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **args) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row; see `dedup_lines`."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = dedup_lines(slim, **args)
    return out.select("doc_id", F.col("__lines")["n_lines"].alias("n_lines"), F.col("__lines")["n_dropped"].alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
