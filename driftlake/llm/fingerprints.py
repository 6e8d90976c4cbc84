"""Operator 9: document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last eight bytes ends a chunk where it is -1 modulo the
block size; each chunk gives one base-64 character. A fingerprint is
`block:signature:signature at twice the block`. Two fingerprints compare where
their block sizes are equal or one is twice the other, by the edit distance of
the signatures made at the same block size. Every chunk has its character, so
signatures span the whole text; those of repetitive texts can be long.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SMALLEST, USUAL, COMMON = 3, 64, 7
#: About how many bytes of text a range of doc_id has.
IN_RANGE = 64 << 20
#: A random value for each byte, made by a rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """At each byte, the sum of the last eight bytes' values, each shifted by its age; mixed."""
    r = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4):
        s = r.copy()
        s[k:] += r[:-k] << np.uint32(3 * k)
        r = s
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    r ^= r >> np.uint32(12)
    return r


def signature(data: bytes, ends: np.ndarray) -> str:
    out, at = [], 0
    for end in ends.tolist():
        out.append(ALPHABET[zlib.crc32(data[at : end + 1]) & 63])
        at = end + 1
    if at < len(data):
        out.append(ALPHABET[zlib.crc32(data[at:]) & 63])
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """The block size is the largest that gives at least half of the usual signature, or the smallest there is."""
    block = SMALLEST
    while block * USUAL < len(data):
        block *= 2
    r = rolling(data) if data else np.zeros(0, np.uint32)
    while True:
        ends = np.flatnonzero(r % np.uint32(block) == block - 1)
        if len(ends) >= USUAL // 2 or block <= SMALLEST:
            break
        block //= 2
    # repetitive texts have as many ends at larger blocks
    while 4 * block < 1 << 32 and len(more := ends[r[ends] % np.uint32(2 * block) == 2 * block - 1]) >= USUAL // 2:
        block, ends = 2 * block, more
    # ends at twice the block are among these
    double = ends[r[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(data, ends)}:{signature(data, double)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 cells at a time."""
    # what both begin and end with belongs to it
    least = min(len(a), len(b))
    start = next((i for i in range(least) if a[i] != b[i]), least)
    end = next((i for i in range(least - start) if a[-1 - i] != b[-1 - i]), least - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return start + end + len(a) - v.bit_count()


def alike(a: str, b: str) -> float:
    """1 - (insertions + deletions) / both lengths; long signatures must share seven characters in a row."""
    if a == b:
        return 1.0 if a else 0.0
    if min(len(a), len(b)) >= COMMON:
        seen = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
        if not any(b[i : i + COMMON] in seen for i in range(len(b) - COMMON + 1)):
            return 0.0
    total = len(a) + len(b)
    return 2 * common_length(a, b) / total if total else 0.0


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where the block sizes don't fit."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    if x == y:
        return max(alike(a1, b1), alike(a2, b2))
    if int(x) == 2 * int(y):
        return alike(a1, b2)
    if int(y) == 2 * int(x):
        return alike(a2, b1)
    return 0.0


def edited(text: str, after: str) -> str:
    """The last half (rounded down) replaced by as much of the next text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


REPORT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row. A null text counts as empty; repeated rows each get theirs; an empty table gives none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: fingerprint(x.encode()))

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))


def compare_neighbours(docs: DataFrame, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Next is the row with the next larger doc_id, after the last the first; nulls
    come first, and rows with the same doc_id follow each other by text. A null
    text counts as empty. A single row is its own next. Other columns are not read.

    Rows go to ranges of doc_id, once; the first row of each range goes to the
    range before it too, so no task needs to see another's rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not parts:
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-size // IN_RANGE))
    cuts = slim.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    slim = slim.withColumn("part", _bisect(cuts, F.col("doc_id")).cast("int"))
    # one row for each range, so bounded by `parts`
    first = {r["part"]: r["least"] for r in slim.groupBy("part").agg(F.min(F.struct(F.col("doc_id"), F.xxhash64("text").alias("th"))).alias("least")).collect()}
    order = sorted(first)
    heads = spark.createDataFrame([(p, first[p]["doc_id"], first[p]["th"], order[k - 1]) for k, p in enumerate(order)], "part int, head_id long, head_th long, before int")
    both = slim.join(F.broadcast(heads), "part")
    is_head = F.col("head_id").eqNullSafe(F.col("doc_id")) & (F.col("head_th") == F.xxhash64("text"))
    own, ahead = F.struct(F.col("part").alias("p"), F.lit(0).alias("ahead")), F.struct(F.col("before").alias("p"), F.lit(1).alias("ahead"))
    slim = both.select("doc_id", "text", F.inline(F.when(is_head, F.array(own, ahead)).otherwise(F.array(own))))
    dealt = slim.repartitionById(max(2, parts), "p").sortWithinPartitions("p", "ahead", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # part, ahead, id, text, fingerprint
        rows = []
        for batch in batches:
            for i, x, p, ahead in zip(batch["doc_id"], batch["text"], batch["p"], batch["ahead"], strict=True):
                if last and last[0] == p and last[1]:
                    continue  # repeated rows of a head: one is enough
                now = (p, ahead, i, x, fingerprint(x.encode()))
                if last and last[0] == p:
                    rows.append(_compare(last, now))
                last = now
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
                rows = []

    out = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "p", "ahead").mapInPandas(run, REPORT)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _bisect(cuts: list[int], value):
    """How many cuts are below the value, by halving."""
    if not cuts:
        return F.lit(0)
    lits = F.array(*map(F.lit, cuts))

    def halved(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = value > F.get(lits, mid)
        found = s["lo"] >= s["hi"]
        return F.struct(F.when(found | ~above, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(found | above, s["hi"]).otherwise(mid).alias("hi"))

    rounds = F.array_repeat(F.lit(0), len(cuts).bit_length())
    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.when(value.isNull(), 0).otherwise(F.aggregate(rounds, ends, halved)["lo"])


def _compare(a: tuple, b: tuple) -> tuple:
    _, _, i, text, own = a
    changed = edited(text, b[3]).encode()
    new = fingerprint(changed)
    return i, len(text), hashlib.sha256(changed).hexdigest(), own, new, likeness(own, new), likeness(own, b[4])
