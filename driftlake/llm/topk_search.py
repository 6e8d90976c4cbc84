"""Operator 5: exact top-k by inner product, with multi-resolution segment statistics.

Vectors are rotated into the principal axes of the rows of a block, so that what
tells them apart comes first; inner products stay. A rotated vector's segments,
narrow in front and wider behind, are summed up by their mean and their
deviation. For two vectors these give a lower bound of the distance, so, with the
lengths known, an upper bound of the inner product. Bounds are taken from few to
many segments, for the pairs that are left; the exact product, of the vectors as
they came, is computed for the survivors alone. Where hardly any pair falls (as
among vectors in random directions), finer bounds cost more than products: such
a level rests for some tiles. That changes no result.

Queries and rows are dealt into blocks of bounded size; each pair of blocks is a
task, and each query's best rows of all tasks are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of a vector's length, where segments end at each level.
LEVELS = ((1,), (1 / 16, 1 / 4, 1), (1 / 32, 1 / 16, 3 / 32, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1))
EXACT = float(1 << 53)
#: A level that leaves more than this share of the pairs rests for so many tiles; up to this share of pairs, products are made one by one.
USELESS, REST, SPARSE = 0.95, 8, 0.1


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: _floor(x.cast("double") * scale))


def _floor(x: Column) -> Column:
    # beyond 2^53 a double is whole already, and may be no long
    return F.when(F.abs(x) < EXACT, F.floor(F.when(F.abs(x) < EXACT, x)).cast("double")).otherwise(x)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def statistics(v: np.ndarray, ends: tuple[float, ...]) -> np.ndarray:
    """For each row the means, times the root of the segment's length, and the deviations' lengths: products of these bound inner products."""
    cuts = sorted({0, *(round(e * v.shape[1]) for e in ends)})
    out = np.empty((len(v), 2 * (len(cuts) - 1)))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = v[:, a:b]
        mean = part.mean(1)
        out[:, k] = mean * math.sqrt(b - a)
        out[:, len(cuts) - 1 + k] = np.sqrt(((part - mean[:, None]) ** 2).sum(1))
    return out


def axes(v: np.ndarray) -> np.ndarray:
    """An orthonormal basis, the direction of the rows' greatest spread first."""
    return np.linalg.eigh(v.T @ v)[1][:, ::-1]


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products, as long as they fit into 64 bits; beyond, the nearest number that does."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, int(y))) for y in row] for row in whole(q) @ whole(v).T], np.int64).reshape(len(q), len(v))


def pair_products(q: np.ndarray, v: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact inner products of single pairs; see `products`."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1]) < EXACT:
        return np.einsum("ij,ij->i", q[rows], v[columns]).astype(np.int64)
    return np.array([products(q[r : r + 1], v[c : c + 1])[0, 0] for r, c in zip(rows.tolist(), columns.tolist(), strict=True)], np.int64)


def best_of(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and their rows, ties to the smaller id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, at = scores[keep], at[keep]
        top = np.lexsort((ids[at], -scores))[:k]
        scores, at = scores[top], at[top]
    return scores, at


def search(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, own: np.ndarray | None = None, step: int = 2048, seen: dict | None = None) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's k best rows, ties to the smaller id. own: the row that each query leaves out (-1: none).

    `seen` gets how many exact products were made (`exact`), of how many pairs (`pairs`).
    """
    own = np.full(len(q), -1) if own is None else own
    basis = axes(v) if len(v) else np.eye(q.shape[1])
    turned_q, turned_v = q @ basis, v @ basis
    stats = [(statistics(turned_q, ends), statistics(turned_v, ends)) for ends in LEVELS]
    slack = 1e-9 * (1 + np.sqrt((q * q).sum(1).max(initial=0) * (v * v).sum(1).max(initial=0)))
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(q))]
    kth = np.full(len(q), -np.inf)
    rest = [0] * len(LEVELS)
    count = {"exact": 0, "pairs": 0}
    for start in range(0, len(v), step):
        part = np.arange(start, min(len(v), start + step))
        count["pairs"] += len(q) * len(part)
        alive, pairs = np.ones((len(q), len(part)), bool), None
        for level, (a, b) in enumerate(stats if start else []):
            if rest[level]:
                rest[level] -= 1
                continue
            before = alive.size if pairs is None else len(pairs[0])
            if pairs is None:
                alive &= a @ b[part].T + slack >= kth[:, None]
                left = int(alive.sum())
                if left <= SPARSE * alive.size:
                    pairs = np.nonzero(alive)
            else:
                r, c = pairs
                keep = np.einsum("ij,ij->i", a[r], b[part[c]]) + slack >= kth[r]
                pairs = r[keep], c[keep]
                left = int(keep.sum())
            if left > USELESS * before:
                rest[level] = REST
            if not left:
                break
        if pairs is None:
            rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(rows):
                continue
            scores = products(q[rows], v[part[columns]])
            count["exact"] += scores.size
            mask = alive[np.ix_(rows, columns)] & (scores >= kth[rows, None]) & (part[columns][None, :] != own[rows, None])
            r, c = np.nonzero(mask)
            found, r, c = scores[mask], rows[r], part[columns][c]
        else:
            r, c = pairs[0], part[pairs[1]]
            count["exact"] += len(r)
            found = pair_products(q, v, r, c)
            keep = (found >= kth[r]) & (c != own[r])
            found, r, c = found[keep], r[keep], c[keep]
        if not len(r):
            continue
        cuts = np.flatnonzero(np.diff(r, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=True):
            x = int(r[a])
            best[x] = best_of(np.concatenate([best[x][0], found[a:b]]), np.concatenate([best[x][1], c[a:b]]), ids, k)
            if len(best[x][0]) >= k:
                kth[x] = best[x][0].min()
    if seen is not None:
        seen.update(count)
    return [(x, int(i), int(s)) for x in range(len(q)) for s, i in zip(*best[x], strict=True)]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, query_block: int = 4096, row_block: int = 32768, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows.

    Queries are the rows whose id is divisible by `every`. Vectors that are null
    or hold a null or non-finite component take no part, nor do rows with a null
    id; vectors of other dimensions don't meet. Rows with the same id are rows
    of their own: each is a candidate for all others, and a query of its own.
    With fewer than k other rows, all come. Scores beyond 64 bits are the nearest
    number that fits. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"))
    # equal rows are kept once, with their number
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("key", F.xxhash64("id", "v"))
    n = vectors.count()
    tasks = max(int(spark.sparkContext.defaultParallelism), 1)
    n_rows = max(1, -(-n // row_block), min(tasks, -(-n // 2048)))
    n_queries = max(1, -(-n // (every * query_block)))
    block = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(m)).cast("int")
    shape = F.size("v").alias("dim")
    columns = ["id", "v", "times", "key", shape]
    left = rows.where(F.col("id") % every == 0).select(*columns, F.lit(True).alias("query"), block("q", n_queries).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"))
    right = rows.select(*columns, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), block("r", n_rows).alias("rb"))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "query_key", "asked", "vec_id", "score", "times"]
        asks, rows = frame[frame["query"]], frame[~frame["query"]]
        if not len(asks) or not len(rows):
            return pd.DataFrame(columns=columns)
        q, v = (np.stack(x["v"].to_numpy()).astype(np.float64).reshape(len(x), int(key[2])) for x in (asks, rows))
        at = {pair: i for i, pair in enumerate(zip(rows["id"], rows["key"], strict=True))}
        alone = [at.get(pair, -1) for pair in zip(asks["id"], asks["key"], strict=True)]
        # a row that is there several times meets its equals
        own = np.array([-1 if i >= 0 and rows["times"].iat[i] > 1 else i for i in alone])
        found = search(q, rows["id"].to_numpy(), v, k, own)
        x, y, s = (np.array([f[j] for f in found], np.int64) for j in range(3))
        times = rows["times"].to_numpy()[y] - (y == np.array(alone)[x])
        return pd.DataFrame(dict(zip(columns, (asks["id"].to_numpy()[x], asks["key"].to_numpy()[x], asks["times"].to_numpy()[x], rows["id"].to_numpy()[y], s, times), strict=True)))

    near = left.unionByName(right).groupBy("qb", "rb", "dim").applyInPandas(run, "query_id long, query_key long, asked long, vec_id long, score long, times long")
    by = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    first = near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place")
    copies = F.sequence(F.lit(1), F.least("times", F.lit(k)))
    ranked = first.withColumn("copy", F.explode(copies)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.withColumn("again", F.explode(F.sequence(F.lit(1), "asked"))).select("query_id", "rank", "vec_id", "score")
