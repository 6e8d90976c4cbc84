"""Nearest neighbours by cosine distance, exact.

Queries and references are dealt into blocks of bounded size; each pair of
blocks is one task (a matrix product), which sends each query's k nearest only.
A window merges them. Nothing is broadcast, so any number of references works.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles, cosine_distance, l2_normalize

NEAR = "query_id long, out string, ref_id long, distance double"


def unit_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *more: str) -> DataFrame:
    """id, u (unit vector) and further columns. Rows take no part whose id or vector is null or whose vector is empty or holds a null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    usable = table.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return usable.select(F.col(vec_id).alias("id"), l2_normalize(as_doubles(F.col(vector))).alias("u"), *more)


def _blocks(n: int, block: int) -> int:
    return max(1, -(-n // block))


def nearest(queries: DataFrame, references: DataFrame, k: int, exclude_self: bool = False, query_block: int = 4096, ref_block: int = 16384, apart: str | None = None) -> DataFrame:
    """query_id, ref_id, distance, rank (from 1): the k nearest references; ties to the smaller id; all if there are fewer.

    With `apart`, a column of both tables, a query doesn't meet references with
    its value, and the result has it too. Vectors of other lengths don't meet.
    Queries without references give no rows.
    """
    nq, nr = _blocks(queries.count(), query_block), _blocks(references.count(), ref_block)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = (F.col(apart) if apart else F.lit(None)).cast("string").alias("out")
    left = queries.select("id", "u", out, F.size("u").alias("dim"), F.lit(True).alias("asks"), deal(nq).alias("qb"), every(nr).alias("rb"))
    right = references.select("id", "u", out, F.size("u").alias("dim"), F.lit(False).alias("asks"), every(nq).alias("qb"), deal(nr).alias("rb"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        ids, names = rows["id"].to_numpy(), rows["out"].to_numpy()
        tags = pd.factorize(rows["out"])[0]
        q_ids, r_ids = ids[asks], ids[~asks]
        if not len(q_ids) or not len(r_ids):
            return pd.DataFrame(columns=["query_id", "out", "ref_id", "distance"])
        q, r, q_tags, r_tags = np.stack(rows["u"][asks].to_numpy()), np.stack(rows["u"][~asks].to_numpy()), tags[asks], tags[~asks]
        order = np.argsort(r_ids, kind="stable")
        r, r_ids, r_tags = r[order], r_ids[order], r_tags[order]
        parts = []
        for at in range(0, len(q), 512):
            distance = 1.0 - q[at : at + 512] @ r.T
            if exclude_self:
                distance[q_ids[at : at + 512, None] == r_ids[None, :]] = np.inf
            if apart:
                distance[q_tags[at : at + 512, None] == r_tags[None, :]] = np.inf
            top = min(k, distance.shape[1])
            # the k-th distance, then all up to it, so that ties are settled by id
            limit = np.partition(distance, top - 1, axis=1)[:, top - 1 : top]
            rows_, columns = np.nonzero((distance <= limit) & np.isfinite(distance))
            parts.append(pd.DataFrame({"query_id": q_ids[at + rows_], "out": names[asks][at + rows_], "ref_id": r_ids[columns], "distance": distance[rows_, columns]}))
        return pd.concat(parts).sort_values(["query_id", "out", "distance", "ref_id"]).groupby(["query_id", "out"], dropna=False).head(k)

    found = left.unionByName(right).groupBy("qb", "rb", "dim").applyInPandas(run, NEAR)
    by = W.partitionBy("query_id", "out").orderBy("distance", "ref_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.withColumn("out", F.col("out").cast(queries.schema[apart].dataType)) if apart else ranked.drop("out")


def nearest_native(queries: DataFrame, references: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The same by a join and a window alone, for small tables and for tests."""
    r = references.select(F.col("id").alias("ref_id"), F.col("u").alias("ru"))
    pairs = queries.select(F.col("id").alias("query_id"), F.col("u").alias("qu")).join(r, F.col("query_id") != F.col("ref_id") if exclude_self else F.lit(True))
    by = W.partitionBy("query_id").orderBy("distance", "ref_id")
    near = pairs.select("query_id", "ref_id", cosine_distance(F.col("qu"), F.col("ru")).alias("distance"))
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mean_distance(queries: DataFrame, references: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """id, distance: mean distance to the k nearest references."""
    near = nearest(queries, references, k, exclude_self)
    return near.groupBy(F.col("query_id").alias("id")).agg(F.avg("distance").alias("distance"))
