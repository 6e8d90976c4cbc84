"""Separation of labelled groups in an embedding, and the groups to measure it on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import strict_normalize


def separation(vectors: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """n_sequences, n_families, within_family_mean_cosine, across_family_mean_cosine, separation_gap.

    Over ordered pairs without the diagonal, by the sums of unit vectors of each
    label: linear in the number of vectors, no pair is made. A mean without
    pairs is null.
    """
    unit = vectors.select(F.col(label).alias("f"), F.posexplode(strict_normalize(F.col(vector))).alias("i", "x"))
    own = unit.groupBy("f", "i").agg(F.sum("x").alias("s"))
    squares = own.groupBy("f").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    total = own.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    sizes = vectors.groupBy(F.col(label).alias("f")).agg(F.count("*").alias("n"))
    sums = squares.join(sizes, "f").agg(F.sum("n").alias("n"), F.count("*").alias("families"), F.sum("ss").alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    n, nn, ss = F.col("n"), F.col("nn"), F.col("ss")
    within, across = F.try_divide(ss - n, nn - n), F.try_divide(F.col("all") - ss, n * n - nn)
    return sums.crossJoin(F.broadcast(total)).select(n.alias("n_sequences"), F.col("families").alias("n_families"), within.alias("within_family_mean_cosine"), across.alias("across_family_mean_cosine"), (within - across).alias("separation_gap"))


def separation_by_pairs(vectors: DataFrame, vec_id: str, label: str = "label", vector: str = "v", block: int = 4096) -> DataFrame:
    """The same from the cosines of all pairs: each pair of blocks is a task, which sends sums alone. Vectors of length 0, or with a null, take no part."""
    unit = vectors.select(F.col(vec_id).alias("i"), F.col(label).cast("string").alias("f"), strict_normalize(F.col(vector)).alias("u"))
    unit = unit.where(F.col("u").isNotNull() & F.forall("u", lambda x: x.isNotNull() & ~F.isnan(x)))
    n = max(1, -(-vectors.count() // block))
    own = F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y")))
    dealt = unit.select("i", "f", "u", own.alias("b"), F.explode(places).alias("p")).select("i", "f", "u", "b", "p.*")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = int(key[0]), int(key[1])
        names, u = pd.factorize(rows["f"])[0], np.stack(rows["u"].to_numpy())
        a, b = (rows["b"] == x).to_numpy(), (rows["b"] == y).to_numpy()
        cosine, same = u[a] @ u[b].T, names[a][:, None] == names[b][None, :]
        if x == y:  # without a vector and itself; both orders are there
            off = ~np.eye(len(cosine), dtype=bool)
            cosine, same, times = cosine[off], same[off], 1
        else:
            times = 2
        return pd.DataFrame({"same": [True, False], "total": [times * cosine[same].sum(), times * cosine[~same].sum()], "n": [times * int(same.sum()), times * int((~same).sum())]})

    sums = dealt.groupBy("x", "y").applyInPandas(run, "same boolean, total double, n long")
    mean = lambda which: F.try_divide(F.sum(F.when(which, F.col("total"))), F.sum(F.when(which, F.col("n"))))
    return sums.agg(mean(F.col("same")).alias("within_family_mean_cosine"), mean(~F.col("same")).alias("across_family_mean_cosine"))


def single_family_members(hits: DataFrame, member: str = "protein_id", family: str = "family") -> DataFrame:
    """member, family of those that hit exactly one family."""
    return hits.groupBy(F.col(member).alias("member")).agg(F.count("*").alias("hits"), F.min(family).alias("family")).where("hits = 1").drop("hits")


def labeled_subset(hits: DataFrame, min_family_size: int = 3, per_family: int = 4, max_families: int | None = None, member: str = "protein_id", family: str = "family") -> DataFrame:
    """family, member, rank, n_members: the first members of families that are large enough.

    With more than `max_families`, the largest stay; ties to the family whose
    first member comes first.
    """
    single = single_family_members(hits, member, family)
    sizes = single.groupBy("family").agg(F.count("*").alias("n_members"), F.min("member").alias("first")).where(F.col("n_members") >= min_family_size)
    if max_families is not None:
        sizes = sizes.orderBy(F.desc("n_members"), "first").limit(max_families)
    rank = F.row_number().over(W.partitionBy("family").orderBy("member"))
    return single.join(sizes.select("family", "n_members"), "family").withColumn("rank", rank.cast("long")).where(F.col("rank") <= per_family)


def largest_family(hits: DataFrame, min_family_size: int, member: str = "protein_id", family: str = "family") -> DataFrame:
    """family, n_members of the family to hold out; the first by name on ties. No row if none is large enough."""
    single = single_family_members(hits, member, family)
    return single.groupBy("family").agg(F.count("*").alias("n_members")).where(F.col("n_members") >= min_family_size).orderBy(F.desc("n_members"), "family").limit(1)
