"""Running sums over one global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, by: str, amounts: dict[str, Column], groups: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with, for each name, the sum of the amount over the rows before: smaller `by`, then smaller `ties`.

    Rows are dealt into ranges of `by`; each range is summed, and sums of the
    ranges before (as many as shuffle partitions, for each group) are added to
    the running sums inside. Nulls come first. The rows are read three times, so
    they should be cheap to make or cached.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(by, [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    dealt = rows.withColumn("__range", at)
    ranges = dealt.groupBy(*groups, "__range").agg(*[F.sum(a).alias(f"__{name}") for name, a in amounts.items()])
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    base = ranges.select(*groups, "__range", *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in amounts])
    inside = W.partitionBy(*groups, "__range").orderBy(by, *ties).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(name) for name, a in amounts.items()])
    same = F.col("l.__range") == F.col("r.__range")
    for g in groups:
        same &= F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    both = own.alias("l").join(base.alias("r"), same)
    return both.select(*[F.col(f"l.{c}") for c in rows.columns], *[(F.col(f"l.{name}") + F.col(f"r.__{name}")).alias(name) for name in amounts])
