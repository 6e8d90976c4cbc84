"""Evaluation of a score against labels: Precision@K, lift, AUROC, ROC, calibration, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import running_sums
from . import evt, knn


def top_positives(scored: DataFrame, most: int, score: str = "novelty", label: str = "is_positive", order: str = "id") -> DataFrame:
    """rank, hit of the best `most` rows; ties stay in input order. Only these rows meet in one task."""
    best = scored.select(F.col(score).alias("s"), F.col(label).cast("double").alias("hit"), F.col(order).alias("o")).orderBy(F.desc("s"), "o").limit(most)
    return best.select("hit", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("s"), "o")).cast("long").alias("rank"))


def precision_at(scored: DataFrame, ks: list[int], **names: str) -> DataFrame:
    """k, precision, n: share of positives among the k best, k clipped to the rows there are; all k in one pass."""
    top = top_positives(scored, max(ks), **names)
    ask = F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k")
    return top.select("rank", "hit", ask).where(F.col("rank") <= F.col("k")).groupBy("k").agg(F.avg("hit").alias("precision"), F.count("*").alias("n"))


def lift_curve(scored: DataFrame, score: str = "novelty", label: str = "is_positive", order: str = "id") -> DataFrame:
    """k, precision, lift over the base rate, for every k up to the number of rows; null lift without positives. Ties stay in input order."""
    hits = F.col("hit")
    rows = scored.select((-F.col(score)).alias("s"), F.col(label).cast("double").alias("hit"), F.col(order).alias("o"))
    base = rows.agg(F.avg("hit")).first()[0]
    placed = running_sums(rows, "s", {"better": F.lit(1), "found": hits}, ties=("o",))
    k = (F.col("better") + 1).cast("long")
    precision = (F.col("found") + hits) / k
    return placed.select(k.alias("k"), precision.alias("precision"), F.try_divide(precision, F.lit(base)).alias("lift"))


def auroc(scored: DataFrame, groups: list[str] = (), score: str = "novelty", label: str = "is_positive") -> DataFrame:
    """auroc, n_pos, n_neg by group: rank sums with average ranks of ties, null where a class is empty.

    Ranks come from counts by distinct score, so tied scores cost one row.
    """
    g = list(groups)
    by_score = scored.groupBy(*g, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    ranked = running_sums(by_score, "s", {"before": F.col("n")}, tuple(g)).withColumn("r", F.col("before") + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*g).agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"))
    pos = F.col("n_pos").cast("double")
    return sums.select(*g, F.try_divide(F.col("rs") - pos * (pos + 1) / 2, pos * F.col("n_neg")).alias("auroc"), "n_pos", "n_neg")


def edges(bins: int) -> list[float]:
    """Equal steps from 0 to 1, as floating-point products of the step."""
    return [k * (1.0 / bins) if k < bins else 1.0 for k in range(bins + 1)]


def bin_of(score: Column, bins: int) -> Column:
    """Right-closed bin from 0, lowest edge included; null outside [0, 1]."""
    at = edges(bins)
    out = F.when((score >= at[0]) & (score <= at[1]), 0)
    for k in range(1, bins):
        out = out.when((score > at[k]) & (score <= at[k + 1]), k)
    return out


def calibration(scored: DataFrame, bins: int = 10, score: str = "novelty", label: str = "is_positive") -> DataFrame:
    """bin, bin_lo, bin_hi, observed, predicted, n of the bins that have rows."""
    at = F.array(*[F.lit(x) for x in edges(bins)])
    rows = scored.select(bin_of(F.col(score), bins).alias("bin"), F.col(score).alias("s"), F.col(label).cast("double").alias("y")).where(F.col("bin").isNotNull())
    found = rows.groupBy("bin").agg(F.avg("y").alias("observed"), F.avg("s").alias("predicted"), F.count("*").alias("n"))
    return found.select(F.col("bin").cast("long").alias("bin"), F.get(at, F.col("bin")).alias("bin_lo"), F.get(at, F.col("bin") + 1).alias("bin_hi"), "observed", "predicted", "n")


def roc(scored: DataFrame, points: int = 200, score: str = "novelty", label: str = "is_positive") -> DataFrame:
    """threshold, tpr, fpr at equal steps from 0 to 1, scores at or above counted.

    Each score goes to the last threshold it reaches; suffix sums do the rest,
    so the table is read once, whatever the number of thresholds.
    """
    step = 1.0 / (points - 1)
    guess = F.floor(F.col(score) / step).cast("int")
    # rounding may put a score one step off
    k = F.when(F.col(score) >= (guess + 1) * F.lit(step), guess + 1).when(F.col(score) < guess * F.lit(step), guess - 1).otherwise(guess)
    rows = scored.where(F.col(score) >= 0).select(F.least(k, F.lit(points - 1)).alias("k"), F.col(label).cast("long").alias("y"))
    counts = rows.groupBy("k").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    spark = scored.sparkSession
    all_k = spark.range(points).select(F.col("id").cast("int").alias("k"))
    after = W.partitionBy(F.lit(0)).orderBy("k").rowsBetween(0, W.unboundedFollowing)
    sums = all_k.join(counts, "k", "left").select("k", F.coalesce(F.sum("p").over(after), F.lit(0)).alias("tp"), F.coalesce(F.sum("q").over(after), F.lit(0)).alias("fp"))
    total = scored.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return sums.crossJoin(F.broadcast(total)).select(F.col("k").cast("long").alias("k"), (F.col("k") * F.lit(step)).alias("threshold"), F.try_divide("tp", "pos").alias("tpr"), F.try_divide("fp", "neg").alias("fpr"))


def histogram(scored: DataFrame, bins: int = 30, score: str = "novelty", label: str = "is_positive") -> DataFrame:
    """label, bin, bin_lo, density, n: each class over its own range; the last bin is right-closed, and a range of no width is one unit wide."""
    spans = scored.groupBy(F.col(label).alias("y")).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count("*").alias("all"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    spans = spans.select("y", lo.alias("lo"), ((hi - lo) / bins).alias("w"), "all")
    rows = scored.select(F.col(label).alias("y"), F.col(score).alias("s")).join(F.broadcast(spans), "y")
    own = rows.withColumn("bin", F.least(F.floor((F.col("s") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("long"))
    return own.groupBy("y", "bin", "lo", "w", "all").agg(F.count("*").alias("n")).select(F.col("y").alias(label), "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_lo"), (F.col("n") / (F.col("all") * F.col("w"))).alias("density"), "n")


def held_out_families(references: DataFrame, families: DataFrame, k: int, q: float, controls: DataFrame) -> DataFrame:
    """family, id, is_positive, novelty: each family scored as if it were unknown, with its controls.

    references: id, u, family; families: family, of those to hold out; controls:
    family, id. Taking a family out changes the neighbours of those references
    alone that had one of its members among their k nearest, so only these are
    searched again, without it. Each family is calibrated on the references left.
    """
    found = knn.nearest(references, references, k, exclude_self=True)
    own = references.select("id", F.col("family").alias("own"))
    near = found.join(own.select(F.col("id").alias("ref_id"), F.col("own").alias("near")), "ref_id")
    usual = found.groupBy(F.col("query_id").alias("id")).agg(F.avg("distance").alias("usual"))
    touched = near.select(F.col("query_id").alias("id"), F.col("near").alias("out")).distinct().join(families.select(F.col("family").alias("out")), "out", "left_semi")
    again = knn.nearest(references.join(touched, "id").select("id", "u", "out"), references.select("id", "u", F.col("family").alias("out")), k, exclude_self=True, apart="out")
    others = again.groupBy(F.col("query_id").alias("id"), F.col("out").alias("family")).agg(F.avg("distance").alias("other"))
    # every reference once for each family
    every = usual.join(own, "id").join(F.broadcast(families.select("family")))
    rows = every.join(others, ["id", "family"], "left").join(touched.select("id", F.col("out").alias("family"), F.lit(True).alias("touched")), ["id", "family"], "left")
    rows = rows.select("family", "id", F.when(F.col("touched"), F.col("other")).otherwise(F.col("usual")).alias("distance"), (F.col("own") == F.col("family")).alias("is_positive")).where(F.col("distance").isNotNull()).cache()
    fits = evt.fit_groups(rows.where(~F.col("is_positive")), "family", q)
    asked = rows.join(controls.select("family", "id", F.lit(True).alias("control")), ["family", "id"], "left").where(F.col("is_positive") | F.col("control"))
    return asked.join(fits, "family").select("family", "id", "is_positive", evt.novelty(F.col("distance"), {n: F.col(n) for n in ("u", "shape", "scale", "zeta_u")}).alias("novelty"))
