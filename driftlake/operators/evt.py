"""Extreme-value calibration: quantile, generalised Pareto tail, novelty, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import running_sums
from ..functions.vectors import gpd_survival

LEAST_EXCEEDANCES = 10
TOO_FEW = "a tail fit takes {least} distances beyond its threshold or more; beyond {u:.6g} there are {n}: too few"
#: Grid of log10(1 + theta * max) of the profile likelihood: lowest, highest, points at each level, levels.
GRID = (-6.0, 3.0, 180, 3)


def quantile(table: DataFrame, column: str, q: float, at_once: int = 1_000_000) -> float:
    """Exact, with linear interpolation, in bounded memory.

    A bracket around the wanted ranks is narrowed by histograms until it holds
    few rows; only these are sorted.
    """
    n, low, high = table.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        raise ValueError("quantile of an empty column")
    position = q * (n - 1)
    first = int(position)
    second = min(first + 1, n - 1)
    below, inside = 0, n
    while inside > at_once and low < high:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        bucket = F.least(F.floor((F.col(column) - low) / width), F.lit(4095))
        rows = table.where(F.col(column).between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy("b").collect()
        before, keep = below, []
        for r in rows:
            if before + r["n"] > first and before <= second:
                keep.append((before, r))
            before += r["n"]
        below, low, high, inside = keep[0][0], keep[0][1]["lo"], keep[-1][1]["hi"], sum(r["n"] for _, r in keep)
        if low == high:
            return float(low)
    rows = table.where(F.col(column).between(low, high)).agg(F.sort_array(F.collect_list(column)).alias("v")).select(F.get("v", F.lit(first - below)).alias("a"), F.get("v", F.lit(second - below)).alias("b")).first()
    return rows["a"] + (position - first) * (rows["b"] - rows["a"])


def exceedances(calibration: DataFrame, u: float) -> DataFrame:
    """y: how far distances lie above u, strictly."""
    return calibration.where(F.col("distance") > u).select((F.col("distance") - u).alias("y"))


def fit_mle(calibration: DataFrame, q: float = 0.9) -> dict:
    """u, shape, scale, zeta_u, n_exceedances, n_calibration by maximum likelihood with location 0.

    With theta = shape / scale the likelihood has one variable; a grid of it is
    summed over all exceedances in one pass, then refined around the best.
    """
    u = quantile(calibration, "distance", q)
    y = exceedances(calibration, u)
    n_all = calibration.count()
    n, most = y.agg(F.count("y"), F.max("y")).first()
    if n < LEAST_EXCEEDANCES:
        raise ValueError(TOO_FEW.format(n=n, u=u, least=LEAST_EXCEEDANCES))
    low, high, points, levels = GRID
    for _ in range(levels):
        step = (high - low) / points
        grid = y.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points)))).withColumn("s", F.lit(low) + F.col("j") * F.lit(step))
        theta = (F.pow(F.lit(10.0), F.col("s")) - 1.0) / F.lit(most)
        sums = grid.withColumn("theta", theta).groupBy("j", "s", "theta").agg(F.avg(F.log1p(F.col("theta") * F.col("y"))).alias("shape"), F.count("*").alias("n"))
        valid = sums.where((F.abs("theta") > 1e-9) & (F.col("shape") > -1))
        fitted = valid.withColumn("ll", -F.col("n") * (F.log(F.col("shape") / F.col("theta")) + F.col("shape") + 1.0))
        best = fitted.orderBy(F.desc("ll"), "j").first()
        low, high = best["s"] - step, best["s"] + step
    return {"u": u, "shape": best["shape"], "scale": best["shape"] / best["theta"], "zeta_u": n / n_all, "n_exceedances": n, "n_calibration": n_all}


def fit_groups(calibration: DataFrame, group: str, q: float = 0.9) -> DataFrame:
    """group, u, shape, scale, zeta_u of each group: `fit_mle` for all groups at once, each step one aggregation.

    Groups with too few excesses are left out. calibration: group, distance.
    """
    rows = calibration.select(group, "distance")
    sizes = rows.groupBy(group).agg(F.count("*").alias("n_all")).withColumn("at", F.lit(float(q)) * (F.col("n_all") - 1))
    placed = running_sums(rows, "distance", {"before": F.lit(1)}, (group,)).join(sizes, group)
    first, second = F.floor("at"), F.least(F.floor("at") + 1, F.col("n_all") - 1)
    at_rank = lambda k: F.min(F.when(F.col("before") == k, F.col("distance")))
    ends = placed.where((F.col("before") == first) | (F.col("before") == second)).groupBy(group, "n_all", "at").agg(at_rank(first).alias("a"), at_rank(second).alias("b"))
    cuts = ends.select(group, "n_all", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("u"))
    y = rows.join(cuts, group).where(F.col("distance") > F.col("u")).select(group, "u", "n_all", (F.col("distance") - F.col("u")).alias("y"))
    low, high, points, levels = GRID
    state = y.groupBy(group, "u", "n_all").agg(F.max("y").alias("most"), F.count("*").alias("n")).where(F.col("n") >= LEAST_EXCEEDANCES).select("*", F.lit(low).alias("low"), F.lit(high).alias("high"))
    names = [group, "u", "n_all", "most", "n"]
    for _ in range(levels):
        grid = state.withColumn("step", (F.col("high") - F.col("low")) / points).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points))))
        grid = grid.withColumn("s", F.col("low") + F.col("j") * F.col("step")).withColumn("theta", (F.pow(F.lit(10.0), F.col("s")) - 1.0) / F.col("most"))
        sums = y.select(group, "y").join(grid, group).groupBy(*names, "step", "j", "s", "theta").agg(F.avg(F.log1p(F.col("theta") * F.col("y"))).alias("shape"))
        valid = sums.where((F.abs("theta") > 1e-9) & (F.col("shape") > -1))
        likelihood = -F.col("n") * (F.log(F.col("shape") / F.col("theta")) + F.col("shape") + 1.0)
        best = valid.groupBy(*names).agg(F.max(F.struct(likelihood.alias("ll"), (-F.col("j")).alias("j"), "s", "step", "theta", "shape")).alias("b"))
        state = best.select(*names, (F.col("b.s") - F.col("b.step")).alias("low"), (F.col("b.s") + F.col("b.step")).alias("high"), F.col("b.theta").alias("theta"), F.col("b.shape").alias("shape"))
    return state.select(group, "u", "shape", (F.col("shape") / F.col("theta")).alias("scale"), (F.col("n") / F.col("n_all")).alias("zeta_u"))


def fit_pwm(calibration: DataFrame, q: float = 0.9) -> dict:
    """The same by probability-weighted moments; an additional estimator, not the likelihood's."""
    u = quantile(calibration, "distance", q)
    y = exceedances(calibration, u)
    ranked = _ranked(y)
    n_all = calibration.count()
    n = y.count()
    if n < LEAST_EXCEEDANCES:
        raise ValueError(TOO_FEW.format(n=n, u=u, least=LEAST_EXCEEDANCES))
    row = ranked.agg(F.avg("y").alias("a0"), F.avg(F.col("y") * (n - F.col("i")) / (n - 1)).alias("a1")).first()
    ratio = row["a0"] / (row["a0"] - 2 * row["a1"])
    return {"u": u, "shape": 2 - ratio, "scale": 2 * row["a0"] * row["a1"] / (row["a0"] - 2 * row["a1"]), "zeta_u": n / n_all, "n_exceedances": n, "n_calibration": n_all}


def _ranked(excesses: DataFrame) -> DataFrame:
    """y with i, its place from 1."""
    return running_sums(excesses.select("y"), "y", {"before": F.lit(1)}).select("y", (F.col("before") + 1).alias("i"))


def novelty(distance: Column, fit: dict) -> Column:
    """1 - p: 0 up to u, then 1 - zeta_u * survival of the excess. fit: numbers or columns."""
    u, shape, scale, zeta = (fit[n] if isinstance(fit[n], Column) else F.lit(fit[n]) for n in ("u", "shape", "scale", "zeta_u"))
    return F.lit(1.0) - F.when(distance > u, zeta * gpd_survival(distance - u, shape, scale)).otherwise(1.0)


def add_novelty(queries: DataFrame, fit: dict) -> DataFrame:
    return queries.withColumn("novelty", novelty(F.col("distance"), fit))


def add_novelty_ecdf(queries: DataFrame, calibration: DataFrame, fit: dict) -> DataFrame:
    """As `add_novelty`, but up to u the share of calibration distances that are not larger.

    A union sorted by distance gives each query its count by a running sum over
    ranges of distance, then inside them: no pairs are made.
    """
    n = fit["n_calibration"]
    both = queries.select("id", "distance", F.lit(0).alias("one")).unionByName(calibration.select(F.lit(None).cast("long").alias("id"), "distance", F.lit(1).alias("one")))
    width = max(fit["u"], 1e-12) / 1024
    both = both.withColumn("b", F.floor(F.col("distance") / width))
    before = both.groupBy("b").agg(F.sum("one").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("one").over(W.partitionBy("b").orderBy("distance"))
    ranked = both.withColumn("inside", inside).where(F.col("id").isNotNull()).join(before.select("b", "before"), "b")
    share = (F.col("before") + F.col("inside")) / F.lit(n)
    counted = ranked.select("id", share.alias("share"))
    return queries.join(counted, "id").withColumn("novelty", F.when(F.col("distance") > fit["u"], novelty(F.col("distance"), fit)).otherwise(F.col("share"))).drop("share")


def qq(calibration: DataFrame, fit: dict) -> DataFrame:
    """empirical, theoretical: order statistics of the excesses against the fitted quantiles at (i - 0.5) / n."""
    y = exceedances(calibration, fit["u"])
    n = fit["n_exceedances"]
    p = (F.col("i") - 0.5) / n
    shape, scale = F.lit(fit["shape"]), F.lit(fit["scale"])
    inverse = F.when(F.abs(shape) < 1e-12, -scale * F.log(1.0 - p)).otherwise(scale / shape * (F.pow(1.0 - p, -shape) - 1.0))
    return _ranked(y).select(F.col("i").cast("long").alias("i"), F.col("y").alias("empirical"), inverse.alias("theoretical"))


def mean_residual_life(calibration: DataFrame, points: int = 20) -> DataFrame:
    """threshold, mean_excess, n: at equal steps from the least to the largest distance (without it)."""
    low, high = calibration.agg(F.min("distance"), F.max("distance")).first()
    at = F.lit(low) + F.col("j") * F.lit((high - low) / points)
    rows = calibration.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("threshold", at).where(F.col("distance") > F.col("threshold"))
    return rows.groupBy("j", "threshold").agg(F.avg(F.col("distance") - F.col("threshold")).alias("mean_excess"), F.count("*").alias("n"))


def anderson_darling(calibration: DataFrame, fit: dict) -> DataFrame:
    """a2, n: the statistic of the excesses under the fitted tail."""
    y = exceedances(calibration, fit["u"])
    n = fit["n_exceedances"]
    cdf = F.least(F.greatest(1.0 - gpd_survival(F.col("y"), F.lit(fit["shape"]), F.lit(fit["scale"])), F.lit(1e-12)), F.lit(1 - 1e-12))
    ranked = _ranked(y).withColumn("f", cdf)
    # the i-th from below meets 2i - 1, and from above 2(n - i) + 1
    term = (2 * F.col("i") - 1) * F.log("f") + (2 * (n - F.col("i")) + 1) * F.log(1.0 - F.col("f"))
    return ranked.agg((F.lit(-float(n)) - F.sum(term) / n).alias("a2"), F.count("*").alias("n"))
