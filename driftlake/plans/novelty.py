"""Queries over `embeddings`: labels 0-4 are references, 5-9 queries, 5 and 6 positive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles, masked_mean, norm, rounded
from ..operators import evaluation as ev
from ..operators import evt, knn, separation
from ..session import table

K, Q, KS = 5, 0.9, [1, 5, 10, 20]
PRECISION_KS = [10, 50, 100, 500, 5000]
SEED = 42


class Base:
    """The steps that the queries share, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str, k: int = K):
        self.k = k
        self.vectors = knn.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
        self.references, self.queries = self.vectors.where("label < 5"), self.vectors.where("label >= 5")
        self.positive = self.queries.select("id", F.col("label").isin(5, 6).alias("is_positive"))

    def calibration(self) -> DataFrame:
        return knn.mean_distance(self.references, self.references, self.k, exclude_self=True)

    def distances(self) -> DataFrame:
        return knn.mean_distance(self.queries, self.references, self.k)

    def fit(self) -> tuple[DataFrame, dict]:
        loo = self.calibration().cache()
        return loo, evt.fit_mle(loo, Q)

    def scored(self) -> DataFrame:
        _, fit = self.fit()
        return evt.add_novelty(self.distances(), fit).join(self.positive, "id")


def l2_normalize_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10."""
    rows = table(spark, sf_dir, "embeddings")
    return knn.unit_vectors(rows.select("*", norm(as_doubles(F.col("embedding"))).alias("before")), "vec_id", "embedding", "before").select(F.col("id").alias("vec_id"), rounded(F.col("before")).alias("norm"), rounded(norm(F.col("u"))).alias("unit_norm"))


def knn_raw_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10-P12, J12, W1, A6, P6."""
    b = Base(spark, sf_dir)
    return b.distances().join(b.positive, "id").select(F.col("id").alias("vec_id"), rounded(F.col("distance")).alias("raw_knn_distance"), "is_positive")


def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours themselves."""
    b = Base(spark, sf_dir)
    return knn.nearest(b.queries, b.references, K).select("query_id", "ref_id", F.col("rank").cast("long").alias("rank"), rounded(F.col("distance")).alias("distance"))


def loo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, A6."""
    return Base(spark, sf_dir).calibration().select(F.col("id").alias("vec_id"), rounded(F.col("distance")).alias("loo_distance"))


def loo_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, F6."""
    loo = Base(spark, sf_dir).calibration().cache()
    u = evt.quantile(loo, "distance", Q)
    return loo.agg(F.count("*").alias("n_calibration"), F.count_if(F.col("distance") > u).alias("n_exceedances")).select(rounded(F.lit(u)).alias("u"), "n_calibration", "n_exceedances", rounded(F.col("n_exceedances") / F.col("n_calibration")).alias("zeta_u"))


def k_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, A6 for several k; one search serves all."""
    b = Base(spark, sf_dir)
    near = knn.nearest(b.queries, b.references, max(KS))
    by_query = near.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in KS]))).where(F.col("rank") <= F.col("k")).groupBy("k", "query_id").agg(F.avg("distance").alias("d"))
    return by_query.groupBy("k").agg(rounded(F.avg("d")).alias("mean_distance"), rounded(F.max("d")).alias("max_distance"))


def _params(spark: SparkSession, fit: dict) -> DataFrame:
    names = ("u", "shape", "scale", "zeta_u")
    return spark.range(1).select(*[rounded(F.lit(float(fit[n])), 5).alias(n) for n in names], F.lit(int(fit["n_exceedances"])).cast("long").alias("n_exceedances"), F.lit(int(fit["n_calibration"])).cast("long").alias("n_calibration"))


def gpd_mle_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return _params(spark, Base(spark, sf_dir).fit()[1])


def gpd_pwm_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 by moments."""
    return _params(spark, evt.fit_pwm(Base(spark, sf_dir).calibration().cache(), Q))


def evt_novelty_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, P17."""
    return Base(spark, sf_dir).scored().select(F.col("id").alias("vec_id"), rounded(F.col("distance")).alias("raw_knn_distance"), rounded(F.col("novelty"), 5).alias("evt_novelty_score"), "is_positive")


def evt_novelty_score_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 with A24 below u."""
    b = Base(spark, sf_dir)
    loo, fit = b.fit()
    return evt.add_novelty_ecdf(b.distances(), loo, fit).select(F.col("id").alias("vec_id"), rounded(F.col("novelty"), 5).alias("evt_novelty_score"))


def novelty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A13."""
    return Base(spark, sf_dir).scored().agg(F.count("*").alias("n"), F.count_if("is_positive").alias("n_positive"), rounded(F.avg(F.when(F.col("is_positive"), F.col("novelty"))), 5).alias("mean_positive"), rounded(F.avg(F.when(~F.col("is_positive"), F.col("novelty"))), 5).alias("mean_still_dark"), rounded(F.avg(F.col("is_positive").cast("double"))).alias("base_rate"))


def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return ev.precision_at(Base(spark, sf_dir).scored().select("id", F.round("novelty", 9).alias("novelty"), "is_positive"), PRECISION_KS).select("k", rounded(F.col("precision")).alias("precision"), "n")


def lift_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20, P18."""
    return ev.lift_curve(Base(spark, sf_dir).scored().select("id", F.round("novelty", 9).alias("novelty"), "is_positive").cache()).select("k", rounded(F.col("precision")).alias("precision"), rounded(F.col("lift")).alias("lift"))


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, U5."""
    return ev.auroc(Base(spark, sf_dir).scored().select(F.round("novelty", 9).alias("novelty"), "is_positive")).select(rounded(F.col("auroc")).alias("auroc"), "n_pos", "n_neg")


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    found = ev.calibration(Base(spark, sf_dir).scored().select(F.round("novelty", 9).alias("novelty"), "is_positive"))
    return found.select("bin", rounded(F.col("bin_lo")).alias("bin_lo"), rounded(F.col("bin_hi")).alias("bin_hi"), rounded(F.col("observed")).alias("observed"), "n")


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    found = ev.roc(Base(spark, sf_dir).scored().select(F.round("novelty", 9).alias("novelty"), "is_positive").cache())
    return found.select("k", rounded(F.col("threshold")).alias("threshold"), rounded(F.col("tpr")).alias("tpr"), rounded(F.col("fpr")).alias("fpr"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, over raw distances."""
    b = Base(spark, sf_dir)
    rows = b.distances().join(b.positive, "id").select(F.round("distance", 9).alias("novelty"), "is_positive").cache()
    return ev.histogram(rows).select("is_positive", "bin", "n", rounded(F.col("density"), 4).alias("density"))


def gpd_qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return evt.qq(*Base(spark, sf_dir).fit()).select("i", rounded(F.col("empirical"), 5).alias("empirical"), rounded(F.col("theoretical"), 5).alias("theoretical"))


def mean_residual_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    loo = Base(spark, sf_dir).calibration().select("id", F.round("distance", 9).alias("distance")).cache()
    return evt.mean_residual_life(loo).select(F.col("j").cast("long").alias("j"), rounded(F.col("mean_excess")).alias("mean_excess"), "n")


def anderson_darling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return evt.anderson_darling(*Base(spark, sf_dir).fit()).select(rounded(F.col("a2"), 4).alias("a2"), "n")


def _separation(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, *[rounded(F.col(c)).alias(c) for c in ("within_family_mean_cosine", "across_family_mean_cosine")])


def separation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, P13 by sums."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", as_doubles(F.col("embedding")).alias("v"))
    return separation.separation(v).select("n_sequences", "n_families", *[rounded(F.col(c)).alias(c) for c in ("within_family_mean_cosine", "across_family_mean_cosine", "separation_gap")])


def separation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, J14 over all pairs, in blocks."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", as_doubles(F.col("embedding")).alias("v"))
    return _separation(separation.separation_by_pairs(v, "vec_id"))


def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask is where a component is positive."""
    v = as_doubles(F.col("embedding"))
    mask = F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(masked_mean(v, mask)).alias("pooled"))


def heldout_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest reference family is taken out; its members against equally many references, excluding themselves (seeded)."""
    b = Base(spark, sf_dir)
    sizes = b.references.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    family = sizes.first()["label"]
    left, out = b.references.where(F.col("label") != family), b.references.where(F.col("label") == family)
    loo = knn.mean_distance(left, left, K, exclude_self=True).cache()
    fit = evt.fit_mle(loo, Q)
    from ..operators.sampling import sample_at_most

    normal = sample_at_most(loo, out.count(), SEED, "id").withColumn("is_positive", F.lit(False))
    both = knn.mean_distance(out, left, K).withColumn("is_positive", F.lit(True)).unionByName(normal)
    found = ev.auroc(evt.add_novelty(both, fit).withColumn("novelty", F.round("novelty", 9)))
    return found.select(F.lit(family).cast("long").alias("family"), rounded(F.col("auroc")).alias("auroc"), "n_pos", "n_neg")


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Base(spark, sf_dir)
    references = b.references.select("id", "u", F.col("label").cast("long").alias("family"))
    families = references.groupBy("family").agg(F.count("*").alias("n")).where("n >= 5")
    # as many controls as members, drawn by hash from the other families
    from ..operators.sampling import draw

    pool = references.select("id", F.col("family").alias("own")).join(F.broadcast(families), F.col("own") != F.col("family"))
    by = W.partitionBy("family").orderBy(draw(SEED, F.col("id")), "id")
    controls = pool.withColumn("r", F.row_number().over(by)).where(F.col("r") <= F.col("n")).select("family", "id")
    return ev.held_out_families(references, families, K, Q, controls)


def auroc_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family of five or more held out in turn."""
    found = ev.auroc(_held_out(spark, sf_dir).withColumn("novelty", F.round("novelty", 9)), ["family"])
    return found.select("family", rounded(F.col("auroc"), 5).alias("auroc"), "n_pos", "n_neg")


def heldout_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of the pooled held-out scores."""
    found = ev.calibration(_held_out(spark, sf_dir).withColumn("novelty", F.round("novelty", 9)))
    return found.select("bin", rounded(F.col("predicted"), 4).alias("predicted"), rounded(F.col("observed"), 4).alias("observed"), "n")


QUERIES = {f.__name__: f for f in (
    l2_normalize_norms, knn_raw_distance, knn_neighbours, loo_distance, loo_quantile, k_sensitivity, gpd_mle_params, gpd_pwm_params, evt_novelty_score,
    evt_novelty_score_ecdf, novelty_summary, precision_at_k, lift_curve, auroc, calibration_bins, roc_curve, score_histogram, gpd_qq, mean_residual_life,
    anderson_darling, separation_score, separation_pairs, masked_mean_pool, heldout_family, auroc_per_family, heldout_calibration,
)}

# ---- the same in SQL

BASE = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e),
u AS (SELECT vec_id, label, v, n, list_transform(v, lambda x: x / greatest(n, 1e-12)) AS u FROM m),
"""
KNN = """
qp AS (SELECT q.vec_id AS id, r.vec_id AS ref, q.label IN (5, 6) AS is_positive, 1 - list_inner_product(q.u, r.u) AS d FROM u q JOIN u r ON q.label >= 5 AND r.label < 5),
qr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS rk FROM qp),
qd AS (SELECT id, any_value(is_positive) AS is_positive, avg(d) AS distance FROM qr WHERE rk <= 5 GROUP BY id),
"""
LOO = """
lp AS (SELECT q.vec_id AS id, r.vec_id AS ref, 1 - list_inner_product(q.u, r.u) AS d FROM u q JOIN u r ON q.label < 5 AND r.label < 5 AND q.vec_id <> r.vec_id),
lr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS rk FROM lp),
loo AS (SELECT id, avg(d) AS distance FROM lr WHERE rk <= 5 GROUP BY id),
"""
TAIL = """
uq AS (SELECT quantile_cont(distance, 0.9) AS u, count(*) AS n_all FROM loo),
y AS (SELECT distance - u AS y FROM loo, uq WHERE distance > u),
ym AS (SELECT max(y) AS top, count(*) AS n FROM y),
"""


def _level(k: int, low: str, step: str, source: str) -> str:
    return f"""
g{k} AS (SELECT j, {low} + j * {step} AS s, (power(10.0, {low} + j * {step}) - 1.0) / top AS theta FROM range(0, 181) t(j), ym{source}),
f{k} AS (SELECT j, s, theta, avg(ln(1 + theta * y)) AS shape, count(*) AS n FROM g{k}, y GROUP BY j, s, theta),
b{k} AS (SELECT s, theta, shape, n, -n * (ln(shape / theta) + shape + 1.0) AS ll FROM f{k} WHERE abs(theta) > 1e-9 AND shape > -1 ORDER BY ll DESC, j LIMIT 1),
"""


S1, S2 = 9.0 / 180, 2 * (9.0 / 180) / 180
MLE = TAIL + _level(1, "-6.0", repr(S1), "") + _level(2, f"(b1.s - {S1!r})", repr(S2), ", b1") + _level(3, f"(b2.s - {S2!r})", repr(2 * S2 / 180), ", b2") + """
fit AS (SELECT uq.u, b3.shape, b3.shape / b3.theta AS scale, ym.n::DOUBLE / uq.n_all AS zeta_u, ym.n AS n_exceedances, uq.n_all AS n_calibration FROM uq, ym, b3),
"""


def _sf(x: str) -> str:
    return f"(CASE WHEN abs(shape) < 1e-12 THEN exp(-({x}) / scale) WHEN 1 + shape * ({x}) / scale <= 0 THEN 0 ELSE power(1 + shape * ({x}) / scale, -1 / shape) END)"


SCORED = f"""
sc AS (SELECT id, is_positive, distance, 1 - CASE WHEN distance > u THEN zeta_u * {_sf('distance - u')} ELSE 1 END AS novelty FROM qd, fit),
"""


def _sql(parts: str, final: str) -> str:
    return "WITH " + parts.strip().rstrip(",") + "\n" + final.strip()


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


FULL = BASE + KNN + LOO + MLE + SCORED
NINE = FULL + "s9 AS (SELECT id, is_positive, round(novelty, 9) AS novelty FROM sc),"
AUC = """
SELECT {g} {r} AS auroc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n - p) AS BIGINT) AS n_neg FROM (
  SELECT *, coalesce(sum(n) OVER ({by} ORDER BY novelty ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk
  FROM (SELECT {g} novelty, count(*) AS n, sum(is_positive::INT) AS p FROM {t} GROUP BY {g} novelty)) {group}
"""
RANKSUM = "(sum(rk * p) - sum(p)::DOUBLE * (sum(p) + 1) / 2) / nullif(sum(p)::DOUBLE * sum(n - p), 0)"
EDGES = "[" + ", ".join(f"{x!r}::DOUBLE" for x in ev.edges(10)) + "]"
BIN = f"(SELECT min(b) FROM range(0, 10) t(b) WHERE novelty <= {EDGES}[b + 2] AND (novelty > {EDGES}[b + 1] OR (b = 0 AND novelty >= 0)))"
HELD = BASE + f"""
lp AS (SELECT q.vec_id AS id, r.vec_id AS ref, q.label AS own, r.label AS other, 1 - list_inner_product(q.u, r.u) AS d FROM u q JOIN u r ON q.label < 5 AND r.label < 5 AND q.vec_id <> r.vec_id),
fam AS (SELECT label AS family, count(*) AS n FROM u WHERE label < 5 GROUP BY label HAVING count(*) >= 5),
hr AS (SELECT family, id, own, d, row_number() OVER (PARTITION BY family, id ORDER BY d, ref) AS rk FROM lp JOIN fam ON other <> family),
hd AS (SELECT family, id, own = family AS is_positive, avg(d) AS distance FROM hr WHERE rk <= 5 GROUP BY family, id, own),
hu AS (SELECT family, quantile_cont(distance, 0.9) AS u, count(*) AS n_all FROM hd WHERE NOT is_positive GROUP BY family),
hy AS (SELECT family, distance - u AS y FROM hd JOIN hu USING (family) WHERE NOT is_positive AND distance > u),
hm AS (SELECT family, max(y) AS top, count(*) AS n FROM hy GROUP BY family HAVING count(*) >= 10),
""" + "".join(f"""
g{k} AS (SELECT hm.family, t.j, {low} + t.j * {step} AS s, (power(10.0, {low} + t.j * {step}) - 1.0) / top AS theta FROM range(0, 181) t(j), hm{src}),
f{k} AS (SELECT family, j, s, theta, avg(ln(1 + theta * y)) AS shape, count(*) AS n FROM g{k} JOIN hy USING (family) GROUP BY family, j, s, theta),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY -n * (ln(shape / theta) + shape + 1.0) DESC, j) AS o FROM f{k} WHERE abs(theta) > 1e-9 AND shape > -1) WHERE o = 1),
""" for k, low, step, src in ((1, "-6.0", repr(S1), ""), (2, f"(b1.s - {S1!r})", repr(S2), " JOIN b1 USING (family)"), (3, f"(b2.s - {S2!r})", repr(2 * S2 / 180), " JOIN b2 USING (family)"))) + f"""
ctl AS (SELECT family, id FROM (SELECT fam.family, x.vec_id AS id, fam.n, row_number() OVER (PARTITION BY fam.family ORDER BY md5('42:' || x.vec_id), x.vec_id) AS o FROM u x JOIN fam ON x.label < 5 AND x.label <> fam.family) WHERE o <= n),
hs AS (SELECT hd.family::BIGINT AS family, hd.is_positive, round(1 - CASE WHEN distance > u THEN hm.n::DOUBLE / n_all * {_sf('distance - u')} ELSE 1 END, 9) AS novelty
       FROM hd JOIN hu USING (family) JOIN hm USING (family) JOIN (SELECT family, shape, shape / theta AS scale FROM b3) b USING (family)
       WHERE is_positive OR (family, id) IN (SELECT family, id FROM ctl)),
"""
PARAMS = f"SELECT {r('u', 5)} AS u, {r('shape', 5)} AS shape, {r('scale', 5)} AS scale, {r('zeta_u', 5)} AS zeta_u, n_exceedances, n_calibration FROM fit"

ORACLES = {
    "l2_normalize_norms": _sql(BASE, f"SELECT vec_id, {r('n')} AS norm, {r('sqrt(list_inner_product(u, u))')} AS unit_norm FROM u"),
    "knn_raw_distance": _sql(BASE + KNN, f"SELECT id AS vec_id, {r('distance')} AS raw_knn_distance, is_positive FROM qd"),
    "knn_neighbours": _sql(BASE + KNN, f"SELECT id AS query_id, ref AS ref_id, rk AS rank, {r('d')} AS distance FROM qr WHERE rk <= 5"),
    "loo_distance": _sql(BASE + LOO, f"SELECT id AS vec_id, {r('distance')} AS loo_distance FROM loo"),
    "loo_quantile": _sql(BASE + LOO + TAIL, f"SELECT {r('u')} AS u, n_all AS n_calibration, n AS n_exceedances, {r('n::DOUBLE / n_all')} AS zeta_u FROM uq, ym"),
    "k_sensitivity": _sql(BASE + KNN + "kd AS (SELECT k, id, avg(d) AS d FROM qr, (VALUES (1::BIGINT), (5), (10), (20)) t(k) WHERE rk <= k GROUP BY k, id),", f"SELECT k, {r('avg(d)')} AS mean_distance, {r('max(d)')} AS max_distance FROM kd GROUP BY k"),
    "gpd_mle_params": _sql(BASE + LOO + MLE, PARAMS),
    "gpd_pwm_params": _sql(BASE + LOO + TAIL + """
yr AS (SELECT y, row_number() OVER (ORDER BY y) AS i FROM y),
w AS (SELECT avg(y) AS a0, avg(y * (ym.n - i) / (ym.n - 1)) AS a1 FROM yr, ym),
fit AS (SELECT u, 2 - a0 / (a0 - 2 * a1) AS shape, 2 * a0 * a1 / (a0 - 2 * a1) AS scale, ym.n::DOUBLE / n_all AS zeta_u, ym.n AS n_exceedances, n_all AS n_calibration FROM w, uq, ym),""", PARAMS),
    "evt_novelty_score": _sql(FULL, f"SELECT id AS vec_id, {r('distance')} AS raw_knn_distance, {r('novelty', 5)} AS evt_novelty_score, is_positive FROM sc"),
    "evt_novelty_score_ecdf": _sql(FULL, f"SELECT id AS vec_id, {r('CASE WHEN distance > u THEN novelty ELSE (SELECT count(*) FROM loo WHERE loo.distance <= sc.distance)::DOUBLE / n_calibration END', 5)} AS evt_novelty_score FROM sc, fit"),
    "novelty_summary": _sql(FULL, f"SELECT count(*) AS n, count(*) FILTER (is_positive) AS n_positive, {r('avg(novelty) FILTER (is_positive)', 5)} AS mean_positive, {r('avg(novelty) FILTER (NOT is_positive)', 5)} AS mean_still_dark, {r('avg(is_positive::INT)')} AS base_rate FROM sc"),
    "precision_at_k": _sql(NINE + "o AS (SELECT is_positive::INT AS hit, row_number() OVER (ORDER BY novelty DESC, id) AS rk FROM s9),", f"SELECT k, {r('avg(hit)')} AS precision, count(*) AS n FROM o, (VALUES (10::BIGINT), (50), (100), (500), (5000)) t(k) WHERE rk <= k GROUP BY k"),
    "lift_curve": _sql(NINE + "o AS (SELECT is_positive::INT AS hit, row_number() OVER (ORDER BY novelty DESC, id) AS rk FROM s9), c AS (SELECT rk, avg(hit) OVER (ORDER BY rk) AS p FROM o),", f"SELECT rk AS k, {r('p')} AS precision, {r('p / nullif((SELECT avg(is_positive::INT) FROM s9), 0)')} AS lift FROM c"),
    "auroc": _sql(NINE, AUC.format(g="", r=r(RANKSUM), by="", t="s9", group="")),
    "calibration_bins": _sql(NINE + f"cb AS (SELECT {BIN} AS bin, is_positive FROM s9),", f"SELECT bin, {r(f'any_value({EDGES}[bin + 1])')} AS bin_lo, {r(f'any_value({EDGES}[bin + 2])')} AS bin_hi, {r('avg(is_positive::INT)')} AS observed, count(*) AS n FROM cb WHERE bin IS NOT NULL GROUP BY bin"),
    "roc_curve": _sql(NINE, f"SELECT k, {r(f'any_value(k * {1.0 / 199!r}::DOUBLE)')} AS threshold, {r(f'count(*) FILTER (is_positive AND novelty >= k * {1.0 / 199!r}::DOUBLE)::DOUBLE / count(*) FILTER (is_positive)')} AS tpr, {r(f'count(*) FILTER (NOT is_positive AND novelty >= k * {1.0 / 199!r}::DOUBLE)::DOUBLE / count(*) FILTER (NOT is_positive)')} AS fpr FROM s9, range(0, 200) t(k) GROUP BY k"),
    "score_histogram": _sql(BASE + KNN + """
h AS (SELECT is_positive, round(distance, 9) AS s FROM qd),
sp AS (SELECT is_positive, min(s) AS lo, (max(s) - min(s)) / 30 AS w, count(*) AS total FROM h GROUP BY is_positive),
hb AS (SELECT is_positive, CAST(least(floor((s - lo) / w), 29) AS BIGINT) AS bin, w, total FROM h JOIN sp USING (is_positive)),""", f"SELECT is_positive, bin, count(*) AS n, {r('count(*) / any_value(total * w)', 4)} AS density FROM hb GROUP BY is_positive, bin"),
    "gpd_qq": _sql(BASE + LOO + MLE + "yr AS (SELECT y, row_number() OVER (ORDER BY y) AS i FROM y),", f"SELECT i, {r('y', 5)} AS empirical, {r('CASE WHEN abs(shape) < 1e-12 THEN -scale * ln(1 - (i - 0.5) / n_exceedances) ELSE scale / shape * (power(1.0 - (i - 0.5) / n_exceedances, -shape) - 1) END', 5)} AS theoretical FROM yr, fit"),
    "mean_residual_life": _sql(BASE + LOO + "l9 AS (SELECT round(distance, 9) AS d FROM loo), mm AS (SELECT min(d) AS lo, (max(d) - min(d)) / 20 AS w FROM l9),", f"SELECT j, {r('avg(d - (lo + j * w))')} AS mean_excess, count(*) AS n FROM l9, mm, range(0, 20) t(j) WHERE d > lo + j * w GROUP BY j"),
    "anderson_darling": _sql(BASE + LOO + MLE + f"yr AS (SELECT row_number() OVER (ORDER BY y) AS i, least(greatest(1 - {_sf('y')}, 1e-12), 1 - 1e-12) AS f, n_exceedances AS n FROM y, fit),", f"SELECT {r('-count(*)::DOUBLE - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1.0 - f)) / count(*)', 4)} AS a2, count(*) AS n FROM yr"),
    "separation_score": _sql(BASE + "pr AS (SELECT a.label = b.label AS same, list_inner_product(a.u, b.u) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),", f"SELECT (SELECT count(*) FROM u) AS n_sequences, (SELECT count(DISTINCT label) FROM u) AS n_families, {r('avg(c) FILTER (same)')} AS within_family_mean_cosine, {r('avg(c) FILTER (NOT same)')} AS across_family_mean_cosine, {r('avg(c) FILTER (same) - avg(c) FILTER (NOT same)')} AS separation_gap FROM pr"),
    "separation_pairs": _sql(BASE + "pr AS (SELECT a.label = b.label AS same, list_inner_product(a.u, b.u) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),", f"SELECT {r('avg(c) FILTER (same)')} AS within_family_mean_cosine, {r('avg(c) FILTER (NOT same)')} AS across_family_mean_cosine FROM pr"),
    "masked_mean_pool": _sql(BASE, f"SELECT vec_id, {r('coalesce(list_sum(list_filter(v, lambda x: x > 0)), 0) / greatest(len(list_filter(v, lambda x: x > 0)), 1)')} AS pooled FROM u"),
    "heldout_family": _sql(BASE + """
big AS (SELECT label AS family FROM u WHERE label < 5 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
lp AS (SELECT q.vec_id AS id, r.vec_id AS ref, q.label = family AS is_positive, 1 - list_inner_product(q.u, r.u) AS d FROM u q, u r, big WHERE q.label < 5 AND r.label < 5 AND r.label <> family AND q.vec_id <> r.vec_id),
lr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS rk FROM lp),
al AS (SELECT id, any_value(is_positive) AS is_positive, avg(d) AS distance FROM lr WHERE rk <= 5 GROUP BY id),
loo AS (SELECT id, distance FROM al WHERE NOT is_positive),""" + MLE + f"""
nm AS (SELECT id FROM loo ORDER BY md5('42:' || id), id LIMIT (SELECT count(*) FROM al WHERE is_positive)),
s9 AS (SELECT is_positive, round(1 - CASE WHEN distance > u THEN zeta_u * {_sf('distance - u')} ELSE 1 END, 9) AS novelty FROM al, fit WHERE is_positive OR id IN (SELECT id FROM nm)),
""", "SELECT (SELECT family::BIGINT FROM big) AS family, * FROM (" + AUC.format(g="", r=r(RANKSUM), by="", t="s9", group="") + ")"),
    "auroc_per_family": _sql(HELD, AUC.format(g="family,", r=r(RANKSUM, 5), by="PARTITION BY family", t="hs", group="GROUP BY family")),
    "heldout_calibration": _sql(HELD + f"cb AS (SELECT {BIN} AS bin, novelty, is_positive FROM hs),", f"SELECT bin, {r('avg(novelty)', 4)} AS predicted, {r('avg(is_positive::INT)', 4)} AS observed, count(*) AS n FROM cb WHERE bin IS NOT NULL GROUP BY bin"),
}
