"""Operators against NumPy and hand-made cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlake.functions import text as tx
from driftlake.functions.vectors import gpd_survival, l2_normalize, masked_mean
from driftlake.operators import device, embedders, evaluation, evt, families, knn, labeling, sampling, separation, transfer


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(y) for y in x]) for i, x in enumerate(m)], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(7).normal(size=(60, 8))


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def test_zero_vector_stays_zero(spark):
    row = vectors(spark, [[0.0, 0.0], [3.0, 4.0]]).orderBy("vec_id").select(l2_normalize(F.col("embedding")).alias("u")).collect()
    assert row[0]["u"] == [0.0, 0.0] and row[1]["u"] == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_equals_native_and_numpy(spark, matrix, exclude):
    table = knn.unit_vectors(vectors(spark, np.vstack([matrix, matrix[:3]])))
    key = lambda rows: sorted((r["query_id"], r["rank"], r["ref_id"], round(r["distance"], 9)) for r in rows)
    blocked = key(knn.nearest(table, table, 4, exclude, query_block=16, ref_block=20).collect())
    assert [x[:3] for x in blocked] == [x[:3] for x in key(knn.nearest_native(table, table, 4, exclude).collect())] or _same_distances(blocked, key(knn.nearest_native(table, table, 4, exclude).collect()))
    sim = unit(np.vstack([matrix, matrix[:3]])) @ unit(np.vstack([matrix, matrix[:3]])).T
    if exclude:
        np.fill_diagonal(sim, -np.inf)
    want = np.sort(1 - sim, axis=1)[:, :4].mean(1)
    got = {r["id"]: r["distance"] for r in knn.mean_distance(table, table, 4, exclude).collect()}
    assert [got[i] for i in range(len(want))] == pytest.approx(want)


def _same_distances(a, b):
    """Copies of a vector lie equally far up to rounding, so their order may differ."""
    return [(x[0], x[1], x[3]) for x in a] == [(x[0], x[1], x[3]) for x in b]


def test_more_neighbours_than_references(spark, matrix):
    refs = knn.unit_vectors(vectors(spark, matrix[:3], 100))
    assert knn.nearest(knn.unit_vectors(vectors(spark, matrix[:2])), refs, 10).count() == 6


def test_quantile(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 16)], "d double")
    assert evt.quantile(rows, "d", 0.9) == pytest.approx(12.8)
    many = np.random.default_rng(1).normal(size=3000).round(2)
    rows = spark.createDataFrame([(float(x),) for x in many], "d double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert evt.quantile(rows, "d", q, at_once=50) == pytest.approx(np.quantile(many, q))


def test_tail_fit(spark):
    rng = np.random.default_rng(3)
    shape, scale = 0.2, 0.5
    d = np.concatenate([rng.uniform(0, 1, 9000), 1 + scale / shape * (rng.uniform(size=1000) ** -shape - 1)])
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "id long, distance double")
    fit = evt.fit_mle(table)
    assert fit["n_exceedances"] == 1000 and fit["shape"] == pytest.approx(shape, abs=0.12) and fit["scale"] == pytest.approx(scale, rel=0.15)
    # the same in one step for several groups, one of them with too few
    both = table.select(F.lit(1).alias("g"), "distance").unionByName(table.select(F.lit(2).alias("g"), (F.col("distance") * 3 + 1).alias("distance"))).unionByName(table.limit(20).select(F.lit(3).alias("g"), "distance"))
    groups = {r["g"]: r for r in evt.fit_groups(both, "g", 0.9).collect()}
    assert set(groups) == {1, 2}
    for n in ("u", "shape", "scale", "zeta_u"):
        assert groups[1][n] == pytest.approx(fit[n], abs=1e-6)
    assert groups[2]["shape"] == pytest.approx(fit["shape"], abs=1e-4) and groups[2]["scale"] == pytest.approx(3 * fit["scale"], rel=1e-3)
    assert evt.fit_pwm(table)["shape"] == pytest.approx(shape, abs=0.15)
    with pytest.raises(ValueError, match="too few"):
        evt.fit_mle(table.where("id < 50"))


def test_survival(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 2.0), (9.0, -0.5, 1.0), (1.0, 0.5, 1.0)], "x double, s double, b double")
    got = [r[0] for r in rows.select(gpd_survival(F.col("x"), F.col("s"), F.col("b"))).collect()]
    assert got == pytest.approx([np.exp(-0.5), 0.0, 1.5**-2])


def test_score_at_threshold_is_zero(spark):
    fit = {"u": 1.0, "shape": 0.1, "scale": 1.0, "zeta_u": 0.1}
    rows = spark.createDataFrame([(1.0,), (1.5,), (9.0,)], "d double").select(evt.novelty(F.col("d"), fit).alias("s")).collect()
    assert rows[0]["s"] == 0 and 0.9 < rows[1]["s"] < rows[2]["s"] < 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.booleans()), min_size=2, max_size=25))
def test_auroc(spark, pairs):
    rows = spark.createDataFrame([(float(s), y, i) for i, (s, y) in enumerate(pairs)], "novelty double, is_positive boolean, id long")
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    got = evaluation.auroc(rows).first()["auroc"]
    if not pos or not neg:
        assert got is None
        return
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got == pytest.approx(want)
    flipped = evaluation.auroc(rows.withColumn("novelty", -F.col("novelty"))).first()["auroc"]
    assert got + flipped == pytest.approx(1)


def test_precision_ties_keep_input_order(spark):
    rows = spark.createDataFrame([(0.0, i % 2 == 0, i) for i in range(6)], "novelty double, is_positive boolean, id long")
    got = {r["k"]: (r["precision"], r["n"]) for r in evaluation.precision_at(rows, [1, 2, 100]).collect()}
    assert got == {1: (1.0, 1), 2: (0.5, 2), 100: (0.5, 6)}


def test_calibration_edges(spark):
    scores = [0.0, 0.1, 0.10000001, 1.0, 1.1, -0.1]
    rows = spark.createDataFrame([(s, True) for s in scores], "novelty double, is_positive boolean")
    got = {r["bin"]: r["n"] for r in evaluation.calibration(rows).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_histogram_of_one_value(spark):
    rows = spark.createDataFrame([(0.5, True), (0.5, True)], "novelty double, is_positive boolean")
    got = evaluation.histogram(rows, 10).collect()
    assert [(r["bin"], r["n"]) for r in got] == [(5, 2)] and got[0]["density"] == pytest.approx(10)


def test_separation(spark, matrix):
    rows = vectors(spark, matrix).withColumn("label", F.col("vec_id") % 4).withColumnRenamed("embedding", "v")
    a, b = separation.separation(rows).first(), separation.separation_by_pairs(rows, "vec_id").first()
    for c in ("within_family_mean_cosine", "across_family_mean_cosine"):
        assert a[c] == pytest.approx(b[c])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 5000), min_size=1, max_size=20), st.integers(1, 400))
def test_allocation(counts, target):
    sizes, f = sampling.allocate(counts, target)
    assert 0 <= f <= 1 and all(sizes[k] <= n and sizes[k] <= max(30, 2) and sizes[k] >= min(n, 2) for k, n in counts.items())


def test_allocation_golden():
    counts = dict(enumerate([1] * 26 + [2] * 150))
    assert sum(sampling.allocate(counts, 500)[0].values()) == 26 + 300
    assert 30000 // 189 * 189 == 29862


def test_group_cap(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 3}") for i in range(60)], "id long, g string")
    got = sampling.stratified_at_most(rows, 9, 42, "id", "g").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"g0": 3, "g1": 3, "g2": 3}


def test_labels(spark):
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "protein_id long, genome string")
    then = spark.createDataFrame([(1, "PF1.2")], "protein_id long, family string")
    now = spark.createDataFrame([(1, "PF9.1"), (2, "PF9.3"), (2, "PF1.2")], "protein_id long, family string")
    new = spark.createDataFrame([("PF9",)], "family string")
    got = {r["protein_id"]: (r["dark"], r["characterised"], r["positive"]) for r in labeling.snapshot_labels(p, then, now, new).collect()}
    assert got == {1: (False, True, False), 2: (True, True, True), 3: (True, False, False)}
    assert labeling.summary(spark.createDataFrame([], "dark boolean, characterised boolean, positive boolean")).first()["pct_dark"] is None


def test_text(spark):
    rows = spark.createDataFrame([("p__X;p__Y",), ("p__",), ("",), (" p__Z",), ("p__a__b;q__x",)], "l string")
    assert [r[0] for r in rows.select(tx.rank_of(F.col("l"), "p")).collect()] == ["Y", "", "", "", "a__b"]
    rows = spark.createDataFrame([("NN",), ("nnn",), ("ANNNNNC",)], "s string")
    assert [r[0] for r in rows.select(tx.mask_ambiguous(F.col("s"))).collect()] == ["NN", "@", "A@C"]
    rows = spark.createDataFrame([("PF10417.12",), ("PF10417",), ("PF1.2.3",)], "s string")
    assert [r[0] for r in rows.select(tx.strip_version(F.col("s"))).collect()] == ["PF10417", "PF10417", "PF1"]


def test_fixed_digits_as_python_prints_them(spark):
    xs = [0.0, -0.0, 0.125, 0.375, 1.005, 2.675, -0.004, -0.125, 0.995, 0.999, 9.996, 99.995, 1e-300, 123456789012345.67, 2.0**52 - 0.5, 2.0**53 + 2, 2.0**63 - 1024, -(2.0**62)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(tx.fixed(F.col("x"), d).alias(str(d)) for d in (1, 2))).collect()
    assert [(r["1"], r["2"]) for r in rows] == [(f"{r['x']:.1f}", f"{r['x']:.2f}") for r in rows] and len(rows) == len(xs)


def test_masked_mean(spark):
    rows = spark.createDataFrame([([1.0, 3.0], [1.0, 0.0]), ([1.0, 3.0], [0.0, 0.0])], "v array<double>, m array<double>")
    assert [r[0] for r in rows.select(masked_mean(F.col("v"), F.col("m"))).collect()] == [1.0, 0.0]


@pytest.mark.parametrize(("total", "done", "want"), [(1000, 0, [(1, 0, 499), (2, 500, 999)]), (300, 0, [(1, 0, 299)]), (0, 0, []), (1001, 500, [(2, 500, 999), (3, 1000, 1000)])])
def test_byte_ranges(spark, total, done, want):
    rows = spark.createDataFrame([(total, done, 2 if done else 1)], "total long, done long, next_part long")
    assert sorted((r["part_number"], r["start"], r["end"]) for r in transfer.byte_ranges(rows, 500).collect()) == want


def test_device():
    assert device.plan("cuda", 8.0, 16.0).quantize_bits == 4
    assert device.plan("cuda", 8.0, 0.0).quantize_bits is None
    assert device.plan("mps", None, 16.0).dtype == "float16" and device.plan("cpu", None, 1.0).dtype == "float32"


def test_embedders(spark):
    rows = spark.createDataFrame([("ACGTACGT",), (None,), ("",)], "s string")
    got = [r["embedding"] for r in embedders.embed(rows, "kmers", "s").collect()]
    assert len(got[0]) == 64 and got[1] is None and got[2] == [0.0] * 64
    with pytest.raises(ValueError, match="unknown"):
        embedders.embed(rows, "none", "s")
    m = embedders.HashedKmers(16, 2)
    for s, v in zip(["abca", "é日", "a", ""], m.vectors(["abca", "é日", "a", ""]), strict=True):
        want = np.zeros(16)
        for x, y in zip(s, s[1:]):
            h = (ord(x) * 31 + ord(y)) * 40503 % 65536 // 256
            want[h // 2 % 16] += 1 if h % 2 else -1
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-12))


def test_tokens_are_cut(spark):
    model = embedders.WeightedModel(lambda: lambda xs: np.array([[len(x), 1.0] for x in xs]), 2, 10)
    assert embedders.cut(model, "a" * 20, None) == "a" * 8 and embedders.cut(model, "abc", None) == "abc" and embedders.cut(model, "a" * 20, 5) == "aaa"
    assert embedders.cut(embedders.HashedKmers(), "a" * 20, None) == "a" * 20
    embedders.register("counted", lambda: model)
    got = embedders.embed(spark.createDataFrame([("x" * 30,), ("xy",)], "s string"), "counted", "s").collect()
    assert [r["embedding"] for r in got] == [[8.0, 1.0], [2.0, 1.0]]
    assert embedders.load_embedder("esm2").dimension == 1280 and embedders.load_embedder("genos-m").max_tokens == 8192


def test_family_search(spark):
    rows = spark.createDataFrame([("g", "a", "MKKKKLL"), ("g", "b", "WWHHWW"), ("h", "a", None), ("h", "b", "")], "genome string, protein_id string, seq string")
    got = families.search(rows, lambda: families.Motifs({"PF1": "K+", "PF2": "WW", "PF3": "L"}, {"PF3": 3})).collect()
    assert sorted(map(tuple, got)) == [("g", "a", "PF1", 4.0), ("g", "b", "PF2", 4.0)]


def test_messy_vectors(spark):
    """Rows that can't be compared take no part; the others are compared as if alone."""
    bad = [(10, None), (11, []), (12, [None, 1.0]), (13, [float("nan"), 1.0]), (14, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0])]
    table = lambda rows: knn.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, knn.nearest(table(good + bad), table(good + bad), 2, exclude_self=True).select("query_id", "ref_id", "rank").collect()))
    want = sorted(map(tuple, knn.nearest(table(good), table(good), 2, exclude_self=True).select("query_id", "ref_id", "rank").collect()))
    assert got == want and {r[0] for r in got} == {1, 2, 3, 4, 5}  # 6 has no other of its length
    assert knn.nearest(table(good), table(bad), 2).count() == 0 and knn.nearest(table(bad), table(good), 2).count() == 0
    assert separation.separation_by_pairs(spark.createDataFrame([(i, v, 1) for i, v in good[:4]] + [(9, None, 1)], "vec_id long, v array<double>, label long"), "vec_id", block=2).first()["within_family_mean_cosine"] == pytest.approx((4 * (2**-0.5) + 1) / 6)


def test_neighbours_apart(spark, matrix):
    rows = knn.unit_vectors(vectors(spark, matrix).withColumn("f", F.col("vec_id") % 3), "vec_id", "embedding", "f")
    got = knn.nearest(rows, rows, 3, exclude_self=True, query_block=7, ref_block=9, apart="f").collect()
    u = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    first = min(r["id"] for r in rows.collect())
    for q in {r["query_id"] for r in got}:
        own = sorted((1 - u[q - first] @ u[j], j + first) for j in range(len(u)) if (j + first) % 3 != q % 3)[:3]
        assert [r["ref_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [j for _, j in own]


def test_running_sums(spark):
    from driftlake.functions.ordering import running_sums

    rng = np.random.default_rng(6)
    data = [(int(i), int(g), float(v), int(a)) for i, (g, v, a) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 50, 400), rng.integers(0, 9, 400)))] + [(1000, 0, None, 5)]
    rows = spark.createDataFrame(data, "i long, g long, v double, a long")
    for groups in ((), ("g",)):
        got = {r["i"]: (r["s"], r["n"]) for r in running_sums(rows, "v", {"s": F.col("a"), "n": F.lit(1)}, groups, ("i",)).collect()}
        key = lambda d: (d[2] is not None, d[2] or 0, d[0])
        for d in data:
            before = [x for x in data if key(x) < key(d) and (not groups or x[1] == d[1])]
            assert got[d[0]] == (sum(x[3] for x in before), len(before))


def test_allocation_is_the_first_halving():
    """The fraction is the one at which halving the interval comes into the window first."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        counts = {str(k): int(n) for k, n in enumerate(rng.integers(1, 4000, rng.integers(1, 25)))}
        target = int(rng.integers(1, 500))
        total = lambda f: sum(min(n, max(2, min(30, round(f * n)))) for n in counts.values())  # noqa: B023, E731
        low, high = 0.0, 1.0
        for _ in range(50):
            f = (low + high) / 2
            if abs(total(f) - target) <= 5:
                break
            low, high = (f, high) if total(f) < target else (low, f)
        else:
            continue
        sizes, got = sampling.allocate(counts, target)
        assert got == f and sizes == {k: min(n, max(2, min(30, round(f * n)))) for k, n in counts.items()}


def test_device_surface():
    here = device.plan_here()
    assert here.device in ("cuda", "mps", "cpu") and here.quantized == (here.quantize_bits is not None)
    assert device.loader_arguments(device.plan("cuda", 8.0, 16.0))["quantize_bits"] == 4 and device.loader_arguments(device.plan("cpu", None, 1.0)) == {"dtype": "float32"}
    assert device.inference_device(device.plan("cuda", 80.0, 16.0)) == "cuda:0" and device.inference_device(device.plan("mps", None, 1.0)) == "mps"
    assert device.peak_memory_gb() >= 0


def test_nearest_plan_makes_no_pairs(spark, matrix):
    table = knn.unit_vectors(vectors(spark, matrix))
    plan = knn.nearest(table, table, 4)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
