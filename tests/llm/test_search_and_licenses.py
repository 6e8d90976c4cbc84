import math
import re
from collections import Counter

import numpy as np
import pytest

from driftlake.llm import license_scan, queries, topk_search

from ..oracle import assert_same, duck
from .conftest import SF


def wanted(rows, k=20, every=20):
    known = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known.append((i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for n, (i, q) in enumerate(known):
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(known) if m != n and len(v) == len(q))
            out += [(i, place + 1, j, -s) for place, (s, j) in enumerate(near[:k])]
    return sorted(out)


def test_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a very common vector: ties
    rows += [(500, None), (501, [None, *rows[0][1][1:]]), (502, [float("nan")] * 24), (503, [float("inf"), *[0.0] * 23]), (None, rows[1][1]), (520, [1.0, 2.0]), (521, [1.0, 2.0]), (540, []), (20, rows[20][1]), (40, [0.0] * 24), (60, [0.1] * 24), (60, [0.1] * 24), (61, rows[7][1]), (61, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk_search.top_k(df, query_block=5, row_block=100).collect())
    assert got == wanted(rows)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(0, [3e15, -1.0]), (1, [2e15, 5.0]), (2, [1e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk_search.top_k(df).orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (2, (1 << 63) - 1)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 37, 64):
        q, v = rng.normal(size=(20, dim)) * 30, rng.normal(size=(50, dim)) * 30
        basis = topk_search.axes(v)
        assert np.allclose((q @ basis) @ (v @ basis).T, q @ v.T)
        for ends in topk_search.LEVELS:
            bound = topk_search.statistics(q @ basis, ends) @ topk_search.statistics(v @ basis, ends).T
            assert (bound >= q @ v.T - 1e-6).all()


@pytest.mark.parametrize("clusters", [40, 0])
def test_few_exact_products(clusters):
    """Among clustered vectors bounds save most products; among vectors in random directions they save none, and nothing is lost."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20_000, 64))
    if clusters:
        v = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(v))] * 8 + v
    v = np.floor(8 * v)
    q, seen = v[::200], {}
    got = topk_search.search(q, np.arange(len(v)), v, 20, np.arange(0, len(v), 200), seen=seen)
    scores = q @ v.T
    scores[np.arange(len(q)), np.arange(0, len(v), 200)] = -np.inf
    for x in range(len(q)):
        best = np.lexsort((np.arange(len(v)), -scores[x]))[:20]
        assert sorted((s, i) for y, i, s in got if y == x) == sorted((int(scores[x, i]), int(i)) for i in best)
    assert seen["pairs"] == q.shape[0] * len(v)
    assert not clusters or seen["exact"] < 0.3 * seen["pairs"]


def test_sql(spark):
    assert_same(queries.op5_topk_search(spark, SF), duck(SF), queries.OP5_SQL)


FILES = [
    ("a/LICENSE", "Released under the MIT License."), ("a/b/COPYING.txt", "Licensed under CC BY-NC 4.0.\nmore"), ("a/b/c/x.txt", "plain words"), ("a/x.txt", "plain"), ("z/x.txt", "plain"),
    ("a/b/own.txt", "Words first.\nLicensed under the Apache License, Version 2.0.\nWords then. And more."), ("top.txt", "nothing"), (None, "nothing"), (None, "Released under the MIT License."),
    ("z/gpl.txt", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3."), ("a/b/c/d/e.txt", None), ("abc/x.txt", "plain"), ("a/LICENSE", "Released under the MIT License."), ("z/note.txt", "The licensed version of the public is under work."),
]


def test_licenses(spark):
    df = spark.createDataFrame([(p, t, "clash") for p, t in FILES], "path string, text string, license string")
    rows = license_scan.scan(df).collect()
    assert len(rows) == len(FILES) and df.columns == license_scan.scan(df).columns[:-1]
    got = {(r["path"], r["text"]): (r["__license"]["license"], r["__license"]["how"], r["__license"]["directory"]) for r in rows}
    assert got[("a/LICENSE", FILES[0][1])] == ("MIT", "file", None)
    assert got[("a/b/c/x.txt", "plain words")] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert got[("a/b/c/d/e.txt", None)] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert got[("a/x.txt", "plain")] == ("MIT", "inherited", "a")
    assert got[("a/b/own.txt", FILES[5][1])][:2] == ("Apache-2.0", "header")
    assert got[("z/gpl.txt", FILES[9][1])][:2] == ("GPL-3.0", "header")
    for p in (("z/x.txt", "plain"), ("top.txt", "nothing"), (None, "nothing"), ("abc/x.txt", "plain"), ("z/note.txt", FILES[13][1])):
        assert got[p] == (None, "none", None)
    assert got[(None, FILES[8][1])][0] == "MIT"


def _terms(text):
    return re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", text.lower())


def _cosines(texts, templates, df, n):
    """Cosines of texts to templates, word by word."""
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 1))) + 1
    named = set().union(*(_terms(t) for _, t in templates))
    vectors = []
    for x in [*texts, *(t for _, t in templates)]:
        v = {w: c * (idf(w) if w in named and w in df else math.log(1 + n) + 1 if w in named else math.log((1 + n) / 2) + 1) for w, c in Counter(_terms(x)).items()}
        size = math.sqrt(sum(y * y for y in v.values()))
        vectors.append({w: y / size for w, y in v.items()})
    return [[sum(y * t.get(w, 0.0) for w, y in x.items()) for t in vectors[len(texts) :]] for x in vectors[: len(texts)]]


def _parts(text):
    out, block = [], []
    for line in [*text.split("\n"), ""]:
        if _terms(line):
            block.append(line)
        elif block:
            out += [*block, " ".join(block)]
            block = []
    return [y for x in out for y in [x, *re.split(r"(?<=[.!?])\s+", x)]]


def test_licenses_against_brute_force(spark):
    """Cosines of every line, paragraph and sentence, and a walk up the path, without the scan's shortcuts or its code."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()
    rng = np.random.default_rng(4)
    names = ["x.py", "y.txt", "LICENSE", "COPYING.md", "notice"]
    rows = [("/".join([*rng.choice(["a", "b", "c"], rng.integers(0, 4)), str(rng.choice(names))]), r["text"]) for r in docs]
    rows += [("a/LICENSE", dict(license_scan.full_texts())["MIT"].replace("\n", " \n * ")), ("b/c/LICENSE", dict(license_scan.full_texts())["LGPL-2.1"]), ("deep/x", "plain")]
    table = spark.createDataFrame(rows, "path string, text string")
    df = Counter()
    for _, x in rows:
        df.update(set(_terms(x)))
    n, texts = len(rows), license_scan.full_texts()
    both = (*license_scan.HEADERS, *texts)
    named = set().union(*(_terms(t) for _, t in both))
    df = {w: c for w, c in df.items() if w in named}
    own = []
    for path, x in rows:
        name = None
        parts = [p for p in _parts(x) if _terms(p)]
        if parts:
            best = max((max(c), -k, c) for k, c in enumerate(_cosines(parts, license_scan.HEADERS, df, n)))
            if best[0] >= 0.75:
                name = license_scan.HEADERS[int(np.argmax(best[2]))][0]
        if re.fullmatch(r"(?i)(licen[cs]e|copying|notice)([.\-_].*)?", path.split("/")[-1]) and _terms(x):
            whole = _cosines([x], texts, df, n)[0]
            if max(whole) >= 0.85:
                name = texts[int(np.argmax(whole))][0]
        own.append(name)
    given = {}
    for (path, _), name in zip(rows, own, strict=True):
        folder, _, base = path.rpartition("/")
        if name and re.fullmatch(r"(?i)(licen[cs]e|copying|notice)([.\-_].*)?", base):
            given[folder] = min(given.get(folder, (base, name)), (base, name))
    want = []
    for (path, x), name in zip(rows, own, strict=True):
        folder = path.rpartition("/")[0]
        while not name and folder not in given and folder:
            folder = folder.rpartition("/")[0]
        want.append((path, x, name or (given[folder][1] if folder in given else None)))
    got = [(r["path"], r["text"], r["__license"]["license"]) for r in license_scan.scan(table).collect()]
    key = lambda r: (r[0], r[1], r[2] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[2] is not None for w in want) > 20


WRAPPED = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n#\n# more"
OTHERS = [
    (WRAPPED, "BSD-3-Clause"), ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
]


def test_other_licenses(spark):
    filler = [(f"f{i}", f"plain words {i} of the work and the text with other terms") for i in range(300)]
    rows = [(f"x{i}", t) for i, (t, _) in enumerate(OTHERS)] + [("p/LICENSE", x) for _, x in license_scan.full_texts()] + filler
    got = license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    found = {r["path"]: r["__license"]["license"] for r in got}
    assert [found[f"x{i}"] for i in range(len(OTHERS))] == [name for _, name in OTHERS]
    whole = {r["text"]: r["__license"]["license"] for r in got if r["path"] == "p/LICENSE"}
    assert all(whole[x] == name for name, x in license_scan.full_texts())


def test_messy_licenses(messy, empty):
    got = license_scan.license_report(messy)
    assert got.count() == messy.count() and got.columns == ["doc_id", "path", "license", "how", "similarity", "evidence", "directory"]
    clash = messy.select("doc_id", "text", messy["doc_id"].cast("string").alias("path"), messy["text"].alias("__scan"), messy["text"].alias("d"), messy["text"].alias("top"))
    assert license_scan.scan(clash).count() == messy.count()


def test_empty(empty):
    assert license_scan.license_report(empty).count() == 0


@pytest.mark.parametrize("name", ["op7_license_scan"])
def test_queries_run(spark, name):
    assert getattr(queries, name)(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
