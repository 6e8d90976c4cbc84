"""Fingerprints and the Jaccard join."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftlake.llm import fingerprints as fp
from driftlake.llm import jaccard_join as jj
from driftlake.llm.components import components
from driftlake.llm._common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")




@pytest.mark.parametrize("parts", [None, 7])
def test_neighbours(unique, parts):
    rows = sorted(unique.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fp.compare_neighbours(unique, parts).collect()}
    assert len(got) == len(rows)
    for a, b in zip(rows, [*rows[1:], rows[0]], strict=True):
        x, y = a["text"] or "", b["text"] or ""
        half = len(x) // 2
        changed = x[: len(x) - half] + y[:half]
        r = got[a["doc_id"]]
        assert r["n_chars"] == len(x) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fp.fingerprint(x.encode()) and r["edited_fingerprint"] == fp.fingerprint(changed.encode())
        assert r["near_edited"] == fp.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fp.likeness(r["fingerprint"], fp.fingerprint(y.encode()))


def test_repeated_and_null_ids(messy, empty, spark):
    got = fp.compare_neighbours(messy).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in messy.collect())
    assert fp.compare_neighbours(empty).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    assert [(r["doc_id"], r["near_next"]) for r in fp.compare_neighbours(one).collect()] == [(5, 1.0)]


def test_rolling_is_a_window():
    data = random.Random(1).randbytes(500)
    r = fp.rolling(data)
    assert (fp.rolling(data[100:])[8:] == r[108:]).all()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 64))) for _ in range(2))
        assert fp.common_length(a, b) == lcs(a, b)


def test_likeness_of_edits():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(3000))
    small = text[:9000] + "EDIT" + text[9000:]
    other = " ".join(rng.choice(words) for _ in range(3000))
    f = [fp.fingerprint(x.encode()) for x in (text, small, other, text[: len(text) // 2] + other[: len(text) // 2])]
    assert fp.likeness(f[0], f[0]) == 1 and fp.likeness(f[0], f[1]) > 0.9
    assert fp.likeness(f[0], f[2]) == 0 and 0.2 < fp.likeness(f[0], f[3]) < 0.9


def brute(rows, width=5, percent=80):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in by[x])
        for x in s:
            by[x].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return Counter((d, len(s), low[find(i)] if s else d, links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(n=400, seed=4):
    """Groups of exact and near copies of very different size, chains, shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 20, 80, 150]))] for _ in range(40)]
    for i in range(n):
        w = list(bases[0] if i % 3 == 0 else bases[rng.randrange(40)])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        text = " ".join(w)
        if rng.random() < 0.3:
            text += " " + passage
        rows.append((i, text.upper() if i % 50 == 0 else text))
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(12):
        rows.append((n + i, " ".join(chain)))
        for k in range(4):
            chain[(i * 17 + k * 5) % 200] = f"c{i}-{k}"
    return rows


@pytest.mark.parametrize(("most_in_task", "common"), [(8_000_000, 64), (4_000, 3)])
def test_join(spark, monkeypatch, most_in_task, common):
    rows = near_copies()
    monkeypatch.setattr(jj, "COMMON", common)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in jj.jaccard_components(df, most_in_task=most_in_task).collect())
    assert got == brute(rows)


def test_join_of_messy_rows(messy, empty):
    got = Counter(tuple(r) for r in jj.jaccard_components(messy).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in messy.collect()])
    assert jj.jaccard_components(empty).count() == 0


def test_link_is_exact_for_any_block():
    rng = np.random.default_rng(5)
    base = np.arange(60)
    sets = {tuple(sorted(set(np.where(rng.random(60) < 0.12, base + rng.integers(100, 9000), base).tolist()))) for _ in range(150)}
    sets = [np.array(s, np.uint64) for s in sorted(sets)]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(np.intersect1d(a, sets[j]))
            if 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    want = [find(i) for i in range(len(sets))]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if 100 * (n := len(np.intersect1d(a, sets[j]))) >= 80 * (len(a) + len(sets[j]) - n)]
    times = rng.integers(1, 5, len(sets))
    degree = np.zeros(len(sets), np.int64)
    for i, j in pairs:
        degree[i] += times[j]
        degree[j] += times[i]
    for block in (2, 8, 64):
        for kept in (1, 64):
            label, links = jj.link(sets, block=block, times=times, kept=kept)
            got = label.tolist()
            assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
            assert links.tolist() == degree.tolist()


def test_answers_are_derived():
    """In a group of near copies most pairs are settled by the answers of a similar set, without a comparison."""
    rng, seen = np.random.default_rng(6), {}
    base = np.arange(1000)
    sets = [np.unique(np.where(rng.random(1000) < 0.02, rng.integers(2000, 1 << 40, 1000), base)).astype(np.uint64) for _ in range(300)]
    label, links = jj.link(sets, seen=seen)
    assert len(set(label.tolist())) == 1 and (links == 299).all()
    assert seen["compared"] < 0.05 * 300 * 299 / 2


def test_first_of_each(unique):
    kept = jj.first_of_each(unique)
    assert kept.columns == unique.columns
    want = {d for d, _, c, _ in brute([(r["doc_id"], r["text"]) for r in unique.collect()]) if d == c}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def _other_half(text, other):
    return fp.likeness(fp.fingerprint(text.encode()), fp.fingerprint(fp.edited(text, other).encode()))


def test_signatures_span_repetitive_texts():
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    other = " ".join(words)
    line = " ".join(words[:12]) + "\n"
    for text in (line * 150, "".join(" ".join(words[k : k + 40]) + "\n" + line * 30 for k in range(0, 400, 80))):
        assert _other_half(text, other) < 0.9
        block, one, two = fp.fingerprint(text.encode()).split(":")
        r, block = fp.rolling(text.encode()).astype(np.int64), int(block)
        # the largest block with half a signature; every chunk has its character
        assert (r % block == block - 1).sum() >= 32 > (r % (2 * block) == 2 * block - 1).sum()
        assert len(one) in ((n := (r % block == block - 1).sum()), n + 1)


def test_common_length_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert fp.common_length(a, b) == row[-1]
