import hashlib
import re
from collections import Counter, defaultdict

import pytest

from driftlake.llm import line_dedup, mixing, queries

from ..oracle import assert_same, duck
from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(rows, key):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in key(r)))


def wanted_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t | {s: 3 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("table", ["messy", "unique"])
def test_mix(request, table):
    docs = request.getfixturevalue(table)
    rows = mixing.taken(docs).collect()
    again = mixing.taken(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    source = defaultdict(int)
    largest = defaultdict(int)
    for r in docs.collect():
        n = len(WORD.findall(r["text"] or ""))
        source[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    want = wanted_targets(source)
    sums = defaultdict(int)
    by_size = {(v, round(want[s], 6)): s for s, v in source.items()}
    for r in rows:
        s = by_size[(r["source_size"], round(r["target"], 6))]
        sums[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in source:
        assert abs(sums[s] - want[s]) <= largest[s] * 3


def test_mix_sql(spark):
    assert_same(queries.op2_mixing(spark, SF), duck(SF), queries.OP2_SQL)


def test_hot_source_and_one_document(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot") for i in range(600)] + [(1000, "a b c", "one"), (1001, None, "none")]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(int)
    for r in got:
        by[r["target"]] += r["taken"]
    for target, n in by.items():
        assert abs(n - target) <= 26 or target < 20


def test_mixed_repeats_rows(unique):
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.taken(unique).collect()}
    mixed = mixing.mixed(unique)
    assert mixed.columns == unique.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    for d, (n, size) in taken.items():
        assert n == size * times[d]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def wanted_lines(rows, least=10):
    docs = {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["text"]), None)
    seen = Counter()
    for _, text in docs:
        seen.update({lower(x.strip(" \t\n\x0b\f\r")) for x in (text or "").split("\n")})
    out = []
    for r in rows:
        own = (r["text"] or "").split("\n")
        bad = [bool(k := lower(x.strip(" \t\n\x0b\f\r"))) and seen[k] >= least for x in own]
        kept = "\n".join(x for x, b in zip(own, bad, strict=True) if not b)
        out.append((r["doc_id"], len(own), sum(bad), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batch_bytes", [1 << 38, 20_000])
def test_lines(messy, batch_bytes):
    got = [tuple(r) for r in line_dedup.line_report(messy, batch_bytes=batch_bytes).collect()]
    want = wanted_lines(messy.collect())
    assert Counter(got) == Counter(want)
    assert sum(x[2] for x in want) > 20


def test_lines_sql(spark):
    assert_same(queries.op3_line_dedup(spark, SF), duck(SF), queries.OP3_SQL)


def test_runs(spark):
    """Counts add up over levels, keys of enough documents aren't added again, and joins and merges neither move nor sort a run."""
    from driftlake.llm._common import Scratch

    runs, total = line_dedup.Runs(Scratch(spark, "t"), 5, 3), Counter()
    for k in range(7):
        batch = [(1, 1, 3), (2, k, 1), (3, 0, 9)]
        runs.admit(spark.createDataFrame(batch, "h1 long, h2 long, n long"))
        total.update({(a, b): n for a, b, n in batch})
    assert [x is not None for x in runs.levels] == [True, True, True]
    a, b = runs.runs()[:2]
    plan = a.join(b.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan and "Bucketed: true" in plan, plan
    assert sorted(tuple(r) for r in runs.full().collect()) == sorted(k for k, n in total.items() if n >= 5)
    assert len(runs.runs()) == 1
    n = {(r["h1"], r["h2"]): r["n"] for r in runs.runs()[0].collect()}
    assert n[3, 0] == 9 and 5 <= n[1, 1] < 21 and all(n[2, k] == 1 for k in range(7))


def test_main_paths_are_native(unique):
    for df in (mixing.taken(unique), line_dedup.line_report(unique), mixing.mixed(unique)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(empty):
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert line_dedup.line_report(empty).count() == 0
