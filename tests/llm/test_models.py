"""Language ID and LM scores."""

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from driftlake.llm import language_id, lm_scoring

COUNTS = {"en": {"the": 30, "then": 4, "cat": 5, "cats": 2, "hat": 3}, "xx": {"zug": 9, "zu": 20, "gut": 4, "tag": 3}}


def _kneser_ney(counts, alphabet, order=4):
    """Brute force: a function that gives log P(symbol | symbols before) of one language, with tuples and Counters."""
    whole = Counter()
    for w, c in counts.items():
        padded = ("",) * (order - 1) + tuple(w) + ("",)
        for i in range(order - 1, len(padded)):
            whole[padded[i - order + 1 : i + 1]] += c
    tables = {order: whole}
    for n in range(order - 1, 0, -1):
        longer = {g[-n - 1 :] for g in whole}
        tables[n] = Counter(g[1:] for g in longer)
    discounts = {}
    for n, t in tables.items():
        n1, n2 = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        discounts[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(symbol, before, n=order):
        if n == 0:
            return 1 / alphabet
        before = before[len(before) - n + 1 :]
        own = {g: c for g, c in tables[n].items() if g[:-1] == before}
        lower = p(symbol, before[1:], n - 1)
        total = sum(own.values())
        if not total:
            return lower
        return max(own.get((*before, symbol), 0) - discounts[n], 0) / total + discounts[n] * len(own) / total * lower

    return p


def test_kneser_ney_against_brute_force():
    m = language_id.Models(COUNTS)
    letters = sorted({c for d in COUNTS.values() for w in d for c in w})
    words = ["the", "then", "cat", "zug", "that", "", "q", "hezu", "guttag", "zzzz", "catscats"]
    got, sizes = m.words(words)
    for k, lang in enumerate(m.langs):
        p = _kneser_ney(COUNTS[lang], len(letters) + 2)
        for w, x in zip(words, got[:, k], strict=True):
            padded = ("",) * 3 + tuple(w) + ("",)
            assert x == pytest.approx(sum(math.log(p(padded[i], padded[i - 3 : i])) for i in range(3, len(padded))), rel=1e-5)
        for before in (("", "", ""), ("", "", "t"), ("", "t", "h"), ("q", "q", "q"), ("c", "a", "t")):
            assert sum(p(c, before) for c in [*letters, ""]) + p("?", before) == pytest.approx(1)
    assert sizes.tolist() == [len(w) + 1 for w in words]


def test_many_labels(spark):
    """Any number of labels; tables grow with what was seen."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(6)), f"l{i % 700}") for i in range(1400)]
    got = language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 1400 and len({r["lang_pred"] for r in got}) > 300
    learnt = {f"l{i % 700}" for i in range(1400) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r["lang_pred"] for r in got} <= learnt


def test_rejection_rate():
    """The limit rejects the stated share of the texts it was measured on."""
    import pandas as pd

    m = language_id.Models(COUNTS)
    rng = np.random.default_rng(9)
    held = pd.DataFrame({"lang_pred": ["en", "xx"] * 1000, "cross_entropy": rng.gamma(9, 0.2, 2000), "predictions": rng.integers(5, 400, 2000)})
    language_id.calibrate(m, held, 0.01)
    over = np.mean([m.excess(*r) > m.bound for r in held.itertuples(index=False)])
    assert over == pytest.approx(0.01, abs=1e-3)
    language_id.calibrate(m, held, 0.0001)
    assert not any(m.excess(*r) > m.bound for r in held.itertuples(index=False))


def test_words_score_best_in_their_language():
    s = language_id.Scorer(language_id.Models(COUNTS))
    got = s.label(["the cat", "zu gut", None, "", "123 !?", "THE CAT!", "THE CAT"])
    assert got["lang_pred"].tolist() == ["en", "xx", "und", "und", "und", "en", "en"]
    assert got["score"].between(0, 1).all() and got["score"].tolist()[2:5] == [0, 0, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.99
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


def test_gibberish_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language_id.fit(docs)
    odd = spark.createDataFrame([("qxzvkj wqxzkv jjxqwz kkvqxz zxqjvk " * 20,), ("жщю ъыэ фхц " * 30,), ("the of and " * 30,)], "text string")
    got = [r["r"]["rejected"] for r in odd.select(language_id.identify(odd, models).alias("r")).collect()]
    assert got == [True, True, False]


def test_language_of_messy_rows(messy, empty):
    rows = language_id.language_report(messy).collect()
    assert len(rows) == messy.count() and {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    for r, x in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(messy.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), strict=True):
        if x["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in x["text"] or ""))
    assert language_id.language_report(empty).count() == 0


def test_only_unlabelled(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["rejected"]) for r in language_id.language_report(df).collect()] == [("und", True)]


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + [b"\n"]


def wanted(rows):
    c = Counter()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    for r in rows:
        if not held(r["doc_id"]):
            c.update(toks(r["text"]))
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        t = toks(r["text"])
        out.append((r["doc_id"], held(r["doc_id"]), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)))
    return out


def _same(got, rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    a, b = sorted((tuple(r)[:6] for r in got), key=order), sorted(wanted(rows), key=order)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert [x[5] for x in a] == pytest.approx([x[5] for x in b], rel=1e-9)


def test_base_scores(messy):
    got = lm_scoring.score(messy).collect()
    _same(got, messy.collect())
    assert all(r["score"] < 0 for r in got)


def test_scores_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.score(docs).collect()
    _same(got, docs.collect())
    for held in (False, True):
        own = [r for r in got if r["held_out"] == held]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_filter_has_every_level():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    levels = np.random.default_rng(2).integers(1, 9, 5000)
    block = lm_scoring.Block.of(keys, levels)
    got = block.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.9
    other = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (block.levels(other) == 0).mean() > 0.9
    assert (lm_scoring.Block.of(keys[:0], levels[:0]).levels(other) == 0).all()


@pytest.mark.parametrize("kind", ["u1", "<u4", "<u8"])
def test_packed(kind):
    values = np.random.default_rng(4).integers(0, 200, 2000).astype(kind)
    assert (lm_scoring.unpacked(lm_scoring.packed(values, kind), kind) == values).all()
    assert len(lm_scoring.unpacked(lm_scoring.packed(values[:0], kind), kind)) == 0


def test_levels():
    counts = np.array([1, 2, 3, 4, 5, 6, 8, 1000])
    back = lm_scoring.count_of()[lm_scoring.level_of(counts)]
    assert back[:4].tolist() == [1, 2, 3, 4.5] and (abs(back - counts) / counts < 0.25).all()


def test_word_levels():
    counts = np.arange(1, 5000)
    back = lm_scoring.WORD_VALUES[np.searchsorted(lm_scoring.WORD_LEAST, counts, "right")]
    assert back[:8].tolist() == list(range(1, 9)) and (abs(back - counts) / counts < 0.07).all()
    assert lm_scoring.WORD_VALUES[0] == 0 and len(lm_scoring.WORD_VALUES) <= 256 and lm_scoring.WORD_LEAST[-1] > 1e9


def test_model_is_written(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lm_scoring.score(docs, model=str(tmp_path / "m"))
    blocks = spark.read.parquet(str(tmp_path / "m")).collect()
    assert {r["kind"] for r in blocks} == {lm_scoring.PAIR, lm_scoring.TRIPLE} and all(len(r["data"]) > 0 for r in blocks)


def test_no_training(spark, empty):
    assert lm_scoring.score(empty).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = lm_scoring.score(df).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_pairs_seen_once_count(spark):
    """`c d` came once, `c f` never; d and f are equally frequent."""
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0]
    free = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10]
    texts = ["a b", "a b", "g h", "g h", "c d", "c e", "i f", "i e"]
    rows = [*zip(free, texts), (held[0], "c d"), (held[1], "c f")]
    got = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 0.1


def test_every_level_has_a_count():
    assert (np.diff(lm_scoring.count_of()) > 0).all()
    counts = np.arange(1, 5000)
    assert set(lm_scoring.level_of(counts).tolist()) == set(range(1, lm_scoring.level_of(np.array([4999]))[0] + 1))


def _model_scores(rows):
    """Brute force of the model: mixture weights by EM on every training word less itself."""
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    values = lm_scoring.count_of()
    level = lru_cache(None)(lambda n: int(lm_scoring.level_of(np.array([float(n)]))[0]))
    value = lru_cache(None)(lambda n: float(values[level(n)]))
    single = lru_cache(None)(lambda n: float(lm_scoring.WORD_VALUES[np.searchsorted(lm_scoring.WORD_LEAST, n, "right")]))
    grams, texts = {1: Counter(), 2: Counter(), 3: Counter()}, {d: [None, None, *toks(x)] for d, x in rows}
    for d, t in texts.items():
        if not held(d):
            for k in grams:
                grams[k].update(tuple(t[i - k + 1 : i + 1]) for i in range(2, len(t)))
    total, n_texts = sum(grams[1].values()), sum(not held(d) for d in texts)
    divisor = total + 0.1 * (len(grams[1]) + 1)

    def history(h):
        if h[-1] is None:
            return float(n_texts)
        return single(grams[1][h]) if len(h) == 1 else value(grams[2][h])

    def share(g, less):
        h = history(g[:-1])
        return max(min(value(grams[len(g)][g]), h) - less, 0) / max(h - less, 1) if h > less else 0.0

    def mixed(t, i, less, weights):
        p = (max(single(grams[1][t[i],]) - less, 0) + 0.1) / divisor
        for k in sorted(weights):
            g = tuple(t[i - k + 1 : i + 1])
            rate = weights[k].get(level(history(g[:-1])), 0)
            p = rate * share(g, less) + (1 - rate) * p
        return p

    weights = {}
    for k in (2, 3):
        seen = {}
        for d, t in texts.items():
            for i in range(2, len(t) if not held(d) else 0):
                g = tuple(t[i - k + 1 : i + 1])
                ratio = share(g, 1) / mixed(t, i, 1, weights)
                # sums are by sixteenths of an octave
                seen.setdefault(level(history(g[:-1])), []).append(2 ** ((math.floor(16 * math.log2(ratio)) + 0.5) / 16) if ratio else 0.0)
        fitted = {}
        for b, own in seen.items():
            own, weight = np.array(own), 0.5
            for _ in range(30):
                weight = float((weight * own / (weight * own + 1 - weight)).mean())
            fitted[b] = min(weight, 0.999)
        weights[k] = fitted
    return {d: sum(math.log10(mixed(t, i, 0, weights)) for i in range(2, len(t))) for d, t in texts.items()}


@pytest.mark.parametrize(("bits", "most", "mean"), [(60, 1e-6, 1e-7), (lm_scoring.BITS, 0.05, 0.01)])
def test_scores_equal_brute_force(spark, bits, most, mean):
    """With many bits the filter tells nothing that it does not hold."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = _model_scores([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, bits_each=bits).collect()}
    assert got.keys() == want.keys()
    off = np.array([got[d] / want[d] - 1 for d in want])
    assert abs(off).max() < most and abs(off.mean()) < mean


def test_layout_does_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs).collect()}
    many = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs.repartition(7)).collect()}
    assert many == pytest.approx(one, rel=1e-9)
    ranges = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, bits_each=60).collect()}
    more = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, bits_each=60, in_range=500).collect()}
    assert more == pytest.approx(ranges, rel=1e-6)


def test_copies_of_training_texts_stand_out(spark):
    """A held-out copy of a training text is likelier, word by word, than a held-out text of the same words in other orders."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) > 500").limit(300).collect()
    held = [i for i in range(20_000, 40_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    free = [i for i in range(20_000, 40_000) if zlib.crc32(str(i).encode()) % 10]
    rng = np.random.default_rng(5)
    rows = [*zip(free, (r["text"] for r in docs))]
    copies = [r["text"] for r in docs[:40]]
    mixed = [" ".join(rng.permutation(x.split())) for x in copies]
    rows += [*zip(held, copies + mixed)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = [got[d] for d in held[:40]], [got[d] for d in held[40:80]]
    assert np.mean([x > y + 0.3 for x, y in zip(a, b)]) > 0.95


def test_one_long_text_is_learnt(spark):
    """A drawn sample missed it: every weight was 0."""
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    free = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    long = " ".join(["a b c d", "e f g h"][i * i % 7 % 2] for i in range(700_000))
    df = spark.createDataFrame([(free, long), (held, "a b c d " * 9)], "doc_id long, text string")
    r = {r["held_out"]: r for r in lm_scoring.score(df).collect()}[True]
    assert r["score"] > r["base_score"] + 1
