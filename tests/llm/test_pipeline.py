import corpus_pipeline as cp
from driftlake.llm import jaccard_join, line_dedup

from .conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        docs = seen[name] = docs.cache()
    n = {k: v.count() for k, v in seen.items()}
    assert n["language_id"] >= 0.99 * first.count() and n["jaccard_join"] < n["line_dedup"] <= n["language_id"]
    # decisions took effect: nothing is left to do
    assert line_dedup.line_report(seen["line_dedup"]).where("n_dropped > 0").count() == 0
    again = jaccard_join.jaccard_components(seen["jaccard_join"])
    assert again.where("doc_id <> component_id").count() == 0
    assert {r["doc_id"] for r in seen["packing"].select("doc_id").distinct().collect()} == {r["doc_id"] for r in seen["mixing"].select("doc_id").distinct().collect()}


def test_run(spark):
    a, b = cp.run(spark, SF), cp.run(spark, SF)
    assert a.count() == b.count() > 0 and a.drop("sequence_id", "offset").exceptAll(b.drop("sequence_id", "offset")).count() == 0


def test_messy(messy, empty, spark):
    for docs in (messy, empty):
        now = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in cp.STAGES:
            now = stage(spark, now, "")
        now.count()


def test_names():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_stages_against_brute_force(spark):
    """Each stage's result from the one before, by plain Python; one group of copies has a third of all rows."""
    import hashlib
    import random
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    import public_tokenizers

    from .test_duplicates import brute
    from .test_mixing_and_lines import WORD, wanted_lines, wanted_targets

    rng = random.Random(7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    hot = max((r["text"] for r in docs), key=lambda x: min(len(x), 4000))[:4000].replace("\n", " ")
    for i in range(60):  # one line, so few equal ones that it stays
        words = hot.split(" ")
        if i > 6:
            words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((10_000 + i, " ".join(words) + "\nshared line\nShared Line ", "en", rng.choice(["web", None]), None))
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "web", 0), (20_002, "123 !", "en", "web", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    now = cp.identify_language(spark, table.withColumn("found", table["text"]), "").cache()
    kept = {r["doc_id"] for r in now.collect()}
    assert now.columns == cp.COLUMNS and {20_000, 20_001, 20_002}.isdisjoint(kept) and len(kept) >= 178

    before, now = now.collect(), cp.drop_repeated_lines(spark, now, "").cache()
    want = {d: h for d, _, _, h in wanted_lines(before)}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in now.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect()) and not any("shared line" in r["text"].lower() for r in now.collect())

    before, now = now.collect(), cp.keep_one_of_each_group(spark, now, "").cache()
    want = {d for d, _, c, _ in brute([(r["doc_id"], r["text"]) for r in before]) if d == c}
    assert {r["doc_id"] for r in now.collect()} == want and len([d for d in want if 10_000 <= d < 20_000]) <= 1

    before, now = now.collect(), cp.mix_sources(spark, now, "").cache()
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    times, sources = Counter(r["doc_id"] for r in now.collect()), defaultdict(list)
    for r in before:
        sources[r["source"]].append(r["doc_id"])
    targets = wanted_targets({s: sum(size[d] for d in own) for s, own in sources.items()})
    for s, own in sources.items():
        assert abs(sum(times[d] * size[d] for d in own) - targets[s]) <= max(size[d] for d in own) / 2 + 1
        assert max(times[d] for d in own) - min(times[d] for d in own) <= 1 and max(times[d] for d in own) <= 3

    before, now = now.collect(), cp.pack_sequences(spark, now, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
    pieces, places = Counter(), defaultdict(list)
    for r in now:
        pieces[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces == {d: n * times[d] for d, n in total.items()}
    for own in places.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_clashing_names(spark, messy):
    """Columns named as stages name their own."""
    clash = messy.select("doc_id", "text", "lang", "source", "n_chars", *[messy["text"].alias(c) for c in ("found", "__lines", "__key", "__bad", "__kept", "__goal", "__copy", "__r")])
    for _, stage in cp.STAGES:
        stage(spark, clash, "").count()
    assert line_dedup.dedup_lines(clash).count() == clash.count()
    assert jaccard_join.first_of_each(clash).columns == clash.columns
