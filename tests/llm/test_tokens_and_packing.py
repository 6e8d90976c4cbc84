import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftlake.llm import packing, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def key(x):
    return (x is None, x or 0)


def test_counts_equal_the_library(messy):
    t = Tokenizer.from_file(WORD)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(messy, WORD).collect()), key=lambda r: (key(r[0]), r[1:]))
    want = []
    for r in messy.collect():
        x = r["text"] or ""
        n = len(t.encode(x, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(x.encode()), n, n > 2048))
    assert got == sorted(want, key=lambda r: (key(r[0]), r[1:]))


def test_counts_on_documents(spark):
    t = Tokenizer.from_file(WORD)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, WORD).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)


def test_whole_tokens_are_single(spark):
    t = Tokenizer.from_file(WORD)
    whole = token_counts.whole_tokens(t)
    assert len(whole) > 30_000
    for w in Random(1).sample(sorted(w for w in whole if w.isascii()), 500):
        assert len(t.encode(w, add_special_tokens=False).ids) == 1 or not token_counts.PRE_TOKEN.fullmatch(w)


def test_empty(empty):
    assert token_counts.token_counts(empty, WORD).count() == 0
    assert packing.pack(empty, BYTE).count() == 0


def wanted_pieces(rows, capacity=1024):
    t = Tokenizer.from_file(BYTE)
    out = Counter()
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        at = 0
        for k in range(-(-len(ids) // capacity)):
            n = first if k == 0 else capacity
            out[(r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at += n
    return out


@pytest.mark.parametrize("table", ["messy", "documents"])
def test_pieces_and_packing(spark, messy, table):
    docs = messy if table == "messy" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, BYTE, island_size=60).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted_pieces(docs.collect())
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    least = -(-sum(r["length"] for r in rows) // 1024)
    whole = sum(r["length"] == 1024 for r in rows)
    assert len(bins) <= whole + (least - whole) * 1.12 + 3


def test_ids_come_along(messy):
    for r in packing.pack(messy.limit(20), BYTE, with_ids=True).collect():
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_genetic_algorithm_beats_best_fit():
    rng = Random(3)
    sizes = [rng.randint(150, 700) for _ in range(400)]
    plain = packing.from_patterns([], sizes, 1024)
    best = packing.evolve(sizes, 1024, 60, 1)
    assert sorted(x for b in best.bins.values() for x in b) == list(range(len(sizes)))
    assert all(sum(sizes[x] for x in b) == best.fill[k] <= 1024 for k, b in best.bins.items())
    assert len(best.bins) <= len(plain.bins) and best.fitness() >= plain.fitness() - 1e-9


def test_patterns_are_used():
    got = packing.from_patterns([(600, 424)], [424, 600, 600, 424, 1000], 1024)
    assert sorted(got.fill.values()) == [1000, 1024, 1024]
