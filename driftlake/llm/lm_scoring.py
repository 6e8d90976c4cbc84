"""Operator 8: language-model scores from a log-frequency Bloom filter.

1. Texts are taken in runs of a few MB, kept as numbers of their words. A run sends
   its different n-grams of each order, as sorted hashes with their counts in
   training texts (0: only in held-out ones), packed by hash range.
2. The task of a range sums up the counts. Those of single words stay exact, as
   the base score needs them. Pairs and triples go into the range's block of the
   filter: an n-gram seen c times has a level of about 2 log2(c), 1 at least, and
   the block holds it with each number from 1 to its level.
3. The runs' n-grams are probed in the same task, with 1, 2, ... until one is
   missing, and each run gets back its levels in the order in which it asked.
4. P(w|u,v) is the triple's share of (u,v), mixed with the pair's share of v, mixed
   with the smoothed share of the word. The weights depend on the level of the
   history and are fitted by EM on all training words, each less itself, on sums
   by level and quantised ratio of the two shares.

A filter over all n-grams grows with the corpus, so it is not broadcast: its
blocks stay where they were made and the probes come to them. No step depends on
how rows lie in partitions, so scores don't either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, clean, crc_mod, release, trim, words_of

if TYPE_CHECKING:
    import pyarrow as pa

#: The end of a text, which no word can be, and the hashes of a start and of two.
END, START, START2 = b"\n", np.uint64(0x5151515151515151), np.uint64(0x2E2E2E2E2E2E2E2E)
#: Code points in a run; highest level; probes for each number; bits for each number held.
CHUNK, LEVELS, PROBES, BITS = 9 << 20, 96, 6, 20.0
#: Bits after its range by which a pair or triple is told.
SHORT = 29
#: Ratios of two shares are told apart by steps of an octave's sixteenth, from 2**-256 on.
STEPS, RATIOS = 16, 8192
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORD, PAIR, TRIPLE = 1, 2, 3


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def level_of(count: np.ndarray) -> np.ndarray:
    """0 for none."""
    return np.where(count > 0, np.clip(np.floor(2 * np.log2(np.maximum(count, 1)) + 1e-9), 1, LEVELS), 0).astype(np.int64)


def count_of() -> np.ndarray:
    """For each level, the mean of the whole numbers that have it (0: none)."""
    out = [0.0, 1.0]
    for level in range(2, LEVELS + 1):
        low, high = math.ceil(2 ** (level / 2) - 1e-9), math.ceil(2 ** ((level + 1) / 2) - 1e-9) - 1
        out.append((low + high) / 2 if high >= low else float(low))
    return np.array(out)


VALUES = count_of()


def fine_levels() -> tuple[np.ndarray, np.ndarray]:
    """Of single words, by steps of an octave's eighth: the least count of each level from 1 on, and the mean of each (0: none)."""
    least = np.array(sorted({math.ceil(2 ** (k / 8) - 1e-9) for k in range(8 * 40)}), np.float64)[:255]
    after = np.append(least[1:], least[-1] * 2 ** (1 / 8))
    return least, np.concatenate([[0.0], (least + np.maximum(np.ceil(after) - 1, least)) / 2])


WORD_LEAST, WORD_VALUES = fine_levels()


class Block:
    """The filter of one hash range."""

    def __init__(self, data: np.ndarray):
        self.data, self.bits = data, np.uint64(8 * len(data))

    @staticmethod
    def places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            x = mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
            return x, mix(x) | np.uint64(1)

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray, bits_each: float = BITS) -> Block:
        """Of keys with each number from 1 to their level."""
        bits = max(64, int(bits_each * levels.sum()) // 8 * 8 + 8)
        out = np.zeros(bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            x, step = cls.places(keys[levels >= level], level)
            with np.errstate(over="ignore"):
                for n in range(PROBES):
                    out[(x + np.uint64(n) * step) % np.uint64(bits)] = True
        return cls(np.packbits(out, bitorder="little"))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: the last number before one that is missing."""
        out, left, k, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys, 1
        while len(left) and level <= LEVELS:
            there = np.arange(len(left))
            x, step = self.places(k, level)
            for n in range(PROBES):
                with np.errstate(over="ignore"):
                    at = (x + np.uint64(n) * step) % self.bits
                found = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                there, x, step = there[found], x[found], step[found]
            left, k = left[there], k[there]
            out[left] = level
            level += 1
        return out


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)


def packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Unsigned numbers, byte by byte of each and compressed."""
    import zstandard

    raw = values.astype(kind)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes())


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def short(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The bits after a hash's range, by which pairs and triples are told apart inside it."""
    return (keys << np.uint64(ranges.bit_length() - 1)) >> np.uint64(64 - SHORT)


def hashes(codes: np.ndarray, word_hash: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of the word, the pair and the triple that end at each token. n: tokens of each text."""
    word, starts = word_hash[codes], np.cumsum(n) - n
    before = np.roll(word, 1)
    before[starts] = START
    pair = pair_hash(before, word)
    history = np.roll(pair, 1)
    history[starts] = START2
    return word, pair, pair_hash(history, word)


TEXTS = "run long, codes binary, words binary, ids array<long>, held array<boolean>, sizes array<long>"
RUNS = "kind int, run long, range int, keys binary, counts binary"


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    columns = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run: its texts as numbers of their words, and the words' hashes in order."""
    import xxhash
    from pyspark import TaskContext

    release()

    def emit(run: int, texts: list[str], ids: list, held: list[bool]) -> pa.RecordBatch:
        found, words, begin = words_of(texts)
        n = np.diff(begin) + 1
        ends = np.cumsum(n) - 1
        codes = np.empty(int(n.sum()), np.int64)
        codes[ends] = len(words)
        within = np.ones(len(codes), bool)
        within[ends] = False
        codes[within] = found
        words.append(END)
        # numbered by hash, so that answers come in this order
        word_hash = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        order = np.argsort(word_hash)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return _batch(TEXTS, [(run, packed(place[codes]), packed(np.diff(word_hash[order], prepend=np.uint64(0)), "<u8"), ids, held, n.tolist())])

    number = TaskContext.get().partitionId() << 20
    texts, ids, held, size = [], [], [], 0
    for batch in batches:
        for i, x, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            texts.append(x)
            ids.append(i)
            held.append(h)
            size += len(x) + 16
            if size > CHUNK:
                yield emit(number, texts, ids, held)
                texts, ids, held, size, number = [], [], [], 0, number + 1
    if texts:
        yield emit(number, texts, ids, held)
    trim()


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words, the words' hashes, tokens of each text."""
    return unpacked(row["codes"]).astype(np.int64), np.cumsum(unpacked(row["words"], "<u8"), dtype=np.uint64), np.array(row["sizes"], np.int64)


def _runs(ranges: int):
    """A run's n-grams by kind and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                codes, word_hash, n = _tokens(row)
                learnt = np.repeat(~np.array(row["held"], bool), n)
                rows = []
                for kind, keys in zip((WORD, PAIR, TRIPLE), hashes(codes, word_hash, n), strict=True):
                    if kind == WORD:
                        keys, counts = word_hash, np.bincount(codes, learnt, len(word_hash))
                    else:
                        keys, inverse = np.unique(keys, return_inverse=True)
                        counts = np.bincount(inverse, learnt, len(keys))
                    own = range_of(keys, ranges)
                    cuts = np.flatnonzero(np.diff(own, prepend=-1))
                    fine, form = (keys, "<u8") if kind == WORD else (short(keys, ranges), "<u4")
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                        rows.append((kind, row["run"], int(own[a]), packed(np.diff(fine[a:b], prepend=np.uint64(0)), form), packed(counts[a:b])))
                yield _batch(RUNS, rows)
        trim()

    return run


ANSWERS = "kind int, run long, range int, n long, total long, data binary"


def _answers(bits_each: float, keep: bool):
    def run(key, runs: pd.DataFrame) -> pd.DataFrame:
        """The range's sums and, to keep, its block (run -1; of words none); for each run, counts of its words or levels of its pairs or triples."""
        kind, exact = int(key[0]), int(key[0]) == WORD
        keys = [np.cumsum(unpacked(x, "<u8" if exact else "<u4").astype(np.uint64)) for x in runs["keys"]]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpacked(x) for x in runs["counts"]])).astype(np.int64)
        seen = total > 0
        rows = []
        if exact:
            answer, block = total, None
        else:
            made = Block.of(every[seen], level_of(total[seen].astype(np.float64)), bits_each)
            answer, block = made.levels(every), made.data.tobytes() if keep else None
        rows.append((kind, -1, int(key[1]), int(seen.sum()), int(total.sum()), block))
        at = 0
        for number, k in zip(runs["run"], keys, strict=True):
            own = answer[inverse[at : at + len(k)]]
            rows.append((kind, int(number), int(key[1]), len(k), 0, packed(own, "<u8" if exact else "u1")))
            at += len(k)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return run


READ = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words binary, pairs binary, triples binary"


def _assemble(divisor: float):
    """A run's texts, with the level of each token, its pair and its triple."""

    def run(rows: pa.Table) -> pa.Table:
        import pyarrow as pa

        own = rows.filter(pa.compute.equal(rows["kind"], 0)).to_pylist()[0]
        answers = rows.filter(pa.compute.greater(rows["kind"], 0)).select(["kind", "range", "data"]).sort_by([("kind", "ascending"), ("range", "ascending")]).to_pylist()
        found = {k: np.concatenate([unpacked(x["data"], "<u8" if k == WORD else "u1") for x in answers if x["kind"] == k]) for k in (WORD, PAIR, TRIPLE)}
        codes, word_hash, n = _tokens(own)
        _, pair, triple = hashes(codes, word_hash, n)
        count = found[WORD].astype(np.float64)
        base, known = np.log10((count + 0.1) / divisor)[codes], (count > 0)[codes]
        words = np.searchsorted(WORD_LEAST, count, "right").astype(np.uint8)[codes]
        pairs, triples = (found[k][np.unique(keys, return_inverse=True)[1]] for k, keys in ((PAIR, pair), (TRIPLE, triple)))
        starts = np.cumsum(n) - n
        cuts = list(zip(starts.tolist(), (starts + n).tolist(), strict=True))
        texts = lambda x: pa.array([packed(x[a:b], "u1") for a, b in cuts], pa.binary())
        out = {
            "doc_id": pa.array(own["ids"], pa.int64()), "held_out": pa.array(own["held"], pa.bool_()), "n_tokens": pa.array(n),
            "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)), "base_score": pa.array(np.add.reduceat(base, starts)),
            "words": texts(words), "pairs": texts(pairs), "triples": texts(triples),
        }
        return pa.table(out)

    return run


def share(count: np.ndarray, history: np.ndarray, less: int = 0) -> np.ndarray:
    """An n-gram's part of its history, each seen `less` times less."""
    own = np.maximum(np.minimum(count, history) - less, 0)
    return np.where(history - less > 0, own / np.maximum(history - less, 1), 0)


class Mixture:
    """Probabilities of the tokens of whole texts. texts: how many training texts there are; weights: by kind, for each level of the history."""

    def __init__(self, texts: float, divisor: float, weights: dict[int, np.ndarray]):
        self.texts, self.divisor, self.weights = texts, divisor, weights

    def shares(self, n: np.ndarray, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, less: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, level of the history, share, probability by shorter histories) of pairs and, if pairs have weights, of triples."""
        starts, count = np.cumsum(n) - n, WORD_VALUES[words]
        lower = (np.maximum(count - less, 0) + 0.1) / self.divisor
        history = np.roll(count, 1)
        history[starts] = self.texts
        longer = np.roll(VALUES[pairs], 1)
        longer[starts] = self.texts
        for kind, seen, before in ((PAIR, pairs, history), (TRIPLE, triples, longer)):
            level, own = level_of(before), share(VALUES[seen], before, less)
            yield kind, level, own, lower
            if kind not in self.weights:
                return
            rate = self.weights[kind][level]
            lower = rate * own + (1 - rate) * lower
        yield 0, level, own, lower


def cell_of(ratio: np.ndarray) -> np.ndarray:
    """The step of each ratio; 0 for none."""
    step = np.floor(STEPS * np.log2(np.where(ratio > 0, ratio, 1))).astype(np.int64) + RATIOS // 2
    return np.where(ratio > 0, np.clip(step, 1, RATIOS - 1), 0)


def fitted(cell: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """For each level of the history, the weight of the longer share that makes the training words likeliest. cell: level * RATIOS + step; n: how many words."""
    out = np.zeros(LEVELS + 1)
    level, step = cell // RATIOS, cell % RATIOS
    ratio = np.where(step > 0, 2.0 ** ((step - RATIOS // 2 + 0.5) / STEPS), 0)
    for b in np.unique(level).tolist():
        r, m = ratio[level == b], n[level == b].astype(np.float64)
        weight = 0.5
        for _ in range(rounds):
            weight = float((m * weight * r / (weight * r + 1 - weight)).sum() / m.sum())
        out[b] = min(weight, 0.999)
    return out


def _arrays(part: dict) -> tuple[np.ndarray, ...]:
    """Tokens of each text; levels of all tokens, their pairs and their triples."""
    return np.array(part["n_tokens"], np.int64), *(np.concatenate([unpacked(x, "u1") for x in part[c]]).astype(np.int64) for c in ("words", "pairs", "triples"))


def _parts(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[dict]:
    """Rows of a batch by about so many tokens."""
    group = np.cumsum(batch.column("n_tokens").to_numpy()) // most
    cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a).to_pydict()


def score(docs: DataFrame, in_range: int = 2_000_000, bits_each: float = BITS, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose crc32(doc_id) mod 10 is not 0 (a null id counts as
    the empty text). A null or empty text is the end token alone. Repeated rows
    count each. With no training rows every count is 0. Other columns are not
    read; an empty table gives no rows. n_known and base_score are exact; the
    model's pairs and triples come from a filter, all of them, seen once too.
    `in_range` is about how many tokens a hash range has, `bits_each` the filter's
    bits for each number it holds; with `model`, a path, the filter's blocks are
    written there (kind, range, n, total, data).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (crc_mod(doc_id, 10) == 0).alias("held"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(4, int(size / 6 / in_range).bit_length())
    runs = scratch.write(slim.mapInArrow(_texts, TEXTS))
    answers = scratch.write(runs.mapInArrow(_runs(ranges), RUNS).groupBy("kind", "range").applyInPandas(_answers(bits_each, model is not None), ANSWERS))
    clean(spark)  # what was shuffled for the answers
    made = answers.where(F.col("run") < 0)
    total, different = made.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if model:
        made.where(F.col("kind") != WORD).select("kind", "range", "n", "total", "data").write.parquet(model)
    divisor = total + 0.1 * (different + 1)
    texts = slim.where(~F.col("held")).count()

    none = lambda kind: F.lit(None).cast(kind)
    own = runs.select(F.lit(0).alias("kind"), "run", F.lit(-1).alias("range"), none("binary").alias("data"), "codes", "words", "ids", "held", "sizes")
    back = answers.where(F.col("run") >= 0).select("kind", "run", "range", "data", *[none(runs.schema[c].dataType).alias(c) for c in ("codes", "words", "ids", "held", "sizes")])
    read = scratch.write(own.unionByName(back).groupBy("run").applyInArrow(_assemble(divisor), READ))
    scratch.drop(runs)
    clean(spark)

    weights: dict[int, np.ndarray] = {}
    for kind in (PAIR, TRIPLE):
        now = Mixture(float(texts), divisor, dict(weights))

        def observe(batches: Iterator[pa.RecordBatch], kind=kind, now=now) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            seen = np.zeros((LEVELS + 1) * RATIOS, np.int64)
            for batch in batches:
                for part in _parts(batch):
                    for k, level, longer, lower in now.shares(*_arrays(part), less=1):
                        if k == kind:
                            seen += np.bincount(level * RATIOS + cell_of(longer / lower), minlength=len(seen))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["cell", "n"])

        learnt = read.where(~F.col("held_out")).select("n_tokens", "words", "pairs", "triples")
        # at most (LEVELS + 1) * RATIOS rows
        sums = learnt.mapInArrow(observe, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        weights[kind] = fitted(sums["cell"].to_numpy(np.int64), sums["n"].to_numpy(np.int64))
    final = Mixture(float(texts), divisor, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            scores = []
            for part in _parts(batch):
                n, *arrays = _arrays(part)
                *_, (_, _, _, model) = final.shares(n, *arrays, less=0)
                scores.append(np.add.reduceat(np.log10(model), np.cumsum(n) - n))
            kept = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate([np.zeros(0), *scores]))], [*kept, "score"])
        trim()

    out = read.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
