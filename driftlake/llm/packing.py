"""Operator 4: best-fit packing by a grouping genetic algorithm.

A document's tokens and an end token are cut into pieces of at most `capacity`;
only the first piece can be shorter. Full pieces fill a sequence alone. The
others are dealt at random to islands of bounded size. Each island evolves
groupings of its pieces: crossover injects whole well-filled bins of one parent
into the other, bins that hold a duplicate are emptied, and what they lose is
placed again by best fit, largest first. Between epochs the fill patterns of an
island's best bins (its elite) go to the next island, which builds a newcomer
from them. At the end the pieces of poorly filled bins meet once more on fewer,
coarser islands.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from random import Random
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Kept, Scratch, file_bytes, held, release, trim

if TYPE_CHECKING:
    import pyarrow as pa

assert sys.byteorder == "little" and array("I").itemsize == 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
BLANK, LETTER, NUMBER, OTHER = range(4)
#: Code points encoded at once.
CHUNK = 4 << 20


def byte_characters() -> dict[int, str]:
    """The byte-level vocabulary's character for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def classes() -> np.ndarray:
    """For each code point whether the library takes it for a blank, a letter, a number or another."""
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(len(out)))
    for kind, pattern in ((BLANK, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        # all that match become one character that no text has
        shown = Replace(Regex(pattern), chr(sys.maxunicode)).normalize_str(points)
        out[:-1][np.frombuffer(shown.encode("utf-32-le"), "<u4")[:-1] == sys.maxunicode] = kind
    return out


def pre_tokens(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. points, kind: of each code point; first: is it a text's first.

    A run of one kind is a pre-token, with the space (0x20) before it; of other
    blanks all but the last stand together. An apostrophe that starts a run takes
    a contraction's letters.
    """
    blank, space = kind == BLANK, points == 0x20
    changed = first.copy()
    changed[1:] |= kind[1:] != kind[:-1]
    after_space = np.zeros(len(points), bool)
    after_space[1:] = space[:-1]
    after_space &= ~first
    last = np.ones(len(points), bool)  # of its text
    last[:-1] = first[1:]
    start = changed & (blank | ~after_space)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~last[:-1]
    mark = np.flatnonzero((points == ord("'")) & changed & ~after_space & ~last)
    if len(mark):
        end = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = end[mark + 1], end[mark + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        double &= ~last[mark + 1]
        start[mark[single | double] + 1] = False
        for at, size in ((mark[single], 2), (mark[double & ~single], 3)):
            at = at + size
            start[at[at < len(start)]] = True
    return start


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Texts are cut into pre-tokens by array operations; each different one is
    merged by the library's model once, and kept. Texts with special strings are
    the library's altogether.
    """

    def __init__(self, tokenizer, kinds: np.ndarray):
        self.tokenizer, self.merge, self.characters, self.kinds = tokenizer, tokenizer.model.tokenize, byte_characters(), kinds
        self.odd = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Kept(self.piece)

    def piece(self, piece: bytes) -> bytes:
        return array("I", [t.id for t in self.merge(piece.decode("latin-1").translate(self.characters))]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, own, size = [np.zeros(0, "<u4")] * len(texts), [], 0
        for k, x in enumerate(texts):
            if any(o in x for o in self.odd):
                out[k] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4")
            elif x:
                own.append(k)
                size += len(x)
            if own and (size > CHUNK or k == len(texts) - 1):
                for j, ids in zip(own, self.together([texts[j] for j in own]), strict=True):
                    out[j] = ids
                own, size = [], 0
        return out

    def together(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa

        whole = "".join(texts)
        points, data = np.frombuffer(whole.encode("utf-32-le"), "<u4"), whole.encode()
        starts = np.cumsum([0, *map(len, texts[:-1])])
        first = np.zeros(len(points), bool)
        first[starts] = True
        at = np.flatnonzero(pre_tokens(points, self.kinds[points], first))
        text_at = np.searchsorted(at, starts)  # each text's first pre-token
        if len(data) > len(points):
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = (np.cumsum(width) - width)[at]
        offsets = np.append(at, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        own = list(map(self.pieces.__getitem__, found.dictionary.to_pylist()))
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids, begin, which = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size, found.indices.to_numpy()
        n = size[which]
        end = np.cumsum(n)
        flat = ids[np.repeat(begin[which] - end + n, n) + np.arange(int(end[-1]))]
        return np.split(flat, (end - n)[text_at[1:]])


def encoder(kept) -> Encoder:
    from tokenizers import Tokenizer

    data, kinds = kept.value
    return held(("packing", hashlib.sha256(data).digest()), lambda: Encoder(Tokenizer.from_str(data.decode()), kinds))


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless with_ids): a row for each piece."""
    kept = docs.sparkSession.sparkContext.broadcast((file_bytes(tokenizer_path), classes()))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        enc = encoder(kept)
        for batch in batches:
            row, piece, start, length, crc, data = ([] for _ in range(6))
            for r, own_ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids = own_ids.tobytes() + end
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    size = (n % capacity or capacity) if k == 0 else capacity
                    own = ids[4 * at : 4 * (at + size)]
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    data.append(own if with_ids else None)
                    at += size
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        trim()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, PIECES)


class Bins:
    """A grouping: bins of pieces, found by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.fill, self.free = capacity, {}, {}, defaultdict(set)
        self.mask = self.next = 0

    def _file(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        self.free[room].add(k)
        self.mask |= 1 << room

    def _unfile(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        self.free[room].discard(k)
        if not self.free[room]:
            self.mask &= ~(1 << room)

    def open(self, items: list[int], fill: int) -> None:
        self.bins[self.next], self.fill[self.next] = items, fill
        self._file(self.next)
        self.next += 1

    def drop(self, k: int) -> list[int]:
        self._unfile(k)
        del self.fill[k]
        return self.bins.pop(k)

    def best_fit(self, item: int, size: int) -> None:
        rooms = self.mask >> size
        if not rooms:
            self.open([item], size)
            return
        room = size + (rooms & -rooms).bit_length() - 1
        k = next(iter(self.free[room]))
        self._unfile(k)
        self.bins[k].append(item)
        self.fill[k] += size
        self._file(k)

    def fitness(self) -> float:
        return sum((f / self.capacity) ** 2 for f in self.fill.values()) / max(1, len(self.fill))

    def copy(self) -> Bins:
        out = Bins(self.capacity)
        out.bins = {k: list(v) for k, v in self.bins.items()}
        out.fill, out.mask, out.next = dict(self.fill), self.mask, self.next
        out.free = defaultdict(set, {k: set(v) for k, v in self.free.items() if v})
        return out


def crossover(a: Bins, b: Bins, sizes: list[int], random: Random, well: float = 0.99, share: float = 0.3) -> Bins:
    """Well-filled bins of b go into a copy of a; what that displaces is placed again by best fit."""
    child = a.copy()
    home = {x: k for k, items in child.bins.items() for x in items}
    same = {tuple(sorted(v)) for v in child.bins.values()}
    injected = [v for k, v in b.bins.items() if b.fill[k] >= well * b.capacity and random.random() < share and tuple(sorted(v)) not in same]
    held = {x for v in injected for x in v}
    displaced = [x for k in {home[x] for x in held} for x in child.drop(k) if x not in held]
    # the worst bins give up their pieces too
    for k in sorted(child.fill, key=child.fill.get)[: 2 + len(child.fill) // 50]:
        displaced += child.drop(k)
    for v in injected:
        child.open(list(v), sum(sizes[x] for x in v))
    for x in sorted(displaced, key=lambda x: (-sizes[x], x)):
        child.best_fit(x, sizes[x])
    return child


def from_patterns(patterns: list[tuple[int, ...]], sizes: list[int], capacity: int) -> Bins:
    """A grouping that uses the patterns wherever own pieces have the sizes."""
    left = defaultdict(list)
    for x in sorted(range(len(sizes)), reverse=True):
        left[sizes[x]].append(x)
    out = Bins(capacity)
    for pattern in patterns:
        need = defaultdict(int)
        for s in pattern:
            need[s] += 1
        while all(len(left.get(s, ())) >= n for s, n in need.items()):
            out.open([left[s].pop() for s in pattern], sum(pattern))
    for s in sorted((s for s in left if left[s]), reverse=True):
        for x in reversed(left[s]):
            out.best_fit(x, s)
    return out


def evolve(sizes: list[int], capacity: int, generations: int, seed: int, start: list[Bins] = (), population: int = 6) -> Bins:
    """The best grouping found; stops at the lower bound."""
    random = Random(seed)
    least = -(-sum(sizes) // capacity)
    group = [*start, from_patterns([], sizes, capacity)]
    while len(group) < population:
        if min(len(g.bins) for g in group) <= least:
            break
        jitter = [s * random.uniform(0.8, 1.0) for s in sizes]
        grown = Bins(capacity)
        for x in sorted(range(len(sizes)), key=lambda x: -jitter[x]):
            grown.best_fit(x, sizes[x])
        group.append(grown)
    rank = lambda g: (-len(g.bins), g.fitness())
    group.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(group[0].bins) <= least or len(group) < 2:
            break
        i, j = random.sample(range(len(group)), 2)
        a, b = group[min(i, j)], group[max(i, j)]
        child = crossover(a, b, sizes, random) if random.random() < 0.5 else crossover(b, a, sizes, random)
        if rank(child) > rank(group[-1]):
            group[-1] = child
            group.sort(key=rank, reverse=True)
    return group[0]


ISLE = "kind int, island long, bin long, at int, item long, size int, pattern array<int>"


def _epoch(capacity: int, generations: int, islands: int, elite: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        release()
        island = int(key[0])
        own = rows[rows["kind"] == 0].sort_values("item", kind="stable")
        if own.empty:
            return pd.DataFrame(columns=["kind", "island", "bin", "at", "item", "size", "pattern"])
        sizes = [int(x) for x in own["size"]]
        start = []
        if (own["bin"] >= 0).all():
            known = Bins(capacity)
            groups = defaultdict(list)
            for x, k in enumerate(own["bin"]):
                groups[int(k)].append(x)
            for k in sorted(groups):
                known.open(groups[k], sum(sizes[x] for x in groups[k]))
            start.append(known)
        patterns = sorted(tuple(int(y) for y in x) for x in rows.loc[rows["kind"] == 1, "pattern"])
        if patterns:
            start.append(from_patterns(sorted(patterns, key=lambda p: (-sum(p), p)), sizes, capacity))
        best = evolve(sizes, capacity, generations, island, start)
        items = own["item"].tolist()
        out, shown = [], []
        for n, k in enumerate(sorted(best.bins)):
            at = 0
            for x in best.bins[k]:
                out.append((0, island, n, at, items[x], sizes[x], None))
                at += sizes[x]
            shown.append((best.fill[k], tuple(sorted((sizes[x] for x in best.bins[k]), reverse=True))))
        for _, pattern in sorted(set(shown), reverse=True)[:elite]:
            if len(pattern) > 1:
                out.append((1, (island + 1) % islands, -1, 0, -1, 0, list(pattern)))
        return pd.DataFrame(out, columns=["kind", "island", "bin", "at", "item", "size", "pattern"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, island_size: int = 2500, epochs: int = 2, generations: int = 24, elite: int = 128, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row for each piece.

    A null or empty text is the end token alone. Repeated rows are documents of
    their own; a null doc_id stays null. Other columns are not read. An empty
    table gives no rows. Pieces of one sequence lie gapless from offset 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    # a number for each piece, fixed once it is written
    pieces = scratch.write(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids, doc_id, text).withColumn("item", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity)
    islands = max(1, -(-short.count() // island_size))
    whole = pieces.where(F.col("length") == capacity).select("*", (F.lit(1 << 60) + F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    state = short.select(F.lit(0).alias("kind"), F.pmod(F.xxhash64("item"), F.lit(islands)).alias("island"), F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("at"), "item", F.col("length").cast("int").alias("size"), F.lit(None).cast("array<int>").alias("pattern"))
    for _ in range(epochs):
        state = scratch.write(state.groupBy("island").applyInPandas(_epoch(capacity, generations, islands, elite), ISLE))
    placed = state.where("kind = 0")
    fill = placed.groupBy("island", "bin").agg(F.sum("size").alias("fill"))
    placed = placed.join(fill, ["island", "bin"])
    poor = F.col("fill") < 0.98 * capacity
    coarse = max(1, islands // 16)
    again = placed.where(poor).select("kind", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(coarse)).alias("island"), F.lit(-1).cast("long").alias("bin"), "at", "item", "size", "pattern")
    again = again.groupBy("island").applyInPandas(_epoch(capacity, 2 * generations, coarse, 0), ISLE)
    number = lambda first: (F.lit(first) + F.col("island") * (1 << 20) + F.col("bin")).alias("sequence_id")
    ends = scratch.write(
        placed.where(~poor).select("item", number(0), F.col("at").cast("long").alias("offset"))
        .unionByName(again.select("item", number(1 << 59), F.col("at").cast("long").alias("offset")))
    )
    out = short.join(ends, "item").unionByName(whole)
    return out.select("doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
