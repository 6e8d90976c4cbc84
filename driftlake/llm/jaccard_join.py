"""Operator 10: exact n-gram Jaccard join with set-relation skipping.

1. Each text's set of shingle hashes is made; equal sets are one class from here on.
   A task sends its shingles as packed, sorted runs by hash range.
2. Half of the shingles, told by a bit of their hash, suffice; only a set with too
   few of these sends others too. Each range counts in how many sets a shingle
   occurs and answers every run with those that occur more than once. A shingle that is common within
   one run is sent as one entry with a count, so no shingle floods its range.
3. With this half first, and rare before common, two similar sets share one of their first shingles.
   Sets whose first shingles occur nowhere else are done. The others, with their
   first shared shingles, fall into candidate groups (components by shared shingle).
4. Within a group an inverted index is probed set by set, by rising size. Blocks
   of a list are skipped whole where positions leave too small an overlap. Some
   sets that answered keep the overlaps with all their candidates; a set similar
   to one of them derives its own from these, within what the two don't share,
   and compares only what that leaves open. All links are counted.

A group beyond `most_in_task` shingles falls into slices of neighbouring set
sizes, and a slice beyond it into blocks, each pair of which is one task; a link
is settled in one of them, and their components are joined again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, Scratch, free, release, trim
from .components import components
from .lm_scoring import mix, packed, range_of, unpacked

KEPT, CHUNK, COMMON, FLAG = 200_000, 8 << 20, 64, 1 << 31
PARTS = "kind int, run long, range int, idx int, doc_id string, n long, h1 long, h2 long, keys binary, docs binary, counts binary"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > KEPT:
                self.clear()
            self[word] = out
        return out


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted different hashes of the text's shingles; a shorter text is one shingle."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width_here = min(width, len(h))
    n = len(h) - width_here + 1
    out = np.full(n, width_here, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width_here):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix(out))


def set_hash(keys: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    import xxhash

    d = xxhash.xxh3_128_digest(keys.astype("<u8").tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _least(n, percent: int):
    """Of a set of n shingles, how many a similar set can lack, and one."""
    return n - (percent * n + 99) // 100 + 1


def _short(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The part of a hash by which shingles are counted: its range, and 32 bits more."""
    bits = np.uint64(ranges.bit_length() - 1)
    return range_of(keys, ranges) << 32 | ((keys << bits) >> np.uint64(32)).astype(np.int64)


def _sent(keys: np.ndarray, percent: int, ranges: int) -> np.ndarray:
    """The shingles that a set is told by: the even short hashes, and, where these are fewer than its first shingles, as many odd ones as are missing, smallest first.

    In the order of all shingles the even ones come first, rare before common,
    then the odd ones by their value; so what is sent holds the first shingles.
    """
    odd = _short(keys, ranges) & 1 == 1
    more = max(0, int(_least(len(keys), percent)) - int((~odd).sum()))
    return np.sort(np.concatenate([keys[~odd], keys[odd][:more]])) if more else keys[~odd]


def _pieces(width: int, percent: int, ranges: int):
    bits = np.uint64(ranges.bit_length() - 1)

    def emit(run: int, docs: list[tuple], sets: list[np.ndarray]) -> pd.DataFrame:
        sent = [_sent(s, percent, ranges) for s in sets]
        # a set's row tells in `range` how many even hashes it has
        rows = [(0, run, int((_short(s, ranges) & 1 == 0).sum()), i, d, len(s), *set_hash(s), None, None, None) for i, (d, s) in enumerate(zip(docs, sets, strict=True))]
        keys, idx = np.concatenate(sent), np.repeat(np.arange(len(sent)), [len(s) for s in sent])
        order = np.argsort(keys, kind="stable")
        keys, idx = keys[order], idx[order]
        if len(keys):
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            size = np.diff(first, append=len(keys))
            hot = np.repeat(size > COMMON, size)
            one = np.zeros(len(keys), bool)
            one[first] = True
            # common here: one entry with the count; who has it stays with the run
            send = one | ~hot
            what = np.where(hot, FLAG, 0) + np.where(hot, np.repeat(size, size), idx)
            k, w = keys[send], what[send]
            own, fine = range_of(k, ranges), ((k << bits) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)], strict=True):
                rows.append((1, run, int(own[a]), -1, None, b - a, 0, 0, packed(np.diff(fine[a:b], prepend=0)), packed(w[a:b]), None))
            if hot.any():
                kept = keys[hot].astype("<u8").tobytes()
                rows.append((2, run, -1, -1, None, int(hot.sum()), 0, 0, kept, packed(idx[hot]), None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        release()
        hashes = WordHashes()
        number = TaskContext.get().partitionId() << 14
        docs, sets, size = [], [], 0
        for batch in batches:
            for d, x in zip(batch["doc_id"], batch["text"], strict=True):
                docs.append(d)
                sets.append(shingles(x, width, hashes))
                size += len(x or "") + 16
                if size > CHUNK:
                    yield emit(number, docs, sets)
                    docs, sets, size, number = [], [], 0, number + 1
        if docs:
            yield emit(number, docs, sets)
        trim()

    return run


def _answers(key, runs: pd.DataFrame) -> pd.DataFrame:
    """For each run of a hash range: its shingles that more than one set has, and how many."""
    fine = [np.cumsum(unpacked(x), dtype=np.uint32) for x in runs["keys"]]
    what = [unpacked(x) for x in runs["docs"]]
    all_fine, all_what = np.concatenate(fine), np.concatenate(what)
    keys, inverse = np.unique(all_fine, return_inverse=True)
    df = np.bincount(inverse, np.where(all_what & FLAG, all_what & (FLAG - 1), 1)).astype(np.int64)
    rows, at = [], 0
    for run, f, w in zip(runs["run"], fine, what, strict=True):
        n = df[inverse[at : at + len(f)]]
        at += len(f)
        keep = n > 1
        if keep.any():
            rows.append((1, int(run), int(key[0]), -1, None, int(keep.sum()), 0, 0, packed(np.diff(f[keep].astype(np.int64), prepend=0)), packed(w[keep]), packed(np.minimum(n[keep], (1 << 32) - 1))))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])


FIRST = "node long, key long, n long, h1 long, h2 long"


def _first_shingles(percent: int, ranges: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Of each set whose first shingles other sets have too: these shingles."""
        docs = rows[rows["kind"] == 0].sort_values("idx")
        parts = {0: [], 1: [], 2: []}
        back = rows[rows["kind"] == 1]
        own = rows[rows["kind"] == 2]
        spread: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, d in zip(own["keys"], own["docs"], strict=True):
            full = np.frombuffer(k, "<u8")
            spread[0] = (_short(full, ranges), unpacked(d).astype(np.int64))
        for r, k, w, c in zip(back["range"], back["keys"], back["docs"], back["counts"], strict=True):
            short = (int(r) << 32) + np.cumsum(unpacked(k).astype(np.int64))
            what, count = unpacked(w).astype(np.int64), unpacked(c).astype(np.int64)
            hot = what & FLAG > 0
            parts[0].append(short[~hot])
            parts[1].append(what[~hot])
            parts[2].append(count[~hot])
            if hot.any():
                names, who = spread[0]
                order = np.argsort(short[hot])
                found = np.searchsorted(short[hot][order], names)
                found = np.minimum(found, len(order) - 1)
                there = short[hot][order][found] == names
                parts[0].append(names[there])
                parts[1].append(who[there])
                parts[2].append(count[hot][order][found[there]])
        columns = [c.split()[0] for c in FIRST.split(", ")]
        if not parts[0] or docs.empty:
            return pd.DataFrame(columns=columns)
        keys, idx, df = (np.concatenate(parts[k]) for k in range(3))
        odd = keys & 1
        order = np.lexsort((keys, np.where(odd, 0, df), odd, idx))
        keys, idx, odd = keys[order], idx[order], odd[order]
        n, even = docs["n"].to_numpy(np.int64), docs["range"].to_numpy(np.int64)
        shared = np.bincount(idx, 1 - odd, minlength=len(n)).astype(np.int64)
        own = np.bincount(idx, minlength=len(n))
        # before these come the even ones that no other set has; odd ones are sent only if they are among the first
        need = _least(n, percent) - (even - shared)
        rank = np.arange(len(idx)) - (np.cumsum(own) - own)[idx]
        keep = (odd == 1) | (rank < need[idx])
        at = idx[keep]
        return pd.DataFrame({"node": (int(key[0]) << 20) + at, "key": keys[keep], "n": n[at], "h1": docs["h1"].to_numpy()[at], "h2": docs["h2"].to_numpy()[at]})

    return run


def _bounds(both: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and overlaps are linked."""
    return 100 * both >= percent * (size + sizes - both)


def link(sets: list[np.ndarray], percent: int = 80, block: int = 64, home=None, times: np.ndarray | None = None, kept: int = 64, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(component of each set, as the number of one of its sets; number of its links). Every set has different, sorted hashes and is not empty.

    home(x, others): which pairs are this call's to settle; all, if not given.
    times: how often a link to each set counts. Of the `kept` sets that answered
    last, the overlaps with all their candidates are known. A set that is similar
    to one of them takes these for its own, less what the two have not in common,
    and only pairs that this leaves open are compared. `seen` gets how many pairs
    were compared.
    """
    label = np.arange(len(sets))
    links = np.zeros(len(sets), np.int64)
    times = np.ones(len(sets), np.int64) if times is None else times
    compared = 0
    if len(sets) < 2:
        return label, links
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(tokens))
    ordered, at = rank[inverse], 0
    rows = []
    single = int((df == 1).sum())  # ranks below this occur once
    for n in sizes.tolist():
        rows.append(np.sort(ordered[at : at + n]))
        at += n
    by_rank = np.sort(df)
    offset = np.cumsum(by_rank) - by_rank
    who, rest, filled = np.zeros(int(by_rank.sum()), np.int32), np.zeros(int(by_rank.sum()), np.int32), np.zeros(len(tokens), np.int64)
    blocks: dict[int, list[tuple[int, int]]] = {}  # of a list: largest rest, smallest size
    members = {k: [k] for k in range(len(sets))}
    mark = np.zeros(len(tokens), bool)
    answers: dict[int, tuple[list[int], list[int]]] = {}  # of the sets kept: others, and overlaps with them
    for x in np.argsort(sizes, kind="stable").tolist():
        row, n = rows[x], len(rows[x])
        first = row[: n - (percent * n + 99) // 100 + 1]
        begin = int(np.searchsorted(first, single))
        found = []
        least = (percent * n + 99) // 100  # size of a partner, and overlap with it
        for i in range(begin, len(first)):
            t = int(first[i])
            size = int(filled[t])
            left = n - i - 1
            lo = int(offset[t])
            for b, (most, small) in enumerate(blocks.get(t, ())):
                if 1 + min(left, most) >= max(least, -(-percent * (n + small) // (100 + percent))):
                    found.append(who[lo + b * block : lo + (b + 1) * block])
            done = size // block * block
            if size > done:
                tail = slice(lo + done, lo + size)
                found.append(who[tail][1 + np.minimum(left, rest[tail]) >= least])
        if found:
            near, often = np.unique(np.concatenate(found), return_counts=True)
            keep = 100 * sizes[near] >= percent * n
            if home:
                keep &= home(x, near)
            near, often = near[keep].astype(np.int64), often[keep]
            if len(near):
                mark[row] = True
                near = near[np.argsort(-often, kind="stable")]  # likeliest first
                overlap = np.full(len(near), -1, np.int64)  # known exactly
                linked = np.zeros(len(near), bool)
                open_ = np.ones(len(near), bool)
                leader = next((i for i, y in enumerate(near[: 4 * kept].tolist()) if y in answers), None)
                if leader is not None:
                    y = int(near[leader])
                    both = int(mark[rows[y]].sum())
                    compared += 1
                    overlap[leader], open_[leader] = both, False
                    linked[leader] = _bounds(np.array(both), n, sizes[y], percent)
                    names, known = (np.array(v, np.int64) for v in answers[y])
                    answers[y][0].append(x)
                    answers[y][1].append(both)
                    if len(names) and linked[leader]:
                        order = np.argsort(names)
                        at = np.minimum(np.searchsorted(names[order], near), len(names) - 1)
                        there = (names[order][at] == near) & open_
                        others = known[order][at]
                        # at least what y shares less what x lacks of y, at most that and what y lacks of x
                        yes = there & _bounds(others - (int(sizes[y]) - both), n, sizes[near], percent)
                        no = there & ~_bounds(np.minimum(others + (n - both), n), n, sizes[near], percent)
                        linked |= yes
                        open_ &= ~(yes | no)
                for i in np.flatnonzero(open_).tolist():
                    overlap[i] = mark[rows[near[i]]].sum()
                    compared += 1
                linked[open_] = _bounds(overlap[open_], n, sizes[near[open_]], percent)
                mark[row] = False
                if leader is None or not linked[leader]:
                    exact = overlap >= 0
                    answers[x] = (near[exact].tolist(), overlap[exact].tolist())
                    if len(answers) > kept:
                        answers.pop(next(iter(answers)))
                hit = near[linked]
                links[x] += times[hit].sum()
                links[hit] += times[x]
                for a in set(label[hit].tolist()) - {int(label[x])}:
                    b = int(label[x])
                    if len(members[a]) > len(members[b]):
                        a, b = b, a
                    label[members[a]] = b
                    members[b] += members.pop(a)
        for i in range(begin, len(first)):
            t = int(first[i])
            k = int(offset[t] + filled[t])
            who[k], rest[k] = x, n - i - 1
            filled[t] += 1
            if filled[t] % block == 0:
                own = slice(k + 1 - block, k + 1)
                blocks.setdefault(t, []).append((int(rest[own].max()), int(sizes[who[own]].min())))
    if seen is not None:
        seen["compared"] = compared
    return label, links


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str, most_bits: int = 1 << 28) -> DataFrame:
    """wanted (doc_id, node, h1, h2, tasks) with data: the sets, made anew from the texts.

    A bit for each hash of a wanted doc_id tells workers which texts to make sets
    of, so that only these sets are moved. It is 16 times as many bits as rows;
    where that is more than `most_bits`, texts are joined to their rows instead.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits = 1 << max(16, (16 * wanted.count()).bit_length())
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(bits))
    told = None
    if bits <= most_bits:
        bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
        words = wanted.select(place("doc_id").alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
        field = np.zeros(bits // 64, np.int64)
        field[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
        told = spark.sparkContext.broadcast(field)
    else:
        texts = texts.join(wanted.select("doc_id"), F.col("__id").eqNullSafe(F.col("doc_id")), "left_semi")

    def read_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        hashes = WordHashes()
        for batch in batches:
            if told is not None:
                p = batch["p"].to_numpy(np.int64)
                batch = batch[(told.value[p >> 6] >> (p & 63)) & 1 == 1]
            out = []
            for d, x in zip(batch["id"], batch["text"], strict=True):
                s = shingles(x, width, hashes)
                out.append((d, *set_hash(s), s.astype("<u8").tobytes()))
            yield pd.DataFrame(out, columns=["id", "g1", "g2", "data"])
        trim()

    made = texts.select(F.col("__id").cast("string").alias("id"), place("__id").alias("p"), "text").mapInPandas(read_sets, "id string, g1 long, g2 long, data binary")
    same = F.col("doc_id").cast("string").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return wanted.join(made, same)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, most_in_task: int = 1_000_000, in_range: int = 4_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (rows that it is linked to) of every row.

    A component is what links reach; a link is 100 * intersection >= percent *
    union of two shingle sets. component_id is its smallest doc_id. A null,
    empty or blank text has an empty set and is linked with nothing. Repeated
    rows are documents with the same id; a null doc_id is never a component's
    smallest unless it has no other. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = 1 << max(4, int(words / 6 / in_range).bit_length())
    parts = scratch.write(slim.mapInPandas(_pieces(width, percent, ranges), PARTS), "kind")
    rows = parts.where("kind = 0").select((F.shiftleft("run", 20) + F.col("idx")).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "n", "h1", "h2")
    names = [c.split()[0] for c in PARTS.split(", ")]
    back = parts.where("kind = 1").select(*names).groupBy("range").applyInPandas(_answers, PARTS)
    back = scratch.write(back)
    first = parts.where("kind <> 1").select(*names).unionByName(back).groupBy("run").applyInPandas(_first_shingles(percent, ranges), FIRST)
    # equal sets have equal first shingles, so the smallest node stands for them everywhere
    first = scratch.write(first.groupBy("key", "n", "h1", "h2").agg(F.min("node").alias("node")))
    by_key = first.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("sets")).where("sets > 1")
    edges = first.join(by_key, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = scratch.write(components(edges, scratch))

    # classes of equal sets with their number of rows
    classes = scratch.write(rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("times")))
    nodes = first.groupBy("node", "n", "h1", "h2").agg(F.lit(1)).select("node", "n", "h1", "h2").join(groups, "node").join(classes.select("node", "times"), "node")
    weight = F.sum("n").alias("weight")
    # a group beyond the bound falls into slices of two neighbouring size bands each: links don't reach farther
    heavy = nodes.groupBy("root").agg(weight)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 2 + 1e-9).cast("int")
    sliced = nodes.join(heavy, "root").withColumn("band", band)
    slices = F.when(F.col("weight") <= most_in_task, F.array(F.lit(-1))).otherwise(F.array(F.col("band") - 1, F.col("band")))
    sliced = scratch.write(sliced.withColumn("slice", F.explode(slices)).drop("weight"))
    # and a slice beyond it into blocks, each pair of which is a task
    weights = sliced.groupBy("root", "slice").agg(weight)
    total = weights.where(F.col("slice") < 0).agg(F.sum("weight")).first()[0] or 0
    tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 4 / most_in_task) + 1)
    blocks = F.when(F.col("weight") <= most_in_task, 1).otherwise(F.ceil(2 * F.col("weight") / most_in_task)).cast("int")
    dealt = sliced.join(weights.select("root", "slice", blocks.alias("blocks")), ["root", "slice"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = F.col("block")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    # small groups share tasks
    whole = F.struct(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("g"), F.lit(-1).alias("slice"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    part = F.struct(F.xxhash64("root", "slice").alias("g"), F.col("slice"), F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    dealt = dealt.withColumn("p", F.explode(pairs)).withColumn("task", F.struct(F.when(F.col("slice") < 0, whole).otherwise(part).alias("key"), "band", "block", "times"))

    wanted = dealt.join(rows.select("node", "doc_id"), "node").groupBy("doc_id", "node", "h1", "h2").agg(F.collect_set("task").alias("tasks"))
    wanted = scratch.write(wanted)
    sets = _sets_of(docs, wanted, width, doc_id, text).select("node", "data", F.inline("tasks")).select("node", "data", "key.*", "band", "block", "times")

    def find_links(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node")
        names, bands, places = (frame[c].to_numpy() for c in ("node", "band", "block"))
        _, piece, i, j = map(int, key)

        def home(x: int, others: np.ndarray) -> np.ndarray:
            """Of the tasks that a pair meets in, one settles it."""
            low, high = np.minimum(places[others], places[x]), np.maximum(places[others], places[x])
            return (np.minimum(bands[others], bands[x]) == piece) & (low == i) & (high == j)

        label, links = link([np.frombuffer(x, "<u8") for x in frame["data"]], percent, home=home if piece >= 0 else None, times=frame["times"].to_numpy(np.int64))
        least = pd.Series(names).groupby(label).transform("min").to_numpy()
        return pd.DataFrame({"a": names, "b": least, "whole": np.full(len(names), piece < 0), "links": links})

    found = scratch.write(sets.groupBy("g", "slice", "i", "j").applyInPandas(find_links, "a long, b long, whole boolean, links long"))
    moved = found.where("a <> b")
    linked = moved.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if moved.where("not whole").limit(1).count():
        linked = linked.unionByName(components(moved.where("not whole").select("a", "b"), scratch).where("node <> root"))
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = scratch.write(classes.join(linked, "node", "left").join(degrees, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")
    known = classes.join(least, "root").select(F.col("n").alias("n2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "component_id", n_links)
    out = rows.join(known, (F.col("n") == F.col("n2")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **args) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest; all columns stay. Rows with a null doc_id go if they are linked to one that has an id."""
    kept = free(docs, "__kept")
    found = jaccard_components(docs, doc_id=doc_id, text=text, **args).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(kept)), "left_semi")
