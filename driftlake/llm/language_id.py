"""Operator 6: language ID by interpolated Kneser-Ney character models.

A text is its words: runs of letters, lower-cased, with a boundary on either
side; a model predicts each letter and the closing boundary from the letters
before it in the word. N-grams stand in one sorted array of 64-bit hashes for
each order, each with the languages that have it and their interpolated log
probabilities; contexts likewise with their back-off weights. So the tables grow
with the n-grams that were seen, not with the number of languages. The language
with the lowest cross-entropy per predicted letter wins (ties: the first by code
point).

Some documents of the sample are kept out of the counts. Their cross-entropies,
less their language's mean and in units of its spread and of the text's length,
give the bound that only the share `false_rejects` of them exceeds. A text
is rejected that exceeds it and is nearer to letters drawn at random than to its
language.

The models are fitted on a sample bounded by `most_chars`; the tables hold at
most `most_chars` n-grams of each order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, held, trim, words_of

#: Tokens, and numbers of their tables, that a worker keeps; code points scored at a time.
KEPT, KEPT_NUMBERS, CHUNK = 250_000, 4_000_000, 2 << 20
#: Labels that are broadcast; more are joined.
MOST_LABELS = 100_000
#: Multiplier of the n-gram hash, odd.
STEP = np.uint64(0x9E3779B97F4A7C15)
EDGE = 0x110000
RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean, predictions long"


@cache
def _letters():
    import regex

    return regex.compile(r"\p{L}+").findall


def letter_runs(token: str) -> list[str]:
    return _letters()(token.lower())


def symbols(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their boundaries; the predicted positions; each one's word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sizes = lengths + order  # order - 1 opening marks, one closing mark
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), EDGE, np.uint64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts + order - 1, lengths)
    out[at] = points
    n = lengths + 1
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return out, within + np.repeat(starts + order - 1, n), np.repeat(np.arange(len(words)), n)


def grams(points: np.ndarray, at: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Hashes of the n symbols that end `skip` before each position."""
    out = np.full(len(at), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            out = (out ^ (out >> np.uint64(29))) * STEP + points[at - k - skip]
        return out ^ (out >> np.uint64(32))


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Table:
    """For sorted hashes, the languages that have them and a number for each."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        every, lang, value = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys]), np.concatenate(values)
        order = np.lexsort((lang, every))
        every, self.lang, self.value = every[order], lang[order], value[order].astype(np.float32)
        first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
        self.keys, self.start = every[first], np.append(first, len(every))

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in wanted, language, number) of all that are there."""
        at, there = find(self.keys, wanted)
        at, place = at[there], np.flatnonzero(there)
        n = self.start[at + 1] - self.start[at]
        end = np.cumsum(n)
        e = np.repeat(self.start[at] - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)
        return np.repeat(place, n), self.lang[e], self.value[e]


class Models:
    """Tables of all languages."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = 4):
        self.order, self.langs = order, sorted(counts)
        self.limits: dict[str, tuple[float, float]] = {}
        self.bound = np.inf
        letters = {c for own in counts.values() for w in own for c in w}
        self.floor = -float(np.log(len(letters) + 2))  # all letters, a boundary and one unseen
        tables = [self._fit(counts[lang]) for lang in self.langs]
        self.grams = {n: Table([t[n][0] for t in tables], [np.log(t[n][1]) for t in tables]) for n in range(1, order + 1)}
        self.contexts = {n: Table([t[n][2] for t in tables], [np.log(t[n][3]) for t in tables]) for n in range(1, order + 1)}

    def _fit(self, counts: dict[str, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By order: n-grams, their probabilities, contexts, their back-off weights; of one language."""
        words = sorted(counts)
        points, at, word = symbols(words, self.order)
        weight = np.array([counts[w] for w in words], np.float64)[word]
        out: dict = {}
        for n in range(1, self.order + 1):
            keys, first, inverse = np.unique(grams(points, at, n), return_index=True, return_inverse=True)
            if n == self.order:
                count = np.bincount(inverse, weight)
            else:  # different symbols to the left
                _, one = np.unique(grams(points, at, n + 1), return_index=True)
                count = np.bincount(inverse[one], minlength=len(keys)).astype(np.float64)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, where = np.unique(grams(points, at[first], n - 1, 1), return_inverse=True)
            total = np.bincount(where, count)
            back = discount * np.bincount(where) / total
            if n == 1:
                lower = np.exp(self.floor)
            else:
                below = out[n - 1]
                lower = below[1][np.searchsorted(below[0], grams(points, at[first], n - 1))]
            p = np.maximum(count - discount, 0) / total[where] + back[where] * lower
            out[n] = (keys, p, context, back)
        return out

    def digest(self) -> bytes:
        """Tells these models from others."""
        import xxhash

        out = xxhash.xxh3_128(repr((self.langs, sorted(self.limits.items()), self.bound)).encode())
        for n in self.grams:
            out.update(self.grams[n].keys.tobytes())
            out.update(self.grams[n].value.tobytes())
        return out.digest()

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the log probability by language and the number of predictions."""
        points, at, word = symbols(words, self.order)
        many = len(self.langs)
        out, left = np.zeros(len(at) * many), np.ones(len(at) * many, bool)
        for n in range(self.order, 0, -1):
            active = np.flatnonzero(left.reshape(-1, many).any(1))
            if not len(active):
                break
            place, lang, value = self.grams[n].entries(grams(points, at[active], n))
            cell = active[place] * many + lang
            new = left[cell]
            out[cell[new]] += value[new]
            left[cell] = False
            place, lang, value = self.contexts[n].entries(grams(points, at[active], n - 1, 1))
            cell = active[place] * many + lang
            new = left[cell]
            out[cell[new]] += value[new]
        out[left] += self.floor
        size = np.bincount(word, minlength=len(words))
        out = out.reshape(-1, many)
        return np.stack([np.bincount(word, out[:, k], len(words)) for k in range(many)], 1), size

    def excess(self, lang: str, cross_entropy: float, n: int) -> float:
        """How far a text's cross-entropy lies above its language's mean, in units of the spread that texts of its length have."""
        mean, spread = self.limits.get(lang, (np.inf, 0.0))
        return (cross_entropy - mean) / (spread + 1.5 / np.sqrt(n)) if mean < np.inf else -np.inf


class Scorer(dict):
    """White-space tokens, as bytes, to rows of a growing table."""

    def __init__(self, models: Models):
        self.models = models
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.table, self.sizes = np.zeros((0, len(self.models.langs))), np.zeros(0, np.int64)

    def __missing__(self, token: bytes) -> int:
        k = self[token] = len(self)
        self.new.append(token)
        return k

    def settle(self) -> None:
        if not self.new:
            return
        letters = _letters()
        runs = [letters(t.decode().lower()) for t in self.new]
        sums, sizes = np.zeros((len(runs), len(self.models.langs))), np.zeros(len(runs), np.int64)
        flat = [r for own in runs for r in own]
        owner = np.repeat(np.arange(len(runs)), [len(own) for own in runs])
        step = max(100, 40_000 // len(self.models.langs))
        for k in range(0, len(flat), step):  # some at a time bounds the arrays
            total, size = self.models.words(flat[k : k + step])
            np.add.at(sums, owner[k : k + step], total)
            np.add.at(sizes, owner[k : k + step], size)
        self.table, self.sizes = np.concatenate([self.table, sums]), np.concatenate([self.sizes, sizes])
        self.new = []

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by language (nats a prediction) and predictions of each text."""
        if len(self) > min(KEPT, KEPT_NUMBERS // len(self.models.langs)):
            self.reset()
        codes, words, begin = words_of([x or "" for x in texts])
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))[codes]
        self.settle()
        n = np.concatenate([[0], np.cumsum(self.sizes[rows])])
        n = n[begin[1:]] - n[begin[:-1]]
        sums = np.zeros((len(texts), len(self.models.langs)))
        full = np.flatnonzero(np.diff(begin))
        if len(full):
            sums[full] = np.add.reduceat(self.table[rows], begin[full], axis=0)
        return -sums / np.maximum(n, 1)[:, None], n

    def label(self, texts: list[str | None]) -> pd.DataFrame:
        out = []
        for h, n in zip(*self.texts(texts), strict=True):
            if not n:
                out.append(("und", 0.0, None, True, 0))
                continue
            k = int(h.argmin())
            lang = self.models.langs[k]
            score = 1 / np.exp(-(h - h[k]) * min(n, 200)).sum()
            # beyond what its language had, and nearer to letters drawn at random
            mean = self.models.limits.get(lang, (np.inf, 0.0))[0]
            rejected = self.models.excess(lang, h[k], n) > self.models.bound and h[k] > (mean - self.models.floor) / 2
            out.append((lang, float(score), float(h[k]), bool(rejected), int(n)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "cross_entropy", "rejected", "predictions"])


def _udf(kept) -> object:
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = kept.value
        scorer = held(("language", models.digest()), lambda: Scorer(models))
        for texts in batches:
            part = texts.str.len().cumsum() // CHUNK
            yield pd.concat([scorer.label(own.tolist()) for _, own in texts.groupby(part.to_numpy(), sort=True)] or [scorer.label([])], ignore_index=True)
        trim()

    return run.asNondeterministic()  # else a filter on the result is pushed below it, and it runs twice


def sample(docs: DataFrame, most_chars: int, longest: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """lang, text, calibrate: labelled rows up to about `most_chars` code points, shared evenly by the languages; one in eight is for calibration."""
    rows = docs.where(F.col(lang).isNotNull() & (F.char_length(text) <= longest)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit("language"), F.col(doc_id)), F.lit(1 << 30)).alias("h"))
    totals = rows.groupBy(F.col("lang").alias("l")).agg(F.sum(F.char_length("text")).alias("n"))
    labels = totals.count()
    share = F.lit(float(most_chars)) / F.lit(float(max(1, labels)))
    cuts = totals.select("l", (F.least(F.lit(1.0), share / F.greatest("n", F.lit(1))) * (1 << 30)).cast("long").alias("cut"))
    # a row for each label: texts are not moved for so few
    kept = rows.join(F.broadcast(cuts) if labels <= MOST_LABELS else cuts, F.col("lang") == F.col("l")).where(F.col("h") < F.col("cut"))
    return kept.select("lang", "text", (F.pmod(F.xxhash64(F.lit("calibrate"), "h"), F.lit(8)) == 0).alias("calibrate"))


def fit(docs: DataFrame, most_chars: int = 2_000_000, longest: int = 100_000, order: int = 4, false_rejects: float = 0.001, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Models | None:
    """Models from labelled rows, of any number of languages; None without any letter to learn from.

    `most_chars` bounds the sample, texts over `longest` code points don't enter
    it. `false_rejects` is the share of the calibration texts that the bound lets
    be exceeded; with fewer than 1 / false_rejects of them it lies above them all,
    by a quarter of their range.
    """
    rows = Scratch(docs.sparkSession, "language").write(sample(docs, most_chars, longest, doc_id, text, lang))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        for b in batches:
            for name, x in zip(b["lang"], b["text"], strict=True):
                words.update((name, r) for r in letter_runs(x))
        yield pd.DataFrame([(a, b, n) for (a, b), n in words.items()], columns=["lang", "word", "n"])

    counted = rows.where(~F.col("calibrate")).select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for name, word, n in counted.toPandas().itertuples(index=False):  # at most as many rows as the sample has words
        counts.setdefault(name, {})[word] = int(n)
    if not counts:
        return None
    models = Models(counts, order)
    held = rows.where("calibrate").select(_udf(docs.sparkSession.sparkContext.broadcast(models))("text").alias("r")).where("r.predictions > 0")
    calibrate(models, held.select("r.lang_pred", "r.cross_entropy", "r.predictions").toPandas(), false_rejects)
    return models


def calibrate(models: Models, held: pd.DataFrame, false_rejects: float, fewest: int = 8) -> None:
    """Sets limits and bound from lang_pred, cross_entropy, predictions of texts the counts don't have; without such texts nothing is rejected."""
    for name, own in held.groupby("lang_pred"):
        if len(own) >= fewest:
            models.limits[name] = (float(own["cross_entropy"].mean()), float(own["cross_entropy"].std()))
    z = np.sort([models.excess(*r) for r in held.itertuples(index=False) if r[0] in models.limits])
    if len(z):
        over = int(false_rejects * len(z))
        models.bound = float(z[-1 - over]) if over else float(z[-1] + (z[-1] - z[0]) / 4)


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> Column:
    """A struct lang_pred, score, cross_entropy, rejected, predictions for each row of docs.

    A null text, or one with no letter, is `und` with score 0 and rejected; so
    is everything where nothing could be learned. Texts are read whole.
    """
    if models is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"), F.lit(0).cast("long").alias("predictions"))
    return _udf(docs.sparkSession.sparkContext.broadcast(models))(F.coalesce(F.col(text), F.lit("")))


def language_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **args) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected, predictions of every row; learns from rows whose crc32(doc_id) mod 3 is not 1 (a null id counts as the empty text)."""
    from ._common import crc_mod

    models = fit(docs.where(crc_mod(doc_id, 3) != 1), doc_id=doc_id, text=text, lang=lang, **args)
    return docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, 3) == 1).alias("held_out"), identify(docs, models, text).alias("r")).select("doc_id", "held_out", "r.*")
