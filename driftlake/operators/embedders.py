"""Pluggable embedders: batches of strings to vectors, by Arrow batches, the model loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """What a backend has: how long its vectors are, how many code points a token and special tokens may take, and the batch call."""

    dimension: int
    #: Whether runs of ambiguous letters are masked before.
    mask: bool
    #: Tokens that the model takes, specials included (None: any number), and how many of them are specials.
    max_tokens: int | None
    specials: int

    def tokenize(self, sequence: str) -> list[str]: ...

    def vectors(self, sequences: list[str]) -> np.ndarray:
        """One row for each sequence."""


class HashedKmers:
    """A deterministic stand-in where no model weights are at hand: signed counts of hashed windows of k code points, unit length."""

    mask, max_tokens, specials = False, None, 0

    def __init__(self, dimension: int = 64, k: int = 3):
        self.dimension, self.k = dimension, k

    def tokenize(self, sequence: str) -> list[str]:
        return list(sequence)

    def vectors(self, sequences: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        points = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(sequences)), lengths)
        n = max(0, len(points) - self.k + 1)
        hashed = np.zeros(n, np.int64)
        for j in range(self.k):
            hashed = hashed * 31 + points[j : j + n]
        hashed = hashed * 40503 % 65536 // 256  # the upper bits are mixed best
        whole = row[:n] == row[self.k - 1 :][:n]  # windows inside one sequence
        at = row[:n][whole] * self.dimension + hashed[whole] // 2 % self.dimension
        sign = np.where(hashed[whole] % 2 == 1, 1.0, -1.0)
        out = np.bincount(at, sign, len(sequences) * self.dimension).reshape(len(sequences), self.dimension)
        return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


class MaskedHashedKmers(HashedKmers):
    """For nucleotides: runs of N are masked before."""

    mask = True


class WeightedModel:
    """A backend whose weights are not part of this package: `load` makes a function from sequences to vectors, once a task."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int, max_tokens: int, specials: int = 2, mask: bool = False):
        self.load, self.dimension, self.max_tokens, self.specials, self.mask = load, dimension, max_tokens, specials, mask
        self.run = None

    def tokenize(self, sequence: str) -> list[str]:
        return list(sequence)  # one token a letter, as protein and nucleotide models have

    def vectors(self, sequences: list[str]) -> np.ndarray:
        self.run = self.run or self.load()
        return self.run(sequences)


def _absent(package: str, model: str) -> Callable:
    def load():
        raise RuntimeError(f"{model} needs the package {package} and its weights; register a backend of your own with register({model!r}, ...)")

    return load


#: Names, dimensions and token limits of the two model backends are fixed values.
REGISTRY: dict[str, Callable[[], Embedder]] = {
    "kmers": HashedKmers,
    "masked-kmers": MaskedHashedKmers,
    "esm2": lambda: WeightedModel(_absent("transformers", "esm2"), 1280, 1024),
    "genos-m": lambda: WeightedModel(_absent("transformers", "genos-m"), 1024, 8192, mask=True),
}


def register(name: str, factory: Callable[[], Embedder]) -> None:
    REGISTRY[name] = factory


def load_embedder(name: str) -> Embedder:
    if name not in REGISTRY:
        raise ValueError(f"unknown embedder {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]()


def cut(model: Embedder, sequence: str, most_tokens: int | None) -> str:
    """The sequence's first tokens, as many as the model takes beside its specials."""
    limits = [m for m in (model.max_tokens, most_tokens) if m]
    if not limits:
        return sequence
    room = max(0, min(limits) - model.specials)
    return sequence if len(sequence) <= room else "".join(model.tokenize(sequence)[:room])


def embed(table: DataFrame, name: str, sequence: str, batch_size: int = 64, most_tokens: int | None = None) -> DataFrame:
    """table with `embedding`; null sequences give null. Tokens beyond the model's limit, or `most_tokens`, are cut off."""
    from ..functions.text import mask_ambiguous

    factory = REGISTRY.get(name)
    mask = load_embedder(name).mask  # unknown names fail here, on the driver

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            known = batch.notna().to_numpy()
            texts = [cut(model, x, most_tokens) for x in batch[known]]
            out = np.empty(len(batch), object)
            at = np.flatnonzero(known)
            for k in range(0, len(texts), batch_size):
                for i, v in zip(at[k : k + batch_size], model.vectors(texts[k : k + batch_size]), strict=True):
                    out[i] = v.astype(np.float32)
            yield pd.Series(out)

    s = F.col(sequence)
    if mask:
        s = mask_ambiguous(s)
    return table.withColumn("embedding", run(s))
