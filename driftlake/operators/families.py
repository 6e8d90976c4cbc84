"""Family search over sequences: a registered scanner gives (family, score), a threshold decides."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "genome string, protein_id string, family string, score double"


class Scanner(Protocol):
    """Made once a task, with its library opened once."""

    def scan(self, sequences: list[str]) -> list[list[tuple[str, float]]]:
        """(family, score) of each sequence's hits at or above the family's own threshold."""


class Motifs:
    """A stand-in where no profile library is at hand: a family is a pattern, its score the letters that match."""

    def __init__(self, patterns: dict[str, str], least: dict[str, float] | None = None):
        self.patterns = [(name, re.compile(p)) for name, p in sorted(patterns.items())]
        self.least = least or {}

    def scan(self, sequences: list[str]) -> list[list[tuple[str, float]]]:
        out = []
        for s in sequences:
            scores = [(name, float(sum(m.end() - m.start() for m in p.finditer(s)))) for name, p in self.patterns]
            out.append([(name, x) for name, x in scores if x > 0 and x >= self.least.get(name, 0.0)])
        return out


def profile_library(path: str, cpus: int = 1) -> Callable[[], Scanner]:
    """A scanner over a library of profiles with gathering thresholds, by pyhmmer (not part of this package's requirements)."""

    def make() -> Scanner:
        try:
            from pyhmmer import easel, hmmer, plan7
        except ImportError as e:
            raise RuntimeError("a search of profiles needs the package pyhmmer") from e
        alphabet = easel.Alphabet.amino()
        with plan7.HMMFile(path) as f:
            profiles = list(f)

        class Profiles:
            def scan(self, sequences: list[str]) -> list[list[tuple[str, float]]]:
                block = [easel.TextSequence(name=str(i).encode(), sequence=s).digitize(alphabet) for i, s in enumerate(sequences)]
                out: list[list[tuple[str, float]]] = [[] for _ in sequences]
                for found in hmmer.hmmsearch(profiles, block, cpus=cpus, bit_cutoffs="gathering"):
                    family = (found.query.accession or found.query.name).decode()
                    for hit in found.included:
                        out[int(hit.name)].append((family, hit.score))
                return out

        return Profiles()

    return make


def search(sequences: DataFrame, make: Callable[[], Scanner], batch_size: int = 1000) -> DataFrame:
    """genome, protein_id, family, score: a row for each hit. Null or empty sequences have none; a protein without hits has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = make()
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                hits = scanner.scan(part["seq"].tolist())
                rows = [(g, p, family, score) for g, p, own in zip(part["genome"], part["protein_id"], hits, strict=True) for family, score in own]
                yield pd.DataFrame(rows, columns=["genome", "protein_id", "family", "score"])

    known = sequences.where(F.col("seq").isNotNull() & (F.col("seq") != "")).select(F.col("genome").cast("string"), F.col("protein_id").cast("string"), "seq")
    return known.mapInPandas(run, HITS)
