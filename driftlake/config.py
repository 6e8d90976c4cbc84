"""Settings of the scorer and its evaluation, frozen before any result is seen."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Scorer:
    k: int = 5
    k_sensitivity: tuple[int, ...] = (1, 5, 10, 20)
    threshold_quantile: float = 0.9
    precision_k: tuple[int, ...] = (50, 100, 500, 1000)
    min_members: int = 5
    max_families: int = 500
    bins: int = 10
    most_length: int = 1024
    seed: int = 42


def load(path: str | Path) -> dict:
    """A YAML file as nested dictionaries."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def scorer(settings: dict) -> Scorer:
    """Known settings from a flat dictionary; unknown names are errors."""
    known = {f.name for f in fields(Scorer)}
    if odd := set(settings) - known:
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return Scorer(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
