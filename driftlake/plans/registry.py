"""All queries of the reference's operators, and their SQL."""

from __future__ import annotations

from . import novelty, panel

QUERIES = {**novelty.QUERIES, **panel.QUERIES}
ORACLES = {**novelty.ORACLES, **panel.ORACLES}
