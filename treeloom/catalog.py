"""Named queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from .plans import corpus, history, lookups, scanning, shape, surface, trees

PARTS = (trees, shape, history, corpus, surface, scanning, lookups)
QUERIES: dict = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for p in PARTS for k, s in p.ORACLES.items()}
