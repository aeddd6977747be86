"""Fractional ranks: lists of small numbers, ordered as Spark orders arrays, with room between any two."""

from __future__ import annotations

#: Parts below the first run from 0 to this.
STEPS = 10
LARGEST = 65535


def nth(n: int) -> list[int]:
    """The n-th (from 0) of a row ranked from nothing; it starts at 1, so that something can come before."""
    return [min(n if n <= LARGEST else LARGEST - 1, LARGEST - 1) + 1]


def between(low: list[int] | None, high: list[int] | None) -> list[int]:
    """A rank after low and before high, either of which may be open.

    Low, padded with zeros, is kept up to the first place with room to its ceiling: high's number there as long as all
    numbers before are high's own, else STEPS. There the rank goes halfway up.
    """
    low = low or []
    if high is None:
        return [min((low[0] if low else 0) + 1, LARGEST)]
    padded = low + [0] * (len(high) + 1)
    alike = next((i for i, (x, y) in enumerate(zip(padded, high)) if x != y), len(high))
    ceilings = [high[i] if i < len(high) and i <= alike else STEPS for i in range(len(padded))]
    at = next(i for i, (x, y) in enumerate(zip(padded, ceilings)) if y - x > 1)
    return [*padded[:at], (padded[at] + ceilings[at]) // 2]
