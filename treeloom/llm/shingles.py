"""Words, five-word shingles and MinHash signatures of many texts at once, as hashed arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return. A-Z fold to a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def split_words(texts: list[str | None], separates: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of all texts in order, and how many words each text has."""
    raw = [(t or "").encode() for t in texts]
    data = _FOLD[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    inside = ~separates[data]
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    end = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    at = np.flatnonzero(inside)
    length = end - start
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    parts = _BYTE[data[at]] * powers(int(length.max()))[place]
    words = mix(np.add.reduceat(parts, np.cumsum(length) - length) + length.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return words, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's distinct shingles as sorted hashes, and a digest of its words; both empty without words."""
    from hashlib import blake2b

    words, counts = split_words(texts)
    sets, digests, at = [], [], 0
    weights = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    for n in counts.tolist():
        w, at = words[at : at + n], at + n
        if n == 0:
            sets.append(w)
            digests.append(b"")
            continue
        k = min(n, WORDS)
        h = np.full(n - k + 1, np.uint64(k * int(ODD) % 2**64), np.uint64)
        for j in range(k):
            h += w[j : n - k + 1 + j] * weights[j]
        sets.append(np.unique(mix(h)))
        digests.append(blake2b(w.tobytes(), digest_size=16).digest())
    return sets, digests


def signatures(sets: list[np.ndarray], size: int, first: int = 0) -> np.ndarray:
    """MinHash signatures, a row of `size` 32-bit values for each set, by the hash functions from number `first` on; a
    row of an empty set is all ones."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        keys = mix(np.arange(2 * first + 1, 2 * (first + size) + 1, dtype=np.uint64) * ODD)
        work = np.empty_like(flat)
        for k in range(size):
            np.bitwise_xor(flat, keys[2 * k], out=work)
            np.multiply(work, keys[2 * k + 1] | np.uint64(1), out=work)
            out[some, k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out
