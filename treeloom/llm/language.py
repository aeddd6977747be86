"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1/-1. A letter trigram is bound by multiplying its three letter
vectors, each permuted (rolled) by its place, a text's profile is the bundle (sum) of its trigrams' vectors, and
a language's prototype is the bundle of its sample texts' unit profiles. A text gets the language whose prototype
has the largest cosine with its profile.

Defined cases: null, empty and letterless texts get `und` with score 0; an empty table gives an empty one; a text of
any length is profiled whole, though only those of SAMPLE_CHARS at most are learned from; equal cosines go to the language that
sorts first; repeated rows get the same answer; without a single labelled text every answer is `und`; null doc_id
counts as an empty text in the fold; all other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1024
#: Bounds of the training sample: texts a language, characters a text.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 20_000
BLOCK = 2048


@cache
def _folds() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of +1/-1 for each code point; a function of the code point alone."""
    words = letters.astype(np.uint64)[:, None] * np.uint64(dim // 64) + np.arange(dim // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def profiles(texts: list[str], dim: int = DIM) -> np.ndarray:
    """The profile of each text, a row each; zero for a text without letters."""
    out = np.zeros((len(texts), dim), np.float32)
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    folded = _folds()[codes]
    keep = (folded != 0) | (np.concatenate(([1], folded[:-1])) != 0)
    at = np.flatnonzero(keep)
    folded = folded[at]
    if len(folded) < 3:
        return out
    letters, index = np.unique(folded, return_inverse=True)
    n = len(letters)
    mid = np.flatnonzero(folded[1:-1] != 0) + 1
    doc = np.searchsorted(ends, at[mid], side="right")
    key = (index[mid - 1] * n + index[mid]) * n + index[mid + 1]
    grams, gram = np.unique(key, return_inverse=True) if n**3 > 1 << 22 else _dense_unique(key, n**3)
    base = letter_vectors(letters, dim)
    rolled = [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    for start in range(0, len(grams), BLOCK):
        g = grams[start : start + BLOCK]
        vectors = rolled[0][g // (n * n)] * rolled[1][g // n % n] * rolled[2][g % n]
        lo, hi = np.searchsorted(gram, (start, start + len(g)))
        counts = np.bincount(doc[lo:hi] * len(g) + gram[lo:hi] - start, minlength=len(texts) * len(g))
        out += counts.reshape(len(texts), len(g)).astype(np.float32) @ vectors.astype(np.float32)
    return out


def _dense_unique(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    present = np.zeros(size, bool)
    present[key] = True
    found = np.flatnonzero(present)
    place = np.zeros(size, np.int64)
    place[found] = np.arange(len(found))
    return found, place[key]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def fold_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def fit(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Prototypes from columns (doc_id, text, lang): at most sample_texts a language, each of sample_chars at most."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    rows = common.bounded_sample(usable.select("doc_id", "lang", "text"), "lang", ["doc_id", "text"], sample_texts).select("lang", "text").collect()
    by: dict[str, list[str]] = {}
    for lang, text in sorted(rows):
        by.setdefault(lang, []).append(text)
    langs = sorted(by)
    return langs, unit(np.array([unit(profiles(by[x])).sum(axis=0) for x in langs], np.float32)) if langs else np.zeros((0, DIM), np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns of keep, then lang_pred and score, for every row of docs."""
    langs, prototypes = model

    def score(part):
        texts = [t or "" for t in part.column(text).to_pylist()]
        rows = profiles(texts)
        some = rows.any(axis=1) if langs else np.zeros(len(texts), bool)
        best = np.zeros(len(texts), np.int64)
        cosine = np.zeros(len(texts))
        if some.any():
            cosines = unit(rows[some]) @ prototypes.T
            best[some] = cosines.argmax(axis=1)
            cosine[some] = cosines.max(axis=1).clip(0, 1)
        return {n: part.column(n) for n in keep} | {"lang_pred": [langs[b] if s else "und" for b, s in zip(best, some, strict=True)], "score": cosine}

    return common.map_batches(docs.select(*dict.fromkeys([*keep, text])), score, common.fields(docs, keep, "lang_pred string, score double"), text)
