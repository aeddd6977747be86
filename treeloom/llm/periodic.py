"""Periodic runs of words: heavy/light lag counting, then island scans of the lags that have enough matches.

A run of period q repeats a block of q words at least `times` times over `least` words or more, so at lag q that many
words but q equal the word q places on. Matches are counted for all lags of a text at once: those of frequent words by
autocorrelation of their places (FFT, whose counts are rounded and exact), those of rare words by the differences of
their pairs of places. Where a lag has enough matches, and four probes in a row that a long stretch cannot miss, the
text is scanned for the stretches themselves.

Texts are handled where they lie, without a shuffle; several share one pass, and a text that is longer than a pass is
a pass of its own. Counting takes n^1.5 log n steps at most for n words. A scan takes n steps; matches that a run already
accounts for at multiples of its period open no scan, so a long periodic text costs few. A text that one word nearly
fills without making a run can still open a scan for many lags.

Defined cases: null and empty texts have no words and no run; a text of any length counts whole; rows of equal texts
(ties), repeated rows and rows without doc_id are each judged alone; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, map_batches

#: Words of a run at least, and how often its block occurs in it at least.
LEAST, TIMES = 24, 3
#: Differences of pairs that are gathered before they are added up.
GATHERED = 1 << 20
SPAN = "struct<start: bigint, length: bigint, period: bigint>"


def heavy_from(n: int) -> float:
    """Occurrences from which a word of a text of n words is cheaper to count by FFT than by its pairs."""
    size = 1 << (2 * n).bit_length()
    return math.sqrt(size * math.log2(size))


def lag_counts(words: np.ndarray, bounds: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """For texts words[bounds[i]:bounds[i + 1]]: how many words equal the word q places on, and where text i's counts begin.

    The count of lag q of text i stands at begins[i] + q, for q up to a `times`-th of the text.
    """
    sizes = np.diff(bounds)
    most = sizes // times
    begins = np.concatenate(([0], np.cumsum(most + 1)))
    total = np.zeros(begins[-1], np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    often = np.diff(np.append(first, len(key)))
    limits = np.array([heavy_from(int(n)) for n in sizes])
    heavy = often > limits[text[order[first]]]
    spectra: dict[int, np.ndarray] = {}
    for at, n in zip(first[heavy], often[heavy]):
        i = int(text[order[at]])
        size = 1 << int(2 * sizes[i]).bit_length()
        places = np.zeros(size)
        places[order[at : at + n] - bounds[i]] = 1
        found = np.fft.rfft(places)
        found = found.real**2 + found.imag**2
        spectra[i] = spectra[i] + found if i in spectra else found
    for i, spectrum in spectra.items():
        total[begins[i] : begins[i + 1]] += np.rint(np.fft.irfft(spectrum)[: most[i] + 1]).astype(np.int64)
        total[begins[i]] = 0
    left = np.flatnonzero(~np.repeat(heavy, often))
    reach, pairs, held = most[text[order]], [], 0
    for step in count(1):
        left = left[left + step < len(key)]
        gap = order[left + step] - order[left]
        fits = (key[left + step] == key[left]) & (gap <= reach[left])
        left, gap = left[fits], gap[fits]
        pairs.append(begins[text[order[left]]] + gap)
        held += len(gap)
        if held > GATHERED or not len(left):
            total += np.bincount(np.concatenate(pairs), minlength=len(total))
            pairs, held = [], 0
        if not len(left):
            return total, begins


def islands(words: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of places that equal the place `lag` on, of `need` places or more."""
    step = max(1, need // 4)
    probe = words[: len(words) - lag : step] == words[lag::step]
    some = min(4, need // step)
    row = probe[: len(probe) - some + 1].copy()
    for k in range(1, some):
        row &= probe[k : len(probe) - some + 1 + k]
    if not row.any():
        return []
    same = np.zeros(len(words) - lag + 2, np.int8)
    same[1:-1] = words[:-lag] == words[lag:]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= need
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period. A stretch counts for its smallest period only."""
    out: list[dict[tuple[int, int], int]] = [{} for _ in range(len(bounds) - 1)]
    total, begins = lag_counts(words, bounds, times)
    text = np.repeat(np.arange(len(out)), np.diff(begins))
    lag = np.arange(len(total)) - begins[text]
    need = np.maximum(np.maximum(least - lag, (times - 1) * lag), 1)
    for at in np.flatnonzero((lag > 0) & (total >= need)).tolist():
        i, q = int(text[at]), int(lag[at])
        if total[at] < need[at]:
            continue
        for start, end in islands(words[bounds[i] : bounds[i + 1]], q, int(need[at])):
            if (start, length := end - start + q) not in out[i]:  # lags ascend: a smaller period came first
                out[i][start, length] = q
                # at a multiple m of q, half as long at most, this run matches over one stretch, which is no other run
                m = np.arange(2 * q, min(length // 2, begins[i + 1] - begins[i] - 1) + 1, q)
                total[begins[i] + m] -= length - m
    return [sorted((start, length, q) for (start, length), q in found.items()) for found in out]


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int32)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in words), collapsed (the text with one period of each run)."""
    if least < 1 or times < 2:
        raise ValueError("a run has one word or more and repeats its block")

    def judge(batch: pa.RecordBatch) -> dict:
        ids: dict[bytes, int] = defaultdict(count().__next__)
        split = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        sizes = [len(w) for w in split]
        flat = np.fromiter((ids[w] for words in split for w in words), np.int64, sum(sizes))
        runs = runs_of(flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), least, times)
        texts = [b" ".join(compress(w, kept(len(w), r)) if r else w).decode() for w, r in zip(split, runs)]
        spans = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        return {"doc_id": batch.column("doc_id"), "n_words": sizes, "runs": spans, "collapsed": texts}

    return map_batches(docs.select("doc_id", "text"), judge, fields(docs, ["doc_id"], f"n_words bigint, runs array<{SPAN}>, collapsed string"))


def repeated_tail(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a periodic tail planted in a tenth of them, chosen by the checksum of doc_id: of n words, those
    from place a on repeat the p words there. Texts without words, and rows without doc_id, stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10).cast("bigint"))
    some = some.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast((n - a) div p + 1 as int)")))
    edited = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return some.select("doc_id", F.when(F.col("n").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length for its period, compared as a fraction; of equal ones the first."""
    better = lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best)
    return F.aggregate(F.slice(runs, F.lit(2), F.size(runs)), F.get(F.col(runs), F.lit(0)), better)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text, for collapse_runs()."""
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    lines = F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), "")
    found = collapse_runs(docs).select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), strongest().alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
