"""Secret scan: fixed patterns, and probabilistic automata inferred from the credentials that those label.

The values that the patterns find are labelled credentials, by kind; all other tokens of the same alphabet and length
are the counter-examples, with and without a digit. For each label a prefix tree of a bounded sample is folded into a probabilistic automaton by
merging statistically compatible states (Hoeffding bound, red-blue order). Every token from the shortest labelled
length on is a candidate, scored by the log likelihood ratio of the best credential format over the better counter-examples;
one above MARGIN becomes a span of kind `format`, unless it overlaps a base span.

Defined cases: null is an empty text, which has no spans; an empty table gives an empty one; a text of any length is
scanned whole, in time in proportion to it; without labelled credentials no span is added; repeated rows get equal
spans; spans that begin together (ties) stand in the order of KINDS; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "format")
#: Labels of the counter-examples: tokens without and with a digit.
OTHER, NUMBERED = "other", "numbered"
DIGIT = re.compile("[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Bounds of the training sample: distinct values a label, characters a value.
SAMPLE_VALUES, SAMPLE_CHARS = 400, 128
#: Confidence of the merge test; log likelihood ratio from which a candidate is reported.
ALPHA, MARGIN = 0.01, 6.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SYMBOLS = len(ALPHABET) + 2  # the end and one for what was never seen
#: Tokens known to be none that a worker remembers.
MEMO = 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]], wanted: set[str] | None = None) -> Iterator[tuple[int, int]]:
    """Tokens (of a wanted set, where one is given) that overlap no base span, in order."""
    taken: list[list[int]] = []  # base spans as disjoint stretches
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    at = 0
    for m in CANDIDATE.finditer(text):
        if wanted is not None and m[0] not in wanted:
            continue
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            yield m.span()


@dataclass
class State:
    visits: int = 0
    stops: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


def differ(a: int, n: int, b: int, m: int, bound: float) -> bool:
    return n > 0 and m > 0 and abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))


class Automaton:
    """A deterministic probabilistic automaton inferred from strings."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.states = [State()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for value in values:
            self.insert(value)
        self.infer()

    def insert(self, value: str) -> None:
        at = 0
        for c in value:
            s = self.states[at]
            s.visits += 1
            s.counts[c] = s.counts.get(c, 0) + 1
            if c not in s.to:
                s.to[c] = len(self.states)
                self.states.append(State())
            at = s.to[c]
        self.states[at].visits += 1
        self.states[at].stops += 1

    def compatible(self, red: int, blue: int) -> bool:
        """Do both have alike chances of ending and of each symbol, and so on below?"""
        todo = [(red, blue)]
        while todo:
            a, b = (self.states[i] for i in todo.pop())
            if differ(a.stops, a.visits, b.stops, b.visits, self.bound):
                return False
            for c in a.counts.keys() | b.counts.keys():
                if differ(a.counts.get(c, 0), a.visits, b.counts.get(c, 0), b.visits, self.bound):
                    return False
            todo += [(a.to[c], b.to[c]) for c in a.to.keys() & b.to.keys()]
        return True

    def fold(self, red: int, blue: int) -> None:
        """Add the tree under blue to red."""
        todo = [(red, blue)]
        while todo:
            i, j = todo.pop()
            if i == j:
                continue
            a, b = self.states[i], self.states[j]
            a.visits += b.visits
            a.stops += b.stops
            for c, n in b.counts.items():
                a.counts[c] = a.counts.get(c, 0) + n
                if c in a.to:
                    todo.append((a.to[c], b.to[c]))
                else:
                    a.to[c] = b.to[c]

    def infer(self) -> None:
        red, done = [0], {0}
        while True:
            blue = {(i, c): t for i in red for c, t in self.states[i].to.items() if t not in done}
            if not blue:
                break
            parent, symbol = max(blue, key=lambda k: (self.states[blue[k]].visits, -k[0], k[1]))
            b = blue[parent, symbol]
            for r in red:
                if self.compatible(r, b):
                    self.states[parent].to[symbol] = r
                    self.fold(r, b)
                    break
            else:
                red.append(b)
                done.add(b)
        place = {r: i for i, r in enumerate(red)}
        kept = [self.states[r] for r in red]
        for s in kept:
            s.to = {c: place[t] for c, t in s.to.items()}
        self.states = kept

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each state and symbol the log chance and the next state, and for each state the log chance of ending.

        Chances are smoothed by half a visit spread over the alphabet; a symbol that was not seen stays in place.
        """
        unseen = len(ALPHABET)
        to = np.tile(np.arange(len(self.states))[:, None], (1, unseen + 1))
        counts = np.zeros((len(self.states), unseen + 1))
        for i, s in enumerate(self.states):
            for c, n in s.counts.items():
                at = ALPHABET.find(c)
                if at >= 0:
                    counts[i, at], to[i, at] = n, s.to[c]
        visits, stops = (np.array([getattr(s, x) for s in self.states], float) for x in ("visits", "stops"))
        return np.log((counts + 0.5 / SYMBOLS) / (visits[:, None] + 0.5)), to, np.log((stops + 0.5 / SYMBOLS) / (visits + 0.5))

    def log_likelihoods(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of several values, the longest first: their symbols one value after the other, and their lengths."""
        chance, to, ends = self.tables
        starts = np.cumsum(lengths) - lengths
        total, at = np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
        longer = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths.max(initial=0))), side="right")
        for t, k in enumerate(longer.tolist()):
            c = symbols[starts[:k] + t]
            total[:k] += chance[at[:k], c]
            at[:k] = to[at[:k], c]
        return total + ends[at]


def fit(docs: DataFrame, text: str = "text", sample_values: int = SAMPLE_VALUES, sample_chars: int = SAMPLE_CHARS) -> dict[str, Automaton]:
    """An automaton for each label from the sample_values with the smallest hash.

    Texts are read once: each task hands on its own smallest ones, of which the smallest are those of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list[tuple[int, str]]] = {}
        for batch in batches:
            for part in common.steps(batch, text):
                found: dict[str, set[str]] = {}
                for t in part.column(text).to_pylist():
                    if not t:
                        continue
                    base = base_spans(t)
                    for s, k, e in base:
                        found.setdefault(KINDS[k], set()).add(ASSIGN.match(t, s)[2] if k == 0 else t[s:e])
                    tokens = {t[s:e] for s, e in candidates(t, base)} if base else set(CANDIDATE.findall(t))
                    numbered = {x for x in tokens if DIGIT.search(x)}
                    found.setdefault(NUMBERED, set()).update(numbered)
                    found.setdefault(OTHER, set()).update(tokens - numbered)
                for label, values in found.items():
                    held = least.get(label, [])
                    under = held[-1][0] if len(held) == sample_values else 1 << 32
                    more = [(h, v) for v in values if len(v) <= sample_chars and (h := zlib.crc32(v.encode())) <= under]
                    least[label] = sorted({*held, *more})[:sample_values]
            common.give_back()
        rows = [(label, v, h) for label, held in least.items() for h, v in held]
        yield pa.RecordBatch.from_pydict({"label": pa.array([r[0] for r in rows], pa.string()), "value": pa.array([r[1] for r in rows], pa.string()), "hash": pa.array([r[2] for r in rows], pa.int64())})

    found = docs.select(text).mapInArrow(run, "label string, value string, hash bigint")
    # in groups of tasks first, so that no task ranks what all of them hand on
    for groups in (64, 1):
        at = Window.partitionBy("label", F.pmod("hash", F.lit(groups))).orderBy("hash", "value")
        found = found.distinct().withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= sample_values).drop("rank")
    rows = sorted((r.label, r.value) for r in found.collect())
    return {label: Automaton([v for k, v in rows if k == label]) for label in sorted({k for k, _ in rows})}


def ratios(values: list[str], model: dict[str, Automaton]) -> np.ndarray:
    """Log likelihood of the best credential format over that of the better counter-examples, for each value.

    Without counter-examples every symbol is as likely as any other.
    """
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    lengths = np.array([len(values[i]) for i in order], np.int64)
    place = np.full(128, len(ALPHABET))
    place[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    codes = np.frombuffer("".join(values[i] for i in order).encode("utf-32-le"), np.uint32)
    symbols = np.where(codes < 128, place[np.minimum(codes, 127)], len(ALPHABET))
    best = lambda labels: np.max([model[k].log_likelihoods(symbols, lengths) for k in labels if k in model], axis=0, initial=-np.inf)
    other = best((OTHER, NUMBERED)) if OTHER in model or NUMBERED in model else -(lengths + 1) * math.log(SYMBOLS)
    found = np.empty(len(values))
    found[order] = best(KINDS) - other
    return found


class Judge:
    """Which tokens are credentials by their format; a bounded number of those that are not is remembered."""

    def __init__(self, model: dict[str, Automaton], margin: float):
        self.model, self.margin = model, margin
        self.no: set[str] = set()

    def __call__(self, tokens: set[str]) -> set[str]:
        fresh = list(tokens.difference(self.no))
        if not fresh or not any(k in self.model for k in KINDS):
            return set()
        yes = {fresh[i] for i in np.flatnonzero(ratios(fresh, self.model) >= self.margin).tolist()}
        if len(self.no) + len(fresh) > MEMO:
            self.no.clear()
        self.no.update(x for x in fresh if x not in yes)
        return yes


def scan(docs: DataFrame, model: dict[str, Automaton], keep: Sequence[str] = ("doc_id",), text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Columns of keep, then n_assign, n_access, n_hex, n_format, base_sha256, spans (kind:start:end, code points)."""
    counts = [f"n_{k}" for k in KINDS]

    judge = Judge(model, margin)

    def run(part):
        out = {n: part.column(n) for n in keep} | {c: [] for c in [*counts, "base_sha256", "spans"]}
        texts = [t or "" for t in part.column(text).to_pylist()]
        tokens = [CANDIDATE.findall(t) for t in texts]
        yes = judge(set().union(*tokens))
        for t, some in zip(texts, tokens, strict=True):
            base = base_spans(t)
            more = [] if yes.isdisjoint(some) else [(s, 3, e) for s, e in candidates(t, base, yes)]
            every = sorted(base + more)
            line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            out["base_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
            out["spans"].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in every))
            for i, c in enumerate(counts):
                out[c].append(sum(k == i for _, k, _ in every))
        return out

    return common.map_batches(docs.select(*dict.fromkeys([*keep, text])), run, common.fields(docs, keep, f"{', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string"), text)
