"""Toxicity by a linear-chain conditional random field over tokens.

Two states (clean, toxic). A token's evidence for the toxic state is the sum of the weights of its features (the
word, its prefixes and its ending); a 2x2 table weighs neighbouring states. Token labels are made from the
document labels: in a toxic document a token is toxic if one of its features is much commoner in toxic than in
clean sample documents. Weights and transitions are fitted by gradient on the conditional likelihood.
Forward-backward marginals give each token's probability; a logistic model over their sum, maximum and density
gives the document's score, and tokens of at least one half are the offending spans.

Defined cases: null and empty texts have no token and get the score of an empty document (the prior for no
evidence); an empty table gives an empty one; a text of any length is scored whole, though only those of SAMPLE_CHARS
at most are learned from; tokens of one half exactly (ties) are offending, as scores of the threshold are; several labels of one document count as their largest; null labels are left out; without labels of both
kinds every score is 0; repeated rows get equal scores; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the training sample: documents of each class, characters a document.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 900, 1800, 20_000
#: A feature is offending evidence if it is in so many toxic sample documents and so much commoner there.
SEED_DOCS, SEED_ODDS = 4, 12.0
STEPS, RATE, DECAY = 40, 0.35, 1e-4
CACHE = 200_000


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"={w}", *(f"^{w[:n]}" for n in (4, 5, 6) if len(w) > n), f"{w[-3:]}$"]


@dataclass
class Chain:
    """Tokens of several texts in time-major order: step t holds the t-th token of each text that is that long."""

    place: np.ndarray  # of each token in text order
    offset: np.ndarray
    active: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chain:
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max(initial=0))
        active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        offset = np.concatenate(([0], np.cumsum(active)))
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        step = np.arange(int(lengths.sum())) - starts
        return cls(offset[step] + np.repeat(rank, lengths), offset, active)

    def marginals(self, evidence: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """P(toxic) of each token in text order; with pairs also the expected count of each pair of states."""
        t00, t01, t10, t11 = np.exp(trans).ravel()
        x = np.empty(len(evidence))
        x[self.place] = np.exp(np.clip(evidence, -30, 30))
        f, b = x.copy(), np.ones(len(x))
        for t in range(1, len(self.active)):
            lo, k, before = self.offset[t], self.active[t], self.offset[t - 1]
            p = f[before : before + k]
            f[lo : lo + k] *= (t01 + t11 * p) / (t00 + t10 * p)
        for t in range(len(self.active) - 2, -1, -1):
            lo, k, after = self.offset[t], self.active[t + 1], self.offset[t + 1]
            n = x[after : after + k] * b[after : after + k]
            b[lo : lo + k] = (t10 + t11 * n) / (t00 + t01 * n)
        odds = f * b
        out = (odds / (1 + odds))[self.place]
        if not pairs:
            return out
        first = self.active[0] if len(self.active) else 0
        step = np.repeat(np.arange(len(self.active)), self.active)[first:]
        prev = self.offset[step - 1] + np.arange(first, len(x)) - self.offset[step]
        n, p = x[first:] * b[first:], f[prev]
        total = t00 + t01 * n + p * (t10 + t11 * n)
        return out, np.array([[(t00 / total).sum(), (t01 * n / total).sum()], [(p * t10 / total).sum(), (p * t11 * n / total).sum()]])


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    head: np.ndarray

    def evidence(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        """known: a bounded memo of words already weighed."""
        get, out = known.get, []
        for w in words:
            s = get(w)
            if s is None:
                if len(known) >= CACHE:
                    known.clear()
                s = known[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
            out.append(s)
        return np.array(out, float)


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text: 1, log(1 + expected toxic tokens), the largest marginal, the square root of their density."""
    starts, some = np.cumsum(lengths) - lengths, lengths > 0
    sums, top = np.zeros(len(lengths)), np.zeros(len(lengths))
    if some.any():  # text by text, so that what stands beside a text changes no digit of its score
        sums[some], top[some] = np.add.reduceat(p, starts[some]), np.maximum.reduceat(p, starts[some])
    return np.stack([np.ones(len(lengths)), np.log1p(np.maximum(sums, 0)), top, np.sqrt(np.maximum(sums, 0) / np.maximum(lengths, 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    at, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        at = at + np.clip(np.linalg.solve(hess, x.T @ (w * (y - p)) - ridge @ at), -4, 4)
    return at


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model | None:
    """A model from labelled texts; weight: how many documents each stands for."""
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    words = [WORD.findall(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    vocabulary: dict[str, int] = {}
    flat = np.array([vocabulary.setdefault(w, len(vocabulary)) for ws in words for w in ws], np.int64)
    names: dict[str, int] = {}
    of = [[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary]
    n_toxic, n_clean = (toxic == 1).sum(), (toxic == 0).sum()
    seen = np.zeros((2, len(names)))
    for ws, y in zip(words, toxic, strict=True):
        for f in {f for w in set(ws) for f in of[vocabulary[w]]}:
            seen[int(y), f] += 1
    odds = ((seen[1] + 0.1) / n_toxic) / ((seen[0] + 0.1) / n_clean)
    seed = (seen[1] >= SEED_DOCS) & (odds >= SEED_ODDS)
    used = np.flatnonzero(seen.sum(axis=0) >= SEED_DOCS)
    column = np.full(len(names) + 1, len(used))
    column[used] = np.arange(len(used))
    width = max((len(x) for x in of), default=1)
    table = column[np.array([x + [len(names)] * (width - len(x)) for x in of], np.int64).reshape(-1, width)]
    offends = np.array([seed[x].any() for x in of], bool)
    doc = np.repeat(np.arange(len(texts)), lengths)
    label = (offends[flat] & (toxic[doc] == 1)).astype(float)
    follows = np.flatnonzero(np.diff(doc, prepend=-1) == 0)
    states = np.array([[((label[follows - 1] == i) & (label[follows] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    chain = Chain.of(lengths)
    at = np.zeros(len(used) + 1 + 5)  # features, one that is never used, bias, transitions
    at[len(used) + 1] = -4.0
    mean, power = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        at[len(used)] = 0
        word_score = at[: len(used) + 1][table].sum(axis=1) + at[len(used) + 1]
        trans = at[len(used) + 2 :].reshape(2, 2)
        p, pairs = chain.marginals(word_score[flat], trans, pairs=True)
        per_word = np.bincount(flat, weights=label - p, minlength=len(vocabulary))
        grad = np.concatenate([np.bincount(table.ravel(), weights=np.repeat(per_word, width), minlength=len(used) + 1), [per_word.sum()], (states - pairs).ravel()]) / len(texts) - DECAY * at
        mean, power = 0.9 * mean + 0.1 * grad, 0.99 * power + 0.01 * grad**2
        at = at + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(at[column[i]]) for f, i in names.items() if column[i] < len(used) and abs(at[column[i]]) > 1e-3}
    model = Model(weights, float(at[len(used) + 1]), at[len(used) + 2 :].reshape(2, 2), np.zeros(4))
    p = chain.marginals(model.evidence([w for ws in words for w in ws], {}), model.trans)
    model.head = logistic(summary(p, lengths), toxic.astype(float), weight / weight.mean())
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model | None:
    """Train on a bounded sample: per class the documents with the smallest hash of doc_id, weighted by class size."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sizes = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = common.bounded_sample(usable, "y", ["doc_id"], 2 * max(sample_toxic, sample_clean))  # so few rows at any size
    joined = docs.filter((F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 0)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = common.bounded_sample(joined, "y", ["doc_id", "text"], max(sample_toxic, sample_clean)).collect()
    rows = sorted(((r.doc_id, r.text, r.y) for r in rows), key=lambda r: (r[2], r[0], r[1]))
    rows = [r for y, most in ((1, sample_toxic), (0, sample_clean)) for r in [x for x in rows if x[2] == y][:most]]
    y = np.array([r[2] for r in rows])
    weight = np.array([sizes[v] / max(1, (y == v).sum()) for v in y])
    return train([r[1] for r in rows], y, weight)


def score(docs: DataFrame, model: Model | None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns of keep, then score, n_toxic (expected toxic tokens) and spans (start:end of tokens at one half or more)."""
    known: dict[str, float] = {}

    def run(part):
        texts = [t or "" for t in part.column(text).to_pylist()]
        kept = {n: part.column(n) for n in keep}
        if model is None:
            return kept | {"score": [0.0] * len(texts), "n_toxic": [0.0] * len(texts), "spans": [""] * len(texts)}
        words = [WORD.findall(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        p = Chain.of(lengths).marginals(model.evidence([w for ws in words for w in ws], known), model.trans)
        about = summary(p, lengths)
        spans, end = [], 0
        for t, n in zip(texts, lengths, strict=True):
            hot, end = np.flatnonzero(p[end : end + n] >= 0.5), end + n
            found = [m.span() for m in WORD.finditer(t)] if len(hot) else []
            spans.append(",".join(f"{found[i][0]}:{found[i][1]}" for i in hot))
        return kept | {"score": 1 / (1 + np.exp(-np.clip((about * model.head).sum(axis=1), -30, 30))), "n_toxic": np.expm1(about[:, 1]), "spans": spans}

    return common.map_batches(docs.select(*dict.fromkeys([*keep, text])), run, common.fields(docs, keep, "score double, n_toxic double, spans string"), text)
