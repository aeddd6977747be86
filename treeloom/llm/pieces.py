"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three parts are compiled from a model file. The normaliser maps a space to U+2581 and puts one in front. The lexicon
is a trie of pieces, with byte arcs for characters that no piece has. The grammar of a byte-pair model is an
automaton whose state is the last piece: piece q may follow p only if merging p's and q's characters in the order of
the merge table ends at p, q. Weights are of the tropical semiring: an arc costs one for each piece or byte that it
writes, and an arc that the grammar forbids costs infinity; along a path costs add, and where paths meet the least is
kept. Composed with an input, the shortest path is found position by position.

Merging is deterministic, so the prefix of a text has one segmentation that the grammar allows: of the paths that
meet at a position one at most has a finite cost. The shortest path is therefore the library's own segmentation, and
ties can't occur.

Between two characters that stand side by side in no piece every path has a bound, so texts are cut there, and what
was cut is looked up in a bounded memo of two generations before it is composed. Decoding gathers the bytes that the
pieces stand for. Runs of spaces, which merge last, are compiled separately.

Defined cases: null and empty texts have no piece; an empty table gives an empty one; a text of any length is encoded
whole; U+2581 in a text counts as a space and is decoded as one; repeated rows get equal pieces; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units of one generation of the memo.
MEMO = 100_000
INFINITE = np.int64(1) << 40


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + n]
            at += n


class Hashed:
    """A fixed map from non-negative 64-bit keys to 32-bit values, for arrays of keys; -1 where there is none."""

    def __init__(self, found: dict[int, int]):
        keys = np.fromiter(found.keys(), np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        bits = max(4, int(len(found) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def merge(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], int]:
    """Join neighbours, the lowest rank first and then the leftmost; the result, and where the last join was."""
    symbols, last = list(symbols), 0
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (rank.get(symbols[i] + symbols[i + 1], INFINITE), i))
        if symbols[best] + symbols[best + 1] not in rank:
            break
        last = len(symbols[best])
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols, last


class Transducer:
    """Compiled from the bytes of a SentencePiece model of kind BPE with the identity normaliser."""

    def __init__(self, model: bytes):
        self.digest = hashlib.sha256(model).hexdigest()
        self.text: list[str] = []
        score, kind, trainer, normalizer = [], [], {}, {}
        for number, value in wire(model):
            if number == 1:
                piece = dict(wire(value))
                self.text.append(piece.get(1, b"").decode())
                score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kind.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(wire(value))
            elif number == 3:
                normalizer = dict(wire(value))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or USER_DEFINED in kind:
            raise ValueError("only BPE models with the identity normaliser and a space in front can be compiled")
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kind, strict=True)) if k == BYTE}
        self.unknown = kind.index(UNKNOWN)
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kind, strict=True)]
        normal = {t: i for i, (t, k) in enumerate(zip(self.text, kind, strict=True)) if k == NORMAL}
        if any(SPACE in t.lstrip(SPACE) for t in normal) or any(len(t) > 1 and c not in normal for t in normal for c in t):
            raise ValueError("pieces with an inner space, or with characters that are no piece, can't be compiled")
        self.runs = {t: i for t, i in normal.items() if not t.strip(SPACE)}
        # ranks of equal scores are equal: the leftmost is then joined first
        order = {s: r for r, s in enumerate(sorted({score[i] for i in normal.values()}, reverse=True))}
        self.run_rank = {t: order[score[i]] for t, i in self.runs.items() if len(t) > 1}
        self.run_memo: dict[int, tuple[int, ...]] = {}
        words = {t: i for t, i in normal.items() if t.strip(SPACE) or len(t) == 1}
        rank = {t: order[score[i]] for t, i in words.items() if len(t) > 1}
        n = len(self.text)
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        whole = np.zeros(n, bool)
        pairs: dict[int, int] = {}
        edges: dict[int, int] = {}
        final: list[int] = [-1]
        follow: set[int] = set()
        for t, i in words.items():
            if len(t) > 1:
                joined, last = merge(list(t), rank)
                whole[i] = len(joined) == 1
                self.rank[i] = rank[t]
                if whole[i]:
                    self.left[i], self.right[i] = words[t[:last]], words[t[last:]]
                for k in range(1, len(t)):
                    a, b = words.get(t[:k]), words.get(t[k:])
                    follow.add((ord(t[k - 1]) << 21) | ord(t[k]))
                    if a is not None and b is not None:
                        pairs[a * n + b] = int(rank[t])
            else:
                whole[i] = True
            node = 0
            for c in t:
                key = (node << 21) | ord(c)
                if key not in edges:
                    edges[key] = len(final)
                    final.append(-1)
                node = edges[key]
            final[node] = i if whole[i] else -1
        self.n, self.pairs, self.edges, self.follow = n, Hashed(pairs), Hashed(edges), Hashed(dict.fromkeys(follow, 1))
        self.final = np.array(final)
        # every path has a bound between a letter and what follows no letter in any piece: units end there, so that the memo knows more
        letter = "[A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ӿ]"
        joined = {t[i + 1] for t in normal for i in range(len(t) - 1) if re.match(letter, t[i])}
        tails = "".join(c for c in "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~" if c not in joined)
        letters = rf" *{letter}+(?=[{re.escape(tails)}])|" if tails else ""
        self.units = re.compile(letters + " *[^ \n]+| +|\n") if not any("\n" in t for t in normal) else re.compile(letters + " *[^ ]+| +")
        # what each piece stands for: all bytes, and where a piece's begin and how many they are
        self.letters, self.sizes = np.frombuffer(b"".join(self.raw), np.uint8), np.array([len(r) for r in self.raw])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.memo: dict[str, bytes] = {}  # of a unit its ids, as 32-bit integers
        self.older: dict[str, bytes] = {}

    def may_follow(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Is p, q what merging their characters ends at? Joins are undone, the latest first; one over the bound that
        came before the join that was undone last would have been made."""
        out = np.ones(len(p), bool)
        todo, limit = np.arange(len(p)), np.full(len(p), INFINITE)
        while len(todo):
            across = self.pairs(p * self.n + q)
            bad = (across >= 0) & (across < limit)
            out[todo[bad]] = False
            a, b = self.rank[p], self.rank[q]
            go = ~bad & ((a >= 0) | (b >= 0))
            todo, p, q, a, b = todo[go], p[go], q[go], a[go], b[go]
            undo = a > b  # equal ranks join from the left, so the right one is undone first
            limit = np.where(undo, a, b + 1)
            p, q = np.where(undo, self.right[p], p), np.where(undo, q, self.left[q])
        return out

    def compose(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """The shortest path of each of several inputs, which hold no run of spaces: all pieces, where those of each
        input begin, and the pieces of inputs with a character that no piece has."""
        codes = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(u) for u in units])
        ends = np.cumsum(lengths)
        first = np.zeros(len(codes) + 1, bool)
        first[0] = True
        first[ends] = True
        cut = first[:-1].copy()
        cut[1:] |= self.follow((codes[:-1] << 21) | codes[1:]) < 0
        starts = np.flatnonzero(cut)
        stop = np.append(starts[1:], len(codes))[np.cumsum(cut) - 1]  # of each character's piece of text
        offset = np.arange(len(codes)) - starts[np.cumsum(cut) - 1]
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        arcs = []
        width = 0
        while len(at):
            node = self.edges((node << 21) | codes[at + width]).astype(np.int64)
            width += 1
            alive = node >= 0
            at, node = at[alive], node[alive]
            piece = self.final[node]
            ok = piece >= 0
            arcs.append(np.stack([offset[at[ok]] + width, at[ok], at[ok] + width - 1, piece[ok]]))
            alive = at + width < stop[at]
            at, node = at[alive], node[alive]
        step, start, end, piece = np.concatenate(arcs, axis=1) if arcs else np.zeros((4, 0), np.int64)
        order = np.argsort(step, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        last, back = np.full(len(codes), -1), np.arange(len(codes))
        cost = np.full(len(codes), INFINITE)  # of the least path up to and with a character
        bounds = np.searchsorted(step[order], np.arange(1, int(step.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            total = np.where(offset[s] == 0, 0, cost[s - 1]) + 1
            inner = np.flatnonzero((offset[s] > 0) & (total < INFINITE))
            total[inner[~self.may_follow(last[s[inner] - 1], p[inner])]] = INFINITE
            np.minimum.at(cost, e, total)
            least = (total == cost[e]) & (total < INFINITE)
            last[e[least]], back[e[least]] = p[least], s[least]
        passed = np.zeros(len(codes), bool)
        front, floor = (ends - 1)[lengths > 0], (ends - lengths)[lengths > 0]
        while len(front):
            passed[front] = True
            front = back[front] - 1
            inside = front >= floor
            front, floor = front[inside], floor[inside]
        places = np.flatnonzero(passed)
        found = last[places]
        bounds = np.searchsorted(places, np.concatenate(([0], ends)))
        spelt = {}
        for i in np.unique(np.searchsorted(ends, places[found < 0], side="right")).tolist():
            at = range(bounds[i], bounds[i + 1])
            spelt[i] = [x for j in at for x in ([int(found[j])] if found[j] >= 0 else [self.bytes.get(b, self.unknown) for b in chr(codes[places[j]]).encode()])]
        return found, bounds, spelt

    def run(self, n: int) -> tuple[int, ...]:
        """Pieces of n spaces in a row."""
        if n not in self.run_memo:
            if len(self.run_memo) > 1000:
                self.run_memo.clear()
            if n <= 64:
                self.run_memo[n] = tuple(self.runs[t] for t in merge([SPACE] * n, self.run_rank)[0])
            else:
                self.run_memo[n] = tuple(self.runs[t] for t in fold_run(n, self.run_rank))
        return self.run_memo[n]

    def learn(self, units: set[str]) -> None:
        """Put units into the memo."""
        if len(self.memo) + len(units) > MEMO:
            self.memo, self.older = {}, self.memo
        fresh = []
        for u in units:
            if (known := self.older.get(u)) is None:
                fresh.append(u)
            else:
                self.memo[u] = known
        bare = [u for u in fresh if u[:1] != " " or (u[1:2] != " " and len(u) > 1)]
        self.learn_words(bare, bare)
        if len(bare) < len(fresh):
            self.learn_spaced([u for u in fresh if u[:1] == " " and (u[1:2] == " " or len(u) == 1)])

    def learn_words(self, units: list[str], words: list[str]) -> None:
        """Put units into the memo with the paths of words, which have one space at most."""
        if not words:
            return
        found, bounds, spelt = self.compose(words)
        flat, bounds = found.astype("<i4").tobytes(), (4 * bounds).tolist()
        self.memo.update(zip(units, map(flat.__getitem__, map(slice, bounds, bounds[1:])), strict=True))
        for i, path in spelt.items():
            self.remember(units[i], path)

    def learn_spaced(self, units: list[str]) -> None:
        """Put units into the memo that begin with several spaces, or have nothing else: only the last can join a word."""
        words = [u for u in units if u.strip(" ")]
        self.learn_words(words, [" " + u.lstrip(" ") for u in words])
        for u in units:
            n = len(u) - len(u.lstrip(" "))
            if n == len(u):
                self.remember(u, self.run(n))
            else:
                path = np.frombuffer(self.memo[u], "<i4").tolist()
                self.remember(u, [*self.run(n), *path[1:]] if path[0] == self.runs[SPACE] else [*self.run(n - 1), *path])

    def remember(self, unit: str, path: Sequence[int]) -> None:
        self.memo[unit] = struct.pack(f"<{len(path)}i", *path)

    def translate(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin."""
        cut = [self.units.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        units = set().union(*cut)
        fresh = units.difference(self.memo)
        # a new generation begins where these don't fit, and then all of them must be in it
        self.learn(fresh if len(self.memo) + len(fresh) <= MEMO else units)
        ids = [b"".join(map(self.memo.__getitem__, us)) for us in cut]
        return np.frombuffer(b"".join(ids), "<i4"), np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids])))

    def restore(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Of each text the bytes that its ids stand for, without the space in front."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.arange(int(sizes.sum())) - np.repeat(ends - sizes - self.begins[ids], sizes)
        data, cuts = self.letters[places].tobytes(), np.concatenate(([0], ends))[bounds].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, bounds = self.translate(texts)
        return [x.tolist() for x in np.split(ids, bounds[1:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    @cached_property
    def size(self) -> int:
        return len(self.text)


def fold_run(n: int, rank: dict[str, int]) -> list[str]:
    """Joining a long run: pairs of equal symbols from the left, again and again, as merge() does one by one."""
    import heapq

    text, following, before = [SPACE] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank.get(SPACE * 2, INFINITE), i, 1, 1) for i in range(n - 1) if SPACE * 2 in rank]
    alive = [True] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = following[i] if alive[i] else n
        if not alive[i] or j >= n or len(text[i]) != a or len(text[j]) != b:
            continue
        text[i] += text[j]
        alive[j] = False
        following[i] = following[j]
        if following[i] < n:
            before[following[i]] = i
        for x in (before[i], i):
            if x >= 0 and following[x] < n and text[x] + text[following[x]] in rank:
                heapq.heappush(heap, (rank[text[x] + text[following[x]]], x, len(text[x]), len(text[following[x]])))
    return [t for t, a in zip(text, alive, strict=True) if a]


_COMPILED: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """Once for each worker process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 and round_trip (is the decoded text the given one?) for each row.

    model: the bytes of the model file, read where the query is planned and carried to the workers (about 0.5 MB).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(part):
        texts = [t or "" for t in part.column(text).to_pylist()]
        fst = compiled(shipped.value)
        flat, offsets = fst.translate(texts)
        decoded = fst.restore(flat, offsets)
        return {
            "doc_id": part.column("doc_id"),
            "n_tokens": np.diff(offsets),
            "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), type=pa.list_(pa.field("element", pa.int32()))),
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
            "round_trip": [a.encode() == b for a, b in zip(texts, decoded, strict=True)],
        }

    return common.map_batches(docs.select(*dict.fromkeys(["doc_id", text])), run, common.fields(docs, ["doc_id"], "n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean"), text)
