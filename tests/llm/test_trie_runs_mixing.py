"""Prefix tries, periodic runs and source mixing against brute force, with the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import mixing, periodic, prefixtrie, running

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    """Every node of the trie of rebuilt conversations, by walking all pairs of nodes."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t, role or "", text or ""))
    tie = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()[:16])
    own = {c: [x[1:] for x in sorted(v, key=tie)] for c, v in turns.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    above = {p[:-1] for p in nodes if p}
    out = set()
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        kids = sum(len(q) == len(p) + 1 for q in under)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids, sum(q not in above for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_turns(rng):
    rows = []
    for c in [*rng.sample(range(-30, 70), 40), None]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]), rng.choice(["hi there", "hi", None, "x\ty z", ""])))
    return rows + rows[:20]


@pytest.mark.parametrize(("block", "heavy"), [(1024, 50_000), (2, 3)])
def test_trie_is_that_of_a_walk_over_all_nodes(spark, monkeypatch, block, heavy):
    """Also where conversations take many blocks, and where common nodes are looked up by broadcast and rare ones not."""
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    monkeypatch.setattr(prefixtrie, "HEAVY", heavy)
    monkeypatch.setattr(prefixtrie, "TOGETHER", 7)
    rows = some_turns(random.Random(block))
    table = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("depth", "copies", "a", "block", "words", "last")})
    got = [tuple(r) for r in prefixtrie.prefix_trie(prefixtrie.rebuilt(table)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    table = spark.createDataFrame([(0, 0, "u", "a b"), (0, 1, "a", "c")] + [(5, None, None, None)] * 3, TURNS)
    assert prefixtrie.prefix_trie(prefixtrie.steps(table.limit(0))).count() == 0
    assert prefixtrie.prefix_trie(prefixtrie.steps(spark.createDataFrame([(None, 1, "u", "x")], TURNS))).count() == 0
    nodes = {(r.conv_id, r.depth): r for r in prefixtrie.prefix_trie(prefixtrie.steps(table)).collect()}
    assert set(nodes) == {(0, 0), (0, 1), (0, 2), (5, 1), (5, 2), (5, 3)}  # equal turns of one conversation are turns each
    assert nodes[0, 0].n_leaves == 2 and nodes[5, 1].parent_conv_id == 0 and nodes[5, 2].parent_conv_id == 5
    long = spark.createDataFrame([(c, t, "u", "same " * 20000 if t == 0 else str(t)) for c in (1, 2) for t in range(3000)], TURNS)
    nodes = {(r.conv_id, r.depth): r for r in prefixtrie.prefix_trie(prefixtrie.steps(long)).collect()}
    assert len(nodes) == 3001 and nodes[1, 0].saved_tokens == 20000 + 2999 and nodes[1, 3000].n_convs == 2


def plain_runs(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def some_words(rng):
    n, letters = rng.choice([0, 1, 5, 23, 24, 30, 60, 200, 500]), rng.choice([1, 2, 3, 10, 50])
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 3 else 0):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        w[a : a + p * rng.randint(2, 8)] = [w[a + i % p] for i in range(len(w[a : a + p * 8]))][: len(w[a : a + p * 8])]
    return w[:n]


@pytest.mark.parametrize("heavy", [None, 3])
def test_runs_are_those_of_a_scan_of_every_lag(monkeypatch, heavy):
    """Whether words are counted by pairs or by FFT."""
    if heavy:
        monkeypatch.setattr(periodic, "heavy_from", lambda n: heavy)
    rng = random.Random(7)
    for least, times in [(24, 3)] * 60 + [(6, 2), (1, 4), (10, 5)] * 10:
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        flat = np.array([x for t in texts for x in t], np.int64)
        total, begins = periodic.lag_counts(flat, bounds, times)
        for i, t in enumerate(texts):
            assert [sum(x == y for x, y in zip(t, t[q:])) for q in range(1, len(t) // times + 1)] == total[begins[i] + 1 : begins[i + 1]].tolist()
        assert periodic.runs_of(flat, bounds, least, times) == [plain_runs(t, least, times) for t in texts]


def test_run_report_plants_and_finds_tails(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 40, 300]))) for i in range(60)}
    texts |= {60: None, 61: "", 62: " \n\t ", 63: "word " * 40000, 64: "x y " * 30 + "  Ä", 65: "one two " * 12, 66: "one two " * 11}
    rows = [*texts.items(), (None, "a b " * 30), (None, "a b " * 30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("runs", "n", "h", "words", "best")})
    got = [tuple(r) for r in periodic.run_report(periodic.repeated_tail(table)).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = [(0, len(w), 1)] if len(w) > 10000 else plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert periodic.run_report(table.limit(0).select("doc_id", "text")).count() == 0
    spans = periodic.collapse_runs(spark.createDataFrame([(1, "a b a b a b c")], "doc_id int, text string"), 6, 3).first()
    assert spans.collapsed == "a b c" and [tuple(r) for r in spans.runs] == [(0, 6, 2)]


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Share all words by weight again and again, each time stopping the sources above their cap."""
    weight = dict(zip(sorted(sizes), weights * len(sizes)))
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in stopped]
        level = (total - sum(stopped.values())) / max(1, sum(weight[s] for s in rest))
        above = {s: repeats * sizes[s] for s in rest if weight[s] * level >= repeats * sizes[s]}
        if not above:
            return stopped | {s: weight[s] * level for s in rest}
        stopped |= above


@pytest.mark.parametrize("hot", [1, 30])
def test_mix_reaches_its_targets(spark, monkeypatch, hot):
    for name, value in (("BUCKET", 8), ("RANKED", 4), ("SPREAD", 3)):
        monkeypatch.setattr(mixing, name, value)
    rng = random.Random(hot)
    sources = ["b", "a", "c", "é", "", None, "tiny", "none"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 50, 400])), s) for i, s in enumerate(rng.choice(sources[:6]) for _ in range(80))]
    rows += [(1000 + i, "x " * rng.choice([3, 90]), "b") for i in range(40 * hot)] + [(5000, "one", "tiny"), (5001, None, "none"), (5002, "", "none"), (None, "p q r", "b")]
    rows += [(6000, "four words of copies", "c")] * 25
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("size", "src", "key", "copies", "start", "slot")})
    got = mixing.mix_report(table, block=64).collect()
    again = mixing.mix_report(table.repartition(7), block=64).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    name = lambda s: "~" if s is None else "=" + s
    sizes, of = defaultdict(int), {}
    for doc_id, text, source in rows:
        sizes[name(source)] += len((text or "").split())
        of[doc_id] = name(source)
    target, taken = plain_targets(sizes), defaultdict(int)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len((t or "").split())) for d, t, _ in rows)
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    assert all(target[s] - 1 < taken[s] <= target[s] for s in sizes) and sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_mix_is_evenly_interleaved_and_lists_what_it_takes(spark):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    pieces = mixing.mix(table, block=100).collect()
    report = {r.doc_id: r.taken for r in mixing.mix_report(table, block=100).collect()}
    taken, order = defaultdict(int), {}
    for p in pieces:
        assert 0 <= p["from"] < p["to"] <= p["size"]
        taken[p.doc_id] += p["to"] - p["from"]
        order.setdefault(p.slot, p.src)
    assert all(taken[d] == n for d, n in report.items())
    slots = [order[s] for s in sorted(order)]
    for n in range(10, len(slots)):  # every beginning of the mix holds each source nearly in proportion
        for src, share in (("=a", 5 / 8), ("=b", 2 / 8), ("=c", 1 / 8)):
            assert abs(slots[:n].count(src) - share * n) < 3


def test_empty_tables_and_running_sums(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    bare = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert {tuple(r) for r in mixing.mix_report(bare).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    rows = spark.range(50).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 7).alias("part"), F.col("id").alias("at"), F.col("id").alias("n"))
    assert all(r.n_before == sum(x for x in range(r["at"]) if x % 2 == r.g) for r in running.before(rows, ["g"], "part", ["at"], ["n"]).collect())
