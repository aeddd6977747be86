"""Operators on small graphs and texts, with results worked out by hand or by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from treeloom.functions import rank, text, tokens
from treeloom.operators import cut, diff, goto, layout, lineops, search, testcode, tree, view
from treeloom.plans import corpus, trees
from treeloom.sources import generations, names, occurrences, scan
from treeloom.streaming import live

COLUMNS = "id bigint, kind string, name string, parent bigint, ord bigint, path string, line_start int, line_end int, is_test boolean"


def entities(spark, rows):
    """rows: (kind, name, parent[, start, end, is_test]); the index is the id."""
    out, paths = [], []
    for i, (kind, name, parent, *more) in enumerate(rows):
        start, end, test = (*more, 0, 0, False)[:3] if len(more) >= 2 else (0, 0, more[0] if more else False)
        paths.append(name if parent is None else f"{paths[parent]}/{name}")
        out.append((i, kind, name, parent, i, paths[-1], start, end, bool(test)))
    return spark.createDataFrame(out, COLUMNS)


def refs(spark, rows):
    return spark.createDataFrame([(i, s, d, k, list(sites[0]) if sites else []) for i, (s, d, k, *sites) in enumerate(rows)], "ref_id bigint, src bigint, dst bigint, kind string, sites array<int>")


def leaves(df):
    return {r.leaf for r in df.collect()}


@pytest.fixture(scope="module")
def shop(spark):
    """Two departments; the references run between rows drawn from a seed."""
    rows = [("folder", "shop", None), ("folder", "sales", 0), ("folder", "stock", 0), ("file", "till.py", 1), ("file", "offer.py", 1), ("file", "shelf.py", 2)]
    rows += [("function", f"do{i}", 3 + i % 3) for i in range(9)]
    rng = random.Random(31)
    found = sorted({(rng.randint(3, 14), rng.randint(3, 14), rng.choice(["call", "import"])) for _ in range(40)})
    found = [r for r in found if r[0] != r[1]]
    graph = entities(spark, rows)
    return rows, found, graph, tree.closure(graph), refs(spark, found)


def landed(rows, found, at):
    """What a cut shows, by walking up from both ends of each reference."""
    parents = [p for _, _, p, *_ in rows]
    shown = set(at)
    for leaf in at:
        while (leaf := parents[leaf]) is not None:
            shown.add(leaf)

    def site(i):
        while i is not None and i not in shown:
            i = parents[i]
        return i

    out = {}
    for n, (a, b, kind) in enumerate(found):
        ends = site(a), site(b)
        if None not in ends and ends[0] != ends[1]:
            out.setdefault((*ends, kind), []).append(n)
    return sorted((*k, v) for k, v in out.items())


def test_expansion_shows_references_where_they_land(shop):
    rows, found, graph, up, all_refs = shop
    seen = lambda at: sorted((r.src, r.dst, r.kind, r.refs) for r in cut.coalesce(all_refs, at, up).collect())
    at, expected = cut.initial(graph), {0}
    for leaf in (0, 2, 1, 4):
        assert leaves(at) == expected and seen(at) == landed(rows, found, expected)
        at = generations.written(cut.expand(at, graph, leaf))
        expected = expected - {leaf} | {i for i, r in enumerate(rows) if r[2] == leaf}
    assert leaves(at) == expected and seen(at) == landed(rows, found, expected)
    assert leaves(cut.collapse(at, graph, up, 3)) == {1, 5}
    assert leaves(cut.expand(at, graph, 14)) == expected
    assert leaves(cut.reveal(cut.initial(graph), graph, up, 6)) == {2, 4, 6, 9, 12}


def test_closure_of_known_and_unknown_depth(shop):
    rows, _, graph, up, _ = shop
    expected = set()
    for i in range(len(rows)):
        at, hops = i, 0
        while at is not None:
            expected.add((i, at, hops))
            at, hops = rows[at][2], hops + 1
    for known in (None, 3, 5):
        assert {(r.id, r.anc, r.hops) for r in tree.closure(graph, known).collect()} == expected
    assert {(r.id, r.anc, r.hops) for r in tree.closure(graph, 1).collect()} == {x for x in expected if x[2] < 2}


def test_cut_migration_coarsens_what_is_gone(spark):
    old = entities(spark, [("folder", "r", None), ("file", "a", 0), ("file", "b", 0), ("function", "f", 1), ("function", "g", 1), ("function", "h", 2)])
    new = entities(spark, [("folder", "r", None), ("file", "b", 0), ("file", "a", 0), ("function", "f", 2), ("function", "h", 1)])
    old_up, new_up = tree.closure(old), tree.closure(new)
    matches = cut.id_map(old, new)
    assert {(r.old_id, r.new_id) for r in matches.collect()} == {(0, 0), (1, 2), (2, 1), (3, 3), (4, None), (5, 4)}
    at = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "leaf bigint, pos bigint")
    assert leaves(cut.migrate(at(3, 4, 2), old_up, matches, new, new_up)) == {3, 1}
    assert leaves(cut.migrate(at(4), old_up, matches, new, new_up)) == {1, 2}
    steps = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 2), (1, 3, None), (2, 0, None), (2, 1, 2), (2, 2, 0)], "generation int, old_id bigint, new_id bigint")
    assert {(r.old_id, r.new_id) for r in cut.compose(steps, 0, 2).collect()} == {(0, 2), (1, None), (2, 0), (3, None)}
    assert cut.compose(steps, 0, 20).count() == 0


def test_innermost_includes_both_ends_and_skips_what_has_no_lines(spark):
    graph = entities(spark, [("folder", "p", None), ("file", "lib.rs", 0, 0, 40), ("class", "W", 1, 5, 20), ("function", "d", 2, 8, 12), ("function", "h", 1, 30, 35), ("function", "n", 1, 0, 0)])
    points = spark.createDataFrame([(1, x) for x in (0, 9, 12, 13, 30, 36)], "file_id bigint, line int")
    got = {r.line: r.id for r in tree.innermost(graph, tree.closure(graph), points).collect()}
    assert got == {0: 1, 9: 3, 12: 3, 13: 2, 30: 4, 36: 1}


def brute_loc(rows, skip):
    kids = {i: [j for j, r in enumerate(rows) if r[2] == i] for i in range(len(rows))}
    out = {}
    for i in reversed(range(len(rows))):
        live_ = [c for c in kids[i] if skip(i) or not skip(c)]
        _, _, _, start, end, test = rows[i]
        own = end - start + 1 if (start, end) != (0, 0) else sum(out[c][0] for c in live_)
        out[i] = (own, own if test else sum(out[c][1] for c in live_))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sizes_agree_with_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [("folder", "r", None, 0, 0, False)]
    for i in range(1, 40):
        lo = rng.randint(0, 9)
        rows.append(("class", f"n{i}", rng.randrange(i), *((lo, lo + rng.randint(0, 5)) if rng.random() < 0.5 else (0, 0)), rng.random() < 0.2))
    graph = entities(spark, rows)
    skip = lambda i: i % 3 == 1
    got = {r.id: (r.loc, r.test_loc) for r in tree.loc(graph, tree.closure(graph), F.col("id") % 3 == 1).collect()}
    assert got == brute_loc(rows, skip)


def test_dense_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 500,) for i in range(500)], "x int")
    assert {(r.x, r.n) for r in tree.dense_ids(rows, "x", name="n").collect()} == {(i, i) for i in range(500)}


def test_test_code_by_name_attribute_and_inheritance(spark):
    rows = [("folder", "p", None), ("folder", "tests", 0), ("file", "it.rs", 1), ("file", "lib.rs", 0), ("module", "tests", 3), ("function", "a", 3, 4, 6), ("function", "b", 3, 9, 10), ("file", "x.py", 0), ("function", "test_q", 7), ("class", "TestC", 7), ("function", "in_tests", 4)]
    graph = entities(spark, rows)
    lines = spark.createDataFrame([(3, i, t) for i, t in enumerate(["", "/// doc", "#[tokio::test]", "// more", "fn a() {", "", "}", "", '#[serde(rename = "test")]', "fn b() {", "}"])], "file_id bigint, line int, text string")
    got = {r.id for r in testcode.mark(graph, tree.closure(graph), lines).collect() if r.is_test}
    assert got == {1, 2, 4, 5, 8, 9, 10}
    names_ = spark.createDataFrame([("conftest.py",), ("a_test.go",), ("b.spec.tsx",), ("c_tests.rs",), ("latest.rs",), ("test",)], "n string")
    assert [r[0] for r in names_.select(testcode.test_file_name(F.col("n"))).collect()] == [True, True, True, True, False, False]
    marks = spark.createDataFrame([("#[cfg(test)]",), ("#[cfg(not(test))]",), ("@pytest.fixture",), ('#[x("test")]',), ("#[cfg_attr(test, y)]",)], "t string")
    assert [r[0] for r in marks.select(testcode.marks_test(F.col("t"))).collect()] == [True, False, True, False, False]


def test_query_terms():
    terms, context = text.tokenize('class FILE:resolver content:"fn respond" "file:x" path: context:3 context:many')
    assert [(t.tag, t.needle) for t in terms] == [(None, "class"), ("file", "resolver"), ("content", "fn respond"), (None, "file:x"), (None, "context:many")] and context == 3
    assert text.percent_decode("a%20b+c%4") == "a b c%4"


def test_folding_lines_and_spans(spark):
    df = spark.createDataFrame([("İX Größe",), ("a\r\nb\n\n",), ("",), ("😀 Foo",)], "t string")
    got = df.select(text.fold(F.col("t")).alias("f"), text.lines(F.col("t")).alias("l"), F.array(*text.utf16_span(F.col("t"), F.lit(2), F.lit(5))).alias("u"), F.array(*text.byte_span(F.col("t"), F.lit(2), F.lit(3))).alias("b")).collect()
    assert [r.f for r in got] == ["ix größe", "a\r\nb\n\n", "", "😀 foo"]
    assert [r.l for r in got[1:3]] == [["a", "b", ""], []]
    assert got[3].u == [3, 6] and got[3].b == [5, 8]


def test_search_ranks_limits_suppresses_and_excerpts(spark):
    rows = [(1, "main.rs", "src/main.rs", "\n".join(["fn main() {", "x", "main main"] + ["pad"] * 7 + ["main"])), (2, "lib.rs", "main/lib.rs", "nothing"), (3, "gone.rs", "gone.rs", None)]
    ix = search.index(spark.createDataFrame(rows, "file_id bigint, name string, path string, text string"))
    found, _ = search.hits(ix, "main", search.Limits(content=2))
    got = [(r.kind, r.pos, r.file_id, r.line, r.start, r.more) for r in found.orderBy("kind", "pos").collect()]
    assert got == [("content", 1, 1, 0, 3, 1), ("content", 2, 1, 2, 0, 1), ("file", 1, 1, None, 0, 0), ("path", 1, 2, None, 0, 0)]
    every, _ = search.hits(ix, "content:main")
    runs = [(r.first_line, len(r.text), len(r.matched)) for r in search.excerpts(ix, every, 1).orderBy("first_line").collect()]
    assert runs == [(0, 4, 2), (9, 2, 1)]
    assert search.hits(ix, "  ")[0] is None
    assert {(r.gram, r.doc.line) for r in search.grams(ix.docs["content"].filter("file_id = 1")).collect()} == {(t[i : i + 3], n) for n, t in enumerate(rows[0][3].split("\n")) for i in range(len(t) - 2)}
    short = search.shortlist(ix.docs["content"], search.grams(ix.docs["content"]), "main")
    assert {r.line for r in short.select("line").collect()} == {0, 2, 10}


def test_tokens(spark):
    assert [tokens.token_at("let é = foo.bar", c) for c in (0, 3, 4, 9, 12, 99)] == ["let", "let", "é", "foo", "foo", "bar"]
    assert tokens.token_at("a  b", 2) is None
    df = spark.createDataFrame([("x focused", "focus"), ("(focus)", "focus"), ("a.b", "."), ("", "")], "t string, n string")
    assert [r[0] for r in df.select(tokens.has_token(F.col("t"), F.col("n"))).collect()] == [False, True, False, False]


def test_goto_prefers_the_named_target(spark):
    graph = entities(spark, [("folder", "p", None), ("file", "a.rs", 0), ("function", "focus", 1), ("function", "focused", 1), ("file", "b.rs", 0), ("function", "caller", 4)])
    all_refs = refs(spark, [(5, 2, "call", [7]), (5, 3, "call", [7]), (5, 1, "import", [7])])
    up = tree.closure(graph)
    asked = spark.createDataFrame([(1, 4, 7, "focus(focused())", "focus"), (2, 4, 7, "focus(focused())", "other"), (3, 1, 7, "focus", "focus")], "ask int, file_id bigint, line int, text string, token string")
    got = {(r.ask, r.dst) for r in goto.targets(asked, goto.sited(graph, up, all_refs)).collect()}
    assert got == {(1, 2), (2, 1)}


def test_all_references_are_asked_and_suppressed(spark):
    at = "/root/testdata/sf0.001"
    rows, _ = trees.graph(spark, at)
    nodes = {r.id: r for r in rows.select("id", "kind", "name", "parent").collect()}
    found = [(r.ref_id, r.src, r.dst, r.kind, list(r.sites)) for r in trees.refs(spark, at).collect()]

    def above(i):
        while i is not None:
            yield i
            i = nodes[i].parent

    file_of = lambda i: next((a for a in above(i) if nodes[a].kind == "file"), None)
    on, asks = {}, set()
    for ref, src, dst, kind, lines in found:
        for line in lines if file_of(src) is not None else []:
            on.setdefault((file_of(src), line), []).append((ref, dst))
            if kind in ("call", "type_ref", "import"):
                asks.add((src, file_of(src), line, nodes[dst].name))
    for query, named in ((corpus.goto_named, True), (corpus.goto_alias, False)):
        expected = {}
        for src, file, line, token in asks:
            for ref, dst in on[file, line]:
                if not named or nodes[dst].name == token:
                    expected[src, dst] = min(ref, expected.get((src, dst), ref))
        got = [(r.ask, r.dst, r.first_ref) for r in query(spark, at).collect()]
        assert any(src % 7 for src, _ in expected) and sorted(got) == sorted((*k, v) for k, v in expected.items())
    hits = {(src, lines[0] if lines else None, d) for _, src, dst, _, lines in found for d in (dst, nodes[dst].parent)}
    outer = {(src, line, a) for src, line, dst in hits for a in list(above(dst))[1:]}
    got = [(r.src, r.line, r.dst) for r in corpus.outer_suppress(spark, at).collect()]
    assert len(got) == len(set(got)) and set(got) == hits - outer


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + 2 * (x != y)))
    return row[-1]


def test_line_operations_rebuild_and_are_shortest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (["".join(rng.choice("xyz")) + "\n" for _ in range(rng.randint(0, 9))] for _ in range(2))
        ops = lineops.line_ops("".join(a), "".join(b))
        assert [x for t, _, _, s, n in ops if t != "delete" for x in b[s : s + n]] == b
        assert [x for t, s, n, _, _ in ops if t != "insert" for x in a[s : s + n]] == a
        assert all(a[s : s + n] == b[p : p + n] for t, s, n, p, _ in ops if t == "equal")
        assert sum(n + m for t, _, n, _, m in ops if t != "equal") == brute_distance(a, b)
    assert lineops.line_ops("a\nb\nc\nd\ne", "a\nb\nc\nnew\nd\ne") == [("equal", 0, 3, 0, 3), ("insert", 3, 0, 3, 1), ("equal", 3, 2, 4, 2)]


def test_union_statuses_and_churn(spark):
    old = entities(spark, [("folder", "r", None), ("file", "a", 0, 0, 3), ("function", "f", 1, 0, 1), ("function", "g", 1, 2, 3), ("file", "gone", 0, 0, 1)])
    new = entities(spark, [("folder", "r", None), ("file", "a", 0, 0, 4), ("function", "f", 1, 0, 1), ("function", "g", 1, 2, 4), ("file", "new", 0, 0, 1)])
    diff.check_roots(old, new)
    both = diff.union(old, tree.closure(old), new, tree.closure(new))
    at = {(r.id, r.name, r.parent) for r in both.collect()}
    assert at == {(0, "r", None), (1, "a", 0), (2, "f", 1), (3, "g", 1), (4, "new", 0), (5, "gone", 0)}
    pairs = spark.createDataFrame([(1, "1\n2\n3\n4", "1\n2\n3\nx\n4"), (4, None, "p\nq"), (5, "p\nq", None)], "file_id bigint, old_text string, new_text string")
    work = diff.file_work(pairs)
    files = work.select(F.col("file_id").alias("id"), "status").join(diff.whole_churn(work).withColumnRenamed("file_id", "id"), "id")
    spans = spark.createDataFrame([(2, 1, s, 0, 1) for s in ("old", "new")] + [(3, 1, "old", 2, 3), (3, 1, "new", 2, 4)], "id bigint, file_id bigint, side string, first int, last int")
    got = {r.id: (r.status, r.added, r.removed) for r in diff.settle(both, tree.closure(both), files, diff.churn(work, spans)).collect()}
    assert got == {0: ("modified", 3, 2), 1: ("modified", 1, 0), 2: ("same", 0, 0), 3: ("modified", 1, 0), 4: ("added", 2, 0), 5: ("removed", 0, 2)}
    with pytest.raises(ValueError):
        diff.check_roots(old, entities(spark, [("folder", "other", None)]))


def test_bundling_levels(spark):
    graph = entities(spark, [("folder", "r", None), ("folder", "x", 0), ("folder", "y", 0), ("file", "x1", 1), ("file", "y1", 2), ("function", "fx", 3), ("function", "fy", 4)])
    up = tree.closure(graph)
    edge = spark.createDataFrame([(5, 6, "call")], "src bigint, dst bigint, kind string")
    boxes = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    at = lambda levels: [(r.src, r.dst) for r in view.bundle(edge, boxes, up, levels).collect()]
    assert at({}) == [(1, 2)]
    assert at({1: (0, 1, 0)}) == [(3, 2)]
    assert at({2: (2, 0, 0)}) == [(1, 6)]
    assert at({0: (0, 0, 1)}) == [(3, 4)]
    assert at({3: (0, 1, 0)}) == [(5, 2)]


def test_layers_ranks_and_geometry(spark):
    assert layout.back_edges(3, [(0, 1), (1, 2), (2, 0)]) == {2}
    assert layout.layers(4, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)]) == [[0], [1, 2], [3]]
    assert rank.between(None, None) == [1] and rank.between([1], [2]) == [1, 5] and [1] < rank.between([1], [1, 1]) < [1, 1]
    assert rank.nth(0) == [1] and rank.between([3], None) == [4]
    rng = random.Random(2)
    for _ in range(300):
        low, high = sorted([rng.randint(0, 12) for _ in range(rng.randint(1, 4))] + [1] for _ in range(2))
        if low != high:
            assert low < rank.between(low, high) < high
    assert layout.settle([7, 8, 9], {7: [1], 9: [2]})[8] == [1, 5]
    apart = layout.separate([[0, 0, 4, 2], [2, 0, 4, 2]], [False, False], [0, 1], (1, 1))
    assert apart[1][0] - apart[0][0] >= 5
    many = [[rng.randint(0, 20), rng.randint(0, 9), rng.randint(1, 5), rng.randint(1, 3)] for _ in range(12)]
    clear = layout.separate(many, [i == 0 for i in range(12)], list(range(12)), (1, 1), 2000)
    assert clear[0] == many[0] and all(a[0] + a[2] + 1 <= b[0] or b[0] + b[2] + 1 <= a[0] or a[1] + a[3] + 1 <= b[1] or b[1] + b[3] + 1 <= a[1] for i, a in enumerate(clear) for b in clear[:i])
    nodes = spark.createDataFrame([(1, 0, 0, 0, 4, 2, False, 1), (2, 0, 10, 0, 4, 2, False, 1), (3, 0, 0, 6, 4, 2, False, 1), (0, None, -2, -2, 30, 20, True, 0)], "id bigint, level bigint, x int, y int, w int, h int, is_box boolean, depth int").withColumn("ord", F.col("id"))
    assert {(r.id, r.next) for r in layout.nearest(nodes, (1, 0)).collect()} >= {(1, 2)}
    assert {(r.id, r.next) for r in layout.nearest(nodes, (0, 1)).collect()} == {(1, 3), (2, 3)}
    points = spark.createDataFrame([(1, 1, 1), (2, -2, 0)], "point int, px int, py int")
    assert [(r.point, r.id) for r in layout.leaf_at(nodes, points).collect()] == [(1, 1)]
    assert [(r.point, r.id) for r in layout.handle_at(nodes, points).collect()] == [(2, 0)]


def test_points_of_one_place_and_equal_rectangles_meet_once(spark, monkeypatch):
    rng = random.Random(5)
    nodes = [(i, rng.randint(-9, 30), rng.randint(-9, 30), rng.choice([0, 1, 2, 3, 40]), rng.choice([1, 2, 70]), rng.random() < 0.5, i) for i in range(120)]
    nodes += [(200 + i, *nodes[i][1:6], 200 + i) for i in range(60)]
    points = [(i, rng.randint(-10, 40), rng.randint(-10, 40)) for i in range(300)] + [(1000 + i, 3, 4) for i in range(5000)]
    met = []
    monkeypatch.setattr(layout, "_meet", lambda n, p, f=layout._meet: (met.append((n.count(), p.count())), f(n, p))[1])
    rows = spark.createDataFrame(nodes, "id int, x int, y int, w int, h int, is_box boolean, depth int")
    asked = spark.createDataFrame(points, "point int, px int, py int")
    inside = lambda n, px, py, b=0: n[1] + b <= px < n[1] + n[3] - b and n[2] + b <= py < n[2] + n[4] - b
    leaf = {p: min(f) for p, x, y in points if (f := [n[0] for n in nodes if not n[5] and inside(n, x, y)])}
    handle = {p: max(f)[1] for p, x, y in points if (f := [(n[6], n[0]) for n in nodes if n[5] and inside(n, x, y) and not inside(n, x, y, 1)])}
    assert {r.point: r.id for r in layout.leaf_at(rows, asked).collect()} == leaf
    assert {r.point: r.id for r in layout.handle_at(rows, asked).collect()} == handle
    assert all(n <= 120 and p <= 301 for n, p in met) and len(met) == 2


def test_ids_of_a_written_table_are_not_broadcast_by_the_size_of_their_file(spark):
    ids = generations.written(spark.range(1_000_000))
    joined = spark.range(2_000_000).join(ids, "id")
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString() and joined.count() == 1_000_000


def test_walks_hand_down_without_a_shuffle_for_each_ancestor(spark, shop):
    rows, _, graph, up, _ = shop
    chain = lambda i: [] if i is None else [*chain(rows[i][2]), i]
    found = tree.with_paths(graph, up)
    assert {r.id: r.path for r in found.collect()} == {i: "/".join(rows[j][1] for j in chain(i)) for i in range(len(rows))}
    assert {r.id: r.key for r in tree.order_key(graph, up).collect()} == {i: chain(i) for i in range(len(rows))}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    old, new = (spark.createDataFrame(x, "id bigint, kind string, path string") for x in ([(1, "file", "a"), (2, "file", "a"), (3, None, "a")], [(7, "file", "a"), (8, None, "a")]))
    assert {tuple(r) for r in cut.id_map(old, new).collect()} == {(1, 7), (2, None), (3, None)}


def test_names_resolve_to_the_first_and_lift(spark):
    nodes = spark.createDataFrame([(0, None, "folder", "p"), (1, 0, "file", "mod.rs"), (2, 1, "module", "geo"), (3, 0, "file", "m.rs"), (4, 3, "function", "main"), (5, 4, "block", "b"), (6, 3, "function", "compute"), (7, 0, "file", "n.rs"), (8, 7, "function", "compute")], "node_id bigint, parent bigint, kind string, name string")
    raw = spark.createDataFrame([(5, "compute", "call", 3), (5, "compute", "call", 1), (4, "len", "call", 1), (6, "compute", "call", 9)], "src bigint, name string, kind string, line int")
    up = tree.closure(nodes.select(F.col("node_id").alias("id"), "parent"))
    assert {r.node_id for r in names.glue(nodes).collect()} == {1, 2}
    kept = names.select_entities(nodes, up)
    assert {(r.node_id, r.up) for r in kept.collect()} == {(0, None), (3, 0), (4, 3), (6, 3), (7, 0), (8, 7)}
    found = names.resolve(names.without_trivial(raw), names.name_table(nodes))
    out = names.dedup(names.lift_refs(found, up, kept, names.glue(nodes))).collect()
    assert [(r.src, r.dst, r.kind, r.sites) for r in out] == [(4, 6, "call", [1, 3])]


def test_symbols_and_dialects(spark):
    s = occurrences.parse_symbol("rust-analyzer cargo demo 0.1.0 geo/impl#[`Labels<'a>`][Show]draw().")
    assert str(s) == "rust-analyzer cargo demo 0.1.0 geo/impl#[`Labels<'a>`][Show]draw()."
    assert str(occurrences.Rust().parent(s)).endswith("geo/Labels#") and occurrences.entity_kind(s, "") == "function"
    assert occurrences.parse_symbol("local 3") is None and occurrences.parse_symbol("a b c d x/y#") is not None
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["import (", '  "a"', ")", 'import "b"', "importer()"])], "file_id bigint, line int, text string")
    got = {r.line: r["import"] for r in occurrences.Go().imports(lines).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}
    assert occurrences.byte_column("a😀b", 3, "utf16") == 5 and occurrences.byte_column("a😀b", 2, "utf32") == 5 and occurrences.byte_column("ab", 9, "utf8") == 2


def test_occurrences_become_references(spark):
    p = "t m p 1 "
    occ = spark.createDataFrame([(0, 0, p + "a/", [0, 0, 0], 1, []), (0, 1, p + "a/f().", [1, 3, 4], 1, [1, 0, 5, 1]), (0, 2, p + "a/f().", [3, 0, 1], 0, []), (1, 0, p + "b/", [0, 0, 0], 1, []), (1, 1, p + "b/g().", [2, 3, 4], 1, [2, 0, 4, 1]), (1, 2, p + "a/f().", [3, 2, 3], 0, []), (1, 3, p + "a/", [0, 4, 5], 0, [])], "doc int, occ int, symbol string, range array<int>, roles int, enclosing_range array<int>")
    kinds = spark.createDataFrame([], "doc int, symbol string, kind string, display_name string, enclosing_symbol string")
    symbols = occurrences.parsed(occ, kinds, "other")
    defs = occurrences.definitions(occ, kinds, symbols)
    files = spark.createDataFrame([(0, "a.x", ""), (1, "b.x", "")], "doc int, file_key string, folder_key string")
    found = occurrences.uses(occ, kinds, symbols, defs, files, spark.createDataFrame([(1, 0)], "doc int, line int"))
    assert {(r.src_key, r.dst_key, r.kind, r.line) for r in found.collect()} == {(p + "b/g().", p + "a/f().", "call", 3), ("b.x", "a.x", "import", 0)}
    assert {(r.canonical, r.parent_key) for r in occurrences.parents(defs, files.select("doc", "file_key")).collect()} == {(p + "a/f().", "a.x"), (p + "b/g().", "b.x")}


def test_scan_and_serving(spark, tmp_path):
    for path, data in {"src/a.rs": b"fn a() {}", "target/x.rs": b"", ".git/c": b"", "b.bin": b"\xff\xfe"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    files = scan.directory(spark, str(tmp_path))
    assert {(r.path, r.text) for r in files.collect()} == {("src/a.rs", "fn a() {}"), ("b.bin", "")}
    assert scan.read_source(files, "src/a.rs") == "fn a() {}"
    for path, status in (("../x", 403), ("nope", 404), ("b.bin", 415)):
        with pytest.raises(scan.SourceError) as e:
            scan.read_source(files, path)
        assert e.value.status == status
    have = spark.createDataFrame([("package.json",), ("go.mod",)], "name string")
    assert scan.indexer_for(have).first().indexer == "scip-go"


def test_generations_survive_a_failed_load():
    loads = iter([1, RuntimeError("broken"), 2])

    def load():
        x = next(loads)
        if isinstance(x, Exception):
            raise x
        return x

    g = live.Generations(load, automatic=False)
    assert g.rebuild() and g.live == 1 and not g.changed() and g.dirty
    assert not g.rebuild() and g.live == 1 and g.error == "broken" and g.dirty
    assert g.rebuild() and g.status() == {"generation": 2, "mode": "static", "dirty": False, "error": None}
    for generation, status in ((None, 400), (1, 409)):
        with pytest.raises(live.Stale) as e:
            g.check(generation)
        assert e.value.status == status
