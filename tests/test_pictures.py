"""Nearest neighbours, labels of groups, and kept graphs, against plain loops."""

from __future__ import annotations

import os
import random

import pytest

from treeloom.operators import layout, view
from treeloom.sources import kept, scan, scanner


@pytest.mark.parametrize(("seed", "spread"), [(1, 0), (2, 1000)])
def test_nearest_is_that_of_all_pairs(spark, seed, spread):
    """Also where a level is two crowds with nothing in between, one point, or a single node."""
    rng = random.Random(seed)
    rows = []
    for level, n in ((None, 40), (1, 1), (2, 60), (3, 2), (4, 5)):
        for _ in range(n):
            at = (0, 0) if level == 4 else (rng.choice([0, spread]) + rng.randint(0, 30), rng.randint(0, 30))
            rows.append((len(rows), level, *at, rng.randint(1, 5), rng.randint(1, 3), rng.randint(0, 9999)))
    nodes = spark.createDataFrame(rows, "id bigint, level bigint, x int, y int, w int, h int, ord bigint")
    for dx, dy in ((1, 0), (0, -1)):
        want = set()
        for a in rows:
            ways = []
            for b in rows:
                x, y = ((b[2] + b[4] / 2) - (a[2] + a[4] / 2)) / 2, (b[3] + b[5] / 2) - (a[3] + a[5] / 2)
                ahead, aside = x * dx + y * dy, abs(x * dy - y * dx)
                if a[1] == b[1] and ahead > 0:
                    ways.append((aside > ahead, ahead + 2 * aside, b[6], b[0]))
            want |= {(a[0], min(ways)[3])} if ways else set()
        assert {(r.id, r.next) for r in layout.nearest(nodes, (dx, dy)).collect()} == want
    assert layout.nearest(nodes.limit(0), (1, 0)).count() == 0


def test_runs_of_single_children_are_one_label(spark):
    groups = [([], 9), ([1], 9), ([1, 2], 9), ([1, 2, 3], 5), ([1, 2, 3, 4], 5), ([1, 2, 3, 4, 5], 5), ([1, 2, 6], 4), ([1, 2, 6, 7], 3)]
    held = [[1, 2, 3, 4, 5], [1, 2, 6], [1, 2, 6, 7]]
    table = spark.createDataFrame(groups, "path array<bigint>, count bigint")
    got = {(tuple(r.path), tuple(r.label), r["count"]) for r in view.compress(table, spark.createDataFrame([(h,) for h in held], "path array<bigint>")).collect()}
    assert got == {((1, 2), (1, 2), 9), ((1, 2, 3, 4, 5), (3, 4, 5), 5), ((1, 2, 6), (6,), 4), ((1, 2, 6, 7), (7,), 3)}


def test_a_kept_graph_is_built_again_only_after_a_change(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "target").mkdir(parents=True)
    (root / "a.rs").write_text("fn one() {}\n")
    built = []

    def build():
        built.append(1)
        entities, refs = scanner.project(scan.directory(spark, str(root)).select("path", "text"), "tree")
        return {"entities": entities, "refs": refs}

    load = lambda commit=None: kept.kept(spark, str(tmp_path / "cache"), str(root), build, commit)
    names = lambda tables: {r.name for r in tables["entities"].collect()}
    assert names(load()) == {"tree", "a.rs", "one"} and len(built) == 1
    assert names(load()) == {"tree", "a.rs", "one"} and len(built) == 1
    (root / "target/x.rs").write_text("fn x() {}")
    (root / ".y.rs").write_text("fn y() {}")
    assert names(load()) == {"tree", "a.rs", "one"} and len(built) == 1
    (root / "b.rs").write_text("fn b() { one() }\n")
    second = load()
    assert names(second) == {"tree", "a.rs", "one", "b.rs", "b"} and second["refs"].count() == 1 and len(built) == 2
    os.remove(root / "b.rs")
    assert names(load()) == {"tree", "a.rs", "one"} and len(built) == 3
    assert names(load("0123")) == {"tree", "a.rs", "one"} and len(built) == 4
    (root / "c.rs").write_text("fn c() {}\n")
    assert names(load("0123")) == {"tree", "a.rs", "one"} and len(built) == 4  # a commit does not change

    def fails():
        raise RuntimeError("no build")

    with pytest.raises(RuntimeError):
        kept.kept(spark, str(tmp_path / "cache"), str(root), fails)
    assert names(load()) == {"tree", "a.rs", "one", "c.rs", "c"} and len(built) == 5
