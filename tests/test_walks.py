"""Walks over trees without a join with all ancestors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from treeloom.operators import cut, layout, testcode, tree, view
from treeloom.sources import generations

#: Two roots, a long chain, leaves at many heights, and a parent that is not there.
PARENTS = {1: None, 2: 1, 3: 2, 4: 3, 5: 4, 6: 1, 7: 3, 8: None, 9: 8, 10: 99}
ABOVE = {i: [i, *up] for i, up in {1: [], 2: [1], 3: [2, 1], 4: [3, 2, 1], 5: [4, 3, 2, 1], 6: [1], 7: [3, 2, 1], 8: [], 9: [8], 10: [99]}.items()}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(i, p, f"n{i}", "file" if i in (3, 6) else "function", i) for i, p in PARENTS.items()]
    return spark.createDataFrame(rows, "id long, parent long, name string, kind string, ord long")


def test_walks_need_no_closure(nodes):
    assert {(r.id, r.anc, r.hops) for r in tree.closure(nodes).collect()} == {(i, a, h) for i, up in ABOVE.items() for h, a in enumerate(up)}
    assert {r.id: r.path for r in tree.display_paths(nodes).collect()} == {i: "/".join(f"n{a}" for a in reversed(up) if a in PARENTS) for i, up in ABOVE.items()}
    assert {r.id: r.parent for r in tree.parents(tree.steps(nodes)).collect()} == PARENTS
    assert {r.id: r.is_test for r in testcode.mark(nodes.withColumn("name", F.when(F.col("id") == 3, "test_a.py").otherwise("x")).withColumn("is_test", F.lit(False))).collect()} == {i: 3 in up for i, up in ABOVE.items()}


def test_a_cycle_is_told(spark):
    with pytest.raises(ValueError, match="cycle"):
        tree.closure(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long"))


@pytest.mark.parametrize("few", [0, 10])
def test_sites_of_few_and_of_many_drawn(nodes, monkeypatch, few):
    monkeypatch.setattr(generations, "FEW", few)
    monkeypatch.setattr(cut, "FEW", few)
    up = generations.written(tree.closure(nodes))
    drawn = up.filter("id in (3, 8) and hops = 0").select("anc")
    got = cut.sites(up, drawn)
    assert {r.id: r.site for r in got.collect()} == {3: 3, 4: 3, 5: 3, 7: 3, 8: 8, 9: 8}
    if few:  # rows of all entities' ancestors do not move to meet what is drawn
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    moved = cut.migrate(nodes.filter("id in (5, 7)").select(F.col("id").alias("leaf"), F.col("id").alias("pos")), tree.steps(nodes), nodes.select(F.col("id").alias("old_id"), F.when(F.col("id") != 5, F.col("id")).alias("new_id")), nodes, tree.steps(nodes))
    assert {r.leaf for r in moved.collect()} == {4, 6, 7, 8}


def test_what_a_picture_drops_may_be_said_of_entities(spark, nodes):
    refs = spark.createDataFrame([(0, 4, 7), (1, 5, 9)], "ref_id long, src long, dst long")
    kept, contain, edges = view.raw_model(nodes, refs, F.col("id") == 9, F.when(F.col("id") == 2, True))
    assert {r.id for r in kept.collect()} == set(PARENTS) - {2, 9} and {(r.parent, r.child) for r in contain.collect()} == {(i, c) for c, i in PARENTS.items() if i in PARENTS and not {i, c} & {2, 9}}
    assert [r.ref_id for r in edges.collect()] == [0]


def test_slots_of_ends_of_one_edge_stand_still(spark):
    rows = [(1, e, 7, 0, 5) for e in ("src", "dst")]
    for given in (rows, rows[::-1]):
        got = layout.port_slots(spark.createDataFrame(given, "edge long, end string, node long, side int, far int").coalesce(1))
        assert {(r.end, r.slot) for r in got.collect()} == {("dst", 0), ("src", 1)}


def test_groups_of_a_tree_are_compressed_by_id(nodes):
    up = generations.written(tree.closure(nodes.filter("id < 8")))
    pairs = nodes.filter("id in (3, 5, 7)").select(F.col("id").alias("group_id")).unionByName(nodes.filter("id = 5").select(F.col("id").alias("group_id")))
    rows = lambda df: {(tuple(r.path), tuple(r.label), r["count"]) for r in df.collect()}
    for point in (6, 1, 4):
        groups, held = view.tree_groups(pairs, up, point)
        assert rows(view.compress_tree(groups, held, up, point)) == rows(view.compress(view.group_counts(pairs, up, point), view.group_paths(pairs.distinct(), up, point)))
    got = view.compress_tree(*view.tree_groups(pairs, up, 6), up, 6)
    assert rows(got) == {((2, 3), (2, 3), 4), ((2, 3, 4, 5), (4, 5), 2), ((2, 3, 7), (7,), 1)}
