"""The union of two versions: numbering, what references ask of it, and what goes through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.operators import diff
from treeloom.plans import history
from treeloom.sources import generations


def rows(spark, nodes):
    return spark.createDataFrame([(i, p, n, "function", o) for i, (p, n, o) in nodes.items()], "id long, parent long, name string, kind string, ord long")


#: Ids differ on the sides; `lost` holds what is gone at three levels, ords may be negative, missing, and of either order.
OLD = {1: (None, "r", 0), 2: (1, "a", 9), 3: (1, "lost", -3), 4: (3, "x", 2), 5: (3, "y", -1), 6: (5, "z", None), 7: (2, "gone", 0), 8: (2, "kept", 5), 9: (1, "late", 4), 10: (2, None, 1)}
NEW = {20: (None, "r", 7), 21: (20, "b", 300), 22: (20, "a", 2), 23: (22, "kept", -8), 24: (22, "fresh", -9), 25: (22, None, None), 26: (21, "deep", 1)}
PAIRS = {1: 20, 2: 22, 8: 23, 10: 25}


def expected():
    """By plain recursion: (old, new) in pre-order with the parent's number."""
    back, out = {n: o for o, n in PAIRS.items()}, []

    def visit(old, new, parent):
        at = len(out)
        out.append((at, old, new, parent))
        by = lambda nodes: lambda i: i if nodes[i][2] is None else nodes[i][2]
        for i in sorted((i for i in NEW if new and NEW[i][0] == new), key=by(NEW)):
            visit(back.get(i), i, at)
        for i in sorted((i for i in OLD if old and OLD[i][0] == old and i not in PAIRS), key=by(OLD)):
            visit(i, None, at)

    visit(1, 20, None)
    return out


def test_union_of_what_is_gone_at_many_levels(spark):
    old, new = rows(spark, OLD), rows(spark, NEW)
    found = diff.match(old, None, new, None)
    assert {(r.old_id, r.new_id) for r in found.collect() if r.old_id and r.new_id} == set(PAIRS.items())
    for matched in (None, found):
        got = sorted((r.id, r.old_id, r.new_id, r.parent) for r in diff.union(old, None, new, None, matched).collect())
        assert got == expected()


def test_references_ask_for_numbers_of_entities_alone(spark, monkeypatch):
    numbered, dense_ids = [], diff.dense_ids
    monkeypatch.setattr(diff, "dense_ids", lambda df, *order, **more: numbered.append(df.columns) or dense_ids(df, *order, **more))
    monkeypatch.setattr(generations, "_WRITTEN", {})
    got = history.diff_ref_status(spark, "/root/testdata/sf0.001")
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.status for r in got.select("status").distinct().collect()} == {"added", "removed", "same"}
    assert numbered == [["old_id", "new_id", "at"]]  # neither the references nor the entities' attributes


def test_shuffled_rows_are_not_gathered_on_the_driver(spark):
    many, some = (generations.written(spark.range(n)) for n in (400_000, 200_000))
    out = many.join(some.filter("id >= 0").distinct(), "id").agg(F.count("*").alias("n"))
    assert out.collect()[0].n == 200_000
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
