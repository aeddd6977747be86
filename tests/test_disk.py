"""What lies on disk: tables made on the way go, and walks list no ancestors that nothing asks for."""

from __future__ import annotations

import os

import pytest

from treeloom.catalog import QUERIES
from treeloom.operators import diff
from treeloom.plans import history
from treeloom.sources import generations

SMALL = "/root/testdata/sf0.001"
#: Two roots of a name each; 4 and 5 hang under 3, 6 is gone with 7 below it, 24 is new below 23.
OLD = {1: (None, "r"), 2: (1, "a"), 3: (1, "b"), 4: (3, "c"), 5: (3, "d"), 6: (2, "gone"), 7: (6, "below")}
NEW = {21: (None, "r"), 22: (21, "a"), 23: (21, "b"), 25: (23, "c"), 26: (23, "d"), 24: (26, "new")}


def rows(spark, nodes):
    return spark.createDataFrame([(i, p, n, "function", i) for i, (p, n) in nodes.items()], "id long, parent long, name string, kind string, ord long")


@pytest.fixture
def fresh(spark, monkeypatch, tmp_path):
    """An empty shared folder, and its tables' columns on demand."""
    monkeypatch.setattr(generations, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(generations, "_WRITTEN", {})
    return lambda: [spark.read.parquet(str(tmp_path / d)).columns for d in os.listdir(tmp_path) if any(f.endswith(".parquet") for f in os.listdir(tmp_path / d))]


def test_tables_on_the_way_to_a_union_go(spark, fresh):
    history.diff_union_ids(spark, SMALL)
    left = fresh()
    assert len(left) == 3 and ["id", "old_id", "new_id", "name"] in left  # besides items and entities
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_attributes_go_along_with_a_union(spark):
    old, new = rows(spark, OLD), rows(spark, {i: (p, None if i == 22 else n) for i, (p, n) in NEW.items()})
    for matched in (None, diff.match(old, None, new, None)):
        got = diff.union_ids(old, new, matched, also=("name",))
        assert [(r.old_id, r.new_id, r.name) for r in got.orderBy("id").collect()] == [(1, 21, "r"), (None, 22, None), (3, 23, "b"), (4, 25, "c"), (5, 26, "d"), (None, 24, "new"), (2, None, "a"), (6, None, "gone"), (7, None, "below")]


def test_presence_is_settled_without_ancestors(spark):
    old, new = rows(spark, OLD), rows(spark, NEW)
    united = diff.attributed(diff.union_ids(old, new), old, new)
    parents = {i: p for nodes in (OLD, NEW) for i, (p, _) in nodes.items()}
    given = spark.createDataFrame([(r.id, r.old_id, r.new_id, parents[r.new_id or r.old_id]) for r in united.collect()], "id long, old_id long, new_id long, parent long")
    got = {(r.old_id, r.new_id): r.status for r in diff.presence_statuses(given, old, new).join(given.drop("parent"), "id").collect()}
    assert got == {(1, 21): "modified", (2, 22): "modified", (3, 23): "modified", (4, 25): "same", (5, 26): "modified", (None, 24): "added", (6, None): "removed", (7, None): "removed"}


@pytest.mark.parametrize("query", ["test_loc_rollup", "outer_suppress", "drawn_target", "bundle_default", "migrate_cut", "remap_compose", "diff_presence_status"])
def test_no_table_of_all_ancestors_or_paths(spark, fresh, query):
    QUERIES[query](spark, SMALL).count()
    assert not any("path" in columns and "kind" in columns and "line_end" not in columns for columns in fresh())
    assert not any(key[1] in ("closure", "side", "paths") for key in generations._WRITTEN)
