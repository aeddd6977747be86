"""From a tree of constructs and raw references by name to a graph: resolution, lifting, and levels.

nodes: (node_id, parent, kind, name, …), numbered in pre-order; raw references: (src, name, kind, line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names too common to be targets.
TRIVIAL = frozenset(
    "new clone unwrap unwrap_or unwrap_or_else expect to_string to_owned into from as_ref as_mut push pop len is_empty iter iter_mut get set insert remove contains contains_key "
    "println print eprintln eprint format panic Some None Ok Err true false self Self super map filter collect fold for_each find any all flat_map and_then or_else ok_or next parse "
    "split join trim default ok err is_some is_none is_ok is_err log error warn info debug trace console Object Array Math JSON input range enumerate zip list dict str int float bool "
    "assert assert_eq assert_ne vec".split()
)
#: How coarse each kind of node is.
LEVEL = {"folder": 0, "module": 1, "file": 2, "class": 3, "function": 4, "block": 5, "line": 6}
#: Places (lines or bytes) of a part of a file in which points and scopes meet.
PART = 512
ENTITY = ("folder", "module", "file", "class", "function")


def name_table(nodes: DataFrame) -> DataFrame:
    """(name, node_id): of all that can be referred to by name, the first in pre-order."""
    return nodes.filter(F.col("kind").isin("function", "class", "module", "file")).groupBy("name").agg(F.min("node_id").alias("node_id"))


def without_trivial(raw: DataFrame) -> DataFrame:
    """Raw references whose name is longer than a byte and says something."""
    return raw.filter((F.octet_length("name") > 1) & ~F.col("name").isin(list(TRIVIAL)))


def resolve(raw: DataFrame, table: DataFrame) -> DataFrame:
    """(src, dst, kind, line): raw references whose name is known, other than to themselves."""
    return raw.join(table, "name").filter("src <> node_id").select("src", F.col("node_id").alias("dst"), "kind", "line")


def innermost_scope(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """points (file_id, at, …) with the smallest half-open range of scopes (file_id, scope, start, end) that holds them.

    Ranges never leave their file and are dealt to every PART places that they touch, so the range predicate runs inside
    an equi-join on file and part; of equal ranges the first counts.
    """
    parts = F.sequence(F.floor(F.col("start") / PART), F.floor((F.col("end") - 1) / PART))
    dealt = scopes.filter(F.col("end") > F.col("start")).withColumn("_part", F.explode(parts))
    hit = points.withColumn("_part", F.floor(F.col("at") / PART)).join(dealt, ["file_id", "_part"]).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    return hit.groupBy(*points.columns).agg(F.min_by("scope", F.struct((F.col("end") - F.col("start")).alias("size"), "scope")).alias("scope"))


def glue(nodes: DataFrame) -> DataFrame:
    """(node_id): `mod.rs` files with no class or function of their own, and the childless module stubs in them."""
    files = nodes.filter("kind = 'file' and name = 'mod.rs'").select("node_id")
    full = nodes.filter("kind in ('class', 'function')").select(F.col("parent").alias("node_id")).distinct()
    empty = files.join(full, "node_id", "left_anti")
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("node_id")).distinct()
    stubs = nodes.filter("kind = 'module'").join(empty.select(F.col("node_id").alias("parent")), "parent", "left_semi").join(parents, "node_id", "left_anti")
    return empty.unionByName(stubs.select("node_id"))


def select_entities(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """nodes that become entities, with `up`: the nearest of their ancestors that does, too.

    tree: the closure of nodes, as (id, anc, hops).
    """
    kept = nodes.filter(F.col("kind").isin(*ENTITY)).join(glue(nodes), "node_id", "left_anti")
    above = tree.filter("hops > 0").join(kept.select(F.col("node_id").alias("anc")), "anc").groupBy(F.col("id").alias("node_id")).agg(F.min_by("anc", "hops").alias("up"))
    return kept.join(above, "node_id", "left")


def lift_refs(found: DataFrame, tree: DataFrame, entities: DataFrame, dropped: DataFrame) -> DataFrame:
    """References between entities: each end at the nearest entity; those that touch a dropped node go, as do loops."""
    clear = found.join(dropped.select(F.col("node_id").alias("src")), "src", "left_anti").join(dropped.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    at = tree.join(entities.select(F.col("node_id").alias("anc")), "anc").groupBy("id").agg(F.min_by("anc", "hops").alias("at"))
    ends = clear.join(at.select(F.col("id").alias("src"), F.col("at").alias("s")), "src").join(at.select(F.col("id").alias("dst"), F.col("at").alias("d")), "dst")
    return ends.filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind", "line")


def dedup(found: DataFrame) -> DataFrame:
    """(src, dst, kind, sites): one reference for each triple, its lines in order."""
    return found.groupBy("src", "dst", "kind").agg(F.array_sort(F.collect_set("line")).alias("sites"))


def at_granularity(refs: DataFrame, nodes: DataFrame, tree: DataFrame, level: str, key: str = "id") -> DataFrame:
    """(src, dst): distinct pairs of the nearest ancestors as coarse as a level, or else the root; no loops."""
    coarse = nodes.filter(F.col("kind").isin([k for k, n in LEVEL.items() if n <= LEVEL[level]]) | F.col("parent").isNull()).select(F.col(key).alias("anc"))
    at = tree.join(coarse, "anc").groupBy("id").agg(F.min_by("anc", "hops").alias("at"))
    pairs = refs.select("src", "dst").join(at.select(F.col("id").alias("src"), F.col("at").alias("s")), "src").join(at.select(F.col("id").alias("dst"), F.col("at").alias("d")), "dst")
    return pairs.filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def refs_from(refs: DataFrame, node: int) -> DataFrame:
    return refs.filter(F.col("src") == node)


def refs_to(refs: DataFrame, node: int) -> DataFrame:
    return refs.filter(F.col("dst") == node)
