"""Cuts through the tree: which leaves are shown, where references land on them, and how cuts survive a rebuild.

A cut is (leaf, pos): an antichain and the order in which its leaves were added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.generations import FEW, alone, few, written
from .tree import above, handed_down, nearest, parents

#: Generations that a client may lag behind.
WINDOW = 16


def initial(entities: DataFrame) -> DataFrame:
    return entities.filter("parent is null").select(F.col("id").alias("leaf"), F.col("id").alias("pos"))


def _after(cut: DataFrame) -> DataFrame:
    return cut.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))


def expand(cut: DataFrame, entities: DataFrame, leaf: int) -> DataFrame:
    """Open a leaf: its children, in order, come after the others. Not on the cut, or childless: nothing changes."""
    on = cut.filter(F.col("leaf") == leaf).select(F.col("leaf").alias("parent"))
    kids = entities.select("id", "parent", F.coalesce("ord", "id").alias("ord")).join(on, "parent")
    opened = kids.select("parent").distinct().withColumnRenamed("parent", "leaf")
    placed = kids.crossJoin(F.broadcast(_after(cut))).select(F.col("id").alias("leaf"), (F.col("last") + 1 + F.col("ord")).alias("pos"))
    return cut.join(opened, "leaf", "left_anti").unionByName(placed)


def collapse(cut: DataFrame, entities: DataFrame, tree: DataFrame, leaf: int) -> DataFrame:
    """Shut the container of a leaf: all leaves under it go, at any depth, and it comes last. Roots stay."""
    on = cut.filter(F.col("leaf") == leaf).select(F.col("leaf").alias("id"))
    boxes = entities.join(on, "id").filter("parent is not null").select(F.col("parent").alias("anc"))
    return _shut(cut, tree, boxes)


def collapse_box(cut: DataFrame, tree: DataFrame, box: int) -> DataFrame:
    """Shut a container at once; nothing changes where no leaf is strictly under it."""
    under = cut.join(tree.filter((F.col("anc") == box) & (F.col("hops") > 0)).select(F.col("id").alias("leaf"), "anc"), "leaf")
    return _shut(cut, tree, under.select("anc").distinct())


def _shut(cut: DataFrame, tree: DataFrame, boxes: DataFrame) -> DataFrame:
    gone = tree.join(boxes, "anc").select(F.col("id").alias("leaf"))
    added = boxes.crossJoin(F.broadcast(_after(cut))).select(F.col("anc").alias("leaf"), (F.col("last") + 1).alias("pos"))
    return cut.join(gone, "leaf", "left_anti").unionByName(added)


def reveal(cut: DataFrame, entities: DataFrame, tree: DataFrame, target: int) -> DataFrame:
    """Open what lies between the cut and an entity, so that it is a leaf; a target above the cut changes nothing.

    The leaf at or above the target is opened, then each strict ancestor of the target below it: what remains are the
    other leaves and all children of what was opened that are not opened themselves.
    """
    above = tree.filter(F.col("id") == target).select("anc", "hops")
    leaf = above.join(cut.select(F.col("leaf").alias("anc")), "anc").select(F.col("hops").alias("leaf_hops"))
    opened = above.crossJoin(leaf).filter("hops > 0 and hops <= leaf_hops").select(F.col("anc").alias("open"))
    kids = entities.select(F.col("id").alias("leaf"), F.col("parent").alias("open"), F.coalesce("ord", "id").alias("pos")).join(opened, "open").select("leaf", "pos")
    return cut.unionByName(kids).join(opened.select(F.col("open").alias("leaf")), "leaf", "left_anti")


def _parents(tree: DataFrame) -> DataFrame:
    """(id, parent) of a closure, or of entities."""
    return tree.select("id", "parent") if "parent" in tree.columns else parents(tree)


def shown(cut: DataFrame, tree: DataFrame) -> DataFrame:
    """(anc): the leaves and all above them. tree: a closure, or entities."""
    if "parent" in tree.columns:
        return above(tree, cut.select(F.col("leaf").alias("id"))).select("anc").distinct()
    return tree.join(few(cut.select(F.col("leaf").alias("id"))), "id").select("anc").distinct()


def sites(tree: DataFrame, drawn: DataFrame) -> DataFrame:
    """(id, site): the nearest drawn (anc) at or above each entity; those without one have no row.

    Where more is drawn than the driver may hand out, it comes down the tree, as all else would meet under the root; so it does
    in entities, given in place of a closure.
    """
    nodes = few(drawn.select("anc"))
    if "parent" not in tree.columns and nodes.count() <= FEW:
        return tree.join(nodes, "anc").groupBy("id").agg(F.min_by("anc", "hops").alias("site"))
    own = _parents(tree).join(nodes.select(F.col("anc").alias("id"), F.col("anc").alias("own")), "id", "left")
    return handed_down(written(own), nearest, "site").filter("site is not null").select("id", "site")


def coalesce(refs: DataFrame, cut: DataFrame, tree: DataFrame) -> DataFrame:
    """(src, dst, kind, refs, n_refs, first_ref): references where they land on the cut, those within one site dropped."""
    at = sites(tree, shown(cut, tree))
    ends = refs.select("ref_id", "src", "dst", "kind").join(at.select(F.col("id").alias("src"), F.col("site").alias("s")), "src").join(at.select(F.col("id").alias("dst"), F.col("site").alias("d")), "dst")
    grouped = ends.filter("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst"), "kind")
    return grouped.agg(F.array_sort(F.collect_list("ref_id")).alias("refs"), F.count("*").alias("n_refs"), F.min("ref_id").alias("first_ref"))


def coalesce_counts(refs: DataFrame, cut: DataFrame, tree: DataFrame) -> DataFrame:
    """As coalesce, without the list of references: pairs are summed up before they are shuffled. tree: a closure, or entities."""
    at = sites(tree, shown(cut, tree))
    if "parent" in tree.columns:
        made = at
        at = alone(lambda: made)  # both ends ask for it
    ends = refs.select("ref_id", "src", "dst", "kind").join(at.select(F.col("id").alias("src"), F.col("site").alias("s")), "src").join(at.select(F.col("id").alias("dst"), F.col("site").alias("d")), "dst")
    return ends.filter("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst"), "kind").agg(F.count("*").alias("n_refs"), F.min("ref_id").alias("first_ref"))


def id_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id): equal kind and path; of several, the i-th by id matches the i-th. No match: null.

    Kinds and paths are met by 128 bits of hash, so that ids and hashes alone are shuffled; a null meets nothing.
    """
    def keyed(side: DataFrame, name: str) -> DataFrame:
        known = F.col("kind").isNotNull() & F.col("path").isNotNull()
        hashed = side.select(F.when(known, F.xxhash64("kind", "path")).alias("h1"), F.when(known, F.xxhash64(F.lit(1), "kind", "path")).alias("h2"), F.col("id").alias(name))
        return hashed.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(name)))

    return keyed(old, "old_id").join(keyed(new, "new_id"), ["h1", "h2", "nth"], "left").select("old_id", "new_id")


def way_back(matches: DataFrame) -> DataFrame:
    """The id map the other way, as far as it leads: the i-th of a kind and path matches the i-th, whichever side asks."""
    return matches.filter("new_id is not null").select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))


def compose(remaps: DataFrame, since: int, current: int) -> DataFrame:
    """(old_id, new_id) over remaps (generation, old_id, new_id) from a generation to the current one.

    Empty outside the window of kept generations, as for an id that was lost on the way.
    """
    steps = range(since + 1, current + 1)
    if len(steps) > WINDOW or not steps:
        return remaps.select("old_id", "new_id").limit(0)
    one = lambda g: remaps.filter(F.col("generation") == g)
    first = one(since + 1).select("old_id", "new_id")
    return reduce(lambda at, g: at.join(one(g).select(F.col("old_id").alias("new_id"), F.col("new_id").alias("to")), "new_id", "left").select("old_id", F.col("to").alias("new_id")), steps[1:], first)


def migrate(cut: DataFrame, old_tree: DataFrame, matches: DataFrame, entities: DataFrame, tree: DataFrame) -> DataFrame:
    """The cut of the new generation: every leaf at its match, or at that of its nearest matched ancestor.

    What is above a target is open; the new leaves are the roots and the children of what is open, as far as those
    are not open themselves.
    """
    at = migrate_ids(cut.select(F.col("leaf").alias("id")), old_tree, matches, True).select(F.col("new_id").alias("id")).distinct()
    # each round asks for the parents of what the last one opened: far fewer than all ancestors of all leaves
    up, opened = entities.select("id", "parent"), None
    while True:
        at = few(up.join(at, "id", "left_semi").filter("parent is not null").select(F.col("parent").alias("id")).distinct())
        if at.isEmpty():
            break
        opened = at if opened is None else opened.unionByName(at)
    if opened is None:
        return initial(entities)
    opened = opened.distinct().withColumnRenamed("id", "open")
    kids = entities.select(F.col("id").alias("leaf"), F.col("parent").alias("open"), F.coalesce("ord", "id").alias("pos")).join(opened, "open").select("leaf", "pos")
    return initial(entities).unionByName(kids).join(opened.select(F.col("open").alias("leaf")), "leaf", "left_anti")


def migrate_ids(ids: DataFrame, old_tree: DataFrame, matches: DataFrame, coarsen: bool) -> DataFrame:
    """(old_id, new_id) for client state (id): exact, or, to coarsen, at the nearest ancestor that survives."""
    known = matches.filter("new_id is not null").select(F.col("old_id").alias("anc"), "new_id")
    if not coarsen:
        return ids.select(F.col("id").alias("old_id")).join(known.withColumnRenamed("anc", "old_id"), "old_id")
    # what is asked for and lost climbs a step at a time, as far as something is known: most is known at once
    up = _parents(old_tree).filter("parent is not null").select(F.col("id").alias("anc"), "parent")
    at, found = ids.select(F.col("id").alias("old_id"), F.col("id").alias("anc")).distinct(), None
    while True:
        asked = written(at.join(known, "anc", "left"))
        here = asked.filter("new_id is not null").select("old_id", "new_id")
        found = here if found is None else found.unionByName(here)
        lost = asked.filter("new_id is null")
        if lost.isEmpty():
            return found
        at = lost.select("old_id", "anc").join(up, "anc").select("old_id", F.col("parent").alias("anc"))
