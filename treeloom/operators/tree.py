"""Containment: ancestors of everything as one table, and what follows from it.

`closure` has a row (id, anc, hops) for each entity and each of its ancestors, itself included. A tree's depth is
small, so it is a few rows for each entity; parent walks become equi-joins with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ranged


#: Lines of a part of a file in which points and spans meet.
PART = 64


def inner(nodes: DataFrame) -> list[DataFrame]:
    """nodes (id, parent, …) that are parents, then those that are parents of such, and so on; each is written.

    Most of a tree is leaves, so these are a fraction of it, and what comes down from above is joined to the leaves once.
    """
    from ..sources.generations import written

    levels, rows, last = [], nodes, None
    while True:
        parents = rows.filter("parent is not null").select(F.col("parent").alias("id")).distinct()
        rows = written(rows.join(parents, "id", "left_semi"))
        n = rows.count()
        if n == 0:
            return levels
        if n == last:
            raise ValueError("the tree has a cycle")
        levels, last = [*levels, rows], n


def closure(entities: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, anc, hops), as far as max_hops where given. An entity takes its ancestors from its parent, once that has its own."""
    nodes, chain = entities.select("id", "parent"), None
    for rows in reversed([nodes, *inner(nodes)]):
        alone = F.when(F.col("parent").isNull(), F.array("id")).otherwise(F.array("id", "parent"))
        if chain is None:
            chain = rows.select("id", alone.alias("chain"))
            continue
        above = chain.select(F.col("id").alias("parent"), F.col("chain").alias("above"))
        chain = rows.join(above, "parent", "left").select("id", F.when(F.col("above").isNull(), alone).otherwise(F.concat(F.array("id"), "above")).alias("chain"))
    kept = chain if max_hops is None else chain.select("id", F.slice("chain", 1, max_hops + 1).alias("chain"))
    return kept.select("id", F.posexplode("chain").alias("hops", "anc")).select("id", "anc", "hops")


def above(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """As closure, of some ids (id) alone: they climb a step at a time, and what they share is asked for its parent once."""
    from ..sources.generations import few, written

    nodes = entities.select(F.col("id").alias("anc"), "parent")
    at, out, hops = written(ids.select("id", F.col("id").alias("anc")).distinct().join(nodes.select("anc"), "anc", "left_semi").select("id", "anc")), None, 0
    while not at.isEmpty():
        here = at.select("id", "anc", F.lit(hops).alias("hops"))
        out = here if out is None else out.unionByName(here)
        asked = few(at.select("anc").distinct())
        over = few(nodes.join(asked, "anc", "left_semi").filter("parent is not null"))
        at, hops = written(at.join(over, "anc").select("id", F.col("parent").alias("anc"))), hops + 1
    return at.select("id", "anc", F.lit(0).alias("hops")) if out is None else out


def get(entities: DataFrame, entity_id: int) -> DataFrame:
    return entities.filter(F.col("id") == entity_id)


def holds(tree: DataFrame, ancestor: int) -> DataFrame:
    """Ids at or under an ancestor."""
    return tree.filter(F.col("anc") == ancestor).select("id")


def depth(tree: DataFrame) -> DataFrame:
    """(id, depth): 0 for a root."""
    return tree.groupBy("id").agg(F.max("hops").alias("depth"))


def handed_down(nodes: DataFrame, step: Callable[[Column | None, Column], Column], name: str) -> DataFrame:
    """nodes (id, parent, own, …) with a column of a name instead of `own`: step(the parent's, own), None above a root.

    Nodes take it from their parents, those with much below them first: a leaf meets its parent's once.
    """
    out = None
    for rows in reversed([nodes, *inner(nodes.select("id", "parent", "own"))]):
        kept = [F.col(c) for c in rows.columns if c != "own"]
        if out is None:
            out = rows.select(*kept, step(None, F.col("own")).alias(name))
            continue
        above = out.select(F.col("id").alias("parent"), F.col(name).alias("_above"), F.lit(True).alias("_under"))
        value = F.when(F.col("_under"), step(F.col("_above"), F.col("own"))).otherwise(step(None, F.col("own")))
        out = rows.join(above, "parent", "left").select(*kept, value.alias(name))
    return out


def steps(entities: DataFrame) -> DataFrame:
    """As closure, as far as parents alone: no join."""
    links = F.array(F.struct(F.col("id").alias("anc"), F.lit(0).alias("hops")), F.struct(F.col("parent").alias("anc"), F.lit(1).alias("hops")))
    return entities.select("id", F.inline(links)).filter("anc is not null")


def parents(tree: DataFrame) -> DataFrame:
    """(id, parent) of a closure."""
    return tree.filter("hops <= 1").groupBy("id").agg(F.max(F.when(F.col("hops") == 1, F.col("anc"))).alias("parent"))


def append(above: Column | None, own: Column) -> Column:
    """A step of handed_down: all from the root down."""
    return F.array(own) if above is None else F.concat(above, F.array(own))


def nearest(above: Column | None, own: Column) -> Column:
    """A step of handed_down: the last that is not null."""
    return own if above is None else F.coalesce(own, above)


def lineage(tree: DataFrame) -> DataFrame:
    """(id, chain): from the root down to the entity."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), F.col("anc").alias("anc"))))
    return tree.groupBy("id").agg(F.transform(pairs, lambda p: p["anc"]).alias("chain"))


def root_name(entities: DataFrame) -> DataFrame:
    return entities.filter("parent is null").agg(F.min_by("name", "id").alias("name"))


def file_of(entities: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(id, file_id): the nearest file at or above; entities above every file have no row."""
    own = entities.select("id", "parent", F.when(F.col("kind") == "file", F.col("id")).alias("own"))
    return handed_down(own, nearest, "file_id").filter("file_id is not null").select("id", "file_id")


def relative(path: Column) -> Column:
    """A path without its first component."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def file_at_path(entities: DataFrame, path: str) -> DataFrame:
    return entities.filter((F.col("kind") == "file") & (relative(F.col("path")) == path)).agg(F.min("id").alias("id")).filter("id is not null")


def order_key(entities: DataFrame, tree: DataFrame | None = None, last_first: bool = False) -> DataFrame:
    """(id, key): sibling ordinals from the root down; sorted by it, entities stand in pre-order."""
    sign = -1 if last_first else 1
    return handed_down(entities.select("id", "parent", (sign * F.coalesce("ord", "id")).alias("own")), append, "key").select("id", "key")


def dense_ids(rows: DataFrame, *order: str | Column, name: str = "id", start: int = 0, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows numbered 0..n-1 in an order, without one task for all: partitions by range, then an offset for each.

    Only the number of rows of each partition comes to the driver. drop: columns that serve the order alone.
    """
    from ..sources.generations import written

    kept = [c for c in rows.columns if c not in drop]
    keys = {o if isinstance(o, str) else f"_key{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    parts = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    parts = written(parts.select(*kept, "_part", (F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33)).alias("_mono")))
    sizes = sorted(parts.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"])
    offsets, total = {}, start
    for r in sizes:
        offsets[r["_part"]] = total
        total += r["n"]
    lookup = F.create_map([F.lit(x) for kv in (offsets or {0: start}).items() for x in kv])
    return parts.select(*kept, (lookup[F.col("_part")] + F.col("_mono")).cast("bigint").alias(name))


def innermost(entities: DataFrame, tree: DataFrame | None, points: DataFrame) -> DataFrame:
    """(file_id, line, id) for points (file_id, line): the smallest entity in the file whose lines hold the line.

    Ranges include both ends; what has none is skipped; where nothing smaller holds the line, the file does. Spans
    stay inside their file and are dealt to every PART lines that they touch, so the range predicate runs within an
    equi-join on file and part, and a large file is no quadratic join.
    """
    own = F.struct((-F.coalesce("ord", "id")).alias("ord"), F.when(F.col("kind") == "file", F.col("id")).alias("file_id"))

    def step(above: Column | None, own: Column) -> Column:
        key, file = (None, None) if above is None else (above["key"], above["file_id"])
        return F.struct(append(key, own["ord"]).alias("key"), nearest(file, own["file_id"]).alias("file_id"))

    inside = handed_down(entities.select("id", "parent", "line_start", "line_end", own.alias("own")), step, "at").filter(ranged() & (F.col("id") != F.col("at.file_id")))
    spans = inside.select("at.file_id", "id", "line_start", "line_end", F.struct((F.col("line_end") - F.col("line_start")).alias("span"), F.col("at.key").alias("key")).alias("by"))
    asked = points.select("file_id", "line").distinct().join(entities.filter("kind = 'file'").select(F.col("id").alias("file_id")), "file_id")
    spans = spans.withColumn("part", F.explode(F.sequence(F.floor(F.col("line_start") / PART), F.floor(F.greatest("line_start", "line_end") / PART))))
    hit = asked.withColumn("part", F.floor(F.col("line") / PART)).join(spans, ["file_id", "part"], "left").withColumn("by", F.when((F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end")), F.col("by")))
    return hit.groupBy("file_id", "line").agg(F.min_by("id", "by").alias("found")).select("file_id", "line", F.coalesce("found", "file_id").alias("id"))


def sums_below(nodes: DataFrame) -> DataFrame:
    """(id, n) for nodes (id, parent, own, skip) without own: the sum over their children of own, or of what is below those.
    A skipped child does not count to a parent that is not skipped itself.

    Sums climb from parent to parent until none is left that takes any; each round has a row for each such parent.
    """
    from ..sources.generations import few, written

    takes, found = nodes.filter("own is null").select("id", "parent", F.col("skip").alias("takes_skip")), None
    at = nodes.filter("own is not null").select("parent", "skip", F.col("own").alias("n"))
    while True:
        given = few(at.filter("parent is not null").groupBy(F.col("parent").alias("id"), "skip").agg(F.sum("n").alias("n")))
        passed = ~F.coalesce(F.col("skip") & ~F.col("takes_skip"), F.lit(False))
        here = written(given.join(takes, "id").filter(passed).groupBy("id", "parent", "takes_skip").agg(F.sum("n").alias("n")))
        if here.isEmpty():
            return (here if found is None else found).groupBy("id").agg(F.sum("n").alias("n"))
        found = here.select("id", "n") if found is None else found.unionByName(here.select("id", "n"))
        at = here.select("parent", F.col("takes_skip").alias("skip"), "n")


def loc(entities: DataFrame, tree: DataFrame | None = None, skip: Column | None = None) -> DataFrame:
    """(id, loc, test_loc): own lines, or for what has no range the sum of its children; and the test part of that.

    skip (over entities' columns): a skipped child does not count to a parent that is not skipped itself. The topmost test
    entities add their lines to what is above them. Neither asks for the ancestors of everything.
    """
    from ..sources.generations import written

    lines = (F.col("line_end") - F.col("line_start") + 1).cast("bigint")
    nodes = written(entities.select("id", "parent", F.coalesce("is_test", F.lit(False)).alias("is_test"), (skip if skip is not None else F.lit(False)).alias("skip"), F.when(ranged(), lines).alias("own")))
    sized = nodes.join(sums_below(nodes), "id", "left").select("id", "parent", "is_test", "skip", F.coalesce("own", "n", F.lit(0)).cast("bigint").alias("loc"))
    tests = sums_below(written(sized.select("id", "parent", "skip", F.when(F.col("is_test"), F.col("loc")).alias("own"))))
    return sized.join(tests, "id", "left").select("id", "loc", F.when(F.col("is_test"), F.col("loc")).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("test_loc"))


def display_paths(entities: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(id, path): names from the root down, joined by slashes."""
    return with_paths(entities.select("id", "parent", "name")).select("id", "path")


def with_paths(entities: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """entities with their display paths."""
    named = handed_down(entities.drop("path").withColumn("own", F.col("name")), append, "path")
    return named.withColumn("path", F.array_join("path", "/"))


def file_paths(entities: DataFrame) -> DataFrame:
    """Files and what holds them, with their display paths: what lies inside files, most of a tree, has no part in these.

    Where a file hangs under what is neither file nor folder nor module, everything gets its path.
    """
    places = entities.filter("kind in ('file', 'folder', 'module')")
    outside = places.filter("parent is not null").join(places.select(F.col("id").alias("parent")), "parent", "left_anti")
    return with_paths(places if outside.isEmpty() else entities)


def violations(entities: DataFrame, refs: DataFrame, tree: DataFrame) -> DataFrame:
    """(rule, n) for each rule of a graph that is broken n times; no rows for a sound graph."""
    rows: list[tuple[str, Callable[[], DataFrame]]] = [
        ("one root", lambda: entities.filter("parent is null").agg(F.abs(F.count("*") - 1).alias("n"))),
        ("dense ids", lambda: entities.agg((F.abs(F.max("id") + 1 - F.count("*")) + F.abs(F.count("*") - F.count_distinct("id"))).alias("n"))),
        ("parents exist", lambda: entities.filter("parent is not null").join(entities.select(F.col("id").alias("parent")), "parent", "left_anti").agg(F.count("*").alias("n"))),
        ("paths", lambda: entities.select("id", F.col("path").alias("given")).join(display_paths(entities, tree), "id").filter("given <> path").agg(F.count("*").alias("n"))),
        ("unique references", lambda: refs.groupBy("src", "dst", "kind").count().filter("count > 1").agg(F.count("*").alias("n"))),
        ("no self-references", lambda: refs.filter("src = dst").agg(F.count("*").alias("n"))),
        ("sites ascend", lambda: refs.filter(F.col("sites") != F.array_sort(F.array_distinct("sites"))).agg(F.count("*").alias("n"))),
    ]
    out = None
    for rule, count in rows:
        part = count().select(F.lit(rule).alias("rule"), F.col("n").cast("bigint").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.filter("n > 0")
