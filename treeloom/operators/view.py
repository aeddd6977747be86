"""From a cut to a picture: filters, one edge for each pair, lifting to common levels, bundling, groups and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import strength
from ..sources.generations import written
from .tree import depth, lineage


@dataclass(frozen=True)
class Settings:
    show_tests: bool = True
    hidden: tuple[int, ...] = ()
    scope: int | None = None
    one_per_pair: bool = True
    changes_only: bool = False


def under(tree: DataFrame, ids: tuple[int, ...] | list[int]) -> DataFrame:
    """(id): everything at or under any of the ids."""
    return tree.filter(F.col("anc").isin(list(ids))).select("id").distinct()


def filter_leaves(cut: DataFrame, entities: DataFrame, tree: DataFrame, settings: Settings) -> DataFrame:
    """The leaves that a view shows: no tests if those are off, nothing at or under what is hidden, the scope alone."""
    out = cut
    if not settings.show_tests:
        out = out.join(entities.filter("is_test").select(F.col("id").alias("leaf")), "leaf", "left_anti")
    if settings.hidden:
        out = out.join(under(tree, settings.hidden).withColumnRenamed("id", "leaf"), "leaf", "left_anti")
    if settings.scope is not None:
        out = out.join(under(tree, [settings.scope]).withColumnRenamed("id", "leaf"), "leaf", "left_semi")
    return out


def filter_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges both of whose ends are shown (anc): leaves, or what holds some."""
    return edges.join(shown.select(F.col("anc").alias("src")), "src", "left_semi").join(shown.select(F.col("anc").alias("dst")), "dst", "left_semi")


def one_per_pair(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, refs): the strongest kind of each ordered pair, references joined in the order of the edges."""
    parts = F.array_sort(F.collect_list(F.struct("first_ref", "refs")))
    return edges.groupBy("src", "dst").agg(F.min_by("kind", strength(F.col("kind"))).alias("kind"), F.flatten(F.transform(parts, lambda p: p["refs"])).alias("refs"))


def by_precedence(edges: DataFrame) -> DataFrame:
    """edges (src, dst, kind, status, count) as one for each pair and status: strongest kind, counts of all kinds, sum.

    Kinds are summed before they are put in a map, so that a pair's kinds never meet more than once each.
    """
    kinds = edges.groupBy("src", "dst", "status", "kind").agg(F.sum("count").alias("n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))
    return kinds.groupBy("src", "dst", "status").agg(F.min_by("kind", strength(F.col("kind"))).alias("kind"), counts.alias("kinds"), F.sum("n").alias("count"))


def offsets(edges: DataFrame, order: str = "pos") -> DataFrame:
    """edges (src, dst, …) with the offset of each among those of its unordered pair: ten apart, around the middle."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    pair = Window.partitionBy(a, b)
    at = F.row_number().over(pair.orderBy(order)) - 1
    middle = (F.count("*").over(pair) - 1) / 2
    return edges.withColumn("offset", F.when(F.col("src") < F.col("dst"), 1).otherwise(-1) * (at - middle) * 10)


def common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def lift(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(src, dst, level, kind): each edge between the two outermost nodes that differ, the strongest kind of each pair.

    level: what holds both, null above the roots. An edge between a node and what holds it has no place and goes.
    """
    chains = lineage(tree)
    ends = edges.join(chains.select(F.col("id").alias("src"), F.col("chain").alias("a")), "src").join(chains.select(F.col("id").alias("dst"), F.col("chain").alias("b")), "dst")
    ends = ends.withColumn("split", common_prefix(F.col("a"), F.col("b"))).filter((F.col("split") < F.size("a")) & (F.col("split") < F.size("b")))
    at = lambda c, i: F.get(F.col(c), i)
    lifted = ends.select(at("a", F.col("split")).alias("src"), at("b", F.col("split")).alias("dst"), at("a", F.col("split") - 1).alias("level"), "kind")
    return lifted.groupBy("src", "dst", "level").agg(F.min_by("kind", strength(F.col("kind"))).alias("kind"))


def drawn_tree(leaves: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, parent, is_box, depth): the leaves of a picture and every container above them; roots have depth 1."""
    walk = leaves.select(F.col("leaf").alias("id")).join(tree, "id")
    step = Window.partitionBy("id").orderBy("hops")
    walk = walk.withColumn("parent", F.lead("anc").over(step)).withColumn("depth", F.max("hops").over(Window.partitionBy("id")) - F.col("hops") + 1)
    return walk.groupBy(F.col("anc").alias("id")).agg(F.max("parent").alias("parent"), (F.min("hops") > 0).alias("is_box"), F.max("depth").alias("depth"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of drawn edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def levels_bottom_up(drawn: DataFrame) -> DataFrame:
    """(level, pos): boxes, the deepest first, then the level of the roots (null)."""
    boxes = drawn.filter("is_box").select(F.col("id").alias("level"), "depth")
    every = boxes.unionByName(boxes.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("level"), F.lit(0).alias("depth")))
    from .tree import dense_ids

    return dense_ids(every, (-F.col("depth")).alias("depth"), "level", name="pos").select("level", "pos")


def visible_refs(edges: DataFrame, refs: DataFrame, dropped: DataFrame) -> DataFrame:
    """edges without the member references that end in what is dropped (id); an edge that loses all goes, as does one
    that ends there itself."""
    gone = dropped.select("id")
    whole = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    kept = refs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("ref_id")
    members = whole.select("src", "dst", "kind", F.explode("refs").alias("ref_id")).join(kept, "ref_id")
    return members.groupBy("src", "dst", "kind").agg(F.array_sort(F.collect_list("ref_id")).alias("refs"), F.count("*").alias("n_refs"), F.min("ref_id").alias("first_ref"))


def raw_model(entities: DataFrame, refs: DataFrame, dropped: DataFrame | Column, unchanged: DataFrame | Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, containment (parent, child) and references of the uncut picture, without what is dropped or unchanged: ids, or
    what is true of such entities."""
    kept = entities
    for gone in (dropped, unchanged):
        if gone is not None:
            kept = kept.filter(~F.coalesce(gone, F.lit(False))) if isinstance(gone, Column) else kept.join(gone.select("id"), "id", "left_anti")
    ids = kept.select("id")
    contain = kept.filter("parent is not null").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select("parent", F.col("id").alias("child"))
    edges = refs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, contain, edges


def attach(chain: Column, meet: Column, reach: Column) -> Column:
    """Where an end of a bundled edge attaches on its chain (leaf first): the deepest place that any box lets it reach.

    reach: for each place on the chain 0, 1 or 2; a box between the leaf and the meeting place that says 1 lets the
    end step inside it by one, and 2 lets it go to the leaf.
    """
    inner = F.sequence(F.lit(1), meet)
    open_ = F.when(meet >= 1, F.filter(inner, lambda i: F.get(reach, i) > 0)).otherwise(F.array().cast("array<int>"))
    far = F.exists(open_, lambda i: F.get(reach, i) == 2)
    return F.when(far, 0).otherwise(F.coalesce(F.array_min(F.transform(open_, lambda i: i - 1)), meet)).cast("int")


def reaches(chain: Column, levels: Column, direction: str) -> Column:
    """For each place of a chain how far its boxes let an end in. levels: map of box to struct(in, out, inward)."""
    def at(i: Column) -> Column:
        own = F.coalesce(F.element_at(levels, F.get(chain, i))[direction], F.lit(0))
        above = F.coalesce(F.element_at(levels, F.coalesce(F.get(chain, i + 1), F.lit(-1).cast("bigint")))["inward"], F.lit(0))
        return F.greatest(own, above)

    return F.transform(F.sequence(F.lit(0), F.size(chain) - 1), at)


def bundle(edges: DataFrame, drawn: DataFrame, tree: DataFrame, bundling: dict[int, tuple[int, int, int]] | None = None) -> DataFrame:
    """(src, src_box, dst, dst_box, kind, status, count): leaf-to-leaf edges lifted to where both sides are siblings,
    then pulled back towards their leaves by the levels (in, out, inward) of boxes, and grouped.

    drawn: the drawn boxes (id). An end is a box wherever it is not the leaf itself.
    """
    boxes = tree.filter("hops > 0").join(drawn.select(F.col("id").alias("anc")), "anc", "left_semi")
    first_gap = tree.filter("hops > 0").join(drawn.select(F.col("id").alias("anc")), "anc", "left_anti").groupBy("id").agg(F.min("hops").alias("gap"))
    walk = boxes.join(first_gap, "id", "left").filter("gap is null or hops < gap")
    pairs = F.array_sort(F.collect_list(F.struct("hops", "anc")))
    up = walk.groupBy("id").agg(F.transform(pairs, lambda p: p["anc"]).alias("up"))
    ends = edges.join(up.select(F.col("id").alias("src"), F.col("up").alias("u")), "src", "left").join(up.select(F.col("id").alias("dst"), F.col("up").alias("w")), "dst", "left")
    none = F.array().cast("array<bigint>")
    ends = ends.withColumn("a", F.concat(F.array("src"), F.coalesce("u", none))).withColumn("b", F.concat(F.array("dst"), F.coalesce("w", none)))
    shared = common_prefix(F.reverse("a"), F.reverse("b"))
    ends = ends.withColumn("ka", F.size("a") - shared - 1).withColumn("kb", F.size("b") - shared - 1).filter("ka >= 0 and kb >= 0")
    level_type = "map<bigint, struct<in: int, out: int, inward: int>>"
    entries = [F.struct(F.lit(k).cast("bigint").alias("key"), F.struct(*(F.lit(v).alias(n) for n, v in zip(("in", "out", "inward"), x, strict=True))).alias("value")) for k, x in (bundling or {}).items()]
    levels = F.map_from_entries(F.array(*entries)).cast(level_type) if entries else F.create_map().cast(level_type)
    ends = ends.withColumn("ia", attach(F.col("a"), F.col("ka"), reaches(F.col("a"), levels, "out"))).withColumn("ib", attach(F.col("b"), F.col("kb"), reaches(F.col("b"), levels, "in")))
    at = lambda c, i: F.get(F.col(c), F.col(i))
    ends = ends.select(at("a", "ia").alias("src"), (F.col("ia") > 0).alias("src_box"), at("b", "ib").alias("dst"), (F.col("ib") > 0).alias("dst_box"), "kind", *(["status"] if "status" in edges.columns else []))
    keys = [c for c in ends.columns]
    return ends.groupBy(*keys).agg(F.count("*").alias("count"))


def selected_refs(edges: DataFrame, tree: DataFrame, selected: int, outgoing: bool = True) -> DataFrame:
    """(ref_id): members of coalesced edges from inside a subtree to outside it, or the other way."""
    inside = tree.filter(F.col("anc") == selected).select("id")
    near, far = ("src", "dst") if outgoing else ("dst", "src")
    crossing = edges.join(inside.withColumnRenamed("id", near), near, "left_semi").join(inside.withColumnRenamed("id", far), far, "left_anti")
    return crossing.select(F.explode("refs").alias("ref_id")).distinct()


def edge_refs(refs: DataFrame, tree: DataFrame, src: int, dst: int, kinds: list[str], status: str | None = None) -> DataFrame:
    """References between two subtrees of some kinds: what stands behind an edge that names no members."""
    out = refs.filter(F.col("kind").isin(kinds)) if status is None else refs.filter(F.col("kind").isin(kinds) & (F.col("status") == status))
    ends = lambda x, name: tree.filter(F.col("anc") == x).select(F.col("id").alias(name))
    return out.join(ends(src, "src"), "src", "left_semi").join(ends(dst, "dst"), "dst", "left_semi")


def group_paths(pairs: DataFrame, tree: DataFrame, point: int) -> DataFrame:
    """pairs (group_id, …) with `path`: the way to the group from where it parts with a reference point."""
    chains = lineage(tree)
    fixed = chains.filter(F.col("id") == point).select(F.col("chain").alias("point"))
    rows = pairs.join(chains.withColumnRenamed("id", "group_id"), "group_id").crossJoin(F.broadcast(fixed))
    split = common_prefix(F.col("chain"), F.col("point"))
    return rows.select(*pairs.columns, F.slice("chain", split + 1, F.greatest(F.size("chain") - split, F.lit(0))).alias("path"))


def group_counts(pairs: DataFrame, tree: DataFrame, point: int) -> DataFrame:
    """(path, id, count): pairs (group_id, …) counted along the path from where each parts with a reference point.

    Every node of the path counts; the empty path has all.
    """
    rows = group_paths(pairs.groupBy("group_id").agg(F.count("*").alias("n")), tree, point)
    prefixes = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    return rows.select(F.explode(prefixes).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("count")).select("path", F.get("path", F.size("path") - 1).alias("id"), "count")


def compress(groups: DataFrame, held: DataFrame) -> DataFrame:
    """(path, label, count) of groups (path, count): runs of single children that hold no references become one label, the ids
    along the run. held: (path) of the groups that hold references themselves.

    Each group points at the one that its run goes on with, or at itself; pointers jump twice as far in every round, so that
    a run of any length ends after as many rounds as its length has bits.
    """
    key = lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), "/")
    nodes = written(groups.filter(F.size("path") > 0).select(key(F.col("path")).alias("key"), key(F.slice("path", F.lit(1), F.size("path") - 1)).alias("up"), "path", "count"))
    only = nodes.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n"), F.min("key").alias("next")).filter("n = 1").select("key", "next")
    goes_on = only.join(held.select(key(F.col("path")).alias("key")).distinct(), "key", "left_anti")
    ends = written(nodes.select("key").join(goes_on, "key", "left").select("key", F.coalesce("next", "key").alias("next")))
    inner = ends.filter("key <> next").select(F.col("next").alias("key"))
    longest = nodes.agg(F.max(F.size("path"))).first()[0] or 1
    for _ in range((longest - 1).bit_length()):
        jump = ends.select(F.col("key").alias("next"), F.col("next").alias("then"))
        ends = written(ends.join(jump, "next").select("key", F.col("then").alias("next")))
    heads = nodes.join(inner, "key", "left_anti").select("key", F.size("path").alias("depth"))
    last = nodes.select(F.col("key").alias("next"), "path", "count")
    return heads.join(ends, "key").join(last, "next").select("path", F.slice("path", F.col("depth"), F.size("path") - F.col("depth") + 1).alias("label"), "count")


def tree_groups(pairs: DataFrame, tree: DataFrame, point: int) -> tuple[DataFrame, DataFrame]:
    """(id, up, count) and (id): what group_counts counts along paths, and the groups that hold pairs (group_id) themselves.

    A path is what a chain has below where it parts with the reference point's, so its last id tells it: nothing but ids
    is moved. up is null at the top of a path.
    """
    fixed = tree.filter(F.col("id") == point).select("anc")
    counted = written(pairs.groupBy("group_id").agg(F.count("*").alias("n")))
    ways = counted.join(tree.select(F.col("id").alias("group_id"), "anc"), "group_id").join(F.broadcast(fixed), "anc", "left_anti")
    counts = ways.groupBy(F.col("anc").alias("id")).agg(F.sum("n").alias("count"))
    ups = tree.filter("hops = 1").join(F.broadcast(fixed), "anc", "left_anti").select("id", F.col("anc").alias("up"))
    return written(counts.join(ups, "id", "left").select("id", "up", "count")), counted.select(F.col("group_id").alias("id"))


def compress_tree(nodes: DataFrame, held: DataFrame, tree: DataFrame, point: int) -> DataFrame:
    """As compress, for groups by id as tree_groups gives them. Pointers jump for those nodes alone that a run goes on from."""
    only = nodes.filter("up is not null").groupBy("up").agg(F.count("*").alias("n"), F.min("id").alias("next")).filter("n = 1")
    runs = written(only.select(F.col("up").alias("id"), "next").join(held.select("id"), "id", "left_anti"))
    inner, longest = runs.select(F.col("next").alias("id")), tree.agg(F.max("hops")).first()[0] or 0
    for _ in range(longest.bit_length()):
        jump = runs.select(F.col("id").alias("next"), F.col("next").alias("then"))
        runs = written(runs.join(jump, "next", "left").select("id", F.coalesce("then", "next").alias("next")))
    heads = nodes.select("id").join(inner, "id", "left_anti").join(runs, "id", "left").select(F.col("id").alias("head"), F.coalesce("next", "id").alias("id"))
    below = tree.join(F.broadcast(tree.filter(F.col("id") == point).select("anc")), "anc", "left_anti")
    rows = heads.join(nodes.select("id", "count"), "id").join(lineage(below).withColumnRenamed("chain", "path"), "id")
    return rows.select("path", F.slice("path", F.array_position("path", F.col("head")).cast("int"), F.size("path")).alias("label"), "count")


def row_summary(rows: DataFrame) -> DataFrame:
    """(row, kinds, statuses, n_sites) for rows (row, src, kind, status, sites): a line that two references share counts
    once, and `same` is no status to show."""
    kinds = rows.groupBy("row", "kind").agg(F.count("*").alias("n")).groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    statuses = rows.groupBy("row").agg(F.array_sort(F.collect_set(F.when(F.col("status") != "same", F.col("status")))).alias("statuses"))
    sites = rows.select("row", "src", F.explode("sites").alias("line")).distinct().groupBy("row").agg(F.count("*").alias("n_sites"))
    return kinds.join(statuses, "row").join(sites, "row", "left").select("row", "kinds", "statuses", F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


def flags(entities: DataFrame, dropped: DataFrame) -> DataFrame:
    """(id, expandable): has an entity a child that is not dropped?"""
    kids = entities.filter("parent is not null").join(dropped.select("id"), "id", "left_anti").select(F.col("parent").alias("id")).distinct()
    return entities.select("id").join(kids.withColumn("expandable", F.lit(True)), "id", "left").select("id", F.coalesce("expandable", F.lit(False)).alias("expandable"))


def boxes_in_order(drawn: DataFrame, tree: DataFrame) -> DataFrame:
    """Drawn boxes with their depth in the graph, for listing parents before what they hold."""
    return drawn.filter("is_box").select("id").join(depth(tree), "id")


