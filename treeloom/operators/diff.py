"""Two versions of a graph as one: matching from the root down, a union tree, statuses, line operations and churn."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import inclusive_line_count
from ..schema import ranged
from ..sources.generations import alone, written
from .lineops import line_ops
from .testcode import is_continuation
from .tree import dense_ids, handed_down, inner

#: Sides larger than this get a status and churn, but no line operations.
MAX_DIFF_BYTES = 1 << 20
OPS = "array<struct<tag: string, old_start: int, old_len: int, new_start: int, new_len: int>>"


def check_roots(old: DataFrame, new: DataFrame) -> None:
    """One root on each side, of equal names."""
    names = []
    for side, entities in (("base", old), ("working", new)):
        roots = entities.filter("parent is null").select("name").take(2)
        if len(roots) != 1:
            raise ValueError(f"the {side} graph has {'no' if not roots else 'more than one'} root entity")
        names.append(roots[0].name)
    if names[0] != names[1]:
        raise ValueError(f"the two trees have different root names ({names[0]} and {names[1]})")


def place(side: int, ord: Column) -> Column:
    """9 bytes of a step in pre-order: what the new side lacks stands last; places from the root down sort as bytes do."""
    return F.unhex(F.concat(F.lit(f"{side:02d}"), F.lpad(F.hex(ord.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))


def key_paths(entities: DataFrame, placed: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, parent, ord, h1, h2): 128 bits of hash of the steps from below the root down (name, kind, ordinal among siblings of
    that name and kind). placed: with `at`, the places of the same steps, from the same walk. also: columns to keep."""
    nth = F.row_number().over(Window.partitionBy("parent", "name", "kind").orderBy(F.coalesce("ord", "id"), "id"))
    ord = F.coalesce("ord", "id").cast("bigint")
    own = F.struct("name", "kind", nth.alias("nth"), *([place(0, ord).alias("at")] if placed else []))

    def step(above: Column | None, own: Column) -> Column:
        # seeds of the root; a null has no weight in a hash, so it is told apart by a flag
        key = (F.lit(0).cast("bigint"), F.lit(1).cast("bigint")) if above is None else tuple(F.xxhash64(above[h], own["name"], own["name"].isNull(), own["kind"], own["nth"]) for h in ("h1", "h2"))
        at = [(own["at"] if above is None else F.concat(above["at"], own["at"])).alias("at")] if placed else []
        return F.struct(key[0].alias("h1"), key[1].alias("h2"), *at)

    nodes = written(entities.select("id", "parent", ord.alias("ord"), own.alias("own"), *also))
    return handed_down(nodes, step, "key").select("id", "parent", "ord", "key.*", *also)


def match(old: DataFrame, old_tree: DataFrame | None, new: DataFrame, new_tree: DataFrame | None) -> DataFrame:
    """(old_id, new_id): a full outer join on key paths, so that what hangs under no match matches nothing.

    Paths are met by 128 bits of hash, so that ids and hashes alone are shuffled.
    """
    key = lambda side, name: key_paths(side).select(F.col("id").alias(name), "h1", "h2")
    return key(old, "old_id").join(key(new, "new_id"), ["h1", "h2"], "full").select("old_id", "new_id")


def union_ids(old: DataFrame, new: DataFrame, matched: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, old_id, new_id): entities of both sides once, with dense ids in pre-order. also: attributes, the new side's first.

    A parent's new children stand in the new order, then its old ones without match in the old order. The new side's walk
    gives hashes and places at once, and what is gone walks down from the places of what is not. Attributes go along, as
    meeting them afterwards would shuffle all ids again.
    """
    def meet() -> DataFrame:
        b = alone(lambda: key_paths(new, True, also).select(F.col("id").alias("new_id"), "h1", "h2", "at", *also))
        if matched is not None:
            return matched.select("old_id", "new_id").join(b.drop("h1", "h2"), "new_id", "left")
        return alone(lambda: key_paths(old).select(F.col("id").alias("old_id"), "h1", "h2")).join(b, ["h1", "h2"], "full")

    rows = alone(lambda: meet().select("old_id", "new_id", "at", *also))
    kept = rows.filter("new_id is not null")
    # only what is gone is asked for its old place
    places = old.select("id", "parent", place(1, F.coalesce("ord", "id")).alias("at"), *also)
    gone = written(rows.filter("new_id is null").select(F.col("old_id").alias("id")).join(places, "id"))
    above = kept.filter("old_id is not null").join(gone.select(F.col("parent").alias("old_id")).distinct(), "old_id", "left_semi").select(F.col("old_id").alias("parent"), F.col("at").alias("top"))
    nodes = written(gone.join(above, "parent", "left").select("id", "parent", F.struct("top", "at").alias("own"), *also))

    def step(over: Column | None, own: Column) -> Column:
        from_top = F.concat(own["top"], own["at"])
        return F.coalesce(from_top, own["at"]) if over is None else F.coalesce(from_top, F.concat(over, own["at"]))

    lost = handed_down(nodes, step, "at").select(F.col("id").alias("old_id"), F.lit(None).cast("bigint").alias("new_id"), "at", *also)
    return dense_ids(kept.select("old_id", "new_id", "at", *also).unionByName(lost), "at", drop=("at",)).select("id", "old_id", "new_id", *also)


def presence_statuses(united: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """united (id, old_id, new_id, parent) as (id, status), where presence on the sides decides alone: added, removed, modified
    where anything below is one of both, else the same. parent: of the new side, or else of the old one.

    What holds a change is found from below, on each side among what has children; no other ancestors are listed.
    """
    def holding(side: DataFrame, changed: DataFrame, name: str) -> DataFrame:
        at, found = changed.filter("parent is not null").select(F.col("parent").alias(name)), None
        holders = inner(side.select("id", "parent"))
        while holders:
            at = written(at.distinct())
            if at.isEmpty():
                break
            found = at if found is None else found.unionByName(at)
            at = holders[0].join(at.withColumnRenamed(name, "id"), "id", "left_semi").filter("parent is not null").select(F.col("parent").alias(name))
        return alone(lambda: (at.limit(0) if found is None else found).distinct()).withColumn(f"{name}_holds", F.lit(True))

    of_new = holding(new, united.filter("old_id is null"), "new_id")
    of_old = holding(old, united.filter("new_id is null"), "old_id")
    rows = united.select("id", "old_id", "new_id").join(of_new, "new_id", "left").join(of_old, "old_id", "left")
    held = F.when(F.col("new_id_holds") | F.col("old_id_holds"), "modified")
    return rows.select("id", F.coalesce(presence(), held, F.lit("same")).alias("status"))


def union(old: DataFrame, old_tree: DataFrame | None, new: DataFrame, new_tree: DataFrame | None, matched: DataFrame | None = None) -> DataFrame:
    """union_ids with parents in the union and the new side's attributes first."""
    return attributed(union_ids(old, new, matched), old, new)


def attributed(ids: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old_id, new_id, parent, …) for the ids of a union."""
    attributes = [c for c in new.columns if c not in ("id", "parent")]
    pick = lambda side, key: side.select(F.col("id").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in attributes), F.col("parent").alias(f"{key}_parent"))
    rows = ids.join(pick(old, "old_id"), "old_id", "left").join(pick(new, "new_id"), "new_id", "left")
    both = rows.select("id", "old_id", "new_id", "old_id_parent", "new_id_parent", *(F.when(F.col("new_id").isNotNull(), F.col(f"new_id_{c}")).otherwise(F.col(f"old_id_{c}")).alias(c) for c in attributes))
    of_new = ids.select(F.col("new_id").alias("new_id_parent"), F.col("id").alias("by_new")).filter("new_id_parent is not null")
    of_old = ids.select(F.col("old_id").alias("old_id_parent"), F.col("id").alias("by_old")).filter("old_id_parent is not null")
    out = both.join(of_new, "new_id_parent", "left").join(of_old, "old_id_parent", "left")
    parent = F.when(F.col("new_id").isNotNull(), F.col("by_new")).otherwise(F.col("by_old"))
    return out.select("id", "old_id", "new_id", parent.alias("parent"), *attributes)


def presence(old: str = "old_id", new: str = "new_id") -> Column:
    """added or removed for what one side lacks, else null."""
    return F.when(F.col(old).isNull(), "added").when(F.col(new).isNull(), "removed")


def ref_statuses(united: DataFrame, old_refs: DataFrame, new_refs: DataFrame) -> DataFrame:
    """(src, dst, kind, sites, status, late, was) by ids of the union: sites and id (was) of the new side where both have the
    reference; late: only the old has it. References with an end that their side lacks are left out."""
    def mapped(refs: DataFrame, side: str) -> DataFrame:
        ids = united.filter(F.col(side).isNotNull()).select(F.col(side).alias("was"), "id")
        ends = refs.join(ids.select(F.col("was").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("was").alias("dst"), F.col("id").alias("d")), "dst")
        return ends.select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind", F.lit(True).alias(f"{side}_there"), F.col("ref_id").alias(f"{side}_ref"), F.col("sites").alias(f"{side}_sites"))

    # each side's joins end before the next side's begin, so that their shuffled rows never lie on disk together
    rows = written(mapped(new_refs, "new_id")).join(written(mapped(old_refs, "old_id")), ["src", "dst", "kind"], "full")
    status = F.coalesce(F.when(F.col("old_id_there").isNull(), "added").when(F.col("new_id_there").isNull(), "removed"), F.lit("same"))
    return rows.select("src", "dst", "kind", F.coalesce("new_id_sites", "old_id_sites").alias("sites"), status.alias("status"), F.col("new_id_there").isNull().alias("late"), F.coalesce("new_id_ref", "old_id_ref").alias("was"))


def union_refs(united: DataFrame, old_refs: DataFrame, new_refs: DataFrame) -> DataFrame:
    """(ref_id, src, dst, kind, sites, status): the new side's first, then what only the old has; sites of the new side
    where both have the reference."""
    rows = ref_statuses(united, old_refs, new_refs)
    return dense_ids(rows, "late", "was", "src", "dst", "kind", name="ref_id").select("ref_id", "src", "dst", "kind", "sites", "status")


def ops_between(old: str, new: str) -> Column:
    """The line operations between two text columns."""
    keys = ("tag", "old_start", "old_len", "new_start", "new_len")

    def run(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(keys, op, strict=True)) for op in line_ops(a, b)] for a, b in zip(olds, news, strict=True)])

    return F.pandas_udf(run, OPS)(old, new)


def file_work(pairs: DataFrame) -> DataFrame:
    """(file_id, status, diffable, ops) for pairs (file_id, old_text, new_text); a null text is a missing side.

    Only texts that differ, on both sides and of diffable size, reach the Python function.
    """
    small = lambda c: F.octet_length(c) <= MAX_DIFF_BYTES
    o, n = F.col("old_text"), F.col("new_text")
    status = F.when(o.isNull() & n.isNull(), "same").when(o.isNull(), "added").when(n.isNull(), "removed").when(o == n, "same").otherwise("modified")
    rows = pairs.withColumn("status", status).withColumn("small", F.coalesce(small("old_text"), F.lit(True)) & F.coalesce(small("new_text"), F.lit(True)))
    op = lambda tag, a, b: F.struct(F.lit(tag).alias("tag"), F.lit(0).alias("old_start"), a.cast("int").alias("old_len"), F.lit(0).alias("new_start"), b.cast("int").alias("new_len"))
    gone, come = op("delete", inclusive_line_count(o), F.lit(0)), op("insert", F.lit(0), inclusive_line_count(n))
    whole = F.when(F.col("status") == "added", F.array(come)).when(F.col("status") == "removed", F.array(gone)).when(F.col("status") == "modified", F.array(gone, come)).otherwise(F.array().cast(OPS))
    detail = (F.col("status") == "modified") & F.col("small")
    plain = rows.filter(~detail).select("file_id", "status", ((F.col("status") != "same") & F.col("small")).alias("diffable"), whole.cast(OPS).alias("ops"))
    fine = rows.filter(detail).select("file_id", "status", F.lit(True).alias("diffable"), ops_between("old_text", "new_text").alias("ops"))
    return plain.unionByName(fine)


def attached(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file_id, start, first) for starts (file_id, start): the first of the comment and attribute lines right above."""
    run = lines.filter(is_continuation(F.col("text"))).select("file_id", "line")
    run = run.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("file_id").orderBy("line")))
    run = run.withColumn("first", F.min("line").over(Window.partitionBy("file_id", "run")))
    above = run.select("file_id", (F.col("line") + 1).alias("start"), "first")
    return starts.join(above, ["file_id", "start"], "left").select("file_id", "start", F.coalesce("first", "start").alias("first"))


#: Lines of a part in which operations and spans of a file meet.
PART = 256


def churn(ops: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, added, removed): how much of the line operations (file_id, ops) lies in spans (id, file_id, side, first, last).

    Inserts count on the new side and deletes on the old; spans include both ends. Both are cut at every PART lines and
    joined by file and part, where their common lines add up, so that a large file is no quadratic join.
    """
    flat = ops.select("file_id", F.explode("ops").alias("op")).select("file_id", "op.*")
    sides = flat.select("file_id", F.when(F.col("tag") == "insert", "new").when(F.col("tag") == "delete", "old").alias("side"), F.when(F.col("tag") == "insert", F.col("new_start")).otherwise(F.col("old_start")).alias("at"), (F.col("old_len") + F.col("new_len")).alias("len")).filter("side is not null and len > 0")
    parts = lambda lo, hi: F.explode(F.sequence(F.floor(lo / PART), F.floor(hi / PART)))
    cut_ops = sides.withColumn("part", parts(F.col("at"), F.col("at") + F.col("len") - 1))
    cut_spans = spans.filter("last >= first").withColumn("part", parts(F.col("first"), F.col("last")))
    hit = cut_spans.join(cut_ops, ["file_id", "side", "part"])
    end = F.least(F.col("last") + 1, F.col("at") + F.col("len"), (F.col("part") + 1) * PART)
    over = F.greatest(F.lit(0), end - F.greatest(F.col("first"), F.col("at"), F.col("part") * PART))
    count = lambda side: F.sum(F.when(F.col("side") == side, over).otherwise(0)).cast("bigint")
    sums = hit.groupBy("id").agg(count("new").alias("added"), count("old").alias("removed"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return spans.select("id").distinct().join(sums, "id", "left").select("id", none("added"), none("removed"))


def whole_churn(ops: DataFrame) -> DataFrame:
    """(file_id, added, removed) of whole files."""
    count = lambda tag, size: F.aggregate("ops", F.lit(0).cast("bigint"), lambda n, o: n + F.when(o["tag"] == tag, o[size]).otherwise(0))
    return ops.select("file_id", count("insert", "new_len").alias("added"), count("delete", "old_len").alias("removed"))


def settle(united: DataFrame, tree: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, status, added, removed) of every entity of a union.

    files: (id, status, added, removed) of files, ranges: (id, added, removed) of what has lines. What has neither
    stands for what is below it: sums of churn, and `same` if all is.
    """
    own = united.select("id", "kind", presence().alias("presence"), (ranged() & (F.col("kind") != "file")).alias("has_range"))
    f = files.select("id", F.col("status").alias("file_status"), F.col("added").alias("f_added"), F.col("removed").alias("f_removed"))
    r = ranges.select("id", F.col("added").alias("r_added"), F.col("removed").alias("r_removed"))
    own = own.join(f, "id", "left").join(r, "id", "left")
    added, removed = (F.coalesce(f"f_{c}", f"r_{c}", F.lit(0)) for c in ("added", "removed"))
    settled = (F.col("kind") == "file") | F.col("has_range")
    by_lines = F.when((added == 0) & (removed == 0), "same").otherwise("modified")
    status = F.when(F.col("kind") == "file", F.coalesce("file_status", F.lit("same"))).when(F.col("has_range"), F.coalesce("presence", by_lines)).otherwise(F.col("presence"))
    nodes = own.select(F.col("id"), settled.alias("settled"), status.alias("status"), F.when(settled, added).otherwise(0).alias("added"), F.when(settled, removed).otherwise(0).alias("removed"))
    # a settled entity counts to each ancestor with nothing settled in between
    about = nodes.select(F.col("id").alias("anc"), F.col("settled").alias("anc_settled"), F.col("status").alias("anc_status"))
    between = Window.partitionBy("id").orderBy("hops").rowsBetween(Window.unboundedPreceding, -1)
    walk = tree.join(about, "anc")
    walk = walk.withColumn("blocked", F.coalesce(F.max(F.col("anc_settled") & (F.col("hops") > 0)).over(between), F.lit(False)))
    walk = walk.withColumn("decided", F.coalesce(F.max(F.col("anc_status").isNotNull() & (F.col("hops") > 0)).over(between), F.lit(False)))
    below = walk.filter("hops > 0 and not anc_settled").join(nodes, "id")
    sums = below.filter("settled and not blocked").groupBy("anc").agg(F.sum("added").alias("a"), F.sum("removed").alias("r"))
    changed = below.filter("not decided and status is not null and status <> 'same'").groupBy("anc").agg(F.lit(True).alias("changed"))
    out = nodes.join(sums.withColumnRenamed("anc", "id"), "id", "left").join(changed.withColumnRenamed("anc", "id"), "id", "left")
    final = F.coalesce("status", F.when(F.col("changed"), "modified").otherwise("same"))
    pick = lambda own, total: F.when(F.col("settled"), F.col(own)).otherwise(F.coalesce(total, F.lit(0))).cast("bigint")
    return out.select("id", final.alias("status"), pick("added", "a").alias("added"), pick("removed", "r").alias("removed"))


def edge_status(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """edges (with refs) with the status of their members, `mixed` where they disagree."""
    rows = edges.select("src", "dst", "kind", F.explode("refs").alias("ref_id")).join(refs.select("ref_id", "status"), "ref_id")
    status = rows.groupBy("src", "dst", "kind").agg(F.when(F.count_distinct("status") == 1, F.min("status")).otherwise("mixed").alias("status"))
    return edges.join(status, ["src", "dst", "kind"])


def listing(ops: DataFrame, old_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    """(file_id, pos, old_line, new_line, tag, text): both sides interleaved, a line number null where a side has none."""
    flat = ops.select("file_id", F.posexplode("ops").alias("k", "op")).select("file_id", "k", "op.*")
    size = F.greatest("old_len", "new_len")
    rows = flat.filter(size > 0).select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    old = F.when(F.col("tag") != "insert", F.col("old_start") + F.col("i"))
    new = F.when(F.col("tag") != "delete", F.col("new_start") + F.col("i"))
    rows = rows.select("file_id", "k", "i", "tag", old.alias("old_line"), new.alias("new_line"))
    a = old_lines.select("file_id", F.col("line").alias("old_line"), F.col("text").alias("old_text"))
    b = new_lines.select("file_id", F.col("line").alias("new_line"), F.col("text").alias("new_text"))
    both = rows.join(b, ["file_id", "new_line"], "left").join(a, ["file_id", "old_line"], "left")
    pos = F.row_number().over(Window.partitionBy("file_id").orderBy("k", "i")) - 1
    return both.select("file_id", pos.alias("pos"), "old_line", "new_line", "tag", F.coalesce("new_text", "old_text").alias("text"))


def served(pairs: DataFrame, work: DataFrame, disk: DataFrame) -> DataFrame:
    """(file_id, text, side, ops): what to show of each file: both sides' operations where there are some, the new text,
    the old one of a removed file, else what is on disk (file_id, text)."""
    rows = pairs.join(work.filter("diffable"), "file_id", "full").join(disk.withColumnRenamed("text", "disk_text"), "file_id", "full")
    shown = F.when(F.col("diffable"), F.coalesce("new_text", "old_text")).otherwise(F.coalesce("disk_text", "new_text", "old_text"))
    side = F.when(F.col("status") == "removed", "old").otherwise("new")
    return rows.select("file_id", shown.alias("text"), side.alias("side"), "ops")
