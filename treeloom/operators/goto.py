"""What an identifier in a line refers to, from the references sited on that line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import has_token
from ..sources.generations import FEW, few, written
from .cut import sites
from .tree import above, file_of


def sited(entities: DataFrame, tree: DataFrame | None, refs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, line, ref_id, dst, name): references by the file and line of their sites. also: more of their columns."""
    files = file_of(entities, tree).select(F.col("id").alias("src"), "file_id")
    names = entities.select(F.col("id").alias("dst"), "name")
    return refs.select(*dict.fromkeys(("ref_id", "src", "dst", *also)), F.explode("sites").alias("line")).join(files, "src").join(names, "dst").select("file_id", "line", "ref_id", "dst", "name", *also)


def targets(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(ask, dst, first_ref) for asked (ask, file_id, line, text, token) over sited() places.

    Targets named by the token; where there are none, those whose name is nowhere on the line (an alias). Each target
    once, in the order of its references.
    """
    found = asked.filter("token is not null").join(places, ["file_id", "line"])
    found = found.withColumn("named", F.col("name") == F.col("token"))
    some = F.max("named").over(Window.partitionBy("ask"))
    picked = found.withColumn("some", some).filter(F.when(F.col("some"), F.col("named")).otherwise(~has_token(F.col("text"), F.col("name"))))
    return picked.groupBy("ask", "dst").agg(F.min("ref_id").alias("first_ref"))


def diff_line(status: str = "status", old: str = "old_line", new: str = "new_line"):
    """The side a reference's sites are lines of: a removed one's are of the old file."""
    return F.when(F.col(status) == "removed", F.col(old)).otherwise(F.col(new))


def diff_targets(asked: DataFrame, places: DataFrame) -> DataFrame:
    """As targets, for rows that show both sides: asked (ask, file_id, old_line, new_line, text, token); places have status."""
    sides = places.withColumn("removed", F.col("status") == "removed")
    old = asked.withColumn("line", F.col("old_line")).join(sides.filter("removed"), ["file_id", "line"])
    new = asked.withColumn("line", F.col("new_line")).join(sides.filter("not removed"), ["file_id", "line"])
    both = old.unionByName(new)
    again = both.select("ask", "file_id", "line", "ref_id", "dst", "name")
    named = F.max(F.col("name") == F.col("token")).over(Window.partitionBy("ask"))
    rows = again.join(asked.select("ask", "text", "token"), "ask").withColumn("some", named)
    picked = rows.filter(F.when(F.col("some"), F.col("name") == F.col("token")).otherwise(~has_token(F.col("text"), F.col("name"))))
    return picked.groupBy("ask", "dst").agg(F.min("ref_id").alias("first_ref"))


def drawn_target(found: DataFrame, tree: DataFrame, drawn: DataFrame) -> DataFrame:
    """(ask, site): the one drawn node that shows all targets; asks whose targets are shown by several, or none, go.

    tree: a closure, or entities, of which only the targets climb.
    """
    found, nodes = written(found.select("ask", "dst")), few(drawn.select("anc"))
    if "parent" in tree.columns and nodes.count() <= FEW:
        tree = above(tree, found.select(F.col("dst").alias("id")).distinct())
    at = sites(tree, nodes).select(F.col("id").alias("dst"), "site")
    return found.join(at, "dst").groupBy("ask").agg(F.min("site").alias("site"), F.count_distinct("site").alias("n")).filter("n = 1").select("ask", "site")


def follow(entities: DataFrame, tree: DataFrame, points: DataFrame, drawn: DataFrame) -> DataFrame:
    """(file_id, line, id, site): what a cursor in a file is in, and the drawn node that shows it."""
    from .tree import innermost

    return innermost(entities, tree, points).join(sites(tree, drawn), "id").select("file_id", "line", "id", "site")
