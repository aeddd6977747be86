"""Two versions of a graph with their texts, compared from end to end: union, operations, widened ranges, churn, statuses.

Everything is one table set over ids of the union. A file's lines meet the entities that lie in it by file and part of a
file; no text leaves the join of the two sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ranged
from ..sources.generations import written
from . import diff, testcode, tree


@dataclass(frozen=True)
class Compared:
    """entities: the union with old_id, new_id, status, added, removed; refs: with status; pairs: (file_id, old_text,
    new_text); work: (file_id, status, diffable, ops)."""

    entities: DataFrame
    refs: DataFrame
    tree: DataFrame
    pairs: DataFrame
    work: DataFrame


def text_pairs(united: DataFrame, old_texts: DataFrame, new_texts: DataFrame) -> DataFrame:
    """(file_id, old_text, new_text) of the files of a union: null on a side that lacks the file, empty where a side has it but
    not its text. Texts are (file_id, text) by the side's own ids."""
    rows = united.filter("kind = 'file'").select(F.col("id").alias("file_id"), "old_id", "new_id")
    for side, texts in (("old", old_texts), ("new", new_texts)):
        found = texts.select(F.col("file_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_found"))
        rows = rows.join(found, f"{side}_id", "left")
    text = lambda side: F.when(F.col(f"{side}_id").isNotNull(), F.coalesce(f"{side}_found", F.lit(""))).alias(f"{side}_text")
    return rows.select("file_id", text("old"), text("new"))


def _attached_lines(pairs: DataFrame, side: str) -> DataFrame:
    """(file_id, line, text) of the lines of one side that belong to what follows them."""
    rows = pairs.filter(F.col(f"{side}_text").isNotNull()).select("file_id", F.posexplode(F.split(f"{side}_text", "\n", -1)).alias("line", "text"))
    return rows.filter(testcode.is_continuation(F.col("text")))


def widened(united: DataFrame, up: DataFrame, pairs: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """(id, file_id, side, first, last): the lines of each entity that has some, with the comments and attributes right above,
    on each side that it is on."""
    inside = united.filter(ranged() & (F.col("kind") != "file")).select("id", "old_id", "new_id").join(tree.file_of(united, up), "id")
    out = []
    for side, entities in sides.items():
        own = entities.select(F.col("id").alias(f"{side}_id"), F.col("line_start").alias("start"), F.col("line_end").alias("last"))
        spans = inside.select("id", "file_id", f"{side}_id").join(own, f"{side}_id")
        above = diff.attached(_attached_lines(pairs, side), spans.select("file_id", "start").distinct())
        out.append(spans.join(above, ["file_id", "start"]).select("id", "file_id", F.lit(side).alias("side"), "first", "last"))
    return out[0].unionByName(out[1])


def compare(old: DataFrame, old_refs: DataFrame, old_texts: DataFrame, new: DataFrame, new_refs: DataFrame, new_texts: DataFrame, max_hops: int | None = None) -> Compared:
    """Both sides need one root each, of one name."""
    diff.check_roots(old, new)
    united = written(diff.union(old, None, new, None))
    up = written(tree.closure(united.select("id", "parent"), max_hops))
    pairs = written(text_pairs(united, old_texts, new_texts))
    work = written(diff.file_work(pairs))
    ranges = diff.churn(work, widened(united, up, pairs, {"old": old, "new": new}))
    files = work.select(F.col("file_id").alias("id"), "status").join(diff.whole_churn(work).withColumnRenamed("file_id", "id"), "id")
    settled = diff.settle(united, up, files, ranges)
    marked = testcode.inherit(united.withColumn("own", F.coalesce("is_test", F.lit(False))).drop("is_test")) if "is_test" in united.columns else united
    return Compared(written(marked.join(settled, "id")), written(diff.union_refs(united, old_refs, new_refs)), up, pairs, work)


def shown_texts(compared: Compared) -> DataFrame:
    """(file_id, text): the new side's text, and the old one of a removed file."""
    return compared.pairs.select("file_id", F.coalesce("new_text", "old_text").alias("text"))


def removed() -> Column:
    return F.col("status") == "removed"
