"""Which entities are test code: by name, by file name, by attributes around a declaration, and by inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ranged
from ..sources.generations import written
from .tree import handed_down, nearest

IDENT = r"\p{IsAlphabetic}\p{N}_"


def test_file_name(name: Column) -> Column:
    """By the conventions of each language's file names."""
    dot = F.length(name) - F.instr(F.reverse(name), ".")
    has = F.instr(name, ".") > 0
    stem = F.when(has, F.substring(name, F.lit(1), dot)).otherwise(name)
    ext = F.when(has, F.substring(name, dot + 2, F.length(name))).otherwise("")
    return (
        F.when(ext == "rs", stem.isin("test", "tests") | stem.endswith("_tests"))
        .when(ext == "go", stem.endswith("_test"))
        .when(ext == "py", (stem == "conftest") | stem.startswith("test_") | stem.endswith("_test"))
        .when(ext.isin("js", "jsx", "ts", "tsx", "mjs", "cjs"), stem.endswith(".test") | stem.endswith(".spec"))
        .otherwise(False)
    )


def named_test(kind: Column, name: Column, file_name: Column) -> Column:
    """By the entity's own name; Python's conventions hold in Python files."""
    python = F.coalesce(file_name.endswith(".py"), F.lit(False))
    return (
        F.when(kind == "folder", name.isin("tests", "test", "__tests__"))
        .when(kind == "file", test_file_name(name))
        .when(kind == "module", name.isin("tests", "test"))
        .when(kind == "function", python & name.startswith("test_"))
        .when(kind == "class", python & name.startswith("Test"))
        .otherwise(False)
    )


def is_attribute(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^\s*(#!?\[|@)"))


def is_continuation(line: Column) -> Column:
    """An attribute, a decorator or a comment: part of the declaration that follows."""
    return F.regexp_like(line, F.lit(r"^\s*(//|/\*|\*|#|@)"))


def marks_test(line: Column) -> Column:
    """Does an attribute line name a test? What is in quotes does not count, nor do `not(test)` and `cfg_attr(test`."""
    compact = F.regexp_replace(line, r"\s", "")
    code = F.regexp_replace(line, r'"[^"]*("|$)', "")
    found = F.regexp_like(code, F.lit(rf"(^|[^{IDENT}])(test|(pytest|rstest|unittest|doctest)($|[^{IDENT}]))"))
    return found & ~compact.contains("not(test)") & ~compact.contains("cfg_attr(test")


def attribute_runs(lines: DataFrame) -> DataFrame:
    """(file_id, line, marked) for the lines of runs of attributes and comments: does the run name a test?"""
    run = lines.filter(is_continuation(F.col("text"))).withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("file_id").orderBy("line")))
    hit = F.max(is_attribute(F.col("text")) & marks_test(F.col("text"))).over(Window.partitionBy("file_id", "run"))
    return run.select("file_id", "line", hit.alias("marked"))


def own_marks(entities: DataFrame, tree: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(id, own): is the entity test code by itself? lines: (file_id, line, text), read for what names leave open."""
    return _own_marks(entities, lines).select("id", "own")


def _own_marks(entities: DataFrame, lines: DataFrame | None) -> DataFrame:
    """entities with `own`; a file hands its id and name down to what it holds."""
    file = F.when(F.col("kind") == "file", F.struct(F.col("id").alias("file_id"), F.col("name").alias("file_name")))
    rows = handed_down(entities.withColumn("own", file), nearest, "file").select(*entities.columns, "file.file_id", "file.file_name")
    rows = rows.withColumn("own", named_test(F.col("kind"), F.col("name"), F.col("file_name")))
    if lines is not None:
        runs = attribute_runs(lines)
        at = F.col("kind").isin("module", "class", "function") & ranged()
        start = F.when(at, F.col("line_start"))
        here = runs.select("file_id", F.col("line").alias("_here"), F.col("marked").alias("marked_here"))
        before = runs.select("file_id", (F.col("line") + 1).alias("_before"), F.col("marked").alias("marked_before"))
        rows = rows.withColumn("_start", start)
        rows = rows.join(here, (rows["file_id"] == here["file_id"]) & (F.col("_start") == F.col("_here")), "left").drop(here["file_id"])
        rows = rows.join(before, (rows["file_id"] == before["file_id"]) & (F.col("_start") == F.col("_before")), "left").drop(before["file_id"])
        rows = rows.withColumn("own", F.col("own") | F.coalesce("marked_here", "marked_before", F.lit(False)))
    return rows.select(*entities.columns, "own")


def inherit(own: DataFrame) -> DataFrame:
    """own (id, parent, own, …) with is_test instead of `own`: whatever is under test code is test code."""
    return handed_down(own, lambda above, own: own if above is None else F.greatest(above, own), "is_test")


def mark(entities: DataFrame, tree: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """entities with is_test set."""
    nodes = entities.drop("is_test")
    if lines is not None:
        return inherit(written(_own_marks(nodes, lines))).select(entities.columns)
    own = F.struct("kind", "name", F.when(F.col("kind") == "file", F.col("name")).alias("file"))

    def step(above: Column | None, own: Column) -> Column:
        file = own["file"] if above is None else nearest(above["file"], own["file"])
        named = named_test(own["kind"], own["name"], file)
        return F.struct(file.alias("file"), (named if above is None else F.greatest(above["is_test"], named)).alias("is_test"))

    return handed_down(nodes.withColumn("own", own), step, "walk").withColumn("is_test", F.col("walk.is_test")).select(entities.columns)
