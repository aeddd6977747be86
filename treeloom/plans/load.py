"""From folders and files to snapshots, and the command line that asks them.

A folder is scanned to entities and references; a single file is a graph without references. A second folder makes the
snapshot two-sided.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import testcode
from ..operators.tree import closure
from ..sources import scan, scanner
from ..sources.generations import written
from .engine import Engine, Snapshot, two_sided

Side = tuple[DataFrame, DataFrame, DataFrame]


def side(files: DataFrame, root: str, single: bool = False) -> Side:
    """Entities with test marks, references, and texts (file_id, text) of files (path, text) under a root of that name."""
    files = written(files.select("path", "text"))
    entities, refs = scanner.project(files, root)
    if single:
        # the file itself is the root, as it was given
        entities = entities.filter("kind <> 'folder'").select("id", *(F.when(F.col("kind") == "file", F.lit(None)).otherwise(F.col("parent")).alias("parent") if c == "parent" else F.col(c) for c in entities.columns if c != "id"))
        entities, refs = entities.withColumns({"id": F.col("id") - 1, "parent": F.col("parent") - 1}), refs.limit(0)
    entities = written(entities.withColumn("is_test", F.lit(False)))
    texts = written(files.join(entities.filter("kind = 'file'").select("path", F.col("id").alias("file_id")), "path").select("file_id", "text"))
    rows = texts.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return testcode.mark(entities, closure(entities.select("id", "parent")), rows), refs, texts


def folder(spark: SparkSession, path: str) -> Side:
    """A folder, or one file, as a side; the root is named like it."""
    name = os.path.basename(path.rstrip("/")) or "."
    found = scan.directory(spark, path)
    single = path.rsplit("/", 1)[-1] and found.filter(F.col("path") == name).count() == 1 and found.limit(2).count() == 1
    return side(found, name, bool(single))


def snapshot(spark: SparkSession, path: str, base: str | None = None, commit: str = "") -> Snapshot:
    """What a path holds, compared with a base folder where one is given. Both sides are named like the path."""
    entities, refs, texts = folder(spark, path)
    if base is not None:
        old = side(scan.directory(spark, base), os.path.basename(path.rstrip("/")) or ".")
        return two_sided(old, (entities, refs, texts), os.path.basename(base.rstrip("/")), commit)
    files = entities.filter("kind = 'file'").select(F.col("id").alias("file_id"), "name", "path").join(texts, "file_id")
    return Snapshot(entities, refs, files)


def dump(snapshot: Snapshot) -> DataFrame:
    """(part, at, line): a graph as lines of text, entities first: id, kind, name, lines and parent; then references."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    nodes = snapshot.entities.select(F.lit(0).alias("part"), F.col("id").alias("at"), F.concat_ws(" ", "id", "kind", "name", F.concat("line_start", F.lit(".."), "line_end"), F.lit("<-"), none("parent")).alias("line"))
    edges = snapshot.refs.select(F.lit(1).alias("part"), F.col("ref_id").alias("at"), F.concat_ws(" ", "src", F.lit("->"), "dst", "kind", F.concat(F.lit("@"), F.array_join(F.transform("sites", lambda s: s.cast("string")), ","))).alias("line"))
    return nodes.unionByName(edges).orderBy("part", "at")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """Command line: what to load, an index or a base to compare with, whether to follow changes, and what to ask."""
    parser = argparse.ArgumentParser(description="Ask a source tree questions.")
    parser.add_argument("path")
    index = parser.add_mutually_exclusive_group()
    index.add_argument("--scip", action="store_true", help="build the graph from an index made on the fly")
    index.add_argument("--scip-index", metavar="FILE", help="build the graph from an index that exists")
    parser.add_argument("--diff", metavar="BASE", help="compare with a folder that holds the base version")
    parser.add_argument("--auto-update", action="store_true", help="rebuild when sources change")
    parser.add_argument("--ask", default="graph", help="graph, coalesced, dump, status, source:ID or search:QUERY")
    args = parser.parse_args(argv)
    if args.diff and args.scip_index:
        parser.error("--diff needs an index of each side, so it does not go with --scip-index")
    return args


def answers(engine: Engine, ask: str) -> Iterator[str]:
    """Lines of JSON, or of text for a dump, read from Spark a partition at a time."""
    what, _, rest = ask.partition(":")
    if what == "graph":
        for part, rows in engine.graph().items():
            yield from (json.dumps({part: json.loads(r.json)}, ensure_ascii=False) for r in rows.toLocalIterator())
    elif what == "coalesced":
        yield from (r.json for r in engine.coalesced().toLocalIterator())
    elif what == "dump":
        yield from (r.line for r in dump(engine.live).toLocalIterator())
    elif what == "status":
        yield json.dumps(engine.status())
    elif what == "source":
        yield json.dumps(engine.source(int(rest)), ensure_ascii=False)
    elif what == "search":
        found = engine.search(rest)
        yield from () if found is None else (r.json for r in found.orderBy("pos").toLocalIterator())
    else:
        raise SystemExit(f"cannot answer {ask!r}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    if args.scip:
        raise SystemExit("no indexer is run here: make an index and give it by --scip-index")
    spark = spark or SparkSession.builder.getOrCreate()
    if args.scip_index:
        from ..sources.scip import snapshot_of

        engine = Engine(lambda: snapshot_of(spark, args.scip_index, args.path))
    else:
        engine = Engine(lambda: snapshot(spark, args.path, args.diff), args.auto_update)
    for line in answers(engine, args.ask):
        sys.stdout.write(line + "\n")


if __name__ == "__main__":
    main()
