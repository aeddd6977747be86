"""The request surface: a snapshot of one generation, and an engine that serves it as rows and JSON."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import percent_decode, utf16_span
from ..operators import compare, cut, diff, search, tree
from ..sources.generations import written
from ..sources.scan import SourceError, read_source
from ..streaming.live import Generations, retained


@dataclass(frozen=True)
class Base:
    """What a generation is compared with: its name, its commit, and the comparison."""

    name: str
    commit: str
    compared: compare.Compared


@dataclass
class Snapshot:
    """One generation: entities, refs, files (file_id, name, path, text, size), and what is derived once from them.

    With a base, entities and references are those of the union, with their statuses, and a changed file's text is that of
    the comparison.
    """

    entities: DataFrame
    refs: DataFrame
    files: DataFrame
    max_hops: int | None = None
    base: Base | None = None
    tree: DataFrame = field(init=False)
    index: search.Index = field(init=False)
    cut: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        if self.base is None:
            self.entities, self.refs = written(self.entities), written(self.refs)
            self.tree = written(tree.closure(self.entities.select("id", "parent"), self.max_hops))
        else:
            self.tree = self.base.compared.tree
        self.index = search.index(self.files, self.entities, self.tree)
        self.cut = cut.initial(self.entities)


def two_sided(old: tuple[DataFrame, DataFrame, DataFrame], new: tuple[DataFrame, DataFrame, DataFrame], name: str = "base", commit: str = "", max_hops: int | None = None) -> Snapshot:
    """A generation that holds two versions, each given as entities, references and texts (file_id, text) of its own ids."""
    found = compare.compare(*old, *new, max_hops=max_hops)
    files = found.entities.filter("kind = 'file'").select(F.col("id").alias("file_id"), "name", "path")
    return Snapshot(found.entities, found.refs, files.join(compare.shown_texts(found), "file_id"), max_hops, Base(name, commit, found))


#: How operations are written on the wire.
SIGNS = {"equal": "=", "delete": "-", "insert": "+"}


class Unchanged(ValueError):
    """A cut operation that would do nothing."""


class Engine:
    """Loads generations and answers questions about the live one. A loader returns a Snapshot."""

    def __init__(self, loader: Callable[[], Snapshot], automatic: bool = True):
        self.remaps: DataFrame | None = None
        self.generations = Generations(loader, automatic, self._carry)
        self.generations.rebuild()
        if self.generations.live is None:
            raise RuntimeError(self.generations.error)

    @property
    def live(self) -> Snapshot:
        return self.generations.live

    def _carry(self, old: Snapshot, new: Snapshot) -> Snapshot:
        """The next generation with the cut where it was, and the map of ids that clients need."""
        matches = written(cut.id_map(old.entities, new.entities))
        new.cut = written(cut.migrate(old.cut, old.tree, matches, new.entities, new.tree))
        step = matches.select(F.lit(self.generations.number + 1).alias("generation"), "old_id", "new_id")
        # written, and only as many as clients may lag behind, so that the plan does not grow with the generations
        self.remaps = written(step if self.remaps is None else retained(self.remaps.unionByName(step)))
        return new

    def graph(self, from_generation: int | None = None) -> dict[str, DataFrame]:
        """JSON rows of nodes and references, without empty fields; and how ids of an older generation map to these."""
        s = self.live
        changed, status = (["status", "added", "removed"], ["status"]) if s.base else ([], [])
        # a removed child is no part of what its folder holds now
        sizes = tree.loc(s.entities, s.tree, compare.removed() if s.base else None)
        rows = s.entities.join(sizes, "id").select("id", "kind", "noun", "name", "parent", "path", "line_start", "line_end", "loc", F.nullif("is_test", F.lit(False)).alias("is_test"), F.nullif("test_loc", F.lit(0)).alias("test_loc"), *changed)
        out = {"nodes": rows.select("id", F.to_json(F.struct(*rows.columns)).alias("json")), "references": s.refs.select("ref_id", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "sites", *status)).alias("json"))}
        if s.base:
            out["diff"] = s.entities.sparkSession.createDataFrame([(s.base.name, s.base.commit)], "base string, base_commit string").select(F.to_json(F.struct("base", "base_commit")).alias("json"))
        if from_generation is not None and self.remaps is not None:
            out["remap"] = cut.compose(self.remaps, from_generation, self.generations.number)
        return out

    def source(self, of: str | int) -> str | dict:
        """The text of the file at a path, or of the file that an entity lies in with what the wire has of it: both sides and
        the operations between them, if the comparison has them."""
        s = self.live
        files = s.files.withColumn("size", F.octet_length("text"))
        if isinstance(of, str):
            return read_source(files, of)
        found = tree.file_of(s.entities, s.tree).filter(F.col("id") == of).first()
        if found is None:
            raise SourceError(404, f"entity {of} has no source file")
        path = s.files.filter(F.col("file_id") == found.file_id).select("path").first()
        out = {"generation": self.generations.number, "id": found.file_id, "path": path.path if path else ""}
        if s.base:
            both, done = s.base.compared.pairs, s.base.compared.work.filter("diffable")
            row = both.join(done, "file_id").filter(F.col("file_id") == found.file_id).first()
            if row is not None:
                ops = [[SIGNS[o.tag], o.old_start, o.old_len, o.new_start, o.new_len] for o in row.ops]
                return out | {"text": row.new_text or "", "old_text": row.old_text or "", "ops": ops}
        return out | {"text": read_source(files, out["path"])}

    def coalesced(self) -> DataFrame:
        s = self.live
        edges = cut.coalesce(s.refs, s.cut, s.tree)
        edges = diff.edge_status(edges, s.refs) if s.base else edges
        return edges.select("first_ref", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "refs", *(["status"] if s.base else []))).alias("json"))

    def search(self, query: str, limits: search.Limits = search.Limits(), encoded: bool = False) -> DataFrame | None:
        """Hits as JSON with spans in UTF-16 units, or None for an empty query."""
        found, _ = search.hits(self.live.index, percent_decode(query) if encoded else query, limits)
        if found is None:
            return None
        start, end = utf16_span(F.col("text"), F.col("start"), F.col("end"))
        return found.select("kind", "pos", "more", F.to_json(F.struct(F.col("file_id").alias("id"), "kind", "path", "line", "text", start.alias("start"), end.alias("end"))).alias("json"))

    def zoom_in(self, leaf: int, generation: int | None) -> None:
        self._change(generation, lambda s: cut.expand(s.cut, s.entities, leaf))

    def zoom_out(self, leaf: int, generation: int | None) -> None:
        self._change(generation, lambda s: cut.collapse(s.cut, s.entities, s.tree, leaf))

    def reset(self, generation: int | None) -> None:
        self.generations.check(generation)
        self.live.cut = cut.initial(self.live.entities)

    def _change(self, generation: int | None, operation: Callable[[Snapshot], DataFrame]) -> None:
        self.generations.check(generation)
        after = written(operation(self.live))
        same = after.select("leaf").exceptAll(self.live.cut.select("leaf")).isEmpty() and self.live.cut.count() == after.count()
        if same:
            raise Unchanged("the cut has no such leaf to open or shut")
        self.live.cut = after

    def status(self) -> dict:
        return self.generations.status()

    def watch(self, automatic: bool) -> None:
        self.generations.automatic = automatic

    def reload(self) -> bool:
        return self.generations.rebuild()
