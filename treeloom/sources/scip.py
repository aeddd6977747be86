"""Binary symbol indexes as a Spark data source, and the graph that an index describes.

An index is one protobuf message, a long sequence of documents. The driver walks over their headers only and deals out
byte ranges; each task reads its ranges and decodes them, so an index of any size is read in parallel. Everything after
that is joins over documents, occurrences and symbols.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import inclusive_line_count
from ..operators import testcode
from ..operators.tree import closure, dense_ids
from . import occurrences as oc
from .generations import written

DOCUMENTS = (
    "doc bigint, relative_path string, position_encoding string, tool string, "
    "occurrences array<struct<symbol: string, range: array<int>, roles: int, enclosing_range: array<int>>>, "
    "symbols array<struct<symbol: string, kind: string, display_name: string, enclosing_symbol: string>>"
)
#: Bytes of documents that one task reads, about.
TASK_BYTES = 16 << 20
#: Bytes of the file that are read at once while headers are looked for.
WINDOW = 1 << 16

#: Fixed values of the format: fields of its messages, encodings, and the kinds that become entities.
METADATA, DOCUMENT = 1, 2
TOOL_INFO, TOOL_NAME = 2, 1
PATH, OCCURRENCE, SYMBOL, ENCODING = 1, 2, 3, 6
ENCODINGS = {1: "utf8", 2: "utf16", 3: "utf32"}
KINDS = {
    7: "Class", 9: "Constructor", 11: "Enum", 17: "Function", 18: "Getter", 21: "Interface", 25: "Macro", 26: "Method", 29: "Module", 30: "Namespace", 33: "Object", 35: "Package", 42: "Protocol", 45: "Setter", 49: "Struct", 53: "Trait", 54: "Type", 55: "TypeAlias", 59: "Union",
    64: "Library", 66: "AbstractMethod", 70: "TraitMethod", 72: "Accessor", 73: "Delegate", 76: "SingletonMethod", 80: "StaticMethod", 85: "Mixin",
}


class BadIndex(ValueError):
    """Bytes that are no index."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadIndex("a number without end")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a message: numbers, or bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if wire == 2 else ({1: 8, 5: 4}.get(wire, -1), at)
            if size < 0 or at + size > len(data):
                raise BadIndex("a field that ends beyond its message")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def signed(value: int) -> int:
    """A 32-bit number; negative ones are written with 64 bits."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def numbers(value: int | bytes) -> list[int]:
    """Repeated numbers, packed or one at a time."""
    if isinstance(value, int):
        return [signed(value)]
    out, at = [], 0
    while at < len(value):
        one, at = varint(value, at)
        out.append(signed(one))
    return out


def document(data: bytes) -> dict:
    out = {"relative_path": "", "position_encoding": "", "occurrences": [], "symbols": []}
    for field, value in fields(data):
        if field == PATH:
            out["relative_path"] = value.decode()
        elif field == ENCODING:
            out["position_encoding"] = ENCODINGS.get(value, "")
        elif field == OCCURRENCE:
            one = {"symbol": "", "range": [], "roles": 0, "enclosing_range": []}
            for f, v in fields(value):
                if f in (1, 7):
                    one["range" if f == 1 else "enclosing_range"] += numbers(v)
                elif f == 2:
                    one["symbol"] = v.decode()
                elif f == 3:
                    one["roles"] = signed(v)
            out["occurrences"].append(one)
        elif field == SYMBOL:
            one = {"symbol": "", "kind": "", "display_name": "", "enclosing_symbol": ""}
            for f, v in fields(value):
                if f == 5:
                    one["kind"] = KINDS.get(v, f"Kind{v}" if v else "")
                elif f in (1, 6, 8):
                    one[{1: "symbol", 6: "display_name", 8: "enclosing_symbol"}[f]] = v.decode()
            out["symbols"].append(one)
    return out


def opened(path: str):
    """A file of any file system that pyarrow knows, for reading at any place."""
    system, inside = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return system.open_input_file(inside)


def headers(file, size: int) -> Iterator[tuple[int, int, int]]:
    """(field, start, length) of the parts of an index; only the bytes of their headers are read."""
    at, begin, held = 0, 0, b""
    while at < size:
        if not begin <= at or at + 20 > begin + len(held) and begin + len(held) < size:
            file.seek(at)
            begin, held = at, file.read(WINDOW)
        key, here = varint(held, at - begin)
        length, here = varint(held, here)
        if key & 7 == 0:
            at = begin + here
            continue
        if key & 7 != 2 or begin + here + length > size:
            raise BadIndex("a part that ends beyond the index")
        yield key >> 3, begin + here, length
        at = begin + here + length


@dataclass
class Range(InputPartition):
    """Documents of one task: their numbers, starts and lengths."""

    path: str
    tool: str
    parts: list[tuple[int, int, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema = path, to_arrow_schema(schema)

    def partitions(self) -> list[Range]:
        tool, out, held, doc = "", [], 0, 0
        with opened(self.path) as file:
            for field, start, length in headers(file, file.size()):
                if field == METADATA:
                    file.seek(start)
                    about = dict(fields(file.read(length)))
                    tool = dict(fields(about.get(TOOL_INFO, b""))).get(TOOL_NAME, b"").decode()
                elif field == DOCUMENT:
                    if not out or held + length > TASK_BYTES:
                        out.append(Range(self.path, "", []))
                        held = 0
                    out[-1].parts.append((doc, start, length))
                    held, doc = held + length, doc + 1
        for part in out:
            part.tool = tool
        return out or [Range(self.path, tool, [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as file:
            for doc, start, length in partition.parts:
                file.seek(start)
                row = {"doc": doc, "tool": partition.tool, **document(file.read(length))}
                yield pa.RecordBatch.from_pylist([row], schema=self.schema)


class ScipSource(DataSource):
    """spark.read.format("scip").load(path): a row for each document of an index."""

    @classmethod
    def name(cls) -> str:
        return "scip"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ScipSource)
    return spark.read.format("scip").load(path)


def graph_of(index: DataFrame, sources: DataFrame, root: str, tool: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and references of an index (rows of DOCUMENTS) whose sources are (path, text); a path without text has no
    byte ranges and no import lines. tool: where known, else that of the index.

    Entities stand as their documents do, by path: folders and files first, then definitions as they occur.
    """
    if tool is None:
        first = index.select("tool").first()
        tool = first.tool if first else ""
    dialect = oc.for_tool(tool)
    kept = written(dense_ids(oc.documents(index), "relative_path", name="_doc").drop("doc").withColumnRenamed("_doc", "doc"))
    texts = kept.select("doc", F.col("relative_path").alias("path"), oc.column_unit(F.col("position_encoding"), tool).alias("unit")).join(sources.select("path", "text"), "path", "left")
    texts = written(texts)
    lines = written(texts.filter("text is not null").select(F.col("doc").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text")))
    occs = written(kept.select("doc", F.posexplode("occurrences").alias("occ", "o")).select("doc", "occ", "o.*"))
    last = kept.select("doc", F.posexplode("symbols").alias("at", "s")).groupBy("doc", "s.symbol").agg(F.max_by("s", "at").alias("s"))
    kinds = last.select("doc", "symbol", "s.kind", "s.display_name", "s.enclosing_symbol")
    symbols = written(oc.parsed(occs, kinds, tool))
    defs = written(oc.definitions(occs, kinds, symbols))
    key = lambda p: F.concat(F.lit("/"), p)
    above = F.regexp_replace("path", "/?[^/]*$", "")
    files = texts.select("doc", key(F.col("path")).alias("file_key"), key(above).alias("folder_key"))
    imports = dialect.imports(lines).filter("import").select(F.col("file_id").alias("doc"), "line")

    # folders and files, each where the first document under it stands
    spine = texts.select("doc", F.filter(F.split("path", "/"), lambda p: p != "").alias("p"), "text")
    steps = spine.select("doc", "p", "text", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("n"))
    upto = lambda n: key(F.array_join(F.slice("p", F.lit(1), n), "/"))
    n, is_file = F.col("n"), F.col("n") == F.size("p")
    placed = steps.select(upto(n).alias("key"), F.when(n > 0, upto(n - 1)).alias("parent_key"), F.when(is_file, "file").otherwise("folder").alias("kind"), F.when(n > 0, F.get("p", n - 1)).otherwise(F.lit(root)).alias("name"), "doc", "n",
        F.when(is_file, F.octet_length("text")).alias("bytes"), F.when(is_file, inclusive_line_count(F.col("text")) - 1).alias("last"))
    empty = index.sparkSession.createDataFrame([("/", None, "folder", root, -1, 0, None, None)], placed.schema)
    top = placed.unionByName(empty).groupBy("key", "parent_key", "kind", "name", "n").agg(F.min("doc").alias("doc"), F.max("bytes").alias("bytes"), F.max("last").alias("last"))
    whole = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint")
    top = top.select("key", "parent_key", "kind", F.lit(None).cast("string").alias("noun"), "name", F.lit(0).alias("late"), "doc", F.col("n").alias("nth"), F.lit(0).alias("line_start"), whole("last").cast("int").alias("line_end"), F.lit(0).cast("bigint").alias("byte_start"), whole("bytes").alias("byte_end"))

    made = defs.filter("not whole_file").join(oc.parents(defs, files), "canonical")
    made = made.select("canonical", "parent_key", F.col("entity_kind").alias("kind"), "noun", "name", "doc", "occ", "span")
    at = _byte_places(made, lines, texts)
    inner = made.join(at, "canonical", "left").select(F.col("canonical").alias("key"), "parent_key", "kind", "noun", "name", F.lit(1).alias("late"), "doc", F.col("occ").alias("nth"), F.col("span.l0").alias("line_start"), F.col("span.l1").alias("line_end"), F.coalesce("b0", F.lit(0)).cast("bigint").alias("byte_start"), F.coalesce("b1", F.lit(0)).cast("bigint").alias("byte_end"))
    numbered = written(dense_ids(top.unionByName(inner), "late", "doc", "nth"))
    ids = numbered.select(F.col("key").alias("k"), F.col("id").alias("of"))
    linked = written(numbered.join(ids.select(F.col("k").alias("parent_key"), F.col("of").alias("parent")), "parent_key", "left"))
    up = written(closure(linked.select("id", "parent")))
    names = linked.select(F.col("id").alias("anc"), F.col("name").alias("step"))
    paths = up.join(names, "anc").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("h"), "step"))), lambda x: x["step"]), "/").alias("path"))
    rows = linked.join(paths, "id").select("id", "kind", "noun", "name", "parent", F.col("id").alias("ord"), "path", "byte_start", "byte_end", "line_start", "line_end", F.lit(False).alias("is_test"))
    by_file = files.join(ids, F.col("file_key") == F.col("k")).select(F.col("doc").alias("file_id"), F.col("of").alias("own"))
    entities = testcode.mark(rows, up, lines.join(by_file, "file_id").select(F.col("own").alias("file_id"), "line", "text"))

    hits = oc.uses(occs, kinds, symbols, defs, files, imports)
    for end in ("src", "dst"):
        hits = hits.join(ids.select(F.col("k").alias(f"{end}_key"), F.col("of").alias(end)), f"{end}_key")
    found = written(hits.select("src", "dst", "kind", "line", "doc", "occ"))
    once = oc.without_outer(found, up).groupBy("src", "dst", "kind").agg(F.array_sort(F.collect_set("line")).alias("sites"), F.min(F.struct("doc", "occ")).alias("seen"))
    refs = dense_ids(once, "seen", "src", "dst", "kind", name="ref_id").select("ref_id", "src", "dst", "kind", "sites")
    return entities, refs


def _byte_places(made: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(canonical, b0, b1): where spans of documents with text begin and end in bytes, within the text."""
    from pyspark.sql import Window

    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.select(F.col("file_id").alias("doc"), "line", F.col("text").alias("of_line"), F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).alias("start"))
    sized = texts.filter("text is not null").select("doc", "unit", F.octet_length("text").alias("size"))
    ends = made.join(sized, "doc").select("canonical", "doc", "unit", "size", F.posexplode(F.array(F.struct(F.col("span.l0").alias("line"), F.col("span.c0").alias("col")), F.struct(F.col("span.l1").alias("line"), F.col("span.c1").alias("col")))).alias("side", "p"))
    rows = ends.select("canonical", "doc", "unit", "size", "side", "p.line", "p.col").join(starts, ["doc", "line"], "left")
    place = F.when(F.col("start").isNull(), F.col("size")).otherwise(F.col("start") + oc.byte_columns("of_line", "col", "unit"))
    return rows.withColumn("place", place).groupBy("canonical").agg(F.max(F.when(F.col("side") == 0, F.col("place"))).alias("b0"), F.max(F.when(F.col("side") == 1, F.col("place"))).alias("b1"))


def snapshot_of(spark: SparkSession, index: str, root: str):
    """A snapshot of an index file, with the sources under a root."""
    from ..plans.engine import Snapshot
    from .scan import directory

    sources = directory(spark, root)
    entities, refs = graph_of(read_index(spark, index), sources, os.path.basename(root.rstrip("/")) or "root")
    named = entities.filter("kind = 'file'").select(F.col("id").alias("file_id"), "name", F.regexp_replace("path", "^[^/]*/?", "").alias("path"))
    return Snapshot(entities, refs, named.join(sources.select("path", "text"), "path", "left"))
