"""Symbol indexes as tables, and the graph they describe.

documents (doc, relative_path, position_encoding, tool), occurrences (doc, occ, symbol, range, roles,
enclosing_range) and symbols (doc, symbol, kind, display_name, enclosing_symbol), as JSON or Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .generations import few, written
from .scan import inside

DEFINITION, IMPORT = 1, 2
#: What an indexer's kinds are in the graph, and the words shown for them.
FUNCTIONS = "Function Method StaticMethod AbstractMethod TraitMethod SingletonMethod Constructor Macro Getter Setter Accessor".split()
CLASSES = "Struct Class Enum Trait Interface Type TypeAlias Union Protocol Object Mixin Delegate".split()
MODULES = "Module Namespace Package Library".split()
NOUNS = {"TraitMethod": "method", "SingletonMethod": "method", "StaticMethod": "static method", "AbstractMethod": "abstract method", "TypeAlias": "type alias"}


@dataclass(frozen=True)
class Symbol:
    """A global symbol: what precedes its descriptors, and those as (name, suffix)."""

    head: str
    descriptors: tuple[tuple[str, str], ...]

    def __str__(self) -> str:
        return self.head + "".join(map(_spell, self.descriptors))

    def parent(self) -> Symbol | None:
        return Symbol(self.head, self.descriptors[:-1]) if len(self.descriptors) > 1 else None


SUFFIXES = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}
SIGNS = {v: k for k, v in SUFFIXES.items()}


def _name(text: str) -> str:
    plain = text and all(c.isascii() and (c.isalnum() or c in "_+-$") for c in text)
    return text if plain else "`" + text.replace("`", "``") + "`"


def _spell(d: tuple[str, str]) -> str:
    name, suffix = d
    if suffix.startswith("method"):
        return f"{_name(name)}({suffix[7:]})."
    if suffix == "type_parameter":
        return f"[{_name(name)}]"
    return f"({_name(name)})" if suffix == "parameter" else _name(name) + SIGNS[suffix]


def parse_symbol(raw: str) -> Symbol | None:
    """scheme, manager, package and version, each ended by a space (two are one in it), then descriptors."""
    if raw.startswith("local "):
        return None
    at = 0
    for _ in range(4):
        while True:
            at = raw.find(" ", at)
            if at < 0:
                return None
            at += 1
            if raw[at : at + 1] != " ":
                break
            at += 1
    head, out = raw[:at], []

    def name() -> str | None:
        nonlocal at
        start = at
        if raw[at : at + 1] == "`":
            text, at = "", at + 1
            while at < len(raw):
                if raw[at] != "`":
                    text, at = text + raw[at], at + 1
                elif raw[at + 1 : at + 2] == "`":
                    text, at = text + "`", at + 2
                else:
                    at += 1
                    return text
            return None
        while at < len(raw) and (raw[at].isalnum() or raw[at] in "_+-$"):
            at += 1
        return raw[start:at] or None

    while at < len(raw):
        opened = raw[at] if raw[at] in "[(" else ""
        at += bool(opened)
        text = name()
        if text is None:
            return None
        sign = raw[at : at + 1]
        at += 1
        if opened:
            if sign != {"[": "]", "(": ")"}[opened]:
                return None
            out.append((text, "type_parameter" if opened == "[" else "parameter"))
        elif sign == "(":
            end = raw.find(").", at)
            if end < 0:
                return None
            out.append((text, "method:" + raw[at:end]))
            at = end + 2
        elif sign in SUFFIXES and sign:
            out.append((text, SUFFIXES[sign]))
        else:
            return None
    return Symbol(head, tuple(out)) if out else None


class Dialect:
    """What the protocol leaves open, for a tool without an adapter: no import is recognised."""

    name = "scip"
    column_unit = "utf8"

    def entity_kind(self, symbol: Symbol, kind: str) -> str | None:
        return entity_kind(symbol, kind)

    def parent(self, symbol: Symbol) -> Symbol | None:
        return symbol.parent()

    def imports(self, lines: DataFrame) -> DataFrame:
        return lines.select("file_id", "line", F.lit(False).alias("import"))


def word(line: Column, text: str) -> Column:
    return F.regexp_like(line, F.lit(rf"^{text}(?![\p{{L}}\p{{N}}_])"))


class Rust(Dialect):
    """Methods hang under impl blocks, which are no entities: their owner is the self type, without generics."""

    name = "rust-analyzer"

    @staticmethod
    def block(descriptors: tuple[tuple[str, str], ...]) -> int | None:
        at = len(descriptors) - 1
        while at >= 0 and descriptors[at][1] == "type_parameter":
            at -= 1
        return at if 0 <= at < len(descriptors) - 1 and descriptors[at] == ("impl", "type") else None

    def entity_kind(self, symbol: Symbol, kind: str) -> str | None:
        return None if self.block(symbol.descriptors) is not None else entity_kind(symbol, kind)

    def parent(self, symbol: Symbol) -> Symbol | None:
        owner = symbol.descriptors[:-1]
        at = self.block(owner)
        if at is None:
            return symbol.parent()
        return Symbol(symbol.head, (*owner[:at], (owner[at + 1][0].split("<")[0], "type")))

    def imports(self, lines: DataFrame) -> DataFrame:
        bare = F.regexp_replace(F.ltrim("text"), r"^pub(\([^)]*\))?\s+", "")
        return lines.select("file_id", "line", word(bare, "use").alias("import"))


class Go(Dialect):
    name = "scip-go"

    def imports(self, lines: DataFrame) -> DataFrame:
        text = F.ltrim("text")
        return block_imports(lines, text.startswith("import ("), text.startswith(")"), word(text, "import"))


class TypeScript(Dialect):
    name = "scip-typescript"
    column_unit = "utf16"

    def imports(self, lines: DataFrame) -> DataFrame:
        bare = F.regexp_replace(F.ltrim("text"), r"^export\s+", "")
        return lines.select("file_id", "line", word(bare, "import").alias("import"))


DIALECTS = {d.name: d for d in (Rust(), Go(), TypeScript())}


def for_tool(tool: str) -> Dialect:
    return DIALECTS.get(tool, Dialect())


def block_imports(lines: DataFrame, opens: Column, closes: Column, alone: Column) -> DataFrame:
    """(file_id, line, import): lines of a block from what opens it to what closes it, and those that import alone.

    A line is in a block if the last mark before it opens one.
    """
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda mark: F.coalesce(F.max(F.when(mark, F.col("line"))).over(before), F.lit(-1))
    rows = lines.withColumn("inside", last(opens) > last(closes))
    return rows.select("file_id", "line", F.when(F.col("inside"), True).otherwise(opens | alone).alias("import"))


def entity_kind(symbol: Symbol, kind: str) -> str | None:
    """By the indexer's kind, else by the last suffix; None is no entity."""
    for names, found in ((FUNCTIONS, "function"), (CLASSES, "class"), (MODULES, "module")):
        if kind in names:
            return found
    if kind not in ("", "UnspecifiedKind"):
        return None
    suffix = symbol.descriptors[-1][1].split(":")[0]
    return {"method": "function", "macro": "function", "type": "class", "namespace": "module"}.get(suffix)


def noun(symbol: Symbol, kind: str) -> str | None:
    if kind in NOUNS:
        return NOUNS[kind]
    if kind in (*FUNCTIONS, *CLASSES, *MODULES):
        return kind.lower()
    if kind not in ("", "UnspecifiedKind"):
        return None
    return {"method": "method", "macro": "macro", "namespace": "namespace"}.get(symbol.descriptors[-1][1].split(":")[0])


def documents(raw: DataFrame) -> DataFrame:
    """Documents inside the project, by path, the first of each."""
    first = F.row_number().over(Window.partitionBy("relative_path").orderBy("doc"))
    return raw.filter(inside(F.col("relative_path"))).withColumn("_n", first).filter("_n = 1").drop("_n")


def span(range_: Column) -> Column:
    """struct(l0, c0, l1, c1) of a range of three or four numbers; null for any other and for negative ones."""
    three, four = F.size(range_) == 3, F.size(range_) == 4
    at = lambda i: F.get(range_, F.lit(i))
    found = F.struct(at(0).alias("l0"), at(1).alias("c0"), F.when(four, at(2)).otherwise(at(0)).alias("l1"), F.when(four, at(3)).otherwise(at(2)).alias("c1"))
    return F.when((three | four) & ~F.exists(range_, lambda x: x < 0), found)


def parsed(occurrences: DataFrame, kinds: DataFrame, tool: str) -> DataFrame:
    """(symbol, scip_kind, canonical, parent, entity_kind, noun, last_name) of distinct symbols that are global."""
    dialect = for_tool(tool)
    pairs = occurrences.select("doc", "symbol").distinct().join(kinds.select("doc", "symbol", F.col("kind").alias("scip_kind")), ["doc", "symbol"], "left").select("symbol", F.coalesce("scip_kind", F.lit("")).alias("scip_kind")).distinct()

    def run(batches):
        for pdf in batches:
            rows = []
            for raw, kind in zip(pdf["symbol"], pdf["scip_kind"], strict=True):
                s = parse_symbol(raw)
                if s is not None:
                    up = dialect.parent(s)
                    rows.append((raw, kind, str(s), None if up is None else str(up), dialect.entity_kind(s, kind), noun(s, kind), s.descriptors[-1][0]))
            yield pd.DataFrame(rows, columns=["symbol", "scip_kind", "canonical", "parent", "entity_kind", "noun", "last_name"])

    return pairs.mapInPandas(run, "symbol string, scip_kind string, canonical string, parent string, entity_kind string, noun string, last_name string")


def definitions(occurrences: DataFrame, kinds: DataFrame, symbols: DataFrame) -> DataFrame:
    """The defining occurrence of each symbol: the first that can be an entity, in document and occurrence order.

    `whole_file`: a module whose range starts the file, or has none, is the file itself.
    """
    about = kinds.select("doc", "symbol", F.col("kind").alias("scip_kind"), "display_name", "enclosing_symbol")
    rows = occurrences.filter(F.col("roles").bitwiseAND(DEFINITION) != 0).join(about, ["doc", "symbol"], "left").withColumn("scip_kind", F.coalesce("scip_kind", F.lit("")))
    rows = rows.join(symbols, ["symbol", "scip_kind"]).filter("entity_kind is not null").withColumn("name_span", span(F.col("range"))).filter("name_span is not null")
    rows = rows.withColumn("enclosing", span(F.col("enclosing_range"))).withColumn("span", F.coalesce("enclosing", "name_span"))
    first = F.row_number().over(Window.partitionBy("canonical").orderBy("doc", "occ"))
    starts = F.col("enclosing").isNull() | ((F.col("enclosing.l0") == 0) & (F.col("enclosing.c0") == 0))
    rows = rows.withColumn("_n", first).filter("_n = 1").drop("_n").withColumn("whole_file", (F.col("entity_kind") == "module") & starts)
    return rows.withColumn("name", F.coalesce(F.nullif("display_name", F.lit("")), "last_name"))


def contains(outer: str, inner: str) -> Column:
    a, b = F.col(outer), F.col(inner)
    start = lambda s: F.struct(s["l0"], s["c0"])
    end = lambda s: F.struct(s["l1"], s["c1"])
    return (start(a) <= start(b)) & (end(b) <= end(a))


#: Lines of a part of a document in which spans and what they hold meet.
PART = 64


def part_of(line: Column) -> Column:
    return F.floor(line / PART).alias("part")


def in_parts(rows: DataFrame, held: str) -> DataFrame:
    """rows once for every part of their document that their span touches, so that a long document is no quadratic join."""
    return rows.withColumn("part", F.explode(F.sequence(F.floor(F.col(f"{held}.l0") / PART), F.floor(F.greatest(f"{held}.l0", f"{held}.l1") / PART))))


def parents(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(canonical, parent_key): the symbol's own parent, then its enclosing symbol, if defined in the same document, then
    the innermost definition around it, then the file. files: (doc, file_key); keys of definitions are their symbols."""
    items = defs.filter("not whole_file")
    key = defs.join(files, "doc").select("doc", "canonical", F.when(F.col("whole_file"), F.col("file_key")).otherwise(F.col("canonical")).alias("key"))
    by_parent = items.join(key.select("doc", F.col("canonical").alias("parent"), F.col("key").alias("k1")), ["doc", "parent"], "left")
    both = by_parent.join(key.select("doc", F.col("canonical").alias("enclosing_symbol"), F.col("key").alias("k2")), ["doc", "enclosing_symbol"], "left")
    around = in_parts(items.select("doc", F.col("canonical").alias("outer"), F.col("span").alias("outer_span")), "outer_span")
    hit = items.select("doc", "canonical", "span", part_of(F.col("span.l0"))).join(around, ["doc", "part"]).filter((F.col("canonical") != F.col("outer")) & contains("outer_span", "span"))
    inner = hit.groupBy("canonical").agg(F.max_by("outer", F.struct(F.col("outer_span.l0"), F.col("outer_span.c0"), (-F.col("outer_span.l1")).alias("l1"), (-F.col("outer_span.c1")).alias("c1"))).alias("k3"))
    return both.join(inner, "canonical", "left").join(files, "doc").select("canonical", F.coalesce("k1", "k2", "k3", "file_key").alias("parent_key"))


def uses(occurrences: DataFrame, kinds: DataFrame, symbols: DataFrame, defs: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src_key, dst_key, kind, line, doc, occ): uses of defined symbols, from the innermost definition around them or the file.

    The defining occurrence is no use, nor is a repeated definition of what is a whole file. A package is its folder:
    files have (doc, file_key, folder_key). imports: (doc, line) of import lines.
    """
    about = kinds.select("doc", "symbol", F.col("kind").alias("scip_kind"))
    named = occurrences.join(about, ["doc", "symbol"], "left").withColumn("scip_kind", F.coalesce("scip_kind", F.lit(""))).join(symbols.select("symbol", "scip_kind", "canonical"), ["symbol", "scip_kind"])
    target = defs.join(files, "doc").select("canonical", F.col("doc").alias("def_doc"), F.col("occ").alias("def_occ"), "whole_file", F.when(~F.col("whole_file"), F.col("canonical")).when(F.col("scip_kind") == "Package", F.col("folder_key")).otherwise(F.col("file_key")).alias("dst_key"), F.when(F.col("whole_file"), "module").otherwise(F.col("entity_kind")).alias("target_kind"))
    rows = named.join(target, "canonical").withColumn("at", span(F.col("range"))).filter("at is not null")
    defines = F.col("roles").bitwiseAND(DEFINITION) != 0
    rows = rows.filter(~((F.col("doc") == F.col("def_doc")) & (F.col("occ") == F.col("def_occ"))) & ~(defines & F.col("whole_file")))
    around = in_parts(defs.filter("not whole_file").select("doc", F.col("canonical").alias("outer"), "span"), "span")
    start = F.struct(F.col("at.l0"), F.col("at.c0"))
    holds = (F.struct(F.col("span.l0"), F.col("span.c0")) <= start) & (start < F.struct(F.col("span.l1"), F.col("span.c1")))
    inner = rows.select("doc", "occ", "at", part_of(F.col("at.l0"))).join(around, ["doc", "part"]).filter(holds).groupBy("doc", "occ").agg(F.max_by("outer", F.struct(F.col("span.l0"), F.col("span.c0"), (-F.col("span.l1")).alias("l1"), (-F.col("span.c1")).alias("c1"))).alias("outer"))
    rows = rows.join(inner, ["doc", "occ"], "left").join(files, "doc").withColumn("src_key", F.coalesce("outer", "file_key")).filter("src_key <> dst_key")
    marked = imports.select("doc", F.col("line").alias("_line"), F.lit(True).alias("_import"))
    rows = rows.join(marked, (rows["doc"] == marked["doc"]) & (F.col("at.l0") == F.col("_line")), "left").drop(marked["doc"])
    return rows.select("src_key", "dst_key", reference_kind(F.col("roles"), F.coalesce("_import", F.lit(False)), F.col("target_kind")).alias("kind"), F.col("at.l0").alias("line"), rows["doc"], "occ")


def reference_kind(roles: Column, on_import_line: Column, target: Column) -> Column:
    return F.when((roles.bitwiseAND(IMPORT) != 0) | on_import_line, "import").when(target == "function", "call").when(target == "class", "type_ref").otherwise("generic")


def without_outer(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """hits (src, line, dst, …) without those whose target holds another target of the same line: a path names its prefixes.

    tree: a closure, or entities. Only targets are asked for what holds them. Hits of these three columns come once each: they
    and what they rule out meet in one grouping.
    """
    from ..operators.tree import above

    hits = written(hits)
    targets = written(hits.select(F.col("dst").alias("id")).distinct())
    up = above(tree, targets) if "parent" in tree.columns else tree.join(targets, "id", "left_semi")
    holds = few(up.filter("hops > 0").select(F.col("id").alias("dst"), "anc").join(targets.withColumnRenamed("id", "anc"), "anc", "left_semi"))
    outer = hits.filter("src is not null and line is not null").select("src", "line", "dst").join(holds, "dst").select("src", "line", F.col("anc").alias("dst"))
    if set(hits.columns) != {"src", "line", "dst"}:
        return hits.join(outer.distinct(), ["src", "line", "dst"], "left_anti")
    both = hits.select("src", "line", "dst", F.lit(False).alias("outer")).unionByName(outer.withColumn("outer", F.lit(True)))
    return both.groupBy("src", "line", "dst").agg(F.max("outer").alias("outer")).filter("not outer").select("src", "line", "dst")


def file_spine(docs: DataFrame, root: str) -> DataFrame:
    """(key, kind, name, parent_key): the root, the folders of all paths once, and the files; keys are paths."""
    parts = docs.select("relative_path", F.filter(F.split("relative_path", "/"), lambda p: p != "").alias("p"))
    at = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    rows = at.select(F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("key"), F.when(F.col("n") == F.size("p"), "file").otherwise("folder").alias("kind"), F.get("p", F.col("n") - 1).alias("name"), F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/").alias("parent_key")).distinct()
    top = docs.sparkSession.range(1).select(F.lit("").alias("key"), F.lit("folder").alias("kind"), F.lit(root).alias("name"), F.lit(None).cast("string").alias("parent_key"))
    return top.unionByName(rows)


def byte_column(line: str, column: int, unit: str) -> int:
    """Bytes of a line before a column counted in a unit (utf8, utf16, utf32), within the line."""
    if unit == "utf8":
        return min(column, len(line.encode()))
    seen = 0
    for i, c in enumerate(line):
        if seen >= column:
            return len(line[:i].encode())
        seen += 2 if unit == "utf16" and ord(c) > 0xFFFF else 1
    return len(line.encode())


def byte_columns(line: str, column: str, unit: str) -> Column:
    """byte_column() of columns; a line of ASCII needs no count."""
    from pyspark.sql.types import IntegerType

    def run(lines: pd.Series, columns: pd.Series, units: pd.Series) -> pd.Series:
        return pd.Series([byte_column(x or "", int(c), u) for x, c, u in zip(lines, columns, units, strict=True)])

    plain = F.col(line).isNull() | (F.octet_length(line) == F.char_length(line))
    return F.when(plain, F.least(F.col(column), F.coalesce(F.octet_length(line), F.lit(0)))).otherwise(F.pandas_udf(run, IntegerType())(line, column, unit))


def column_unit(encoding: Column, tool: str) -> Column:
    """The unit of a document's columns; where it says none, what its tool counts."""
    return F.when(encoding.isin("utf8", "utf16", "utf32"), encoding).otherwise(for_tool(tool).column_unit)
