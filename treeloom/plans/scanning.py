"""Queries of the scanner: a source file of each language for each customer, with what must be found in it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources import scanner, scip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Text of a customer's file; {k % 7} is computed. Each line that must be found: kind, noun, name, lines, and what holds it.
RUST = (
    "rs",
    """use shop::n{n}::{Item{k % 7}, other as alias, all::*};
/* fn no{k}() {} /* nested */ */ #[derive(Clone)]
pub struct P{k}<T>(T);
impl<T> Show for P{k}<T> where T: Fn(u8) {
    fn draw<'a>(&'a self) -> char {
        println!("{}", no(1));
        match self.items
            .f{k % 5}(1)? { Some(x) => '{', Other(x) if ok{k % 3}(x) => b{k % 4}::<u8>(2), _ => r#"" no("# }
    }
}
trait T{k % 4} { fn sig(&self); }
mod inner { enum E { A(u8) } pub(crate) async fn deep() { let Named(x) = go(3); } }
""",
    [
        ("import", "", "shop", 0, 0, ""), ("import", "", "n{n}", 0, 0, ""), ("import", "", "Item{k % 7}", 0, 0, ""), ("import", "", "other", 0, 0, ""),
        ("class", "struct", "P{k}", 2, 2, ""), ("class", "impl", "P{k}<T>", 3, 9, ""), ("function", "function", "draw", 4, 8, "P{k}<T>"),
        ("call", "", "f{k % 5}", 6, 6, "draw"), ("call", "", "ok{k % 3}", 7, 7, "draw"), ("call", "", "b{k % 4}", 7, 7, "draw"),
        ("class", "trait", "T{k % 4}", 10, 10, ""), ("function", "function", "sig", 10, 10, "T{k % 4}"),
        ("module", "module", "inner", 11, 11, ""), ("class", "enum", "E", 11, 11, "inner"), ("function", "function", "deep", 11, 11, "inner"), ("call", "", "go", 11, 11, "deep"),
    ],
)
JAVASCRIPT = (
    "mjs",
    """import D{k % 3}, { a{k} as b } from './n{n}.js';
import * as whole from 'whole';
export class C{k} extends mix(Base) {
  run(x) { return this.go{k % 5}(`t ${ inner{k % 4}(`{ ${ most(1) }`) } (`); }
  bound = (y) => later(y)
  static async *each(a = first()) { if (a) { new Box(a).open(); } }
}
const twice = (x) => f{k % 7}(x) / 2; // no()
const g = function() { return hop("no(") };
const own = { key() { return 1; }, other: /[(]no\\/(/g };
""",
    [
        ("import", "", "D{k % 3}", 0, 0, ""), ("import", "", "a{k}", 0, 0, ""), ("import", "", "whole", 1, 1, ""), ("class", "class", "C{k}", 2, 6, ""), ("call", "", "mix", 2, 2, "C{k}"),
        ("function", "method", "run", 3, 3, "C{k}"), ("call", "", "go{k % 5}", 3, 3, "run"), ("call", "", "inner{k % 4}", 3, 3, "run"), ("call", "", "most", 3, 3, "run"),
        ("function", "function", "bound = (y) => later(y)", 4, 4, "C{k}"), ("call", "", "later", 4, 4, "bound = (y) => later(y)"),
        ("function", "method", "each", 5, 5, "C{k}"), ("call", "", "first", 5, 5, "each"), ("call", "", "open", 5, 5, "each"),
        ("function", "function", "const twice = (x) => f{k % 7}(x) / 2; // no()", 7, 7, ""), ("call", "", "f{k % 7}", 7, 7, "const twice = (x) => f{k % 7}(x) / 2; // no()"),
        ("function", "function", "const g = function() { return hop(\"no(\") };", 8, 8, ""), ("call", "", "hop", 8, 8, "const g = function() { return hop(\"no(\") };"),
        ("function", "method", "key", 9, 9, ""),
    ],
)
TYPESCRIPT = (
    "ts",
    """import { type T{k % 3}, A{n} as B } from './x';
interface I{k}<T> { name: string; run(x: T): Promise<{ z: number }>; cb: (x: number) => void }
type Pair{k % 4} = [number, (x: string) => void];
abstract class K{k} implements I{k}<string> {
  @Input() name: string = make{k % 5}<string>(1);
  constructor(private readonly s: Svc) { super(s); }
  abstract q(): void;
  go(a: number): { b: number } { switch (a) { case 1: { one(a); break } default: two(a) } }
}
namespace N{n}.M { export function f(cb: (x: number) => void): void { greet{k % 6}(cb); } top(1); }
enum Color { Red = 1 }
""",
    [
        ("import", "", "T{k % 3}", 0, 0, ""), ("import", "", "A{n}", 0, 0, ""), ("class", "interface", "I{k}", 1, 1, ""), ("function", "method", "run", 1, 1, "I{k}"),
        ("class", "type alias", "Pair{k % 4}", 2, 2, ""), ("class", "class", "K{k}", 3, 8, ""), ("call", "", "Input", 4, 4, "K{k}"), ("call", "", "make{k % 5}", 4, 4, "K{k}"),
        ("function", "method", "constructor", 5, 5, "K{k}"), ("function", "method", "q", 6, 6, "K{k}"), ("function", "method", "go", 7, 7, "K{k}"), ("call", "", "one", 7, 7, "go"), ("call", "", "two", 7, 7, "go"),
        ("module", "namespace", "N{n}.M", 9, 9, ""), ("function", "function", "f", 9, 9, "N{n}.M"), ("call", "", "greet{k % 6}", 9, 9, "f"), ("call", "", "top", 9, 9, ""), ("class", "enum", "Color", 10, 10, ""),
    ],
)
PYTHON = (
    "py",
    """from .n{n}.mod import (a{k} as b,
    c)
import os.path as p, q{k % 3}
@deco{k % 5}(1)
class K{k}(Base, metaclass=make()):
    '''def no(): pass'''
    x = [y(i)
for i in z]
    async def m(self, a=dflt()) -> int:
        return f"{fmt{k % 4}(a)!r:>3} {{no()}}" + obj.one(1)(
            2)

    def g[T](self): pass  # no()
if K{k}:
    def h(): last()
""",
    [
        ("import", "", "mod", 0, 0, ""), ("import", "", "a{k}", 0, 0, ""), ("import", "", "c", 1, 1, ""), ("import", "", "path", 2, 2, ""), ("import", "", "q{k % 3}", 2, 2, ""),
        ("function", "function", "@deco{k % 5}(1)", 3, 12, ""), ("call", "", "deco{k % 5}", 3, 3, "@deco{k % 5}(1)"), ("class", "class", "K{k}", 4, 12, "@deco{k % 5}(1)"), ("call", "", "make", 4, 4, "K{k}"), ("call", "", "y", 6, 6, "K{k}"),
        ("function", "function", "m", 8, 10, "K{k}"), ("call", "", "dflt", 8, 8, "m"), ("call", "", "fmt{k % 4}", 9, 9, "m"), ("call", "", "one", 9, 9, "m"), ("call", "", "one", 9, 9, "m"),
        ("function", "function", "g", 12, 12, "K{k}"), ("function", "function", "h", 14, 14, ""), ("call", "", "last", 14, 14, "h"),
    ],
)
SQL = (
    "sql",
    """-- create table no{k} (x int);
CREATE OR REPLACE TABLE "s{n}".t{k} (
  x varchar default 'a;b'
);
create view if not exists v{k % 9} as /* ; */ select x
from t{k}
""",
    [("class", "table", "s{n}.t{k}", 1, 3, ""), ("class", "view", "v{k % 9}", 4, 5, "")],
)


def text_sql(template: str) -> str:
    """A template as portable SQL: what may clash with formats or quotes is put in by translate()."""
    held = template.replace("\n", "§").replace("'", "¤").replace("\\", "¬")
    parts = re.split(r"\{([kn](?: % \d+)?)\}", held)
    plain = lambda s: "'" + s.replace("{", "«").replace("}", "»").replace("$", "¢") + "'"
    value = lambda e: f"CAST({e.replace('k', 'c_custkey').replace('n', 'c_nationkey')} AS VARCHAR(20))"
    pieces = [plain(p) if i % 2 == 0 else value(p) for i, p in enumerate(parts)]
    return f"translate(concat({', '.join(pieces)}, ''), '§¤¬«»¢', concat(chr(10), chr(39), chr(92), chr(123), chr(125), chr(36)))"


def scanned_sources(spark, sf_dir, ext: str, template: str) -> DataFrame:
    """(path, kind, noun, name, line_start, line_end, of): constructs and raw references, each with the name of what holds it."""
    files = fx.sql(spark, sf_dir, f"SELECT concat('c', CAST(c_custkey AS VARCHAR(20)), '.{ext}') AS path, {text_sql(template)} AS text FROM {{customer}}")
    found = scanner.scanned(files)
    name = lambda at: F.coalesce(F.get(F.col("constructs"), at)["name"], F.lit(""))
    row = lambda c, noun, first, last, of: F.struct(c["kind"].alias("kind"), noun.alias("noun"), c["name"].alias("name"), c[first].alias("line_start"), c[last].alias("line_end"), name(c[of]).alias("of"))
    constructs = F.transform("constructs", lambda c: row(c, c["noun"], "line_start", "line_end", "parent"))
    refs = F.transform("refs", lambda r: row(r, F.lit(""), "line", "line", "src"))
    # both at once, so that each text is scanned once
    return found.select("path", F.explode(F.concat(constructs, refs)).alias("row")).select("path", "row.*")


def _add(name: str, ext: str, template: str, rows: list) -> None:
    def run(spark, sf_dir):
        return scanned_sources(spark, sf_dir, ext, template)

    QUERIES[name] = run
    row = "SELECT concat('c', CAST(c_custkey AS VARCHAR(20)), '.{}') AS path, '{}' AS kind, '{}' AS noun, {} AS name, {} AS line_start, {} AS line_end, {} AS \"of\" FROM customer"
    ORACLES[name] = " UNION ALL ".join(row.format(ext, kind, noun, text_sql(own), first, last, text_sql(of)) for kind, noun, own, first, last, of in rows)


for _name, _case in (("scan_rust", RUST), ("scan_javascript", JAVASCRIPT), ("scan_typescript", TYPESCRIPT), ("scan_python", PYTHON), ("scan_sql", SQL)):
    _add(_name, *_case)

#: A document of a symbol index for each customer: a type, a method of it, an import and a use of another customer's type.
TOOL = "rust-analyzer"
_OWN = "CAST(c_custkey AS VARCHAR(20))"
_TO = "CAST(c_custkey % 7 + 1 AS VARCHAR(20))"
_TYPE = f"concat('rust-analyzer cargo shop 0.1.0 c', {{}}, '/S', {{}}, '#')"
INDEX = f"""SELECT c_custkey AS doc, concat('n', CAST(c_nationkey AS VARCHAR(20)), '/c', {_OWN}, '.rs') AS relative_path, 'utf8' AS position_encoding, '{TOOL}' AS tool,
  array(named_struct('symbol', own, 'range', array(0, 11, 12), 'roles', 1, 'enclosing_range', array(0, 0, 1, 1)), named_struct('symbol', method, 'range', array(3, 7, 8), 'roles', 1, 'enclosing_range', array(3, 4, 5, 5)),
    named_struct('symbol', other, 'range', array(4, 8, 9), 'roles', 0, 'enclosing_range', cast(array() AS array<int>)), named_struct('symbol', other, 'range', array(2, 4, 5), 'roles', 2, 'enclosing_range', cast(array() AS array<int>))) AS occurrences,
  array(named_struct('symbol', own, 'kind', 'Struct', 'display_name', '', 'enclosing_symbol', ''), named_struct('symbol', method, 'kind', 'Method', 'display_name', '', 'enclosing_symbol', '')) AS symbols
FROM (SELECT c_custkey, c_nationkey, {_TYPE.format(_OWN, _OWN)} AS own, {_TYPE.format(_TO, _TO)} AS other, concat('rust-analyzer cargo shop 0.1.0 c', {_OWN}, '/impl#[S', {_OWN}, ']m', {_OWN}, '().') AS method FROM {{customer}})"""


def index_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = fx.sql(spark, sf_dir, INDEX)
    text = F.lit("pub struct S {\n}\n\n    fn m() {\n        S\n    }\n")
    return scip.graph_of(docs, docs.select(F.col("relative_path").alias("path"), text.alias("text")), "shop", TOOL)


def index_entities(spark, sf_dir):
    entities, _ = index_graph(spark, sf_dir)
    above = entities.select(F.col("id").alias("parent"), F.col("path").alias("parent_path"))
    return entities.join(above, "parent", "left").select("path", "kind", "noun", "line_start", "line_end", "byte_start", "byte_end", "parent_path")


def index_refs(spark, sf_dir):
    entities, refs = index_graph(spark, sf_dir)
    end = lambda x: entities.select(F.col("id").alias(x), F.col("path").alias(f"{x}_path"))
    return refs.join(end("src"), "src").join(end("dst"), "dst").select("src_path", "dst_path", "kind", F.element_at("sites", 1).alias("line"))


QUERIES |= {"index_entities": index_entities, "index_refs": index_refs}
_FILES = "f AS (SELECT c_custkey AS k, 'shop/n' || c_nationkey AS folder, 'shop/n' || c_nationkey || '/c' || c_custkey || '.rs' AS path FROM customer)"
ORACLES |= {
    "index_entities": f"""WITH {_FILES} SELECT 'shop' AS path, 'folder' AS kind, CAST(NULL AS VARCHAR) AS noun, 0 AS line_start, 0 AS line_end, 0 AS byte_start, 0 AS byte_end, CAST(NULL AS VARCHAR) AS parent_path
  UNION ALL SELECT DISTINCT folder, 'folder', NULL, 0, 0, 0, 0, 'shop' FROM f UNION ALL SELECT path, 'file', NULL, 0, 5, 0, 47, folder FROM f
  UNION ALL SELECT path || '/S' || k, 'class', 'struct', 0, 1, 0, 16, path FROM f UNION ALL SELECT path || '/S' || k || '/m' || k, 'function', 'method', 3, 5, 22, 46, path || '/S' || k FROM f""",
    "index_refs": f"""WITH {_FILES}, t AS (SELECT a.path, a.k, b.path || '/S' || b.k AS dst_path FROM f a JOIN f b ON b.k = a.k % 7 + 1)
  SELECT path || '/S' || k || '/m' || k AS src_path, dst_path, 'type_ref' AS kind, 4 AS line FROM t UNION ALL SELECT path, dst_path, 'import', 2 FROM t""",
}
