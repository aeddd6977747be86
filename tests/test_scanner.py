"""Scanners of source texts, and a whole tree of files to a graph, with results worked out by hand."""

from __future__ import annotations

from treeloom.plans import scanning
from treeloom.sources import scanner


def found(text, lang):
    constructs, refs = scanner.scan(text, lang)
    return [(c["kind"], c["noun"], c["name"], c["line_start"], c["line_end"], c["depth"]) for c in constructs], [(r["src"], r["name"], r["kind"], r["line"]) for r in refs]


def test_python_by_indentation():
    text = 'import os.path as p\nfrom a.b import c as d, e\n\n@deco(1)\n@two\ndef f(\n    x,\n):\n    """def no(): pass"""\n    return c.g(x)  # h()\n\n\nclass K(Base):\n    def m(self):\n        return f(1)\n\n    y = 2\n'
    constructs, refs = found(text, "python")
    assert constructs == [("function", "function", "@deco(1)", 3, 9, 0), ("function", "function", "f", 5, 9, 1), ("class", "class", "K", 12, 16, 0), ("function", "function", "m", 13, 14, 1)]
    assert refs == [(None, "path", "import", 0), (None, "b", "import", 1), (None, "c", "import", 1), (None, "e", "import", 1), (0, "deco", "call", 3), (1, "g", "call", 9), (3, "f", "call", 14)]


def test_rust_by_braces():
    text = 'use a::b::{c, d as e, *};\nmod inner;\n// fn no() {}\nstruct P { x: i32 }\nimpl Show for P {\n    fn draw(&self) -> char { println!("fn x"); geo::len(self.x); \'{\' }\n}\ntrait T { fn sig(&self); }\n'
    constructs, refs = found(text, "rust")
    assert constructs == [("module", "module", "inner", 1, 1, 0), ("class", "struct", "P", 3, 3, 0), ("class", "impl", "P", 4, 6, 0), ("function", "function", "draw", 5, 5, 1), ("class", "trait", "T", 7, 7, 0), ("function", "function", "sig", 7, 7, 1)]
    assert refs == [(None, "a", "import", 0), (None, "b", "import", 0), (None, "c", "import", 0), (None, "d", "import", 0), (3, "len", "call", 5)]


def test_typescript_and_sql():
    text = 'import { A as B, C } from "./x";\ninterface I { size(): number; }\nclass K extends B {\n  run(a: number): void { if (a) { this.go(a); } }\n}\nconst twice = (x: number) => x * 2;\ntype Pair = [number, number];\nnamespace N { function f() { return new K(); } }\n'
    constructs, refs = found(text, "typescript")
    assert constructs == [("class", "interface", "I", 1, 1, 0), ("function", "method", "size", 1, 1, 1), ("class", "class", "K", 2, 4, 0), ("function", "method", "run", 3, 3, 1), ("function", "function", "const twice = (x: number) => x * 2;", 5, 5, 0), ("class", "type alias", "Pair", 6, 6, 0), ("module", "namespace", "N", 7, 7, 0), ("function", "function", "f", 7, 7, 1)]
    assert refs == [(None, "A", "import", 0), (None, "C", "import", 0), (3, "go", "call", 3)]
    assert found("-- create table no (x int);\nCREATE TABLE t.a (\n x int\n);\ncreate or replace view v as select 1;", "sql")[0] == [("class", "table", "t.a", 1, 3, 0), ("class", "view", "v", 4, 4, 0)]
    assert found("any text f()", "plain") == ([], []) and found("", "python") == ([], [])


def test_javascript_forms_that_have_no_name_of_their_own():
    text = "export default class extends B { m() { go(); } }\nconst f = function() { hop(1) };\nconst c = a ? (x) => yes(x) : (y) => no(y);\nnew Box(in_(1)).then(2);\nconst t = `a ${ `b ${ deep(1) }` } (` + x / 2 / 3;\n/[(]x\\/(/.test(v);\nlast(1)(2)?.(3)\n"
    constructs, refs = found(text, "javascript")
    line = text.split("\n")
    assert [c[2] for c in constructs] == [line[0], "m", line[1], line[2], line[2]]
    assert [(name, row) for _, name, _, row in refs] == [("go", 0), ("hop", 1), ("yes", 2), ("no", 2), ("then", 3), ("in_", 3), ("deep", 4), ("test", 5), ("last", 6), ("last", 6), ("last", 6)]
    assert found("class A {\n  x = one(1)\n  y() { two() }\n  async\n  z() {}\n}", "javascript")[0][1:] == [("function", "method", "y", 2, 2, 1), ("function", "method", "z", 3, 4, 1)]


def test_typescript_tells_types_from_values():
    text = "let a: (x: number) => void = (x) => act(x);\nlet b: { m(): void } = { m() { own(); } };\nfunction over(x: string): void;\nfunction over(x: any): Promise<{ a: 1 }> { return x as (y) => z; }\nswitch (v) { case 1: { w(1); } }\nconst h = async <T>(x: T): Promise<T> => await call<T>(x);\n"
    constructs, refs = found(text, "typescript")
    assert [(c[2], c[3]) for c in constructs] == [("let a: (x: number) => void = (x) => act(x);", 0), ("m", 1), ("m", 1), ("over", 2), ("over", 3), ("const h = async <T>(x: T): Promise<T> => await call<T>(x);", 5)]
    assert [(r[0], r[1]) for r in refs] == [(0, "act"), (2, "own"), (None, "w"), (5, "call")]


def test_rust_patterns_macros_and_paths():
    text = "fn a() { let Some(x) = opt(1) else { return }; for Pair(p, q) in list_of(2) {} vec![no(1)].tail_of(3); x.y\n  .z(4)?; c::d::<Vec<u8>>(5); match r(6) { A(_) | B(_) => {} C { n } if n => s(7), } }\nimpl fmt::Show for geo::P<T> { }\npub use a::{self, b::{c as d, e::*}, f};\n"
    constructs, refs = found(text, "rust")
    assert [(c[1], c[2]) for c in constructs] == [("function", "a"), ("impl", "geo::P<T>")]
    assert [(r[1], r[3]) for r in refs if r[2] == "call"] == [("opt", 0), ("list_of", 0), ("tail_of", 0), ("z", 0), ("Vec", 1), ("r", 1), ("s", 1)]
    assert [r[1] for r in refs if r[2] == "import"] == ["a", "b", "c", "f"]


def test_broken_texts_are_read_to_their_end():
    for lang in ("rust", "javascript", "typescript", "tsx", "python", "sql"):
        for text in ("(((", ")]}", "fn f( {", "class A { m( { x => ", "`${`${", "'", '"""', "def f(:\n x", "/* /*", "impl<", "match x {", "use a::{", "import {", "create table", "r#\"", "@", "a?.(", "type X =", "f'{'", "f'{a(}'"):
            constructs, refs = scanner.scan(text, lang)
            assert all(0 <= c["byte_start"] <= c["byte_end"] <= len(text) for c in constructs)


def test_time_is_linear_in_functions_and_in_depth():
    import time

    def took(n):
        texts = [("".join(f"fn f{i}() {{ g{i}(1); }}\n" for i in range(n)), "rust"), ("class A {" + "".join(f"m{i}(x) {{ return g(x) }}\n" for i in range(n)) + "}", "typescript"), ("fn a() { " * n + "}" * n, "rust"), ("((x) => " * n + ")" * n, "javascript"), ("x = a" + " + b" * n, "rust")]
        best = []
        for text, lang in texts:
            began = time.process_time()
            scanner.scan(text, lang)
            best.append(time.process_time() - began)
        return best

    took(500)
    for few, many in zip(took(1000), took(8000)):
        assert many < 40 * few + 0.5  # eight times the text; the square would be 64 times


def test_a_word_that_begins_a_class_or_function_is_a_construct_on_request():
    names = lambda text, lang: [(c["kind"], c["name"], c["depth"]) for c in scanner.scan(text, lang, keywords=True)[0]]
    assert names("class A:\n    def f(self): pass\n", "python") == [("class", "A", 0), ("class", "class A:", 1), ("function", "f", 1)]
    assert names("export function f() { return class {} }", "typescript") == [("function", "f", 0), ("function", "export function f() { return class {} }", 1), ("class", "export function f() { return class {} }", 1)]


def test_byte_ranges_of_other_letters():
    text = "é = 1\ndef ß():\n    pass\n"
    one = scanner.scan(text, "python")[0][0]
    assert (one["byte_start"], one["byte_end"]) == (7, len("é = 1\ndef ß():\n    pass".encode())) and one["name"] == "ß"


def test_a_tree_of_files_becomes_a_graph(spark):
    files = spark.createDataFrame([("zeta/mod.rs", "mod geo;\n"), ("zeta/geo.rs", "fn area() { shape() }\nfn shape() {}\n"), ("app.py", "from geo import area\n\ndef main():\n    area()\n    area()\n    helper()\n\ndef helper():\n    pass\n"), ("notes.txt", None)], "path string, text string")
    entities, refs = scanner.project(files, "demo")
    rows = sorted(entities.collect(), key=lambda r: r.id)
    assert [(r.id, r.kind, r.name, r.parent) for r in rows] == [(0, "folder", "demo", None), (1, "folder", "zeta", 0), (2, "file", "geo.rs", 1), (3, "function", "area", 2), (4, "function", "shape", 2), (5, "file", "app.py", 0), (6, "function", "main", 5), (7, "function", "helper", 5), (8, "file", "notes.txt", 0)]
    got = {(r.src, r.dst, r.kind, tuple(r.sites)) for r in refs.collect()}
    assert got == {(3, 4, "call", (0,)), (5, 3, "import", (0,)), (6, 3, "call", (3, 4)), (6, 7, "call", (5,))}


def test_a_scan_query_reads_each_text_once_and_on_all_cores(spark, tmp_path):
    spark.range(40).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = scanning.QUERIES["scan_rust"](spark, str(tmp_path))
    assert found.count() == 40 * len(scanning.RUST[2])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_references_are_lifted_from_written_walks(spark, monkeypatch):
    from treeloom.sources import names

    seen, lift = [], names.lift_refs
    monkeypatch.setattr(names, "lift_refs", lambda found, up, kept, dropped: seen.extend([up, kept]) or lift(found, up, kept, dropped))
    files = spark.createDataFrame([("a/x.py", "def one():\n    two()\n\ndef two():\n    pass\n")], "path string, text string")
    scanner.project(files, "r")
    assert len(seen) == 2 and all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)
