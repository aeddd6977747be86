"""Symbol indexes: the wire format against an encoder of its own, and graphs worked out by hand."""

from __future__ import annotations

import pytest

from treeloom.sources import scip


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def put(field, value):
    if isinstance(value, int):
        return varint(field << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else b"".join(map(varint, value)) if isinstance(value, list) else value
    return varint(field << 3 | 2) + varint(len(value)) + value


def index(tool, docs):
    """docs: path -> (encoding, occurrences (symbol, range, roles, enclosing), symbols (symbol, kind, name, enclosing))."""
    out = put(1, put(1, 0) + put(2, put(1, tool) + put(2, "1.0")) + put(3, "file:///elsewhere"))
    for path, (encoding, occurrences, symbols) in docs.items():
        body = put(4, "lang") + put(1, path)
        for symbol, range_, roles, enclosing in occurrences:
            body += put(2, put(1, range_) + put(2, symbol) + put(3, roles) + put(5, 12) + (put(7, enclosing) if enclosing else b""))
        for symbol, kind, name, enclosing in symbols:
            body += put(3, put(1, symbol) + put(3, "text") + put(5, kind) + put(6, name) + (put(8, enclosing) if enclosing else b""))
        out += put(2, body + put(6, encoding))
    return out + put(3, put(1, "external"))


R = "rust-analyzer cargo shop 0.1.0 "
SHAPES = "pub struct Point {\n    x: i32,\n}\nimpl Show for Point {\n    fn new() -> Point {\n        Point { x: 1 }\n    }\n}\n#[test]\nfn checks() {\n    Point::new();\n}\n"
MAIN = "mod shapes;\nuse shapes::Point;\n\nfn main() {\n    Point::new();\n    local();\n}\n"
RUST = {
    "src/shapes.rs": (1, [
        (R + "shapes/", [0, 0, 0], 1, [0, 0, 12, 0]),
        (R + "shapes/Point#", [0, 11, 16], 1, [0, 0, 2, 1]),
        (R + "shapes/impl#[Point][Show]new().", [4, 7, 10], 1, [4, 4, 6, 5]),
        (R + "shapes/Point#", [4, 16, 21], 0, None),
        (R + "shapes/Point#", [5, 8, 13], 0, None),
        (R + "shapes/checks().", [9, 3, 9], 1, [8, 0, 11, 1]),
        (R + "shapes/Point#", [10, 4, 9], 0, None),
        (R + "shapes/impl#[Point][Show]new().", [10, 11, 14], 0, None),
        ("local 1", [5, 0, 1], 1, None),
        (R + "shapes/Point#x.", [1, 4, 5], 1, None),
    ], [(R + "shapes/", 29, "shapes", ""), (R + "shapes/Point#", 49, "Point", ""), (R + "shapes/impl#[Point][Show]new().", 70, "new", ""), (R + "shapes/checks().", 17, "checks", ""), (R + "shapes/Point#x.", 15, "x", "")]),
    "src/main.rs": (1, [
        (R + "main/", [0, 0, 0], 1, None),
        (R + "shapes/", [0, 4, 10], 0, None),
        (R + "shapes/", [1, 4, 10], 0, None),
        (R + "shapes/Point#", [1, 12, 17], 0, None),
        (R + "main/main().", [3, 3, 7], 1, [3, 0, 6, 1]),
        (R + "shapes/Point#", [4, 4, 9], 0, None),
        (R + "shapes/impl#[Point][Show]new().", [4, 11, 14], 0, None),
        (R + "unknown/x().", [5, 4, 9], 0, None),
        (R + "shapes/Point#", [-1, 4, 9], 0, None),
    ], [(R + "main/", 29, "main", ""), (R + "main/main().", 17, "main", "")]),
    "../out.rs": (1, [(R + "out/f().", [0, 0, 1], 1, [0, 0, 1, 1])], []),
}


def build(spark, tmp_path, tool, docs, texts, name="proj"):
    (tmp_path / "index.scip").write_bytes(index(tool, docs))
    sources = spark.createDataFrame(list(texts.items()) or [("none", None)], "path string, text string")
    entities, refs = scip.graph_of(scip.read_index(spark, str(tmp_path / "index.scip")), sources, name)
    rows = sorted(entities.collect(), key=lambda r: r.id)
    path = {r.id: r.path for r in rows}
    assert [r.id for r in rows] == list(range(len(rows)))
    return rows, {(path[r.src], path[r.dst], r.kind): list(r.sites) for r in refs.collect()}


def test_methods_hang_under_their_type_and_paths_name_their_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scip, "TASK_BYTES", 1)  # a task for each document
    monkeypatch.setattr(scip, "WINDOW", 32)
    rows, refs = build(spark, tmp_path, "rust-analyzer", RUST, {"src/shapes.rs": SHAPES, "src/main.rs": MAIN})
    got = [(r.kind, r.path, r.line_start, r.line_end) for r in rows]
    assert got == [
        ("folder", "proj", 0, 0), ("folder", "proj/src", 0, 0), ("file", "proj/src/main.rs", 0, 6), ("file", "proj/src/shapes.rs", 0, 11), ("function", "proj/src/main.rs/main", 3, 6),
        ("class", "proj/src/shapes.rs/Point", 0, 2), ("function", "proj/src/shapes.rs/Point/new", 4, 6), ("function", "proj/src/shapes.rs/checks", 8, 11),
    ]
    by = {r.path: r for r in rows}
    new = by["proj/src/shapes.rs/Point/new"]
    assert SHAPES[new.byte_start : new.byte_end].startswith("fn new()") and SHAPES[: new.byte_end].endswith("    }") and new.noun == "method"
    assert by["proj/src/shapes.rs/checks"].is_test and not new.is_test
    assert refs == {
        ("proj/src/main.rs", "proj/src/shapes.rs", "generic"): [0],
        ("proj/src/main.rs", "proj/src/shapes.rs/Point", "import"): [1],
        ("proj/src/main.rs/main", "proj/src/shapes.rs/Point/new", "call"): [4],
        ("proj/src/shapes.rs/Point/new", "proj/src/shapes.rs/Point", "type_ref"): [4, 5],
        ("proj/src/shapes.rs/checks", "proj/src/shapes.rs/Point/new", "call"): [10],
    }


def test_missing_sources_keep_lines_and_have_no_imports(spark, tmp_path):
    rows, refs = build(spark, tmp_path, "rust-analyzer", RUST, {})
    assert {(r.line_start, r.line_end, r.byte_start, r.byte_end) for r in rows if r.name == "new"} == {(4, 6, 0, 0)}
    assert "import" not in {kind for _, _, kind in refs} and refs["proj/src/main.rs", "proj/src/shapes.rs/Point", "type_ref"] == [1]


def test_unknown_tools_have_no_blocks_and_no_imports(spark, tmp_path):
    rows, refs = build(spark, tmp_path, "other-tool", RUST, {"src/shapes.rs": SHAPES, "src/main.rs": MAIN})
    assert "proj/src/shapes.rs/new" in {r.path for r in rows} and "import" not in {kind for _, _, kind in refs}


def test_packages_are_folders_and_columns_count_code_units(spark, tmp_path):
    g = "scip-go gomod shop . "
    docs = {
        "geo/a.go": (0, [(g + "`shop/geo`/", [0, 8, 11], 1, None), (g + "`shop/geo`/Area().", [2, 5, 9], 1, [2, 0, 4, 1])], [(g + "`shop/geo`/", 35, "geo", ""), (g + "`shop/geo`/Area().", 17, "Area", "")]),
        "geo/b.go": (0, [(g + "`shop/geo`/", [0, 8, 11], 1, None)], [(g + "`shop/geo`/", 35, "geo", "")]),
        "use.go": (0, [(g + "`shop/geo`/", [3, 3, 8], 0, None), (g + "`shop/geo`/Area().", [7, 5, 9], 0, None), (g + "`shop`/main().", [6, 5, 9], 1, [6, 0, 8, 1])], [(g + "`shop`/main().", 17, "main", "")]),
    }
    rows, refs = build(spark, tmp_path, "scip-go", docs, {"geo/a.go": "package geo\n\nfunc Area() {\n\n}\n", "geo/b.go": "package geo\n", "use.go": 'package main\n\nimport (\n\t"shop/geo"\n)\n\nfunc main() {\n\tgeo.Area()\n}\n'})
    assert refs == {("proj/use.go", "proj/geo", "import"): [3], ("proj/use.go/main", "proj/geo/a.go/Area", "call"): [7]}
    t = "scip-typescript npm shop 1.0.0 "
    text = "/* 😀 */ function shout() {}\nfunction é() { shout(); }\n"
    docs = {"a.ts": (0, [(t + "`a.ts`/", [0, 0, 0], 1, [0, 0, 2, 0]), (t + "`a.ts`/shout().", [0, 18, 23], 1, [0, 9, 0, 28]), (t + "`a.ts`/é().", [1, 9, 10], 1, [1, 0, 1, 25]), (t + "`a.ts`/shout().", [1, 15, 20], 0, None)], [])}
    rows, refs = build(spark, tmp_path, "scip-typescript", docs, {"a.ts": text})
    by = {r.name: r for r in rows}
    raw = text.encode()
    assert raw[by["shout"].byte_start : by["shout"].byte_end].decode() == "function shout() {}" and raw[by["é"].byte_start : by["é"].byte_end].decode() == "function é() { shout(); }"
    assert refs == {("proj/a.ts/é", "proj/a.ts/shout", "call"): [1]}


def test_empty_and_broken_indexes(spark, tmp_path):
    rows, refs = build(spark, tmp_path, "x", {}, {})
    assert [(r.kind, r.path) for r in rows] == [("folder", "proj")] and refs == {}
    (tmp_path / "bad.scip").write_bytes(index("x", RUST)[:-30])
    with pytest.raises(Exception, match="beyond"):
        scip.read_index(spark, str(tmp_path / "bad.scip")).collect()
    for raw in (b"\xff" * 12, b"\x0a"):
        with pytest.raises(scip.BadIndex):
            list(scip.fields(raw))


def test_command_line_reads_an_index(spark, tmp_path, capsys):
    from treeloom.plans import load

    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src/shapes.rs").write_text(SHAPES)
    (root / "src/main.rs").write_text(MAIN)
    (tmp_path / "index.scip").write_bytes(index("rust-analyzer", RUST))
    load.main([str(root), "--scip-index", str(tmp_path / "index.scip"), "--ask", "search:symbol:new"], spark)
    assert '"path":"src/shapes.rs"' in capsys.readouterr().out
