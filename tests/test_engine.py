"""The engine over two generations."""

from __future__ import annotations

import json

import pytest

from treeloom.plans import load
from treeloom.plans.engine import Engine, Snapshot, Unchanged
from treeloom.plans.load import arguments
from treeloom.sources.scan import SourceError
from treeloom.streaming.live import Stale

ENTITIES = "id bigint, kind string, noun string, name string, parent bigint, ord bigint, path string, line_start int, line_end int, is_test boolean"


def snapshot(spark, names):
    rows = [(0, "folder", None, "p", None, 0, "p", 0, 0, False)]
    rows += [(i, "file", None, n, 0, i, f"p/{n}", 0, 4, False) for i, n in enumerate(names, 1)]
    rows += [(10 + i, "function", "fn", f"f{i}", i, 0, f"p/{n}/f{i}", 1, 2, False) for i, n in enumerate(names, 1)]
    refs = spark.createDataFrame([(0, 11, 12, "call", [1])], "ref_id bigint, src bigint, dst bigint, kind string, sites array<int>")
    files = spark.createDataFrame([(i, n, n, f"fn f{i}() 😀 main\n") for i, n in enumerate(names, 1)], "file_id bigint, name string, path string, text string")
    return Snapshot(spark.createDataFrame(rows, ENTITIES), refs, files, 3)


def test_requests_and_rebuilds(spark):
    loads = iter([["a.rs", "b.rs"], ["a.rs", "c.rs"]])
    engine = Engine(lambda: snapshot(spark, next(loads)), automatic=False)
    engine.zoom_in(0, 1)
    assert [json.loads(r.json) for r in engine.coalesced().collect()] == [{"from": 1, "to": 2, "kind": "call", "refs": [0]}]
    with pytest.raises(Unchanged):
        engine.zoom_in(11, 1)
    with pytest.raises(Stale):
        engine.zoom_out(1, 7)
    hit = json.loads(next(r.json for r in engine.search("main").collect()))
    assert (hit["start"], hit["end"]) == (11, 15) and engine.search(" ") is None
    assert engine.source("a.rs").startswith("fn f1")
    node = json.loads(next(r.json for r in engine.graph()["nodes"].collect() if r.id == 1))
    assert node["loc"] == 5 and "is_test" not in node and "noun" not in node
    assert engine.reload() and engine.status()["generation"] == 2
    assert {r.leaf for r in engine.live.cut.collect()} == {1, 2}
    assert {(r.old_id, r.new_id) for r in engine.graph(1)["remap"].collect()} == {(0, 0), (1, 1), (2, None), (11, 11), (12, None)}
    engine.reset(2)
    assert {r.leaf for r in engine.live.cut.collect()} == {0}


OLD = {"src/lib.rs": "use a::b;\n\n/// Doc.\nfn alpha() {\n    beta();\n}\nfn beta() {}\n", "src/gone.rs": "fn gone() {\n    alpha();\n}\n", "tests/old.rs": "fn t() {}\n", "same.py": "def f(): pass\n"}
NEW = {"src/lib.rs": "use a::b;\n\n/// Doc, revised.\nfn alpha() {\n    beta();\n}\nfn beta() {}\n", "src/fresh.rs": "fn fresh() {\n    beta();\n}\n", "same.py": "def f(): pass\n"}


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    out = {}
    for name, files in (("base", OLD), ("work", NEW)):
        out[name] = tmp_path_factory.mktemp(name) / "proj"
        for path, text in files.items():
            (out[name] / path).parent.mkdir(parents=True, exist_ok=True)
            (out[name] / path).write_text(text)
    return out


def test_two_sided_snapshot(spark, roots):
    engine = Engine(lambda: load.snapshot(spark, str(roots["work"]), str(roots["base"]), "0123abcd"))
    graph = {part: [json.loads(r.json) for r in rows.collect()] for part, rows in engine.graph().items()}
    assert graph["diff"] == [{"base": "proj", "base_commit": "0123abcd"}]
    node = {(n["kind"], n["name"]): n for n in graph["nodes"]}
    said = {k: (n["status"], n["added"], n["removed"]) for k, n in node.items()}
    assert said == {
        ("folder", "proj"): ("modified", 4, 5), ("folder", "src"): ("modified", 4, 4), ("folder", "tests"): ("removed", 0, 1), ("file", "lib.rs"): ("modified", 1, 1), ("function", "alpha"): ("modified", 1, 1),
        ("function", "beta"): ("same", 0, 0), ("file", "gone.rs"): ("removed", 0, 3), ("function", "gone"): ("removed", 0, 3), ("file", "fresh.rs"): ("added", 3, 0), ("function", "fresh"): ("added", 3, 0),
        ("file", "old.rs"): ("removed", 0, 1), ("function", "t"): ("same", 0, 0), ("file", "same.py"): ("same", 0, 0), ("function", "f"): ("same", 0, 0),
    } | {("function", "t"): ("removed", 0, 0)}
    assert node["file", "old.rs"]["is_test"] and node["function", "t"]["is_test"] and "is_test" not in node["function", "fresh"]
    assert node["folder", "src"]["loc"] == 7 + 3 and node["file", "gone.rs"]["loc"] == 3  # what is gone counts to itself alone
    name = {n["id"]: n["name"] for n in graph["nodes"]}
    assert {(name[r["from"]], name[r["to"]], r["status"]) for r in graph["references"]} == {("alpha", "beta", "same"), ("gone", "alpha", "removed"), ("fresh", "beta", "added")}
    found = engine.source(node["function", "alpha"]["id"])
    assert (found["path"], found["text"], found["old_text"]) == ("src/lib.rs", NEW["src/lib.rs"], OLD["src/lib.rs"])
    assert found["ops"] == [["=", 0, 2, 0, 2], ["-", 2, 1, 2, 0], ["+", 3, 0, 2, 1], ["=", 3, 4, 3, 4]]
    assert engine.source(node["function", "gone"]["id"])["text"] == "" and "ops" not in engine.source(node["function", "f"]["id"])
    with pytest.raises(SourceError):
        engine.source(node["folder", "src"]["id"])
    hit = lambda q: {(json.loads(r.json)["kind"], json.loads(r.json)["path"]) for r in engine.search(q).collect()}
    assert ("content", "src/gone.rs") in hit("gone") and hit("revised") == {("content", "src/lib.rs")} and not hit('content:"/// Doc."')
    engine.zoom_in(node["folder", "proj"]["id"], 1)
    engine.zoom_in(node["folder", "src"]["id"], 1)
    assert {(name[e["from"]], name[e["to"]], e["status"]) for e in (json.loads(r.json) for r in engine.coalesced().collect())} == {("gone.rs", "lib.rs", "removed"), ("fresh.rs", "lib.rs", "added")}


def test_command_line_and_single_files(spark, roots, capsys):
    load.main([str(roots["work"]), "--ask", "dump"], spark)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "0 folder proj 0..0 <- -" and lines[-1].endswith(" call @4") and len(lines) == 9 + 2
    load.main([str(roots["work"] / "src/lib.rs"), "--ask", "dump"], spark)
    assert capsys.readouterr().out.splitlines() == ["0 file lib.rs 0..6 <- -", "1 function alpha 3..5 <- 0", "2 function beta 6..6 <- 0"]
    load.main([str(roots["work"]), "--diff", str(roots["base"]), "--ask", "search:symbol:fresh"], spark)
    assert json.loads(capsys.readouterr().out)["text"] == "fresh"
    load.main([str(roots["work"]), "--ask", "status"], spark)
    assert json.loads(capsys.readouterr().out)["generation"] == 1
    with pytest.raises(SystemExit):
        load.main([str(roots["work"]), "--ask", "nothing"], spark)


def test_arguments():
    assert arguments(["--diff", "HEAD", "x"]).diff == "HEAD"
    for bad in (["--scip", "--scip-index", "f", "x"], ["--diff", "HEAD", "--scip-index", "f", "x"]):
        with pytest.raises(SystemExit):
            arguments(bad)


def test_sessions_agree_between_stream_and_table(spark, tmp_path):
    from treeloom.streaming import live

    events = spark.sql("select timestamp_micros(id * id * 40000) ts, 'src/a.rs' path from range(12)")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.sessions(spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in")), "300 milliseconds", "1 second")
    query = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    table = {(r.first, r.n) for r in live.batches(events, "300 milliseconds").collect()}
    # in append mode the last batch is still open: a later event may belong to it
    closed = {(r.first, r.n) for r in spark.table("closed").collect()}
    assert closed < table and len(table) - len(closed) <= 4 and closed


def test_changes_between_listings(tmp_path):
    from treeloom.sources import changes

    (tmp_path / "target").mkdir()
    for name in ("a.rs", "b.rs", ".hidden", "target/x"):
        (tmp_path / name).write_text("1")
    before = changes.listing(str(tmp_path))
    assert sorted(before) == ["a.rs", "b.rs"] and changes.changes(before, before) == []
    (tmp_path / "a.rs").write_text("longer")
    (tmp_path / "b.rs").unlink()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.rs").write_text("1")
    assert [x[:2] for x in changes.changes(before, changes.listing(str(tmp_path)))] == [("a.rs", "modified"), ("b.rs", "removed"), ("sub/c.rs", "added")]


def test_a_burst_of_changes_is_one_rebuild_and_so_is_the_last(spark, tmp_path):
    import time

    from treeloom.streaming import live

    root = tmp_path / "tree"
    root.mkdir()
    (root / "old.rs").write_text("fn old() {}")
    seen = []
    generations = live.Generations(lambda: seen.append(sorted(p.name for p in root.iterdir())) or seen[-1])
    query = live.follow(live.watch(spark, str(root)), generations, str(tmp_path / "cp"), gap_ms=1500)
    try:
        def settled(n):
            until = time.time() + 90
            while len(seen) < n and time.time() < until and query.isActive:
                time.sleep(0.2)
            assert len(seen) == n, (seen, query.exception())

        until = time.time() + 90
        while query.lastProgress is None and time.time() < until:
            time.sleep(0.2)
        for i in range(4):
            (root / f"f{i}.rs").write_text(str(i))
            time.sleep(0.2)
        settled(1)
        assert seen[0] == ["f0.rs", "f1.rs", "f2.rs", "f3.rs", "old.rs"]
        (root / "old.rs").write_text("fn old() { changed() }")
        (root / ".ignored").write_text("x")
        (root / "f0.rs").unlink()
        settled(2)  # no later event closes it
        time.sleep(3)
        assert len(seen) == 2 and generations.number == 2 and not generations.dirty
    finally:
        query.stop()
