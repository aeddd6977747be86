"""The stored index against the plain one: equal hits, and plans that read what they need."""

from __future__ import annotations

import random

import numpy as np
import pytest

from treeloom.operators import postings, search, tree


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["needle", "Größe", "the", "thE", "ABBA", "abcbcd", "😀x", "a", "zz", "haystack"]
    rows = [(i, f"f{i}_{rng.choice(words)}.txt", f"d{i % 3}/f{i}.txt", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(500, "none", "d0/none", None), (501, "empty", "", ""), (502, "rare", "d9/rare", "only here: quixotic")]
    files = spark.createDataFrame(rows, "file_id bigint, name string, path string, text string")
    entities = spark.createDataFrame([(1000, "folder", "r", None, 0, 0)] + [(i, "file", f"f{i}", 1000, 0, 9) for i in range(120)] + [(2000 + i, "function", rng.choice(words) + str(i), i, 1, 2) for i in range(120)], "id bigint, kind string, name string, parent bigint, line_start int, line_end int")
    plain = search.index(files, entities, tree.closure(entities.select("id", "parent")))
    path = str(tmp_path_factory.mktemp("store") / "index")
    assert postings.store(plain, path, 8).buckets == 8
    return plain, postings.open_store(spark, path)


@pytest.mark.parametrize("query", ["needle", "content:NEEDLE content:größe", "the", "zz", "a", "path:d1 haystack", "symbol:abba file:needle", "content:quixotic", "content:quixotick", "content:bcbcd path:rare", '"here: qui"', "😀x", "empty", "content:the symbol:nothing"])
def test_stored_and_plain_indexes_agree(indexes, query):
    for limits in (search.ALL, search.Limits(2, 3, 4, 5)):
        plain, stored = (search.hits(ix, query, limits)[0] for ix in indexes)
        rows = lambda df: [] if df is None else sorted(map(tuple, df.drop("doc").collect()), key=repr)
        assert rows(plain) == rows(stored)


def test_frequencies_are_those_of_the_grams(indexes):
    plain, stored = indexes
    for kind in plain.docs:
        want = {r.gram: r["count"] for r in search.grams(plain.docs[kind]).groupBy("gram").count().collect()}
        assert {r.gram: r.df for r in stored.frequencies[kind].collect()} == want
        assert {(r.gram, r.bucket) for r in stored.postings[kind].select("gram", "bucket").collect()} == {(r.gram, r.bucket) for r in stored.postings[kind].select("gram", postings.bucket(stored.postings[kind]["gram"], 8)).collect()}


def test_a_rare_query_reads_its_buckets_and_parts(indexes, spark):
    _, stored = indexes
    found = stored.having("content", search.tokenize("content:quixotic")[0])
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in plan and "dynamicpruning" in plan and "In(gram" in plan
    assert found.count() == 1
    assert stored.rarest("content", {"xyz", "the"}) is None and stored.rarest("content", {"nee"}) == [] or stored.rarest("content", {"nee"}) == ["nee"]


def test_an_empty_index(spark, tmp_path):
    files = spark.createDataFrame([], "file_id bigint, name string, path string, text string")
    stored = postings.store(search.index(files), str(tmp_path / "none"))
    assert search.hits(stored, "anything")[0].count() == 0


def test_a_block_has_one_posting_for_each_gram(spark, tmp_path):
    files = spark.createDataFrame([(i, f"f{i}", f"d/f{i}", "the same line\n" * 50) for i in range(40)], "file_id bigint, name string, path string, text string").coalesce(1)
    stored = postings.store(search.index(files), str(tmp_path / "many"), 4)
    assert {r.df for r in stored.frequencies["content"].collect()} == {2000}
    assert stored.postings["content"].count() <= 11 * 4  # not a row for each gram of each line


def test_blocks_of_many_letters_and_of_gaps():
    numbers = [5, 6, 7, 20, 21]
    assert list(postings._cuts(np.array(numbers), [1] * 5)) == [(0, 3), (3, 5)]
    texts = ["".join(chr(c) for c in range(at, at + 60_000) if not 0xD800 <= c < 0xE000) for at in (0x100, 0x20000, 0x40000, 0x60000, 0x80000)]
    got = {(g, first + a) for b in postings._block(texts, 7) for g, first, at in zip(*(b.column(c).to_pylist() for c in ("gram", "first", "at"))) for a in at}
    assert got == {(t[i : i + 3], 7 + n) for n, t in enumerate(texts) for i in range(len(t) - 2)}


def test_names_and_paths_filter_without_a_join(indexes):
    for ix in indexes:
        found = search.matches(ix, search.tokenize("content:a path:d1 file:needle")[0], "content")
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0
        rows, _ = search.hits(ix, "needle", search.ALL, ("path",))
        assert {r.kind for r in rows.collect()} <= {"path"}
