"""Queries about containment: ancestors, files, lines, sizes, tests, cuts and where references land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cut, testcode, tree
from ..sources import fixtures as fx
from ..sources.generations import once

CLOSURE = """
closure AS (
  SELECT id, id AS anc, 0 AS hops FROM entities
  UNION ALL SELECT c.id, e.parent, c.hops + 1 FROM closure c JOIN entities e ON c.anc = e.id WHERE e.parent IS NOT NULL)"""


def oracle(body: str, *ctes: str) -> str:
    return fx.duck("WITH RECURSIVE " + ", ".join([fx.GRAPH, CLOSURE, *ctes]) + " " + body)


def tree_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("entities", sf_dir), lambda: fx.entities(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and their closure, written once for each input; what walks down the tree asks entities alone."""
    entities = tree_of(spark, sf_dir)
    return entities, once(spark, ("closure", sf_dir), lambda: tree.closure(entities.select("id", "parent"), fx.HOPS))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("refs", sf_dir), lambda: fx.refs(spark, sf_dir))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(oracle("SELECT anc, count(*) AS n, CAST(max(hops) AS INT) AS deepest FROM closure GROUP BY anc"))
def closure_sizes(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    return up.groupBy("anc").agg(F.count("*").alias("n"), F.max("hops").alias("deepest"))


@query(oracle("SELECT c.id, arg_min(c.anc, c.hops) AS file_id FROM closure c JOIN entities f ON c.anc = f.id WHERE f.kind = 'file' GROUP BY c.id"))
def file_of(spark, sf_dir):
    return tree.file_of(tree_of(spark, sf_dir))


POINTS = f"points AS (SELECT {fx.CUSTOMER} + c_custkey AS file_id, c_custkey % 97 AS line FROM {{customer}} UNION SELECT {fx.CUSTOMER} + c_custkey, (c_custkey * 7) % 401 FROM {{customer}})"
UNDER = "inside AS (SELECT c.id, c.anc AS file_id FROM closure c JOIN entities f ON c.anc = f.id AND f.kind = 'file' WHERE c.hops > 0)"


@query(oracle("""SELECT p.file_id, CAST(p.line AS INT) AS line, coalesce(arg_min(e.id, (e.line_end - e.line_start) * 10 + CASE e.kind WHEN 'class' THEN 0 ELSE 1 END), p.file_id) AS id
  FROM points p LEFT JOIN (SELECT e.*, i.file_id FROM entities e JOIN inside i ON e.id = i.id) e
    ON e.file_id = p.file_id AND p.line BETWEEN e.line_start AND e.line_end AND NOT (e.line_start = 0 AND e.line_end = 0) GROUP BY p.file_id, p.line""", POINTS, UNDER))
def innermost_at(spark, sf_dir):
    points = fx.sql(spark, sf_dir, f"WITH {POINTS} SELECT file_id, CAST(line AS INT) AS line FROM points")
    return tree.innermost(tree_of(spark, sf_dir), None, points)


@query(oracle("SELECT depth, count(*) AS n FROM (SELECT id, CAST(max(hops) AS INT) AS depth FROM closure GROUP BY id) GROUP BY depth"))
def depth_histogram(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    return tree.depth(up).groupBy("depth").agg(F.count("*").alias("n"))


@query(oracle("SELECT id, string_agg(CAST(anc AS VARCHAR), '/' ORDER BY hops DESC) AS chain FROM closure GROUP BY id"))
def lineage(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    return tree.lineage(up).select("id", F.array_join(F.transform("chain", lambda x: x.cast("string")), "/").alias("chain"))


@query(oracle("SELECT c.id, string_agg(e.name, '/' ORDER BY c.hops DESC) AS path FROM closure c JOIN entities e ON c.anc = e.id GROUP BY c.id"))
def display_paths(spark, sf_dir):
    return tree.display_paths(tree_of(spark, sf_dir))


@query(oracle("SELECT id, row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT c.id, list(e.ord ORDER BY c.hops DESC) AS key FROM closure c JOIN entities e ON c.anc = e.id GROUP BY c.id)"))
def preorder_ids(spark, sf_dir):
    return tree.dense_ids(tree.order_key(tree_of(spark, sf_dir)), "key", name="pos").select("id", "pos")


@query(oracle(f"SELECT id FROM closure WHERE anc = {fx.NATION} + 7"))
def subtree(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    return tree.holds(up, fx.NATION + 7)


# Sizes: ranged entities add to what is above them, as far as the next ranged one.
OWN = "own AS (SELECT *, NOT (line_start = 0 AND line_end = 0) AS ranged, CAST(line_end - line_start + 1 AS BIGINT) AS own FROM entities)"
STOPS = """stops AS (SELECT c.id, min(c.hops) AS stop FROM closure c JOIN own a ON c.anc = a.id WHERE a.ranged AND c.hops > 0 GROUP BY c.id)"""


def size_sql(cut_cte: str) -> str:
    return oracle("""SELECT e.id, CAST(coalesce(sum(d.own) FILTER (WHERE d.id IS NOT NULL), 0) AS BIGINT) AS loc FROM own e
      LEFT JOIN (SELECT c.anc, d.id, d.own FROM closure c JOIN own d ON c.id = d.id AND d.ranged JOIN own x ON c.anc = x.id LEFT JOIN stops s ON s.id = c.id LEFT JOIN cuts k ON k.id = c.id
        WHERE c.hops = 0 OR (NOT x.ranged AND (s.stop IS NULL OR c.hops < s.stop) AND (k.at IS NULL OR c.hops < k.at))) d ON d.anc = e.id GROUP BY e.id""", OWN, STOPS, cut_cte)


@query(size_sql("cuts AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS INT) AS at)"))
def loc_rollup(spark, sf_dir):
    return tree.loc(tree_of(spark, sf_dir)).select("id", "loc")


SKIPPED = "id % 11 = 5"


@query(size_sql(f"cuts AS (SELECT c.id, min(c.hops) AS at FROM closure c JOIN closure b ON b.id = c.id AND b.hops = c.hops - 1 WHERE b.anc % 11 = 5 AND c.anc % 11 <> 5 GROUP BY c.id)"))
def loc_rollup_skip(spark, sf_dir):
    return tree.loc(tree_of(spark, sf_dir), None, F.expr(SKIPPED)).select("id", "loc")


OWN_TEST = """marks AS (SELECT id, kind, CASE WHEN kind = 'folder' THEN name IN ('tests', 'test', '__tests__') WHEN kind = 'file' THEN
  (name LIKE '%.py' AND (name = 'conftest.py' OR name LIKE 'test\\_%.py' ESCAPE '\\' OR name LIKE '%\\_test.py' ESCAPE '\\')) OR (name LIKE '%\\_test.go' ESCAPE '\\') OR (name IN ('test.rs', 'tests.rs') OR name LIKE '%\\_tests.rs' ESCAPE '\\') ELSE false END AS own FROM entities)"""
IS_TEST = "tested AS (SELECT c.id, bool_or(m.own) AS is_test FROM closure c JOIN marks m ON c.anc = m.id GROUP BY c.id)"


@query(oracle("SELECT id, own FROM marks", OWN_TEST))
def test_names(spark, sf_dir):
    return testcode.own_marks(tree_of(spark, sf_dir))


@query(oracle("SELECT id, is_test FROM tested", OWN_TEST, IS_TEST))
def test_inherit(spark, sf_dir):
    return testcode.mark(tree_of(spark, sf_dir)).select("id", "is_test")


@query(oracle(f"""SELECT e.id, CAST(coalesce(sum(t.loc), 0) AS BIGINT) AS test_loc FROM entities e LEFT JOIN (
    SELECT c.anc, s.loc FROM closure c JOIN tested d ON c.id = d.id AND d.is_test JOIN tested x ON c.anc = x.id JOIN sized s ON s.id = c.id
    LEFT JOIN (SELECT c.id, min(c.hops) AS stop FROM closure c JOIN tested a ON c.anc = a.id WHERE a.is_test AND c.hops > 0 GROUP BY c.id) p ON p.id = c.id
    WHERE c.hops = 0 OR (NOT x.is_test AND (p.stop IS NULL OR c.hops < p.stop))) t ON t.anc = e.id GROUP BY e.id""", OWN_TEST, IS_TEST, OWN, STOPS, """sized AS (
    SELECT e.id, coalesce(sum(d.own), 0) AS loc FROM own e LEFT JOIN (SELECT c.anc, d.own FROM closure c JOIN own d ON c.id = d.id AND d.ranged JOIN own x ON c.anc = x.id LEFT JOIN stops s ON s.id = c.id
      WHERE c.hops = 0 OR (NOT x.ranged AND (s.stop IS NULL OR c.hops < s.stop))) d ON d.anc = e.id GROUP BY e.id)"""))
def test_loc_rollup(spark, sf_dir):
    entities = tree_of(spark, sf_dir).select("id", "parent", "kind", "name", "line_start", "line_end", "is_test")
    return tree.loc(testcode.mark(entities)).select("id", "test_loc")


def nation_cut(entities: DataFrame) -> DataFrame:
    """Nations and brands, as opening the root and every region gives."""
    top = entities.filter(f"(id >= {fx.NATION} and id < {fx.CUSTOMER}) or (id >= {fx.BRAND} and id < {fx.PART})")
    return top.select(F.col("id").alias("leaf"), F.col("id").alias("pos"))


NATION_CUT = f"cut AS (SELECT id AS leaf FROM entities WHERE (id >= {fx.NATION} AND id < {fx.CUSTOMER}) OR (id >= {fx.BRAND} AND id < {fx.PART}))"
MIXED_CUT = f"""cut AS (SELECT id AS leaf FROM entities WHERE (id >= {fx.NATION} AND id < {fx.NATION} + 12) OR (parent >= {fx.NATION} + 12 AND parent < {fx.CUSTOMER}) OR (id >= {fx.BRAND} AND id < {fx.PART}))"""
SITES = """shown AS (SELECT DISTINCT c.anc FROM cut JOIN closure c ON c.id = cut.leaf),
sites AS (SELECT c.id, arg_min(c.anc, c.hops) AS site FROM closure c JOIN shown s ON c.anc = s.anc GROUP BY c.id)"""
COALESCED = """edges AS (SELECT a.site AS src, b.site AS dst, r.kind, count(*) AS n_refs, min(r.ref_id) AS first_ref FROM refs r JOIN sites a ON r.src = a.id JOIN sites b ON r.dst = b.id WHERE a.site <> b.site GROUP BY ALL)"""


def mixed_cut(entities: DataFrame) -> DataFrame:
    rows = entities.filter(f"(id >= {fx.NATION} and id < {fx.NATION} + 12) or (parent >= {fx.NATION} + 12 and parent < {fx.CUSTOMER}) or (id >= {fx.BRAND} and id < {fx.PART})")
    return rows.select(F.col("id").alias("leaf"), F.col("id").alias("pos"))


@query(oracle("SELECT id, site FROM sites", NATION_CUT, SITES))
def sites(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return cut.sites(up, cut.shown(nation_cut(entities), up))


@query(oracle("SELECT * FROM edges", NATION_CUT, SITES, COALESCED))
def coalesce_nation(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return cut.coalesce_counts(refs(spark, sf_dir), nation_cut(entities), up)


@query(oracle("SELECT a.site AS src, b.site AS dst, r.kind, string_agg(CAST(r.ref_id AS VARCHAR), ',' ORDER BY r.ref_id) AS refs FROM refs r JOIN sites a ON r.src = a.id JOIN sites b ON r.dst = b.id WHERE a.site <> b.site GROUP BY ALL", MIXED_CUT, SITES))
def coalesce_mixed_depth(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    edges = cut.coalesce(refs(spark, sf_dir), mixed_cut(entities), up)
    return edges.select("src", "dst", "kind", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


@query(oracle(f"SELECT id AS leaf FROM entities WHERE parent = 0 AND id <> {fx.REGION} + 1 UNION ALL SELECT id FROM entities WHERE parent = {fx.REGION} + 1"))
def cut_expand(spark, sf_dir):
    entities, _ = graph(spark, sf_dir)
    at = cut.expand(cut.initial(entities), entities, 0)
    return cut.expand(at, entities, fx.REGION + 1).select("leaf")


#: The first leaf of the cut below a region, and what it is shut into.
PICKED = f"picked AS (SELECT parent FROM entities WHERE id = (SELECT min(leaf) FROM cut JOIN closure c ON c.id = cut.leaf AND c.anc = {fx.REGION} + 2))"


@query(oracle("SELECT leaf FROM cut WHERE leaf NOT IN (SELECT id FROM closure JOIN picked ON anc = parent) UNION ALL SELECT parent FROM picked", MIXED_CUT, PICKED))
def cut_collapse(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    at = mixed_cut(entities)
    leaf = at.join(tree.holds(up, fx.REGION + 2).withColumnRenamed("id", "leaf"), "leaf").agg(F.min("leaf")).first()[0]
    return cut.collapse(at, entities, up, leaf).select("leaf")


@query(oracle(f"SELECT leaf FROM cut WHERE leaf NOT IN (SELECT id FROM closure WHERE anc = {fx.REGION} + 3) UNION ALL SELECT {fx.REGION} + 3", MIXED_CUT))
def cut_collapse_box(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return cut.collapse_box(mixed_cut(entities), up, fx.REGION + 3).select("leaf")


@query(oracle(f"""SELECT id AS leaf FROM entities WHERE parent IN (SELECT anc FROM closure WHERE id = {fx.ORDER} + 5 AND hops > 0) AND id NOT IN (SELECT anc FROM closure WHERE id = {fx.ORDER} + 5 AND hops > 0)"""))
def cut_reveal(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return cut.reveal(cut.initial(entities), entities, up, fx.ORDER + 5).select("leaf")
