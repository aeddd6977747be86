"""Queries about what a view shows and where: order, ports, hits on rectangles, layers, line operations, served files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import cut, diff, goto, layout, search, testcode
from ..sources import fixtures as fx
from ..sources import scanner
from ..sources.fixtures import SOURCES
from ..sources.generations import once
from .corpus import ASKED, PLACES, asked
from .trees import IS_TEST, NATION_CUT, OWN_TEST, SITES, graph, nation_cut, oracle, tree_of
from .trees import refs as all_refs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Customers as rectangles on their nation's canvas.
NODES = "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS level, CAST(c_custkey * 7 % 331 AS INT) AS x, CAST(c_custkey * 13 % 97 AS INT) AS y, CAST(c_custkey % 5 + 1 AS INT) AS w, CAST(c_custkey % 3 + 1 AS INT) AS h, c_custkey % 4 = 0 AS is_box, CAST(c_custkey % 6 AS INT) AS depth, CAST(c_custkey AS BIGINT) AS ord FROM {customer}"
POINTS = "SELECT CAST(o_orderkey AS BIGINT) AS point, CAST(o_orderkey % 331 AS INT) AS px, CAST(o_custkey % 97 AS INT) AS py FROM {orders}"


@query(fx.duck(f"SELECT id, level, CAST(row_number() OVER (PARTITION BY level ORDER BY y, x, id) - 1 AS INT) AS nth FROM ({NODES})"))
def reading_order(spark, sf_dir):
    return layout.reading_order(fx.sql(spark, sf_dir, NODES)).select("id", "level", F.col("nth").cast("int").alias("nth"))


HOLDS = "px >= x AND px < x + w AND py >= y AND py < y + h"


@query(fx.duck(f"SELECT p.point, min(n.id) AS id FROM ({POINTS}) p JOIN ({NODES}) n ON {HOLDS} WHERE NOT is_box GROUP BY p.point"))
def leaf_at(spark, sf_dir):
    return layout.leaf_at(fx.sql(spark, sf_dir, NODES), fx.sql(spark, sf_dir, POINTS))


@query(fx.duck(f"SELECT point, arg_max(id, CAST(depth AS BIGINT) * 1000000000 + id) AS id FROM ({POINTS}) p JOIN ({NODES}) n ON {HOLDS} WHERE is_box AND NOT (px >= x + 1 AND px < x + w - 1 AND py >= y + 1 AND py < y + h - 1) GROUP BY point"))
def handle_at(spark, sf_dir):
    # boxes of one depth overlap here, which no layout gives; the larger id is made the deeper
    nodes = fx.sql(spark, sf_dir, NODES).withColumn("depth", F.col("depth").cast("bigint") * 1_000_000_000 + F.col("id"))
    return layout.handle_at(nodes, fx.sql(spark, sf_dir, POINTS))


@query(fx.duck(f"""SELECT id, arg_min(next, (far, cost, ord)) AS next FROM (SELECT a.id, b.id AS next, b.ord, abs((b.y + b.h / 2.0) - (a.y + a.h / 2.0)) > ((b.x + b.w / 2.0) - (a.x + a.w / 2.0)) / 2 AS far,
  ((b.x + b.w / 2.0) - (a.x + a.w / 2.0)) / 2 + 2 * abs((b.y + b.h / 2.0) - (a.y + a.h / 2.0)) AS cost FROM ({NODES}) a JOIN ({NODES}) b ON a.level = b.level AND a.id <> b.id WHERE (b.x + b.w / 2.0) > (a.x + a.w / 2.0)) GROUP BY id"""))
def nearest_right(spark, sf_dir):
    return layout.nearest(fx.sql(spark, sf_dir, NODES), (1, 0))


ENDS = "SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS edge, CASE WHEN l_quantity > 25 THEN 'src' ELSE 'dst' END AS end, CAST(l_suppkey AS BIGINT) AS node, CAST(l_partkey % 4 AS INT) AS side, CAST(l_partkey % 101 AS INT) AS far FROM {lineitem}"


@query(fx.duck(f'SELECT edge, "end", CAST(row_number() OVER (PARTITION BY node, side ORDER BY far, edge) - 1 AS INT) AS slot, count(*) OVER (PARTITION BY node, side) AS slots FROM ({ENDS.replace("AS end", """AS "end" """)})'))
def port_slots(spark, sf_dir):
    return layout.port_slots(fx.sql(spark, sf_dir, ENDS)).select("edge", "end", F.col("slot").cast("int").alias("slot"), "slots")


@query(oracle("SELECT DISTINCT a.parent AS level, a.anc AS src, b.anc AS dst FROM refs r JOIN child a ON a.id = r.src JOIN child b ON b.id = r.dst AND b.parent = a.parent WHERE a.anc <> b.anc",
    "child AS (SELECT c.id, c.anc, e.parent FROM closure c JOIN entities e ON e.id = c.anc WHERE e.parent IS NOT NULL)"))
def lift_to_level(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    return layout.lift_to_level(all_refs(spark, sf_dir), up)


#: Brands that follow one another in a year: each brand points at all larger ones of the same order.
FOLLOWS = """years AS (SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS level, o_orderkey AS k, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS b
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey)"""


@query(fx.duck(f"""WITH RECURSIVE {FOLLOWS}, steps AS (SELECT DISTINCT a.level, a.b AS src, c.b AS dst FROM years a JOIN years c ON a.k = c.k AND a.level = c.level AND a.b < c.b),
  paths AS (SELECT DISTINCT level, b AS id, 0 AS n FROM years UNION SELECT s.level, s.dst, p.n + 1 FROM paths p JOIN steps s ON s.level = p.level AND s.src = p.id)
  SELECT level, id, CAST(max(n) AS INT) AS rank FROM paths GROUP BY level, id"""))
def layers(spark, sf_dir):
    years = fx.sql(spark, sf_dir, f"WITH {FOLLOWS} SELECT * FROM years")
    pairs = years.alias("a").join(years.alias("c"), (F.col("a.k") == F.col("c.k")) & (F.col("a.level") == F.col("c.level")) & (F.col("a.b") < F.col("c.b")))
    edges = pairs.select("a.level", F.col("a.b").alias("src"), F.col("c.b").alias("dst")).distinct().withColumn("pos", F.col("src") * 1000 + F.col("dst"))
    return layout.layered(years.select("level", F.col("b").alias("id")).distinct(), edges).select("level", "id", "rank")


@query(oracle("""SELECT ask, min(site) AS site FROM (SELECT DISTINCT t.ask, s.site FROM (SELECT DISTINCT a.ask, p.dst FROM asked a JOIN places p ON a.file_id = p.file_id AND a.line = p.line AND p.name = a.token) t JOIN sites s ON s.id = t.dst)
  GROUP BY ask HAVING count(*) = 1""", ASKED, PLACES, NATION_CUT, SITES))
def drawn_target(spark, sf_dir):
    entities = tree_of(spark, sf_dir)
    return goto.drawn_target(goto.targets(*asked(spark, sf_dir, False)), entities, cut.shown(nation_cut(entities), entities))


@query(oracle(f"""SELECT id AS file_id FROM tested WHERE NOT is_test AND id IN (SELECT id FROM entities WHERE kind = 'file')
  AND id NOT IN (SELECT id FROM closure WHERE anc = {fx.NATION} + 3) AND id IN (SELECT id FROM closure WHERE anc = {fx.REGION} + 1)""", OWN_TEST, IS_TEST))
def visible_files(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    found = entities.filter("kind = 'file'").select(F.col("id").alias("file_id"))
    return search.visible(found, testcode.mark(entities, up), up, False, [fx.NATION + 3], fx.REGION + 1)


#: Two versions of each document: alike, gone, longer at the end, new, or with a line in front.
SIDES = """SELECT doc_id AS file_id, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE text END AS old_text,
  CASE doc_id % 5 WHEN 1 THEN NULL WHEN 2 THEN concat(text, chr(10), 'the very last line') WHEN 4 THEN concat('a line in front', chr(10), text) ELSE text END AS new_text FROM {documents}"""


def work(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pairs = fx.sql(spark, sf_dir, SIDES)
    return pairs, once(spark, ("file work", sf_dir), lambda: diff.file_work(pairs))


SMALL = "(old_text IS NULL OR octet_length(encode(old_text)) <= 1048576) AND (new_text IS NULL OR octet_length(encode(new_text)) <= 1048576)"
STATUS = "CASE WHEN old_text IS NULL AND new_text IS NULL THEN 'same' WHEN old_text IS NULL THEN 'added' WHEN new_text IS NULL THEN 'removed' WHEN old_text = new_text THEN 'same' ELSE 'modified' END"


@query(fx.duck(f"SELECT file_id, status, status <> 'same' AND small AS diffable FROM (SELECT file_id, {STATUS} AS status, {SMALL} AS small FROM ({SIDES}))"))
def file_status(spark, sf_dir):
    return work(spark, sf_dir)[1].select("file_id", "status", "diffable")


#: The operations of every document: n lines (the last perhaps without an end), and what each case makes of them.
OPS = """counted AS (SELECT doc_id AS file_id, doc_id % 5 AS c, text, len(CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END) AS n, text <> '' AND l[-1] <> '' AS open FROM (SELECT *, string_split(text, chr(10)) AS l FROM {documents})),
kept AS (SELECT *, n - CASE WHEN open THEN 1 ELSE 0 END AS k FROM counted),
ops AS (SELECT file_id, 0 AS nth, 'delete' AS tag, 0 AS old_start, n AS old_len, 0 AS new_start, 0 AS new_len FROM kept WHERE c = 1
  UNION ALL SELECT file_id, 0, 'insert', 0, 0, 0, n FROM kept WHERE c = 3
  UNION ALL SELECT file_id, 0, 'insert', 0, 0, 0, 1 FROM kept WHERE c = 4 UNION ALL SELECT file_id, 1, 'equal', 0, n, 1, n FROM kept WHERE c = 4 AND n > 0
  UNION ALL SELECT file_id, 0, 'equal', 0, k, 0, k FROM kept WHERE c = 2 AND k > 0 UNION ALL SELECT file_id, 1, 'delete', k, 1, k, 0 FROM kept WHERE c = 2 AND open UNION ALL SELECT file_id, 2, 'insert', n, 0, k, 2 FROM kept WHERE c = 2)"""


@query(fx.duck(f"WITH {OPS} SELECT file_id, tag, CAST(old_start AS INT) AS old_start, CAST(old_len AS INT) AS old_len, CAST(new_start AS INT) AS new_start, CAST(new_len AS INT) AS new_len FROM ops"))
def line_ops(spark, sf_dir):
    return work(spark, sf_dir)[1].select("file_id", F.explode("ops").alias("op")).select("file_id", "op.*")


@query(fx.duck(f"""WITH {OPS}, sides AS (SELECT file_id, string_split(old_text, chr(10)) AS o, string_split(new_text, chr(10)) AS w FROM ({SIDES})),
  rows AS (SELECT file_id, nth, tag, unnest(range(0, greatest(old_len, new_len))) AS i, old_start, new_start FROM ops WHERE greatest(old_len, new_len) > 0)
  SELECT r.file_id, CAST(row_number() OVER (PARTITION BY r.file_id ORDER BY nth, i) - 1 AS INT) AS pos, CASE WHEN tag <> 'insert' THEN CAST(old_start + i AS INT) END AS old_line, CASE WHEN tag <> 'delete' THEN CAST(new_start + i AS INT) END AS new_line, tag,
  md5(CASE WHEN tag <> 'delete' THEN w[new_start + i + 1] ELSE o[old_start + i + 1] END) AS digest FROM rows r JOIN sides s ON s.file_id = r.file_id"""))
def diff_listing(spark, sf_dir):
    pairs, done = work(spark, sf_dir)
    side = lambda c: pairs.filter(F.col(c).isNotNull()).select("file_id", F.posexplode(lines(F.col(c))).alias("line", "text"))
    rows = diff.listing(done, side("old_text"), side("new_text"))
    return rows.select("file_id", F.col("pos").cast("int").alias("pos"), "old_line", "new_line", "tag", F.md5("text").alias("digest"))


@query(fx.duck(f"""SELECT p.file_id, md5(CASE WHEN status <> 'same' AND small THEN coalesce(new_text, old_text) ELSE coalesce(d.text, new_text, old_text) END) AS digest, CASE WHEN status = 'removed' THEN 'old' ELSE 'new' END AS side
  FROM (SELECT *, {STATUS} AS status, {SMALL} AS small FROM ({SIDES})) p LEFT JOIN (SELECT doc_id, concat(text, ' on disk') AS text FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = p.file_id"""))
def served_sources(spark, sf_dir):
    pairs, done = work(spark, sf_dir)
    disk = fx.sql(spark, sf_dir, "SELECT doc_id AS file_id, concat(text, ' on disk') AS text FROM {documents} WHERE doc_id % 2 = 0")
    return diff.served(pairs, done, disk).select("file_id", F.md5("text").alias("digest"), "side")


@query(fx.duck(f"""WITH s AS ({SOURCES}) SELECT path, 'class' AS kind, 'C' || k AS name, 0 AS line_start, 2 AS line_end, 0 AS depth FROM s
  UNION ALL SELECT path, 'function', 'm' || k % 5, 1, 2, 1 FROM s UNION ALL SELECT path, 'function', 'f' || k % 11, 4, 5, 0 FROM s"""))
def scan_constructs(spark, sf_dir):
    found = scanner.scanned(fx.sql(spark, sf_dir, SOURCES)).select("path", F.explode("constructs").alias("c"))
    return found.select("path", "c.kind", "c.name", "c.line_start", "c.line_end", "c.depth")


@query(fx.duck(f"""WITH s AS ({SOURCES}), firsts AS (SELECT k % 11 AS j, arg_min(path, ('n' || n, path)) AS path FROM s GROUP BY k % 11)
  SELECT s.path AS src_path, 'm' || s.k % 5 AS src_name, f.path AS dst_path, 'f' || f.j AS dst_name, 'call' AS kind, '2' AS sites FROM s JOIN firsts f ON f.j = s.k % 7"""))
def scan_project(spark, sf_dir):
    entities, refs = scanner.project(fx.sql(spark, sf_dir, SOURCES).select("path", "text"), "shop")
    end = lambda x: entities.select(F.col("id").alias(x), F.col("path").alias(f"{x}_path"), F.col("name").alias(f"{x}_name"))
    named = refs.join(end("src"), "src").join(end("dst"), "dst")
    return named.select("src_path", "src_name", "dst_path", "dst_name", "kind", F.array_join(F.transform("sites", lambda x: x.cast("string")), ",").alias("sites"))
