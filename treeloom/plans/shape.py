"""Queries about pictures: filters, pairs, lifting, bundling, offsets, groups, summaries and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cut, testcode, tree, view
from ..sources import fixtures as fx
from ..sources.generations import alone, written
from .trees import COALESCED, IS_TEST, MIXED_CUT, NATION_CUT, OWN_TEST, SITES, graph, mixed_cut, nation_cut, oracle, tree_of
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


STRENGTH = "CASE kind WHEN 'call' THEN 0 WHEN 'type_ref' THEN 1 WHEN 'var_ref' THEN 2 WHEN 'import' THEN 3 WHEN 'generic' THEN 4 ELSE 5 END"
SETTINGS = view.Settings(show_tests=False, hidden=(fx.NATION + 1, fx.REGION + 4), scope=None)
SHOWN = f"""leaves AS (SELECT leaf FROM cut JOIN tested t ON t.id = leaf WHERE NOT t.is_test AND leaf NOT IN (SELECT id FROM closure WHERE anc IN ({fx.NATION + 1}, {fx.REGION + 4}))),
drawn AS (SELECT DISTINCT c.anc FROM leaves JOIN closure c ON c.id = leaf)"""


def marked(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return testcode.mark(entities, up), up


@query(oracle("SELECT leaf FROM leaves", NATION_CUT, OWN_TEST, IS_TEST, SHOWN))
def view_filter(spark, sf_dir):
    entities, up = marked(spark, sf_dir)
    return view.filter_leaves(nation_cut(entities), entities, up, SETTINGS).select("leaf")


@query(oracle("SELECT leaf FROM cut WHERE leaf IN (SELECT id FROM closure WHERE anc = " + str(fx.REGION + 1) + ")", MIXED_CUT))
def view_scope(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return view.filter_leaves(mixed_cut(entities), entities, up, view.Settings(scope=fx.REGION + 1)).select("leaf")


@query(oracle("SELECT src, dst, kind, n_refs, first_ref FROM edges WHERE src IN (SELECT anc FROM drawn) AND dst IN (SELECT anc FROM drawn)", NATION_CUT, OWN_TEST, IS_TEST, SHOWN, SITES, COALESCED))
def view_edges(spark, sf_dir):
    entities, up = marked(spark, sf_dir)
    leaves = view.filter_leaves(nation_cut(entities), entities, up, SETTINGS)
    return view.filter_edges(cut.coalesce_counts(all_refs(spark, sf_dir), nation_cut(entities), up), cut.shown(leaves, up))


def mixed_edges(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return cut.coalesce(all_refs(spark, sf_dir), mixed_cut(entities), up), entities, up


@query(oracle(f"""SELECT e.src, e.dst, arg_min(e.kind, {STRENGTH.replace("kind", "e.kind")}) AS kind, md5(string_agg(CAST(m.ref_id AS VARCHAR), ',' ORDER BY e.first_ref, m.ref_id)) AS refs FROM edges e
  JOIN (SELECT a.site AS src, b.site AS dst, r.kind, r.ref_id FROM refs r JOIN sites a ON r.src = a.id JOIN sites b ON r.dst = b.id) m ON m.src = e.src AND m.dst = e.dst AND m.kind = e.kind GROUP BY e.src, e.dst""", MIXED_CUT, SITES, COALESCED))
def one_per_pair(spark, sf_dir):
    edges, _, _ = mixed_edges(spark, sf_dir)
    members = F.array_join(F.transform("refs", lambda r: r.cast("string")), ",")
    return view.one_per_pair(edges).select("src", "dst", "kind", F.md5(members).alias("refs"))


@query(oracle(f"""SELECT src, dst, status, arg_min(kind, {STRENGTH}) AS kind, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds, CAST(sum(n) AS BIGINT) AS count
  FROM (SELECT src, dst, CASE WHEN first_ref % 3 = 0 THEN 'added' ELSE 'same' END AS status, kind, CAST(sum(n_refs) AS BIGINT) AS n FROM edges GROUP BY ALL) GROUP BY src, dst, status""", MIXED_CUT, SITES, COALESCED))
def collapse_kinds(spark, sf_dir):
    edges, _, _ = mixed_edges(spark, sf_dir)
    rows = edges.select("src", "dst", "kind", F.when(F.col("first_ref") % 3 == 0, "added").otherwise("same").alias("status"), F.col("n_refs").alias("count"))
    entries = F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return view.by_precedence(rows).select("src", "dst", "status", "kind", F.array_join(entries, ",").alias("kinds"), "count")


CHAINS = "chains AS (SELECT id, list(anc ORDER BY hops DESC) AS chain FROM closure GROUP BY id)"
SPLIT = "len(list_filter(range(1, least(len(a.chain), len(b.chain)) + 1), lambda i: a.chain[1:i] = b.chain[1:i]))"


@query(oracle(f"""SELECT src, dst, level, arg_min(kind, {STRENGTH}) AS kind FROM (
    SELECT a.chain[s + 1] AS src, b.chain[s + 1] AS dst, a.chain[s] AS level, kind FROM (SELECT e.*, {SPLIT} AS s FROM edges e JOIN chains a ON a.id = e.src JOIN chains b ON b.id = e.dst) e
      JOIN chains a ON a.id = e.src JOIN chains b ON b.id = e.dst WHERE s < len(a.chain) AND s < len(b.chain)) GROUP BY ALL""", MIXED_CUT, SITES, COALESCED, CHAINS))
def lift_edges(spark, sf_dir):
    edges, _, up = mixed_edges(spark, sf_dir)
    return view.lift(edges.select("src", "dst", "kind"), up)


@query(oracle("SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id", MIXED_CUT, SITES, COALESCED))
def degrees(spark, sf_dir):
    edges, _, _ = mixed_edges(spark, sf_dir)
    return view.degrees(edges)


@query(oracle("""SELECT c.anc AS id, max(e.parent) AS parent, min(c.hops) > 0 AS is_box, CAST(max(d.depth - c.hops) + 1 AS INT) AS depth FROM cut JOIN closure c ON c.id = leaf
  JOIN entities e ON e.id = c.anc JOIN (SELECT id, max(hops) AS depth FROM closure GROUP BY id) d ON d.id = leaf GROUP BY c.anc""", MIXED_CUT))
def drawn_tree(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return view.drawn_tree(mixed_cut(entities), up)


@query(oracle("""SELECT level, row_number() OVER (ORDER BY d DESC, level) - 1 AS pos FROM (SELECT c.anc AS level, max(d.depth - c.hops) + 1 AS d FROM cut JOIN closure c ON c.id = leaf
  JOIN (SELECT id, max(hops) AS depth FROM closure GROUP BY id) d ON d.id = leaf GROUP BY c.anc HAVING min(c.hops) > 0 UNION ALL SELECT NULL, 0)""", MIXED_CUT))
def levels_bottom_up(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return view.levels_bottom_up(view.drawn_tree(mixed_cut(entities), up))


@query(oracle("""SELECT src, dst, kind, CAST((CASE WHEN src < dst THEN 1 ELSE -1 END) * (row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY first_ref) - 1
  - (count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) - 1) / 2.0) * 10 AS DOUBLE) AS offset FROM edges""", NATION_CUT, SITES, COALESCED))
def offsets(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    edges = cut.coalesce_counts(all_refs(spark, sf_dir), nation_cut(entities), up)
    return view.offsets(edges, "first_ref").select("src", "dst", "kind", F.col("offset").cast("double").alias("offset"))


UPCHAINS = f"""ups AS (SELECT id, list(anc ORDER BY hops) AS up FROM closure GROUP BY id)"""
MEET = "len(list_filter(range(1, least(len(a.up), len(b.up)) + 1), lambda i: list_reverse(a.up)[1:i] = list_reverse(b.up)[1:i]))"


def mixed_bundle(spark, sf_dir):
    """Edges, drawn boxes, and the closure of what is drawn: whatever an edge ends at, and all above it."""
    entities = tree_of(spark, sf_dir)
    at = mixed_cut(entities)
    drawn = written(cut.shown(at, entities))
    ends = alone(lambda: tree.above(entities, drawn.withColumnRenamed("anc", "id")))
    boxes = written(view.drawn_tree(at, ends).filter("is_box").select("id"))
    edges = alone(lambda: cut.coalesce_counts(all_refs(spark, sf_dir), at, entities).select("src", "dst", "kind"))
    return edges, boxes, ends


@query(oracle(f"""SELECT src, src_box, dst, dst_box, kind, count(*) AS count FROM (SELECT a.up[ka] AS src, ka > 1 AS src_box, b.up[kb] AS dst, kb > 1 AS dst_box, kind FROM (
    SELECT e.*, len(a.up) - {MEET} AS ka, len(b.up) - {MEET} AS kb FROM edges e JOIN ups a ON a.id = e.src JOIN ups b ON b.id = e.dst) e JOIN ups a ON a.id = e.src JOIN ups b ON b.id = e.dst WHERE ka > 0 AND kb > 0) GROUP BY ALL""", MIXED_CUT, SITES, COALESCED, UPCHAINS))
def bundle_default(spark, sf_dir):
    return view.bundle(*mixed_bundle(spark, sf_dir))


#: How far boxes let ends in, for this query: (in, out, inward).
LEVELS = {fx.REGION + 1: (1, 1, 0), fx.NATION + 14: (2, 0, 1), fx.REGION + 2: (0, 2, 1)}


def reach_sql(up: str, i: str, way: int) -> str:
    of = lambda x, n: f"CASE {x} " + " ".join(f"WHEN {k} THEN {v[n]}" for k, v in LEVELS.items()) + " ELSE 0 END"
    return f"greatest({of(f'{up}[{i} + 1]', way)}, {of(f'{up}[{i} + 2]', 2)})"


def attach_sql(up: str, meet: str, way: int) -> str:
    places = lambda condition: f"list_filter(range(1, {meet} + 1), lambda i: {reach_sql(up, 'i', way)} {condition})"
    return f"CASE WHEN len({places('= 2')}) > 0 THEN 0 WHEN len({places('> 0')}) > 0 THEN list_min({places('> 0')}) - 1 ELSE {meet} END"


@query(oracle(f"""SELECT src, src_box, dst, dst_box, kind, count(*) AS count FROM (SELECT a.up[ia + 1] AS src, ia > 0 AS src_box, b.up[ib + 1] AS dst, ib > 0 AS dst_box, kind FROM (
    SELECT m.src, m.dst, m.kind, {attach_sql("a.up", "ka", 1)} AS ia, {attach_sql("b.up", "kb", 0)} AS ib FROM (
      SELECT e.src, e.dst, e.kind, len(a.up) - {MEET} - 1 AS ka, len(b.up) - {MEET} - 1 AS kb FROM edges e JOIN ups a ON a.id = e.src JOIN ups b ON b.id = e.dst) m
    JOIN ups a ON a.id = m.src JOIN ups b ON b.id = m.dst WHERE ka >= 0 AND kb >= 0) x JOIN ups a ON a.id = x.src JOIN ups b ON b.id = x.dst) GROUP BY ALL""", MIXED_CUT, SITES, COALESCED, UPCHAINS))
def bundle_levels(spark, sf_dir):
    edges, boxes, up = mixed_bundle(spark, sf_dir)
    return view.bundle(edges, boxes, up, LEVELS)


IN_OUT = f"""SELECT DISTINCT r.ref_id, {{way}} FROM refs r JOIN sites a ON r.src = a.id JOIN sites b ON r.dst = b.id WHERE a.site <> b.site AND {{near}}.site IN (SELECT id FROM closure WHERE anc = {fx.REGION + 1}) AND {{far}}.site NOT IN (SELECT id FROM closure WHERE anc = {fx.REGION + 1})"""


@query(oracle(IN_OUT.format(way="'out' AS way", near="a", far="b") + " UNION ALL " + IN_OUT.format(way="'in'", near="b", far="a"), MIXED_CUT, SITES))
def in_out_refs(spark, sf_dir):
    edges, _, up = mixed_edges(spark, sf_dir)
    one = lambda out, name: view.selected_refs(edges, up, fx.REGION + 1, out).withColumn("way", F.lit(name))
    return one(True, "out").unionByName(one(False, "in"))


@query(oracle(f"SELECT ref_id FROM refs WHERE kind IN ('call', 'var_ref') AND src IN (SELECT id FROM closure WHERE anc = {fx.REGION + 1}) AND dst IN (SELECT id FROM closure WHERE anc = {fx.NATION + 3})"))
def edge_refs(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    return view.edge_refs(all_refs(spark, sf_dir), up, fx.REGION + 1, fx.NATION + 3, ["call", "var_ref"]).select("ref_id")


@query(oracle(f"""SELECT array_to_string(path, '/') AS path, count(*) AS count FROM (SELECT unnest([p[1:n] for n in range(0, len(p) + 1)]) AS path FROM (
    SELECT chain[len(list_filter(range(1, least(len(chain), len(point)) + 1), lambda i: chain[1:i] = point[1:i])) + 1:] AS p FROM refs JOIN chains c ON c.id = refs.dst, (SELECT chain AS point FROM chains WHERE id = {fx.NATION + 3}))) GROUP BY path""", CHAINS))
def group_tree_counts(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    groups = view.group_counts(all_refs(spark, sf_dir).select(F.col("dst").alias("group_id")), up, fx.NATION + 3)
    return groups.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "count")


#: Groups of references by their source: orders of one item, and customers of one order, are runs.
GROUPS = f"""own AS (SELECT DISTINCT refs.src, chain[len(list_filter(range(1, least(len(chain), len(point)) + 1), lambda i: chain[1:i] = point[1:i])) + 1:] AS p FROM refs JOIN chains c ON c.id = refs.src, (SELECT chain AS point FROM chains WHERE id = {fx.NATION + 3})),
  counted AS (SELECT src, count(*) AS n FROM refs GROUP BY src), groups AS (SELECT path, sum(n) AS count FROM (SELECT src, unnest([p[1:n] for n in range(1, len(p) + 1)]) AS path FROM own) JOIN counted USING (src) GROUP BY path),
  kids AS (SELECT path[1:len(path) - 1] AS path, count(*) AS n, min(path) AS next FROM groups GROUP BY 1), runs AS (SELECT k.path, k.next FROM kids k WHERE n = 1 AND k.path NOT IN (SELECT p FROM own) AND len(k.path) > 0),
  walk AS (SELECT path AS head, path FROM groups WHERE path NOT IN (SELECT next FROM runs) UNION ALL SELECT head, next FROM walk JOIN runs USING (path))"""


@query(oracle("""SELECT array_to_string(w.path, '/') AS path, array_to_string(w.path[len(w.head):], '/') AS label, CAST(g.count AS BIGINT) AS count
  FROM (SELECT head, max(path) AS path FROM walk GROUP BY head) w JOIN groups g ON g.path = w.path""", CHAINS, GROUPS))
def group_tree_labels(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    pairs = all_refs(spark, sf_dir).select(F.col("src").alias("group_id"))
    nodes, held = view.tree_groups(pairs, up, fx.NATION + 3)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/").alias(c)
    return view.compress_tree(nodes, held, up, fx.NATION + 3).select(text("path"), text("label"), "count")


@query(oracle("""SELECT k.row, k.kinds, s.statuses, n.n_sites FROM (SELECT row, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT dst AS row, kind, count(*) AS n FROM refs GROUP BY ALL) GROUP BY row) k
  JOIN (SELECT dst AS row, coalesce(string_agg(DISTINCT CASE WHEN ref_id % 5 = 0 THEN 'added' END, ','), '') AS statuses FROM refs GROUP BY dst) s USING (row) JOIN (SELECT dst AS row, count(DISTINCT (src, line)) AS n_sites FROM refs GROUP BY dst) n USING (row)"""))
def site_summary(spark, sf_dir):
    rows = all_refs(spark, sf_dir).select(F.col("dst").alias("row"), "src", "kind", F.when(F.col("ref_id") % 5 == 0, "added").otherwise("same").alias("status"), "sites")
    entries = F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return view.row_summary(rows).select("row", F.array_join(entries, ",").alias("kinds"), F.array_join("statuses", ",").alias("statuses"), "n_sites")


@query(oracle("""SELECT id, CASE WHEN kind = 'file' AND line_end + 1 > 1 THEN format('{:,}', line_end - line_start + 1) || ' loc' WHEN kind <> 'folder' AND NOT (line_start = 0 AND line_end = 0) THEN (line_start + 1) || '–' || (line_end + 1) ELSE '' END AS size,
  kind || CASE WHEN kind = 'file' AND line_end + 1 > 1 THEN ' · ' || format('{:,}', line_end - line_start + 1) || ' loc' WHEN kind <> 'folder' AND NOT (line_start = 0 AND line_end = 0) THEN ' · ' || (line_start + 1) || '–' || (line_end + 1) ELSE '' END || CASE WHEN id % 2 = 0 THEN ' · test' ELSE '' END AS detail FROM entities"""))
def labels(spark, sf_dir):
    entities, _ = graph(spark, sf_dir)
    lines = F.when((F.col("kind") == "file") & (F.col("line_end") > 0), F.col("line_end") - F.col("line_start") + 1).otherwise(0)
    size = tx.size_label(F.col("kind"), lines, F.col("line_start"), F.col("line_end"))
    return entities.select("id", size.alias("size"), tx.detail_label(F.col("kind"), F.lit(None).cast("string"), size, F.col("id") % 2 == 0).alias("detail"))


@query(oracle("SELECT id, id IN (SELECT parent FROM entities WHERE parent IS NOT NULL AND id NOT IN (SELECT id FROM closure WHERE anc = " + str(fx.REGION + 4) + ")) AS expandable FROM entities"))
def expandable(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return view.flags(entities, view.under(up, [fx.REGION + 4]))


@query(oracle(f"""SELECT a.site AS src, b.site AS dst, r.kind, count(*) AS n_refs FROM refs r JOIN sites a ON r.src = a.id JOIN sites b ON r.dst = b.id JOIN tested x ON x.id = r.src JOIN tested y ON y.id = r.dst JOIN tested v ON v.id = a.site JOIN tested w ON w.id = b.site
  WHERE a.site <> b.site AND NOT x.is_test AND NOT y.is_test AND NOT v.is_test AND NOT w.is_test GROUP BY ALL""", NATION_CUT, SITES, OWN_TEST, IS_TEST))
def visible_refs(spark, sf_dir):
    entities, up = marked(spark, sf_dir)
    refs = all_refs(spark, sf_dir)
    edges = cut.coalesce(refs, nation_cut(entities), up)
    return view.visible_refs(edges, refs, entities.filter("is_test").select("id")).select("src", "dst", "kind", "n_refs")


