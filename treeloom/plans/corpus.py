"""Queries about texts and names: search, excerpts, go-to, name resolution, occurrences, imports, lines and live batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import goto, layout, postings, search, tree
from ..sources import fixtures as fx
from ..sources import names, occurrences, scanner
from ..sources.fixtures import SOURCES
from ..sources.generations import few, once, shared_dir, spread
from ..streaming import live
from .trees import graph, oracle, tree_of
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


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select(F.col("doc_id").alias("file_id"), name.alias("name"), F.concat_ws("/", "lang", "source", name).alias("path"), "text")


FILES = """files AS (SELECT doc_id AS file_id, 'doc_' || doc_id || '.txt' AS name, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, text FROM documents),
pieces AS (SELECT file_id, name, path, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM (SELECT *, string_split(text, chr(10)) AS l FROM files)),
lines AS (SELECT file_id, name, path, unnest(l) AS text, CAST(unnest(range(0, len(l))) AS INT) AS line FROM pieces)"""


def docs_sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([FILES, *ctes]) + " " + body


@query(docs_sql("SELECT file_id, line, CAST(length(text) AS INT) AS chars, md5(text) AS digest FROM lines"))
def split_lines(spark, sf_dir):
    rows = search.index(files(spark, sf_dir)).lines
    return rows.select("file_id", "line", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(docs_sql("SELECT gram, count(*) AS df FROM (SELECT DISTINCT file_id, line, unnest([substr(lower(text), CAST(i AS INT), 3) for i in range(1, length(text) - 1)]) AS gram FROM lines) GROUP BY gram"))
def trigram_df(spark, sf_dir):
    return search.grams(search.index(files(spark, sf_dir)).docs["content"]).groupBy("gram").agg(F.count("*").alias("df"))


HIT = "CAST(strpos(lower({x}), '{n}') - 1 AS INT) AS start"


_STORES: dict[tuple[str, str], str] = {}


def stored(spark, sf_dir) -> postings.StoredIndex:
    """The index of the documents, written on first use by this application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = f"{shared_dir(spark)}/{key[0]}-{uuid.uuid4().hex}"
        postings.store(search.index(files(spark, sf_dir)), path)
        _STORES[key] = path
    return postings.open_store(spark, _STORES[key])


@query(ORACLES["trigram_df"])
def postings_df(spark, sf_dir):
    return stored(spark, sf_dir).frequencies["content"]


def hits(spark, sf_dir, text: str, limits: search.Limits, kinds: tuple[str, ...] = search.ORDER) -> DataFrame:
    found, _ = search.hits(stored(spark, sf_dir), text, limits, kinds)
    return found


@query(docs_sql(f"SELECT file_id, line, {HIT.format(x='text', n='keitkeit')} FROM lines WHERE contains(lower(text), 'keitkeit') AND contains(lower(text), 'ung')"))
def search_rare(spark, sf_dir):
    return hits(spark, sf_dir, "content:keitkeit content:ung", search.ALL).select("file_id", "line", "start")


#: The scanned files, with their classes and functions as symbols.
@query(fx.duck(f"""WITH s AS ({SOURCES}), symbols AS (SELECT path, 'm' || k % 5 AS name, 1 AS line FROM s UNION ALL SELECT path, 'f' || k % 11, 4 FROM s)
  SELECT CAST(pos AS INT) AS pos, CAST(greatest(n - 30, 0) AS BIGINT) AS more, path, line, name AS text FROM (SELECT *, row_number() OVER (ORDER BY length(name), path, line) AS pos, count(*) OVER () AS n FROM symbols WHERE contains(name, 'f1')) WHERE pos <= 30"""))
def search_symbols(spark, sf_dir):
    sources = fx.sql(spark, sf_dir, SOURCES).select("path", "text")
    entities, _ = scanner.project(sources, "shop")
    entities = once(spark, ("shop", sf_dir), lambda: entities)
    own = entities.filter("kind = 'file'").select(F.col("id").alias("file_id"), "name", "path").join(sources, "path")
    ix = search.index(own, entities, tree.closure(entities.select("id", "parent"), 4))
    found, _ = search.hits(ix, "symbol:F1", search.Limits())
    return found.select(F.col("pos").cast("int").alias("pos"), "more", "path", "line", "text")


@query(docs_sql(f"SELECT file_id, line, {HIT.format(x='text', n='the')} FROM lines WHERE contains(lower(text), 'the')"))
def search_content(spark, sf_dir):
    return hits(spark, sf_dir, "content:The", search.ALL).select("file_id", "line", "start")


@query(docs_sql(f"SELECT file_id, line, {HIT.format(x='text', n='ing the')} FROM lines WHERE contains(lower(text), 'ing the') AND contains(lower(text), 'tion')"))
def search_multi_term(spark, sf_dir):
    return hits(spark, sf_dir, 'content:"ing the" content:tion', search.ALL).select("file_id", "line", "start")


@query(docs_sql(f"SELECT file_id, line, {HIT.format(x='text', n='la')} FROM lines WHERE contains(lower(text), 'la') AND contains(path, 'fr/') AND contains(name, '7')"))
def search_tag_filter(spark, sf_dir):
    return hits(spark, sf_dir, "content:la path:fr/ file:7", search.ALL, ("content",)).select("file_id", "line", "start")


@query(docs_sql("""SELECT kind, CAST(pos AS INT) AS pos, CAST(greatest(n - k, 0) AS BIGINT) AS more, file_id FROM (
  SELECT 'content' AS kind, 100 AS k, row_number() OVER (ORDER BY path, line) AS pos, count(*) OVER () AS n, file_id FROM lines WHERE contains(lower(text), 'src1')
  UNION ALL SELECT 'path', 30, row_number() OVER (ORDER BY length(path), path), count(*) OVER (), file_id FROM files WHERE contains(path, 'src1')) WHERE pos <= k"""))
def search_topk_more(spark, sf_dir):
    return hits(spark, sf_dir, "src1", search.Limits()).select("kind", "pos", "more", "file_id")


@query(docs_sql("""SELECT 'file' AS kind, file_id FROM files WHERE contains(name, 'doc_1') UNION ALL
  SELECT 'path', file_id FROM files WHERE contains(path, 'doc_1') AND NOT (contains(name, 'doc_1') AND strpos(path, 'doc_1') - 1 >= length(path) - length(name)) UNION ALL SELECT 'content', file_id FROM lines WHERE contains(lower(text), 'doc_1')"""))
def search_path_suppress(spark, sf_dir):
    return hits(spark, sf_dir, "doc_1", search.ALL).select("kind", "file_id")


@query(docs_sql("""SELECT file_id, CAST(min(lo) AS INT) AS first_line, CAST(max(hi) AS INT) AS last_line, count(*) AS marks FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY line) AS run FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM (
      SELECT h.file_id, h.line, greatest(h.line - 1, 0) AS lo, least(h.line + 1, n - 1) AS hi FROM lines h JOIN (SELECT file_id, count(*) AS n FROM lines GROUP BY file_id) USING (file_id) WHERE contains(lower(h.text), 'tionth')))) GROUP BY file_id, run"""))
def excerpts_merge(spark, sf_dir):
    ix = search.index(files(spark, sf_dir))
    found, context = search.hits(ix, "content:tionth context:1", search.ALL)
    out = search.excerpts(ix, found, context)
    return out.select("file_id", "first_line", (F.col("first_line") + F.size("text") - 1).alias("last_line"), F.size("matched").cast("bigint").alias("marks"))


ASKED = f"asked AS (SELECT DISTINCT r.src AS ask, f.file_id, r.line, e.name AS token FROM refs r JOIN (SELECT c.id, c.anc AS file_id FROM closure c JOIN entities x ON x.id = c.anc AND x.kind = 'file') f ON f.id = r.src JOIN entities e ON e.id = r.dst WHERE r.kind IN ('call', 'type_ref', 'import'))"


def asked(spark, sf_dir, alias: bool) -> tuple[DataFrame, DataFrame]:
    refs = all_refs(spark, sf_dir)
    places = once(spark, ("places", sf_dir), lambda: goto.sited(tree_of(spark, sf_dir), None, refs, ("src", "kind")))
    rows = places.filter("kind in ('call', 'type_ref', 'import')").select(F.col("src").alias("ask"), "file_id", "line", F.col("name").alias("token")).distinct()
    places = places.drop("src", "kind")
    return (rows.withColumn("token", F.lit("alias")).withColumn("text", F.lit("alias here")) if alias else rows.withColumn("text", F.col("token"))), places


PLACES = "places AS (SELECT f.file_id, r.line, r.ref_id, r.dst, e.name FROM refs r JOIN (SELECT c.id, c.anc AS file_id FROM closure c JOIN entities x ON x.id = c.anc AND x.kind = 'file') f ON f.id = r.src JOIN entities e ON e.id = r.dst)"


@query(oracle("SELECT a.ask, p.dst, min(p.ref_id) AS first_ref FROM asked a JOIN places p ON a.file_id = p.file_id AND a.line = p.line AND p.name = a.token GROUP BY a.ask, p.dst", ASKED, PLACES))
def goto_named(spark, sf_dir):
    return goto.targets(*asked(spark, sf_dir, False))


@query(oracle("SELECT a.ask, p.dst, min(p.ref_id) AS first_ref FROM asked a JOIN places p ON a.file_id = p.file_id AND a.line = p.line GROUP BY a.ask, p.dst", ASKED, PLACES))
def goto_alias(spark, sf_dir):
    return goto.targets(*asked(spark, sf_dir, True))


WORDS = """words AS (SELECT file_id, line, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM lines),
firsts AS (SELECT lower(regexp_extract(text, '[A-Za-z]+')) AS name, min(file_id * 10000 + line) AS node FROM lines WHERE regexp_extract(text, '[A-Za-z]+') <> '' GROUP BY ALL)"""


def words(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = search.index(files(spark, sf_dir)).lines
    node = F.col("file_id") * 10_000 + F.col("line")
    first = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))
    nodes = lines.select(node.alias("node_id"), F.lit("function").alias("kind"), first.alias("name")).filter("name <> ''")
    found = lines.select(node.alias("src"), F.col("line"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name"))
    return nodes, found.select("src", F.lower("name").alias("name"), F.lit("call").alias("kind"), "line")


@query(docs_sql("SELECT name, node AS node_id FROM firsts", WORDS))
def name_table(spark, sf_dir):
    return names.name_table(words(spark, sf_dir)[0])


TRIVIAL = "(" + ", ".join(f"'{w}'" for w in sorted(names.TRIVIAL)) + ")"


@query(docs_sql(f"""SELECT w.file_id * 10000 + w.line AS src, f.node AS dst, count(DISTINCT w.line) AS n_sites FROM words w JOIN firsts f ON lower(w.name) = f.name
  WHERE w.file_id * 10000 + w.line <> f.node AND lower(w.name) NOT IN {TRIVIAL} GROUP BY ALL""", WORDS))
def name_resolve(spark, sf_dir):
    nodes, raw = words(spark, sf_dir)
    found = names.resolve(names.without_trivial(raw), names.name_table(nodes))
    return names.dedup(found).select("src", "dst", F.size("sites").cast("bigint").alias("n_sites"))


@query(oracle(f"""SELECT p.file_id, p.line, arg_min(e.id, (e.line_end + 1 - e.line_start) * 100000000000 + e.id % 100000000000) AS scope FROM points p JOIN
  (SELECT c.anc AS file_id, e.* FROM closure c JOIN entities f ON f.id = c.anc AND f.kind = 'file' JOIN entities e ON e.id = c.id WHERE e.kind = 'function') e ON e.file_id = p.file_id AND p.line >= e.line_start AND p.line < e.line_end + 1 GROUP BY p.file_id, p.line""",
    f"points AS (SELECT DISTINCT {fx.CUSTOMER} + c_custkey AS file_id, CAST(c_custkey % 97 AS INT) AS line FROM {{customer}})"))
def scope_range_join(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    points = fx.sql(spark, sf_dir, f"SELECT DISTINCT {fx.CUSTOMER} + c_custkey AS file_id, CAST(c_custkey % 97 AS INT) AS line FROM {{customer}}")
    owner = up.join(entities.filter("kind = 'file'").select(F.col("id").alias("anc")), "anc").select("id", F.col("anc").alias("file_id"))
    scopes = entities.filter("kind = 'function'").join(owner, "id").select("file_id", F.col("id").alias("scope"), F.col("line_start").alias("start"), (F.col("line_end") + 1).alias("end"))
    return names.innermost_scope(points.withColumn("at", F.col("line")), scopes).select("file_id", "line", "scope")


@query(oracle("""SELECT DISTINCT a.anc AS src, b.anc AS dst FROM refs r JOIN (SELECT c.id, arg_min(c.anc, c.hops) AS anc FROM closure c JOIN entities e ON e.id = c.anc WHERE e.kind IN ('folder', 'file') GROUP BY c.id) a ON a.id = r.src
  JOIN (SELECT c.id, arg_min(c.anc, c.hops) AS anc FROM closure c JOIN entities e ON e.id = c.anc WHERE e.kind IN ('folder', 'file') GROUP BY c.id) b ON b.id = r.dst WHERE a.anc <> b.anc"""))
def granularity_refs(spark, sf_dir):
    entities, up = graph(spark, sf_dir)
    return names.at_granularity(all_refs(spark, sf_dir), entities, up, "file")


@query(oracle("""SELECT h.src, h.line, h.dst FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o JOIN closure c ON c.id = o.dst AND c.anc = h.dst AND c.hops > 0 WHERE o.src = h.src AND o.line = h.line)""",
    f"hits AS (SELECT DISTINCT src, refs.line, unnest([dst, parent]) AS dst FROM refs JOIN entities ON entities.id = dst)"))
def outer_suppress(spark, sf_dir):
    entities = tree_of(spark, sf_dir)
    refs = all_refs(spark, sf_dir).select("src", F.col("sites")[0].alias("line"), "dst")
    owners = few(entities.select(F.col("id").alias("dst"), "parent").join(refs.select("dst").distinct(), "dst", "left_semi"))
    hits_ = refs.join(owners, "dst").select("src", "line", F.explode(F.array("dst", "parent")).alias("dst"))
    return occurrences.without_outer(hits_, entities)


@query(docs_sql("""SELECT file_id, line, CASE WHEN inside THEN true ELSE starts_with(t, 'The') END AS import FROM (SELECT file_id, line, ltrim(text) AS t,
  coalesce(max(CASE WHEN starts_with(ltrim(text), 'The') AND contains(text, ',') THEN line END) OVER w, -1) > coalesce(max(CASE WHEN starts_with(ltrim(text), 'An') THEN line END) OVER w, -1) AS inside
  FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def import_block(spark, sf_dir):
    lines = search.index(files(spark, sf_dir)).lines
    head = F.ltrim("text")
    opens = head.startswith("The") & F.contains("text", F.lit(","))
    return occurrences.block_imports(lines, opens, head.startswith("An"), head.startswith("The")).select("file_id", "line", "import")


DEEP = "deep AS (SELECT id, max(hops) AS d FROM closure GROUP BY id)"


@query(oracle("""SELECT g.gap, count(*) AS crossing FROM (SELECT least(a.d, b.d) AS lo, greatest(a.d, b.d) AS hi FROM refs r JOIN deep a ON a.id = r.src JOIN deep b ON b.id = r.dst) e JOIN (SELECT unnest(range(0, 6)) AS gap) g ON g.gap >= lo AND g.gap < hi GROUP BY g.gap""", DEEP))
def gap_crossings(spark, sf_dir):
    _, up = graph(spark, sf_dir)
    deep = up.groupBy("id").agg(F.max("hops").alias("rank"))
    return layout.crossings(all_refs(spark, sf_dir), deep).select(F.col("gap").cast("bigint").alias("gap"), "crossing")


@query("""SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, batch""")
def debounce_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return live.batches(events, "30 minutes", "user_id").select("user_id", "first", "last", "n")


