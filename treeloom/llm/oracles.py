"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


BLANK = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, {words("text", BLANK)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in range(1, len(w) - least(len(w), 5) + 2)]) AS s FROM w WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM edges UNION SELECT e.a, reach.r FROM reach JOIN edges e ON e.b = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN comp USING (doc_id)"""

SHARDING = """WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
spread AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
placed AS (SELECT *, key >> CAST(60 - depth AS INT) AS prefix FROM spread),
sizes AS (SELECT depth, prefix, sum(n_bytes) AS bytes, count(*) AS docs, sum(n_bytes) <= {limit} OR min(key) = max(key) AS final FROM placed GROUP BY ALL),
leaves AS (SELECT p.doc_id, p.n_bytes, min(p.depth) AS depth FROM placed p JOIN sizes s USING (depth, prefix) WHERE s.final GROUP BY ALL)
SELECT l.doc_id, l.n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(p.prefix), CAST(l.depth AS INT), '0') END AS shard, CAST(l.depth AS INT) AS depth, CAST(s.bytes AS BIGINT) AS shard_bytes, s.docs AS shard_docs, s.bytes > {limit} AS oversized
FROM leaves l JOIN placed p ON p.doc_id = l.doc_id AND p.depth = l.depth JOIN sizes s ON s.depth = p.depth AND s.prefix = p.prefix"""

DECONTAMINATION = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text", PLAIN)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text", PLAIN)} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) AS g FROM b WHERE len(w) > 0),
grams AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS g FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hits AS (SELECT g.r, g.i, g.n, item FROM grams g JOIN win ON win.g = g.g AND win.n = g.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""

LINE_DEDUP = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
long AS (SELECT * FROM l WHERE line <> ''),
firsts AS (SELECT line, min((doc_id, line_no)) AS f, length(line) AS n FROM long GROUP BY line),
fuzzy AS (SELECT *, n // 4 AS q FROM firsts WHERE n * {edits} >= {chars}),
near AS (SELECT a.line AS a, b.line AS b, b.f AS other FROM fuzzy a JOIN fuzzy b ON b.n BETWEEN a.n - {edits} AND a.n + {edits} AND a.line <> b.line
  AND (substr(a.line, 1, a.q) = substr(b.line, 1, a.q) OR right(a.line, a.q) = right(b.line, a.q) OR contains(b.line, substr(a.line, a.n // 3 + 1, a.q + 1)))
  WHERE levenshtein(a.line, b.line) <= least({edits}, least(a.n, b.n) * {edits} // {chars})),
judged AS (SELECT long.doc_id, line_no, count(near.b) AS links, (long.doc_id, line_no) > least(firsts.f, coalesce(min(near.other), firsts.f)) AS goes FROM long JOIN firsts USING (line) LEFT JOIN near ON near.a = long.line GROUP BY long.doc_id, line_no, firsts.f),
docs AS (SELECT doc_id, count(*) AS n_compared, CAST(sum(links) AS BIGINT) AS n_links, count(*) FILTER (WHERE goes) AS n_dropped, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (WHERE goes) AS dropped FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, coalesce(n_compared, 0) AS n_compared, coalesce(n_links, 0) AS n_links, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped FROM documents d LEFT JOIN docs USING (doc_id)"""


def crc32(text: str) -> str:
    """The checksum of ASCII text: a byte of it in each step, a bit in each step within."""
    bit = "lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})))"


PREFIX_TRIE = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS step, len(regexp_extract_all(text, '{BLANK}')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id AS base, count(*) AS n FROM u GROUP BY conv_id),
k AS (SELECT conv_id, base, h, least(h, coalesce(n, 0)) AS k FROM c LEFT JOIN n USING (base)),
occ AS (SELECT conv_id, 0 AS d, '' AS step, 0 AS words FROM k UNION ALL SELECT k.conv_id, pos + 1, '/' || step, words FROM k JOIN u ON u.conv_id = k.base AND u.pos < k.k
  UNION ALL SELECT k.conv_id, k.k + u.pos - k.h + 1, '/' || step, words FROM k JOIN u ON u.conv_id = k.conv_id AND u.pos >= k.h),
path AS (SELECT conv_id, d, words, string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY d) AS p, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM occ),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256, bool_and(ends) AS leaf FROM path GROUP BY p, d),
kids AS (SELECT left(p, length(p) - 65) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sums AS (SELECT v.p, count(*) FILTER (WHERE w.leaf) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved FROM node v JOIN node w ON starts_with(w.p, v.p) GROUP BY v.p)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN sums USING (p) LEFT JOIN kids USING (p) LEFT JOIN node above ON node.d > 0 AND above.p = left(node.p, length(node.p) - 65)"""

PERIODIC_RUNS = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK}') AS w, {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
s AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM w),
e AS (SELECT doc_id, n, CASE WHEN a = n THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM s),
place AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM e),
hit AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM place x JOIN place y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS gap FROM hit) GROUP BY doc_id, q, gap HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT doc_id, s, n, min(q) AS q FROM island GROUP BY doc_id, s, n),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min((s, n, q), (-n / q, s, q)) AS b, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM run),
kept AS (SELECT place.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM place ANTI JOIN gone USING (doc_id, i) GROUP BY place.doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b[1] AS BIGINT) AS start, CAST(b[2] AS BIGINT) AS length, CAST(b[3] AS BIGINT) AS period, CAST(1000 * b[2] // b[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256 FROM e LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

MIXING = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '~') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, {weights}[(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS weight FROM d GROUP BY src),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS t FROM s),
fill AS (SELECT 0 AS step, src, source_size, weight, false AS stops FROM s
  UNION ALL SELECT step + 1, src, source_size, weight, stops OR {repeats} * source_size <= weight * (CAST((SELECT t FROM total) - {repeats} * coalesce(sum(source_size) FILTER (WHERE stops) OVER (), 0) AS DOUBLE) / sum(weight) FILTER (WHERE NOT stops) OVER ())
  FROM fill WHERE step < (SELECT count(*) FROM s)),
last AS (SELECT * FROM fill WHERE step = (SELECT count(*) FROM s)),
aim AS (SELECT src, source_size, CASE WHEN stops THEN CAST({repeats} * source_size AS DOUBLE) ELSE weight * (CAST((SELECT t FROM total) - {repeats} * coalesce(sum(source_size) FILTER (WHERE stops) OVER (), 0) AS DOUBLE) / sum(weight) FILTER (WHERE NOT stops) OVER ()) END AS target FROM last),
quota AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota, CAST(coalesce(sum(CAST(floor(target) AS BIGINT)) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low FROM aim),
size AS (SELECT CAST(sum(quota) AS BIGINT) AS q, CAST(ceil(sum(quota) / {block}) AS BIGINT) AS n FROM quota),
point AS (SELECT slot, CAST(floor(CAST((slot * {golden}) % {range} AS DOUBLE) / CAST({range} AS DOUBLE) * CAST(q AS DOUBLE)) AS BIGINT) AS x FROM (SELECT unnest(range(n)) AS slot, q FROM size)),
hit AS (SELECT slot, src FROM point JOIN quota ON x >= low AND x < low + quota),
slot AS (SELECT * FROM hit UNION ALL SELECT n + row_number() OVER (ORDER BY src) - 1, src FROM quota, size WHERE quota > 0 AND src NOT IN (SELECT src FROM hit)),
ranked AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank, count(*) OVER (PARTITION BY src) AS slots FROM slot),
cut AS (SELECT src, source_size, rank * (quota // slots) + (quota % slots) * rank // slots AS a, (rank + 1) * (quota // slots) + (quota % slots) * (rank + 1) // slots AS b FROM ranked JOIN quota USING (src)),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
took AS (SELECT r, sum(greatest(0, least(b, start + size + turn * source_size) - greatest(a, start + turn * source_size))) AS taken FROM laid JOIN cut USING (src), (SELECT unnest(range({repeats})) AS turn) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM d JOIN quota USING (src) LEFT JOIN took USING (r)"""
