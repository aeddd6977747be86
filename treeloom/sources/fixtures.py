"""Graphs made of the driver's tables, as SQL that Spark and DuckDB both run.

Containment: root, regions and nations (folders), customers (files), orders (classes), items (functions); brands
(files) and parts (classes); suppliers (files) under their nation. References: item to part, item to supplier, at
the first line of the item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: First id of each kind.
REGION, NATION, CUSTOMER, SUPPLIER, BRAND, PART, ORDER, ITEM = 1_000, 2_000, 10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9, 5 * 10**9, 10**11
#: The tree's depth below its root.
HOPS = 5

GRAPH = f"""
items0 AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, o_custkey,
         CAST(l_quantity AS INT) AS qty,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS nth
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey),
items AS (
  SELECT items0.*, {ITEM} + l_orderkey * 64 + nth AS id,
         CAST(sum(qty) OVER (PARTITION BY o_custkey ORDER BY l_orderkey, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS upto
  FROM items0),
spans AS (SELECT l_orderkey, min(upto - qty) AS s, max(upto - 1) AS e FROM items GROUP BY l_orderkey),
files AS (SELECT o_custkey, max(upto - 1) AS e FROM items GROUP BY o_custkey),
entities AS (
  SELECT CAST(0 AS BIGINT) AS id, 'folder' AS kind, 'tpch' AS name, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS ord, 0 AS line_start, 0 AS line_end
  UNION ALL SELECT CAST({REGION} + r_regionkey AS BIGINT), 'folder', CASE WHEN r_regionkey = 3 THEN 'tests' ELSE r_name END, 0, r_regionkey, 0, 0 FROM {{region}}
  UNION ALL SELECT CAST({NATION} + n_nationkey AS BIGINT), 'folder', n_name, {REGION} + n_regionkey, n_nationkey, 0, 0 FROM {{nation}}
  UNION ALL SELECT CAST({SUPPLIER} + s_suppkey AS BIGINT), 'file', concat('s', CAST(s_suppkey AS VARCHAR(20)), '.go'), {NATION} + s_nationkey, {SUPPLIER} + s_suppkey, 0, 0 FROM {{supplier}}
  UNION ALL SELECT CAST({CUSTOMER} + c_custkey AS BIGINT), 'file', CASE WHEN c_custkey % 10 = 0 THEN concat('test_', CAST(c_custkey AS VARCHAR(20)), '.py') ELSE concat('c', CAST(c_custkey AS VARCHAR(20)), '.rs') END,
         {NATION} + c_nationkey, c_custkey, 0, coalesce(e, 0) FROM {{customer}} LEFT JOIN files ON c_custkey = o_custkey
  UNION ALL SELECT DISTINCT CAST({BRAND} + CAST(replace(p_brand, 'Brand#', '') AS INT) AS BIGINT), 'file', p_brand, 0, {BRAND} + CAST(replace(p_brand, 'Brand#', '') AS INT), 0, 0 FROM {{part}}
  UNION ALL SELECT CAST({PART} + p_partkey AS BIGINT), 'class', p_name, {BRAND} + CAST(replace(p_brand, 'Brand#', '') AS INT), p_partkey, 0, 0 FROM {{part}}
  UNION ALL SELECT CAST({ORDER} + o_orderkey AS BIGINT), 'class', o_orderpriority, {CUSTOMER} + o_custkey, o_orderkey, coalesce(s, 0), coalesce(e, 0) FROM {{orders}} LEFT JOIN spans ON o_orderkey = l_orderkey
  UNION ALL SELECT id, 'function', concat('l', CAST(l_linenumber AS VARCHAR(20))), {ORDER} + l_orderkey, nth, upto - qty, upto - 1 FROM items),
refs AS (
  SELECT id * 2 AS ref_id, id AS src, {PART} + l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'type_ref' ELSE 'import' END AS kind, upto - qty AS line FROM items
  UNION ALL SELECT id * 2 + 1, id, {SUPPLIER} + l_suppkey, CASE l_linestatus WHEN 'O' THEN 'var_ref' ELSE 'generic' END, upto - qty FROM items)"""

#: A source file for each customer: a class with a method that calls a function, and a function.
SOURCES = """SELECT concat('n', CAST(c_nationkey AS VARCHAR(20)), '/c', CAST(c_custkey AS VARCHAR(20)), '.py') AS path, c_custkey AS k, c_nationkey AS n, concat('class C', CAST(c_custkey AS VARCHAR(20)), ':', chr(10), '    def m', CAST(c_custkey % 5 AS VARCHAR(20)), '(self):', chr(10),
  '        return f', CAST(c_custkey % 7 AS VARCHAR(20)), '(', CAST(c_custkey AS VARCHAR(20)), ')  # g()', chr(10), chr(10), 'def f', CAST(c_custkey % 11 AS VARCHAR(20)), '():', chr(10), '    pass', chr(10)) AS text FROM {customer}"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "events", "pages", "conversations")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run portable SQL whose {table} are the driver's tables."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same text for DuckDB, where the tables are views of those names."""
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of GRAPH, written once: entities and references are made of them, and each would number them again."""
    from .generations import once

    return once(spark, ("items", sf_dir), lambda: sql(spark, sf_dir, f"WITH {GRAPH[:GRAPH.index('spans AS')].rstrip().rstrip(',')} SELECT id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, o_custkey, qty, nth, upto FROM items"))


def of_items(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of GRAPH, from the items on."""
    text = f"WITH items AS (SELECT * FROM {{items}}), {GRAPH[GRAPH.index('spans AS'):]} SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used, items=items(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = of_items(spark, sf_dir, "entities")
    none = lambda kind: F.lit(None).cast(kind)
    return out.select("id", "kind", none("string").alias("noun"), "name", "parent", "ord", none("string").alias("path"), none("bigint").alias("byte_start"), none("bigint").alias("byte_end"), "line_start", "line_end", F.lit(False).alias("is_test"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_items(spark, sf_dir, "refs").selectExpr("ref_id", "src", "dst", "kind", "array(line) AS sites")
