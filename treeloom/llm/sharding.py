"""Sharding by extendible hashing, with DataFrame operations only.

A document's directory key is a 60-bit hash of its doc_id and text. A bucket is a prefix of key bits; it splits on the
next bit while its bytes exceed the limit, and no other bucket splits with it. Documents are added up once, in fine
cells (a few bits deeper than an even split needs), and cells a few levels at a time into the prefixes above them; the
leaves are the prefixes that fit under a parent that does not. Cells that are still too large go on alone, eight bits
deeper at a time.

Defined cases: null and empty texts have 0 bytes and are sharded like others; an empty table has no shard; a text of
any length counts whole; rows without doc_id, or that repeat one, are parted by their text; repeated rows of one text
(ties) share a key and cannot be parted: a bucket of one key is final even over the limit, and marked `oversized`;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 60
#: Bits of a cell beyond those of an even split; bits of each further round; levels that are added up at a time.
SPARE, STEP, RISE = 6, 8, 4


def key_of(docs: DataFrame) -> Column:
    text = F.md5(F.coalesce("text", F.lit("")))
    whole = F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), text))
    return F.conv(F.substring(whole, 1, BITS // 4), 16, 10).cast("bigint")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), key_of(docs).alias("key"))


def _final(limit: int, prefix: str = ""):
    return (F.col(f"{prefix}bytes") <= limit) | (F.col(f"{prefix}low") == F.col(f"{prefix}high"))


def _sizes(cells: DataFrame, base: int, depth: int) -> DataFrame:
    """(depth, prefix, bytes, docs, low, high) of all prefixes of `base` to `depth` bits: each table adds up RISE levels."""
    totals = (F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = at = cells.select(F.lit(depth).alias("depth"), F.col("cell").alias("prefix"), "bytes", "docs", "low", "high")
    while depth > base:
        top, depth = depth, max(base, depth - RISE)
        above = at.drop("depth").select("*", F.explode(F.sequence(F.lit(depth), F.lit(top - 1))).alias("depth"))
        above = materialize(above.withColumn("prefix", F.expr(f"shiftright(prefix, {top} - depth)")).groupBy("depth", "prefix").agg(*totals))
        out, at = out.unionByName(above), above.filter(F.col("depth") == depth)
    return out


def _level(rows: DataFrame, base: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows under open buckets of `base` bits: the leaf of each cell of `depth` bits, and the cells still open."""
    cell = F.shiftright("key", BITS - depth).alias("cell")
    cells = materialize(rows.groupBy(cell).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("key").alias("low"), F.max("key").alias("high")))
    sizes = _sizes(cells, base, depth)
    parents = sizes.filter(~_final(limit)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    final = sizes.filter(_final(limit)).withColumn("parent", F.shiftright("prefix", 1))
    # a final bucket is a leaf if its parent is not final, or if there is none
    leaves = final.filter(F.col("depth") == 0).unionByName(final.filter("depth > 0").join(parents, ["depth", "parent"], "left_semi").select(final.columns))
    span = F.sequence(F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1"))
    directory = leaves.select(F.explode(span).alias("cell"), "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    return materialize(directory.join(cells.select("cell"), "cell", "left_semi")), cells.filter(~_final(limit)).select("cell")


def shards(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, shard (its key bits), depth, shard_bytes, shard_docs, oversized for every row of docs."""
    return _placed(docs, limit).drop("key")


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    rows = materialize(keyed(docs))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, depth = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    done = []
    while True:
        cell = F.shiftright("key", BITS - depth).alias("cell")
        directory, open_ = _level(rows, base, depth, limit)
        done.append(rows.select("*", cell).join(directory, "cell").drop("cell"))
        if depth == BITS or open_.isEmpty():
            break
        rows = materialize(rows.select("*", cell).join(open_, "cell", "left_semi").drop("cell"))
        base, depth = depth, min(BITS, depth + STEP)
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "n_bytes", "key", name.alias("shard"), "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, limit: int, path: str) -> str:
    """Write docs as one folder of files for each shard; returns the name of the partition column, `shard` unless docs has one.

    A shard's rows are read, added up and written by one task, so the limit should be some hundred MB.
    """
    column, key = "shard", "_key"
    while column in docs.columns:
        column += "_"
    while key in docs.columns:
        key += "_"
    where = _placed(docs, limit).select(F.col("key").alias(key), F.col("shard").alias(column)).distinct()
    placed = docs.withColumn(key, key_of(docs)).join(where, key).drop(key)
    placed.repartition(column).write.partitionBy(column).parquet(path)
    return column
