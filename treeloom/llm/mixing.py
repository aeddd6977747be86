"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Each source has a quota of words, its weighted share of all words, a few times its own size at most. Slot t of the
schedule is the point frac(t * golden ratio), mapped through the cumulative quotas to a source, so that every stretch of
the mix holds the sources nearly in proportion. A source's documents are shuffled (by a hash of their own) and laid end
to end, as often as its quota needs; its quota is cut into as many equal blocks of words as it has slots, and the slot
of rank r takes block r. The mix is thus a table of (slot, document, words from, to).

Nothing gathers a source: documents are added up in buckets of the shuffle hash and buckets within their source, ranks
in blocks of slots, and slots meet documents in cells of a block's length, by an equi-join. Rows that agree in source,
doc_id and text are one entry with a count until they meet their cell.

Defined cases: null and empty texts have size 0 and are returned with nothing taken; rows without source are a source,
the last one; a text of any length is cut at blocks; repeated rows, and rows without doc_id, are each laid down and
returned; a source of few words has one slot at least; an empty table gives no row; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .running import before

#: Weights of the sources in order, repeating; how often the words of a source are taken at most; words of a block, about.
WEIGHTS, REPEATS, BLOCK = (5, 2, 1), 3, 1024
#: 2^32 over the golden ratio: multiples of it, modulo 2^32, are the points of the schedule.
GOLDEN, RANGE = 2654435769, 1 << 32
#: Slots of a block that are ranked together, entries of a bucket (about), copies that are spread together.
RANKED, BUCKET, SPREAD = 4096, 8192, 4096
ENTRY = ("src", "bucket", "key", "doc_id", "size")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def entries(docs: DataFrame) -> DataFrame:
    """src (the source, marked so that none is no source's name), key (the shuffle hash), doc_id, size, copies."""
    key = F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    src = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("~"))
    return docs.select(src.alias("src"), key.alias("key"), "doc_id", n_words().alias("size")).groupBy("src", "key", "doc_id", "size").agg(F.count("*").alias("copies"))


def quotas(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """src, source_size, target, quota (whole words) and low (the quotas before it), of a table (src, source_size).

    Sources are filled in the order in which they reach their cap: while one takes less than its share of what is left, it
    stops at its cap; the first that does not sets the level for it and all after it. The table has a row a source.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    named = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(Window.orderBy("src")) - 1) % len(weights))))
    cap = (F.col("source_size") * repeats).cast("double")
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    ahead, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - repeats * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    judged = named.select("*", cap.alias("cap"), level.alias("level"), F.row_number().over(filled).alias("turn")).withColumn("stops", F.col("cap") <= F.col("weight") * F.col("level"))
    first = F.min_by(F.when(~F.col("stops"), F.col("level")), F.when(~F.col("stops"), F.col("turn"))).over(Window.partitionBy())
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * first)
    whole = judged.select("src", "source_size", target.alias("target")).withColumn("quota", F.floor("target").cast("bigint"))
    low = F.coalesce(F.sum("quota").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return whole.withColumn("low", low.cast("bigint"))


def schedule(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, src, rank (of the slot among its source's), slots (how many those are), quota, source_size, for quotas()."""
    spark = shares.sparkSession
    total = shares.agg(F.sum("quota")).first()[0] or 0
    n = math.ceil(total / block)
    cells = max(1, min(n, 1 << 16))
    some = shares.filter("quota > 0").select("src", "quota", "source_size", "low")
    # a source's interval meets the points by cells of the unit interval, which no source's share can fill with rows
    at = lambda words: F.floor(words * F.lit(cells / max(1, total)))
    spans = some.select("*", F.explode(F.sequence(at(F.col("low")), at(F.col("low") + F.col("quota")))).alias("cell"))
    point = F.floor(F.expr(f"(id * {GOLDEN}) % {RANGE}") / float(RANGE) * float(total)).cast("bigint")
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", at(F.col("point")))
    placed = points.join(spans, "cell").filter("point >= low and point < low + quota").select("slot", "src", F.lit(1).cast("bigint").alias("one"))
    placed = materialize(placed)
    missed = some.join(placed.select("src").distinct(), "src", "left_anti")
    late = missed.select((F.lit(n) + F.row_number().over(Window.orderBy("src")) - 1).cast("bigint").alias("slot"), "src", F.lit(1).cast("bigint").alias("one"))
    all_ = placed.unionByName(late).withColumn("part", F.floor(F.col("slot") / RANKED))
    ranked = before(all_, ["src"], "part", ["slot"], ["one"])
    # a few rows for each source: the counts of its blocks of slots reach it with them
    counts = all_.groupBy("src", "part").count().groupBy("src").agg(F.sum("count").alias("slots")).join(some, "src")
    parts = counts.join(all_.select("src", "part").distinct(), "src").select("src", "part", "slots", "quota", "source_size")
    return ranked.select("slot", "src", "part", F.col("one_before").alias("rank")).join(parts, ["src", "part"]).drop("part")


def _laid(found: DataFrame) -> DataFrame:
    """Entries with `start`: the words of their source before them, in the order of the shuffle."""
    rows = found.withColumn("words", F.col("size") * F.col("copies"))
    return before(rows, ["src"], "bucket", ["key", "doc_id", "size"], ["words"]).withColumnRenamed("words_before", "start")


def _bucketed(found: DataFrame) -> DataFrame:
    digits = max(0, math.ceil(math.log(max(1, found.count() / BUCKET), 16)))
    return found.withColumn("bucket", F.substring("key", 1, digits) if digits else F.lit(""))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """slot, doc_id, key (shuffle hash), src, copy, from, to: the words of a document that each slot of the mix takes, in order."""
    found = materialize(entries(docs))
    shares = materialize(quotas(found.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, repeats))
    return _pieces(_laid(_bucketed(found)), shares, block)


def _pieces(laid: DataFrame, shares: DataFrame, block: int) -> DataFrame:
    slots = schedule(shares, block)
    edge = lambda r: F.expr(f"{r} * (quota div slots) + (quota % slots) * {r} div slots")
    taken = slots.select("slot", "src", "source_size", edge("rank").alias("a"), edge("(rank + 1)").alias("b"))
    turns = taken.select("*", F.explode(F.sequence(F.expr("a div source_size"), F.expr("(b - 1) div source_size"))).alias("turn")).filter("b > a")
    clipped = turns.select("slot", "src", "turn", F.expr("greatest(a - turn * source_size, 0)").alias("a"), F.expr("least(b - turn * source_size, source_size)").alias("b"))
    asked = clipped.select("*", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")).alias("cell"))
    lying = laid.filter("words > 0").select("src", "bucket", "key", "doc_id", "size", "start", "words", F.explode(F.expr(f"sequence(start div {block}, (start + words - 1) div {block})")).alias("cell"))
    # clipped to the cell, so that no pair of ranges meets twice
    low, high = F.greatest("a", "start", F.col("cell") * block), F.least("b", F.col("start") + F.col("words"), (F.col("cell") + 1) * block)
    met = asked.join(lying, ["src", "cell"]).select("slot", "turn", *ENTRY, (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high")).filter("high > low")
    each = met.select("*", F.explode(F.expr("sequence(low div size, (high - 1) div size)")).alias("copy"))
    return each.select("slot", "turn", *ENTRY, "copy", F.expr("greatest(low - copy * size, 0)").alias("from"), F.expr("least(high - copy * size, size)").alias("to"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs: the words that the mix takes of it, repeats counted."""
    found = materialize(entries(docs))
    shares = materialize(quotas(found.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, repeats))
    laid = materialize(_laid(_bucketed(found)))
    per_copy = materialize(_pieces(laid, shares, block).groupBy(*ENTRY, "copy").agg(F.sum(F.col("to") - F.col("from")).alias("taken")))
    used = per_copy.groupBy("src", "bucket", "key", F.col("doc_id").alias("of"), F.col("size").alias("words_of")).agg(F.count("*").alias("used"))
    same = (laid["src"] == used["src"]) & (laid["bucket"] == used["bucket"]) & (laid["key"] == used["key"]) & laid["doc_id"].eqNullSafe(used["of"]) & (laid["size"] == used["words_of"])
    left = laid.join(used, same, "left").select(*(laid[c] for c in ENTRY), (laid["copies"] - F.coalesce("used", F.lit(0))).alias("left")).filter("left > 0")
    heaps = left.select("*", F.explode(F.expr(f"sequence(0, (left - 1) div {SPREAD})")).alias("heap"))
    many = heaps.filter(f"left > {SPREAD}").repartition("key", "heap").unionByName(heaps.filter(f"left <= {SPREAD}"))
    idle = many.select(*ENTRY, F.explode(F.expr(f"array_repeat(0L, cast(least({SPREAD}, left - heap * {SPREAD}) as int))")).alias("taken"))
    # shares reach the documents through (src, bucket), which no source fills
    about = laid.select("src", "bucket").distinct().join(shares.select("src", "source_size", "target"), "src")
    return per_copy.select(*ENTRY, "taken").unionByName(idle).join(about, ["src", "bucket"]).select("doc_id", "size", "source_size", "target", "taken")
