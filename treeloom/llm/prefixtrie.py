"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns, and its smallest conversation owns it; along a conversation's path, what it
owns is a suffix, for whoever is smallest in a prefix is smallest in all that continue it with them. So one depth for
each conversation says all it owns: the marks come from one group-by of prefixes, and sums over subtrees from a second
one, in which each member adds what the subtree has on its path and leaves out what it owns there. No table has a row
for a pair of nodes, and no subtree is walked.

Prefixes are named by running sums over a conversation, in windows: each turn adds a 128-bit hash of its depth, role and
text, so the name of a prefix is 128 bits of hash too. A conversation of any length is summed in blocks. Marks are
compared by depth and not by a window over each prefix, since the root and a common first turn hold most conversations.

Defined cases: null role and text are empty; turns of a conversation come by turn, null first, equal ones by a hash of
role and text; repeated rows are turns each; rows without conv_id belong to no conversation and are left out; texts and
conversations of any length are whole; an empty table has no member and no node; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .mixing import n_words
from .running import before

#: Turns of a block of a conversation; span of conversation ids whose list is one text.
BLOCK, TOGETHER = 1024, 4096
#: Nodes with this share of all prefixes, at most as many, are looked up by broadcast.
HEAVY = 50_000
NODE = ("depth", "a", "b")


def _pair(*parts: str | Column) -> tuple[Column, Column]:
    """128 bits of hash of the columns, as two numbers."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("b"), *reversed(parts))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, first, past (places of equal turns, from 0), digest (of role and text), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), n_words().alias("words"))
    once = rows.groupBy("conv_id", "turn", "digest", "words").agg(F.count("*").alias("copies"))
    # parts of a conversation in the order of its turns; written, so that both uses see the same parts
    parted = materialize(once.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()))
    placed = before(parted, ["conv_id"], "part", ["turn", "digest"], ["copies"])
    return placed.select("conv_id", F.col("copies_before").alias("first"), (F.col("copies_before") + F.col("copies")).alias("past"), "digest", "words")


def _blocks(low: str, high: str) -> Column:
    return F.explode(F.expr(f"sequence({low} div {BLOCK}, {high} div {BLOCK})"))


def steps(conversations: DataFrame, near: int = 20, borrowed: Column | None = None) -> DataFrame:
    """conv_id, depth, digest, words, last for each turn of each conversation and its root (depth 0).

    With `borrowed` (of conv_id), so many first turns are those of the first conversation of the run of `near` ids that a
    conversation is in, as far as it has them, and not its own.
    """
    rows = materialize(turns(conversations))
    lengths = rows.groupBy("conv_id").agg(F.max("past").alias("own"))
    h = F.lit(0) if borrowed is None else borrowed
    convs = lengths.select("conv_id", "own", h.cast("bigint").alias("h"), F.expr(f"conv_id - conv_id % {near}").alias("base"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "own", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    of_block = convs.select("conv_id", "h", "k", "n", _blocks("0L", "(own - 1)").alias("block"))
    lying = rows.select("*", _blocks("first", "(past - 1)").alias("block")).join(of_block, ["conv_id", "block"])
    at = F.explode(F.expr(f"sequence(greatest(first, block * {BLOCK}), least(past, (block + 1) * {BLOCK}) - 1)"))
    own = lying.select("conv_id", "h", "k", "n", "digest", "words", at.alias("at")).filter("at >= h").select("conv_id", F.expr("k + at - h + 1").alias("depth"), "digest", "words", "n")
    heads = rows.filter(f"conv_id % {near} = 0").join(convs.groupBy(F.col("base").alias("conv_id")).agg(F.max("k").alias("most")), "conv_id").filter("first < most")
    heads = heads.select(F.col("conv_id").alias("base"), "digest", "words", F.explode(F.expr("sequence(first, least(past, most) - 1)")).alias("at"))
    lent = convs.join(heads, "base").filter("at < k").select("conv_id", F.expr("at + 1").alias("depth"), "digest", "words", "n")
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("bigint").alias("words"), "n")
    return own.unionByName(lent).unionByName(root).select("conv_id", "depth", "digest", "words", (F.col("depth") == F.col("n")).alias("last"))


def named(path: DataFrame) -> DataFrame:
    """steps() with the name (a, b) of the prefix that ends there and of its parent (pa, pb), and the words before the turn."""
    halves = []
    for half in _pair("depth", "digest"):
        halves += [half.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(half, 32)]
    zero = F.lit(0).cast("bigint")
    limbs = [F.when(F.col("depth") == 0, zero).otherwise(x).alias(f"e{i}") for i, x in enumerate(halves)]
    rows = materialize(path.select("conv_id", "depth", F.expr(f"depth div {BLOCK}").alias("block"), "words", "last", *limbs))
    names = [f"e{i}" for i in range(4)]
    sums = before(rows, ["conv_id"], "block", ["depth"], [*names, "words"])
    here, above = _pair(*(F.col(c) + F.col(f"{c}_before") for c in names)), _pair(*(f"{c}_before" for c in names))
    out = materialize(sums.select("conv_id", "depth", "block", "words", "last", F.col("words_before").alias("ahead"), here[0].alias("a"), here[1].alias("b"), above[0].alias("pa"), above[1].alias("pb")))
    discard(rows)
    return out


def _ownership(path: DataFrame) -> DataFrame:
    """conv_id, depth_owned (where its suffix begins), shared (words of the path before it), leaf, above (owner of the node before
    it), n (turns), for every conversation; one that owns nothing has a suffix beyond its end."""
    count = F.count("*").alias("members")
    nodes = materialize(path.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), count, F.count_if("last").alias("ends"), F.min("ahead").alias("ahead"), F.min("pa").alias("pa"), F.min("pb").alias("pb")))
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("depth_owned"), F.min("ahead").alias("shared"), F.max(F.col("ends") == F.col("members")).alias("leaf"), F.min_by("pa", "depth").alias("a"), F.min_by("pb", "depth").alias("b")
    )
    own = materialize(own)
    hung = own.filter("depth_owned > 0").select("conv_id", (F.col("depth_owned") - 1).alias("depth"), "a", "b")
    # members of all nodes add up to the rows of path, so no more than HEAVY nodes are heavy, and no other has many children
    heavy = F.col("members") * HEAVY >= path.count()
    met = hung.join(F.broadcast(nodes.filter(heavy).select(*NODE, F.col("owner").alias("above"))), [*NODE], "left")
    light = met.filter("above is null").drop("above").join(nodes.filter(~heavy).select(*NODE, F.col("owner").alias("above")), [*NODE])
    above = met.filter("above is not null").unionByName(light).select("conv_id", "above")
    whole = path.filter("last").select("conv_id", F.col("depth").alias("n"), (F.col("ahead") + F.col("words")).alias("all"))
    found = whole.join(own.drop("a", "b"), "conv_id", "left").join(above, "conv_id", "left")
    return found.select("conv_id", F.coalesce("depth_owned", F.col("n") + 1).alias("depth_owned"), F.coalesce("shared", "all").alias("shared"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "above", "n")


def end_digests(path: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 for nodes where conversations end: the digest of their ids, ascending, comma-joined.

    A node's ids are joined in spans of TOGETHER ids first; a digest then reads its spans one after another.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    spans = path.filter("last").groupBy(*NODE, F.floor(F.col("conv_id") / TOGETHER).alias("span")).agg(ids.alias("ids"))
    sorted_ = spans.repartition(*NODE).sortWithinPartitions(*NODE, "span")
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, state.hexdigest())))], schema=schema)

    return sorted_.select(*NODE, "ids").mapInArrow(digest, "depth bigint, a bigint, b bigint, ends_sha256 string")


def prefix_trie(path: DataFrame) -> DataFrame:
    """The nodes of the trie of steps(): conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A node is told from others by owner and depth."""
    path = named(path)
    owned = _ownership(path)
    owned = owned.select("*", _blocks("0L", "n").alias("block"))
    member = path.join(owned, ["conv_id", "block"])
    child = (F.col("depth") < F.col("n")) & (F.col("depth_owned") <= F.col("depth") + 1)
    parent = F.when(F.col("depth_owned") < F.col("depth"), F.col("conv_id")).when(F.col("depth_owned") == F.col("depth"), F.col("above"))
    nodes = member.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if(child).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("ahead"), F.lit(0))).alias("saved_tokens"),
    )
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.join(end_digests(path), [*NODE], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """steps() of conversations that begin with up to three turns of the first conversation of their twenty, as their id's
    checksum says."""
    return steps(conversations, 20, F.crc32(F.col("conv_id").cast("string")) % 4)
