"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same words form a class, whose smallest doc_id represents it. A representative's set of distinct
five-word shingles gets a MinHash signature; BANDS bands of ROWS values each put it in as many buckets. Buckets with
the same members are checked once. Within a bucket, signatures are compared BATCH values at a time: with m of n
values equal, similarity has the posterior Beta(m + 1, n - m + 1), and a pair goes once the chance that it reaches
the threshold is under MISS. What survives is verified on the full shingle sets; pairs that are already connected
need no check, so a bucket yields at most one link a member. Links become components.

A bucket of more than BLOCK members (or BLOCK_BYTES of shingles) is checked as pairs of blocks in separate groups.
No bucket is capped and no pair is left out other than by MISS and by the chance (2e-6 at the threshold, less above)
that no band agrees.

Defined cases: null, empty and blank texts have no shingle and are linked with nothing; an empty table gives an empty
one; under five words the whole sequence is the one shingle; a text of any length has all its shingles compared; of a
group the smallest doc_id is kept, and all rows that share it (ties) are; rows of a repeated doc_id are one document that has the links of all its rows; rows
without doc_id are not compared, get no component and are kept; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import mix, shingle_sets, signatures

ROWS, BANDS = 5, 48
#: Similarity, as a percentage, from which documents are linked.
PERCENT = 75
BATCH, BATCHES, MISS = 32, 4, 1e-6
BLOCK, BLOCK_BYTES = 1024, 32 << 20


@cache
def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest matches among n values that leave the threshold a chance of `miss`.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is the chance of at most m successes in n + 1 trials of chance t.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * np.log(t) + (n + 1 - m) * np.log1p(-t))
        if total >= miss:
            return m
    return n


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (a hash of the words; null without any) and the key of each band."""

    def run(part):
        sets, digests = shingle_sets(part.column("text").to_pylist())
        rows = signatures(sets, ROWS * BANDS).reshape(len(sets), BANDS, ROWS).astype(np.uint64)
        keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for j in range(ROWS):
            keys = mix((keys + rows[:, :, j]) * np.uint64(0x9FB21C651E98DF25))
        return {"doc_id": part.column("doc_id"), "n_shingles": [len(s) for s in sets], "class_id": [class_of(d) for d in digests], "bands": keys.view(np.int64)}

    return common.map_batches(docs.select("doc_id", "text"), run, common.fields(docs, ["doc_id"], "n_shingles bigint, class_id bigint, bands array<bigint>"))


def class_of(digest: bytes) -> int | None:
    return int.from_bytes(digest[:8], "little", signed=True) if digest else None


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i


def bucket_links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is similar in a bucket; with two sides only pairs across them are compared."""
    n = len(sets)
    sign = signatures(sets, BATCH * BATCHES, ROWS * BANDS)  # other draws than those that made the bucket
    size = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    held = np.zeros(int(local.max()) + 1, bool)
    forest, of, links = Forest(n), np.arange(n), []
    crossing = len(set(side.tolist())) > 1
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        rest = rest[(of[i + 1 :] != of[i]) & ((side[i + 1 :] != side[i]) | (not crossing))]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        matches = np.zeros(len(rest), np.int64)
        for b in range(BATCHES):
            if not len(rest):
                break
            at = slice(b * BATCH, (b + 1) * BATCH)
            matches += (sign[rest, at] == sign[i, at]).sum(axis=1)
            stays = matches >= least_matches((b + 1) * BATCH, percent)
            rest, matches = rest[stays], matches[stays]
        if not len(rest):
            continue
        held[local[starts[i] : ends[i]]] = True
        owners = np.repeat(np.arange(len(rest)), size[rest])
        flat = np.concatenate([local[starts[j] : ends[j]] for j in rest])
        common_ = np.bincount(owners, weights=held[flat], minlength=len(rest)).astype(np.int64)
        held[local[starts[i] : ends[i]]] = False
        for j in rest[100 * common_ >= percent * (size[rest] + size[i] - common_)].tolist():
            a, b = forest.root(i), forest.root(j)
            if a != b:
                forest.parent[max(a, b)] = min(a, b)
                links.append((i, j))
        if links and links[-1][0] == i:
            of = np.array([forest.root(k) for k in range(n)])
    return links


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): enough verified links between classes (class_id, rep, n_shingles, bands) to connect all that are similar."""
    bands = classes.select("class_id", "n_shingles", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("class_id").cast("decimal(38,0)")).alias("mark"), F.sum("n_shingles").alias("shingles")).filter("members > 1")
    once = buckets.groupBy("members", "mark").agg(F.min(F.struct("key", "shingles")).alias("first"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("first.shingles") * 8 / BLOCK_BYTES)).cast("int")
    chosen = common.materialize(once.select(F.col("first.key").alias("key"), blocks.alias("blocks")))
    found = bands.select("key", "class_id").join(chosen, "key").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    # the pairs of blocks (x, y), x <= y, that this member's block is in, numbered x * blocks + y
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(other, lambda o: F.least(F.col("block"), o) * F.col("blocks") + F.greatest(F.col("block"), o))
    members = common.materialize(found.select("class_id", "key", "block", F.explode(pairs).alias("pair")))
    needed = members.select("class_id").distinct().join(classes.select("class_id", "rep"), "class_id").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(needed, "doc_id", "left_semi")

    def sets(part):
        found, digests = shingle_sets(part.column("text").to_pylist())
        return {"class_id": [class_of(d) for d in digests], "shingles": [s.tobytes() for s in found]}

    shingles = common.map_batches(texts, sets, "class_id bigint, shingles binary")
    grouped = members.join(shingles, "class_id").repartition("key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            group.sort(key=lambda row: row[0])
            ids = [row[0] for row in group]
            out = bucket_links([np.frombuffer(row[2], np.uint64) for row in group], np.array([row[1] for row in group]))
            return pa.RecordBatch.from_pydict({"u": pa.array([ids[a] for a, _ in out], pa.int64()), "v": pa.array([ids[b] for _, b in out], pa.int64())})

        at, group = None, []
        for batch in batches:
            for part in common.steps(batch, "shingles"):
                columns = [part.column(c).to_pylist() for c in ("key", "pair", "class_id", "block", "shingles")]
                for key, pair, *row in zip(*columns, strict=True):
                    if (key, pair) != at:
                        if len(group) > 1:
                            yield close()
                        at, group = (key, pair), []
                    group.append(row)
            common.give_back()
        if len(group) > 1:
            yield close()

    return grouped.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    seen = common.materialize(sketches(docs))
    words = seen.filter("doc_id is not null and class_id is not null")
    # equal in every row of a class, so any will do; aggregated before the shuffle, however many copies there are
    classes = common.materialize(words.groupBy("class_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    ids = words.groupBy("doc_id").agg(F.min("class_id").alias("v"), F.max("class_id").alias("u")).filter("u > v")
    repeated = words.select("doc_id", F.col("class_id").alias("u")).join(ids.select("doc_id", "v"), "doc_id").select("u", "v")
    joined = components(links(classes, docs).unionByName(repeated))
    grouped = classes.select("class_id", "rep").join(joined, F.col("class_id") == F.col("id"), "left").select("class_id", "rep", F.coalesce("component", "class_id").alias("component"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = common.materialize(grouped.join(least, "component").select("class_id", "component_id"))
    out = seen.select("doc_id", "n_shingles", "class_id").join(labels, "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
