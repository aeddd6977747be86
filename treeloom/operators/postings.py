"""A search index on disk: documents in parts, and an inverted index of their trigrams.

Documents of a kind are written as they come, in parts; a document's number tells its part. A block of documents has one
posting for each of its grams: the numbers of all its documents that have the gram, from the block's first on, so that what
is shuffled and sorted are lists and not single pairs. Postings lie in buckets of grams, sorted by gram and number, and a
query reads the row groups of its grams in their buckets alone. Candidates then lead back to the parts that hold them, and
are verified there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.text import Term, fold
from .search import Index

#: Buckets of grams; rarest grams of a query that are intersected; share of documents from which a gram tells too little.
BUCKETS, RAREST, COMMON = 32, 4, 0.2
#: The bits of a number that count within a part.
WITHIN = 33
KINDS = "kind string, buckets int, schema string"
#: Documents of a block (their offsets are small integers), and characters, from which on a block takes no more.
BLOCK, BLOCK_CHARS = 1 << 15, 1 << 22
LISTS = "gram string, first bigint, n int, at array<smallint>"
POSTINGS = f"{LISTS}, bucket int"


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int").alias("bucket")


def part_of(number: Column) -> Column:
    return F.shiftright(number, WITHIN).cast("int").alias("part")


@dataclass(frozen=True)
class StoredIndex(Index):
    """An Index whose documents are tables with `part` and `no`; postings: kind to (gram, first, n, at, bucket); frequencies: kind to
    (gram, df); sizes: documents of a kind."""

    postings: dict[str, DataFrame] = field(default_factory=dict)
    frequencies: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    buckets: int = BUCKETS

    def having(self, kind: str, terms: Sequence[Term]) -> DataFrame:
        """Documents that hold all terms: those of the rarest grams' postings, verified; all, where no gram is rare."""
        docs = self.docs[kind]
        holds = reduce(lambda a, b: a & b, (F.contains("folded", F.lit(t.folded)) for t in terms))
        chosen = self.rarest(kind, {t.folded[i : i + 3] for t in terms for i in range(len(t.folded) - 2)})
        if chosen is None:
            return docs.limit(0)
        if chosen:
            docs = docs.join(self.candidates(kind, chosen), ["part", "no"], "left_semi")
        return docs.filter(holds)

    def rarest(self, kind: str, wanted: set[str]) -> list[str] | None:
        """The rarest of these grams that few documents have; None if a gram is in no document. A row for each gram of the
        query comes to the driver."""
        if not wanted:
            return []
        known = {r.gram: r.df for r in self.frequencies[kind].filter(F.col("gram").isin(sorted(wanted))).collect()}
        if len(known) < len(wanted):
            return None
        return [g for g in sorted(known, key=lambda g: (known[g], g))[:RAREST] if known[g] <= COMMON * self.sizes[kind]]

    def candidates(self, kind: str, chosen: list[str]) -> DataFrame:
        """(part, no) of the documents with all chosen grams. Only the grams' buckets are read, and in them their row groups."""
        spark = self.docs[kind].sparkSession
        of = {r.bucket for r in spark.createDataFrame([(g,) for g in chosen], "gram string").select(bucket(F.col("gram"), self.buckets)).collect()}
        hit = self.postings[kind].filter(F.col("bucket").isin(sorted(of)) & F.col("gram").isin(chosen))
        hit = hit.select("gram", F.explode(F.transform("at", lambda a: F.col("first") + a)).alias("no"))
        return hit.groupBy("no").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen)).select(part_of(F.col("no")), "no")


def _cuts(numbers: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of blocks: numbers that follow each other, few enough of them and of their characters."""
    lo, chars = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and (chars >= BLOCK_CHARS or numbers[i] != numbers[i - 1] + 1 or i - lo >= BLOCK):
            yield lo, i
            lo, chars = i, 0
        chars += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _block(texts: list[str], first: int) -> Iterator[pa.RecordBatch]:
    """The postings of one block; texts of too many different characters for one number are two blocks."""
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(codes) < 3:
        return
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen).astype(np.uint32)
    k = len(letters)
    if k**3 * n >= 1 << 63 and n > 1:
        yield from _block(texts[: n // 2], first)
        yield from _block(texts[n // 2 :], first + n // 2)
        return
    rank = (np.cumsum(seen) - 1)[codes]
    of = np.repeat(np.arange(n), [len(t) for t in texts])
    pairs = (((rank[:-2] * k + rank[1:-1]) * k + rank[2:]) * n + of[2:])[of[:-2] == of[2:]]
    if not len(pairs):
        return
    pairs.sort()
    gram, at = np.divmod(pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))], n)
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    name = gram[starts]
    text = letters[np.stack([name // (k * k), name // k % k, name % k], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    offsets = np.append(starts, len(gram)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int16)))
    columns = [pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), pa.array(np.full(len(starts), first, np.int64)), pa.array(np.diff(offsets)), lists]
    yield pa.RecordBatch.from_arrays(columns, names=["gram", "first", "n", "at"])


def lists(docs: DataFrame) -> DataFrame:
    """(gram, first, n, at) of docs (no, folded): for each block and gram the n documents that have it, as numbers from the block's
    first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column("no").to_numpy(), batch.column("folded").to_pylist()
            for lo, hi in _cuts(numbers, [len(t) for t in texts]):
                yield from _block(texts[lo:hi], int(numbers[lo]))

    return docs.select("no", "folded").mapInArrow(run, LISTS)


def store(ix: Index, path: str, buckets: int = BUCKETS) -> StoredIndex:
    """Write an index under a path, and open it."""
    spark, schemas = ix.lines.sparkSession, []
    for kind, docs in ix.docs.items():
        numbered = docs.drop("folded").withColumn("no", F.monotonically_increasing_id())
        numbered.withColumn("part", part_of(F.col("no"))).write.partitionBy("part").parquet(f"{path}/{kind}/docs")
        kept = spark.read.schema(numbered.schema).parquet(f"{path}/{kind}/docs")
        found = lists(kept.select("no", fold(F.col("text")).alias("folded"))).withColumn("bucket", bucket(F.col("gram"), buckets))
        # a common gram is dealt to several files by the parts of its documents
        dealt = found.repartition("bucket", F.shiftright("first", WITHIN) % 4).sortWithinPartitions("bucket", "gram", "first")
        dealt.write.partitionBy("bucket").options(**{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#at.list.element": "false"}).parquet(f"{path}/{kind}/postings")
        written = spark.read.schema(POSTINGS).parquet(f"{path}/{kind}/postings")
        written.groupBy("gram").agg(F.sum("n").alias("df")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/{kind}/frequencies")
        schemas.append((kind, buckets, kept.schema.add("part", IntegerType()).json()))
    spark.createDataFrame(schemas, KINDS).coalesce(1).write.json(f"{path}/kinds")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> StoredIndex:
    rows = spark.read.schema(KINDS).json(f"{path}/kinds").collect()
    docs = {r.kind: spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.kind}/docs").withColumn("folded", fold(F.col("text"))) for r in rows}
    postings = {r.kind: spark.read.schema(POSTINGS).parquet(f"{path}/{r.kind}/postings") for r in rows}
    frequencies = {r.kind: spark.read.schema("gram string, df bigint").parquet(f"{path}/{r.kind}/frequencies") for r in rows}
    sizes = {k: d.count() for k, d in docs.items()}
    return StoredIndex(docs, docs["content"].select("file_id", "line", "text"), postings, frequencies, sizes, max((r.buckets for r in rows), default=BUCKETS))
