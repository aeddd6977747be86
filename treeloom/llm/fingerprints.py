"""Document fingerprints by locally consistent parsing.

A text's code points are level 0. At each level runs of one symbol become one symbol; deterministic coin tossing
(the lowest bit in which a symbol differs from its left neighbour, with that bit's value, repeated until labels are
smaller than six) labels the symbols; phrases start at local maxima of the labels and are named by a hash of what
they hold, until a text is one phrase (three levels at least). Bounds depend only on a few neighbours in the same
text, so equal substrings have equal interior phrases at every level, wherever they stand.

phrases() gives every name of a level. The fingerprint of a document keeps the KEPT smallest distinct names, of 32
bits, of levels 1, 2 and 3 up, and likeness is the weighted mean of the shares that two fingerprints have in common: an
estimate, from k names of a group, whose standard error is sqrt(p * (1 - p) / k) at a share of p, for the whole at
most 0.05, however long the texts.

Defined cases: null is an empty text, whose fingerprint is ".." and which is like an empty text (1) and unlike any
other (0); an empty table gives an empty one; a text of any length is parsed whole; equal texts have equal
fingerprints, whatever stands beside them; rows that repeat a doc_id (ties) follow one another by the hash of their
text, then by text; rows without doc_id stand below all others; a table of one row is its own next document; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

#: Names kept of levels 1, 2, and 3 up; their weight in the likeness.
KEPT, WEIGHTS = (16, 48, 64), (0.1, 0.3, 0.6)
LOWEST = -(2**63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def toss(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which each symbol differs from its left neighbour, plus that bit."""
    left = np.empty_like(a)
    left[1:] = a[:-1]
    left[first] = ~a[first]
    x = a ^ left
    place = np.bitwise_count((x & -x) - a.dtype.type(1)) if a.dtype != np.uint8 else np.bitwise_count((x & (~x + np.uint8(1))) - np.uint8(1))
    return (2 * place + ((a >> place.astype(a.dtype)) & a.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def parse(names: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one level over several texts: names, and the text of each."""
    fresh = np.empty(len(names), bool)
    fresh[0] = True
    fresh[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    if len(at) < len(names):
        run = np.diff(at, append=len(names)).astype(np.uint64)
        names, doc = names[at], doc[at]
        long = run > 1
        names[long] = mix(names[long] + run[long] * np.uint64(0x9FB21C651E98DF25))
    first = np.empty(len(names), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    label = names
    for _ in range(4):
        label = toss(label, first)
    start = first.copy()
    rises = label[1:] > label[:-1]
    start[1:-1] |= rises[:-1] & (label[1:-1] > label[2:]) & ~first[2:]  # a text's last symbol begins no phrase, whatever follows
    starts = np.flatnonzero(start)
    place = np.arange(len(names)) - np.repeat(starts, np.diff(starts, append=len(names)))
    part = mix(names + (place.astype(np.uint64) + np.uint64(64 * level + 1)) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(part, starts) + np.uint64(level)), doc[starts]


def levels(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level by level the names of all phrases, and the number of each one's text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return
    names = mix(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    doc, level = np.repeat(np.arange(len(texts)), lengths), 0
    while len(names):
        level += 1
        with np.errstate(over="ignore"):
            names, doc = parse(names, doc, level)
        yield level, names, doc
        if level >= 3:  # what is one phrase is done
            more = np.bincount(doc)[doc] > 1
            names, doc = names[more], doc[more]


def fingerprint(texts: list[str]) -> list[str]:
    """Of each text the smallest distinct phrase names of each group of levels, as hexadecimal words."""
    groups: list[list[np.ndarray]] = [[], [], []]
    for level, names, doc in levels(texts):
        groups[min(level, 3) - 1].append((doc.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
    if not groups[0]:
        return [".."] * len(texts)
    out: list[list[str]] = [[] for _ in texts]
    for arrays, kept in zip(groups, KEPT, strict=True):
        key = np.sort(np.concatenate(arrays))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        owner = (key >> np.uint64(32)).astype(np.int64)
        word = (key & np.uint64(0xFFFFFFFF)).astype(">u4")
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            out[i].append(word[bounds[i] : min(bounds[i] + kept, bounds[i + 1])].tobytes().hex())
    return [".".join(x) for x in out]


def phrases(docs: DataFrame, level: int) -> DataFrame:
    """doc_id and the names of all phrases of a level in order, for every row of docs; none where a text has no such level."""

    def run(part):
        texts = [t or "" for t in part.column("text").to_pylist()]
        names, doc = next(((n, d) for at, n, d in levels(texts) if at == level), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        return {"doc_id": part.column("doc_id"), "names": common.ragged(names.view(np.int64), np.searchsorted(doc, np.arange(len(texts) + 1)))}

    return common.map_batches(docs.select("doc_id", "text"), run, common.fields(docs, ["doc_id"], "names array<bigint>"))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; of each group of levels the share of the smallest names of the union that both have."""
    if a == b:
        return 1.0
    total = weight = 0.0
    for x, y, kept, w in zip(a.split("."), b.split("."), KEPT, WEIGHTS, strict=True):
        u, v = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        least = sorted(u | v)[:kept]
        if least:
            total += w * sum(s in u and s in v for s in least) / len(least)
            weight += w
    return total / weight if weight else 0.0


def edited(text: str, following: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def with_next(docs: DataFrame, cells: int) -> DataFrame:
    """Rows dealt to cells of about equal numbers, in order; each cell also gets, marked, the row that follows its last.

    Cells are bounded by quantiles of the ids; one that a single id fills (or rows without any) is parted by the hash of
    the text. Only ids are read for that; bounds, sizes and the first row's key of each cell come to the driver.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / cells for i in range(1, cells)], 10_000).alias("cuts")).first().cuts if cells > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    parts = np.ones(len(cuts) + 1, np.int64)

    def numbers(id_: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        cell = np.searchsorted(cuts, id_, side="left")
        return (np.cumsum(parts) - parts)[cell] + (((hash_ >> 32) + (1 << 31)) * parts[cell] >> 32)

    def number(id_: str, hash_: str | Column) -> Column:
        """As numbers() stands now: a function is shipped as it is when first used."""
        return F.pandas_udf(lambda i, h: pd.Series(numbers(i.to_numpy(), h.to_numpy())), "bigint")(id_, hash_)

    sizes = ids.groupBy(number("id", F.lit(0).cast("bigint")).alias("cell")).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()
    share = sum(r.n for r in sizes) / cells
    for r in sizes:
        if r.low == r.high and r.n > 2 * share:
            parts[r.cell] = -(-r.n // max(1, int(share)))
    hash_ = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), hash_.alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    keys_of = rows.select("id", "hash") if (parts > 1).any() else ids.withColumn("hash", F.lit(0).cast("bigint"))
    tops = {r.cell: (r.top.id, r.top.hash) for r in keys_of.groupBy(number("id", "hash").alias("cell")).agg(F.max(F.struct("id", "hash")).alias("top")).collect()}
    order = sorted(tops)
    above = {c: order[(i + 1) % len(order)] for i, c in enumerate(order)}  # the lowest cell is followed by the highest row
    highest = {c: top if (parts > 1).any() else (top[0], None) for c, top in tops.items()}

    @F.pandas_udf("array<int>")
    def numbers_of(id_, hash_):
        id_, hash_ = id_.to_numpy(), hash_.to_numpy()
        found = numbers(id_, hash_).tolist()
        return pd.Series([[c, -above[c] - 1] if highest[c][0] == i and highest[c][1] in (None, h) else [c] for c, i, h in zip(found, id_.tolist(), hash_.tolist(), strict=True)])

    dealt = rows.select("*", F.explode(numbers_of("id", "hash")).alias("to")).withColumn("cell", F.when(F.col("to") < 0, -F.col("to") - 1).otherwise(F.col("to"))).withColumn("follows", F.col("to") < 0)
    return dealt.select("doc_id", "id", "hash", "text", "cell", "follows").repartition("cell").sortWithinPartitions("cell", "follows", F.desc("id"), F.desc("hash"), "text")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """For each row: its fingerprint, that of its edited text, and its likeness to that and to the next document's."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    cells = cells or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row that has not met its next: (cell, follows, doc_id, text, fingerprint)
        for batch in batches:
            for part in common.steps(batch, "text", common.STEP_BYTES):
                rows = list(zip(*(part.column(c).to_pylist() for c in ("cell", "follows", "doc_id", "text")), strict=True))
                rows = [(*r, m) for r, m in zip(rows, fingerprint([r[3] for r in rows]), strict=True)]
                chain = ([held] if held else []) + rows
                pairs = [(a, b) for a, b in zip(chain, chain[1:]) if not a[1] and a[0] == b[0]]
                held = chain[-1]
                if pairs:
                    yield answer(pairs)

    def answer(pairs: list[tuple]) -> pa.RecordBatch:
        changed = [edited(a[3], b[3]) for a, b in pairs]
        other = fingerprint(changed)
        columns = [
            [a[2] for a, _ in pairs],
            [len(a[3]) for a, _ in pairs],
            [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            [a[4] for a, _ in pairs],
            other,
            [likeness(a[4], o) for (a, _), o in zip(pairs, other, strict=True)],
            [likeness(a[4], b[4]) for a, b in pairs],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, SCHEMA)
