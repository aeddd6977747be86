"""Search over file names, paths, lines and symbols, with tagged terms, ranking, limits and excerpts.

The index is four tables of documents; a query's terms become predicates on their folded texts. A term tagged for
another kind filters by file: each document has its file's name and path, the other kinds are met by a semi-join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import Term, byte_span, fold, lines, tokenize
from .tree import dense_ids, file_of

MAX_CONTEXT = 50
#: Order of the kinds in a result.
ORDER = ("symbol", "file", "path", "content")
#: Kinds with one document for each file, and the column in which every document has its text.
OF_FILE = {"file": "name", "path": "path"}


@dataclass(frozen=True)
class Limits:
    """How many hits of each kind are listed; None lists all."""

    file: int | None = 30
    path: int | None = 30
    content: int | None = 100
    symbol: int | None = 30


TERMINAL = Limits(50, 50, 2000, 200)
ALL = Limits(None, None, None, None)


@dataclass(frozen=True)
class Index:
    """docs: for each kind (doc, file_id, path, line, text, folded); lines: (file_id, line, text)."""

    docs: dict[str, DataFrame]
    lines: DataFrame

    def having(self, kind: str, terms: Sequence[Term]) -> DataFrame:
        """Documents of a kind that hold all terms."""
        return self.docs[kind].filter(reduce(lambda a, b: a & b, (F.contains("folded", F.lit(t.folded)) for t in terms)))


def index(files: DataFrame, entities: DataFrame | None = None, tree: DataFrame | None = None) -> Index:
    """files: (file_id, name, path, text); a null text leaves the file out, an empty path is its name.

    entities: where given, what is neither file nor folder becomes a symbol, at the line it starts on.
    """
    known = files.filter("text is not null").withColumn("path", F.when(F.col("path") == "", F.col("name")).otherwise(F.col("path")))
    none = F.lit(None).cast("int")

    def doc(df: DataFrame, key: Column, line: Column, text: Column) -> DataFrame:
        return df.select(key.alias("doc"), "file_id", "name", "path", line.alias("line"), text.alias("text")).withColumn("folded", fold(F.col("text")))

    split = known.select("file_id", "name", "path", F.posexplode(lines(F.col("text"))).alias("line", "body"))
    docs = {
        "file": doc(known, F.struct("file_id"), none, F.col("name")),
        "path": doc(known, F.struct("file_id"), none, F.col("path")),
        "content": doc(split, F.struct("file_id", "line"), F.col("line"), F.col("body")),
    }
    if entities is not None:
        symbols = entities.filter("kind not in ('file', 'folder')").select("id", F.col("name").alias("symbol"), "line_start")
        placed = symbols.join(file_of(entities, tree), "id").join(known.select("file_id", "name", "path"), "file_id")
        docs["symbol"] = doc(placed, F.struct("id"), F.col("line_start"), F.col("symbol"))
    return Index(docs, split.select("file_id", "line", F.col("body").alias("text")))


def grams(docs: DataFrame, size: int = 3) -> DataFrame:
    """(gram, doc): each run of `size` characters of a folded text, once for each document.

    Code points of many texts are compared at once, as arrays; a text is a row, so a batch is bounded by its rows.
    """
    doc = docs.schema["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                texts = batch.column("folded").to_pylist()
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
                of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                n = len(codes) - size + 1
                if n <= 0:
                    continue
                within = np.flatnonzero(of[:n] == of[size - 1 :])
                windows = np.lib.stride_tricks.sliding_window_view(codes, size)[within]
                name = np.zeros(len(within), np.uint64)
                for i in range(size):
                    name = (name << np.uint64(21)) | windows[:, i]
                order = np.lexsort((name, of[within]))
                name, owner = name[order], of[within][order]
                first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])))) if len(order) else order
                distinct, kind = np.unique(name[first], return_inverse=True)
                text = ["".join(chr(d >> 21 * i & 0x1FFFFF) for i in reversed(range(size))) for d in distinct.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()).take(pa.array(kind)), batch.column("doc").take(pa.array(owner[first]))], names=["gram", "doc"])

    if not 1 <= size <= 3:
        raise ValueError("grams have one to three characters")
    return docs.filter(F.length("folded") >= size).select("doc", "folded").mapInArrow(run, StructType([StructField("gram", StringType()), doc]))


def shortlist(docs: DataFrame, postings: DataFrame, needle: str) -> DataFrame:
    """docs that have every gram of a needle of three characters or more: candidates, to be verified."""
    wanted = list({needle[i : i + 3] for i in range(len(needle) - 2)})
    if not wanted:
        return docs
    hit = postings.filter(F.col("gram").isin(wanted)).groupBy("doc").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return docs.join(hit.select("doc"), "doc", "left_semi")


def find(text: Column, needle: str) -> Column:
    """Character offset of the first occurrence, from 0; -1 for none."""
    return F.instr(text, needle) - 1


def matches(ix: Index, terms: list[Term], kind: str) -> DataFrame | None:
    """Documents of a kind for which every term holds, with `start` and `end` of the first term about their own text."""
    own = [t for t in terms if t.tag in (None, kind)]
    if not own or kind not in ix.docs:
        return None
    out = ix.having(kind, own)
    for t in terms:
        if t.tag in OF_FILE and t.tag != kind:
            out = out.filter(F.contains(fold(F.col(OF_FILE[t.tag])), F.lit(t.folded)))
        elif t.tag not in (None, kind):
            if t.tag not in ix.docs:
                return None
            files = ix.having(t.tag, [t]).select("file_id")
            out = out.join(files, "file_id", "left_semi")
    at = find(F.col("folded"), own[0].folded)
    return out.withColumn("start", at).withColumn("end", at + len(own[0].needle))


def ranking(kind: str) -> list[Column]:
    return {
        "symbol": [F.length("text"), F.col("path"), F.col("line"), F.col("doc")],
        "file": [F.length("text"), F.col("path"), F.col("doc")],
        "path": [F.length("path"), F.col("path"), F.col("doc")],
        "content": [F.col("path"), F.col("line"), F.col("doc")],
    }[kind]


def hits(ix: Index, query: str, limits: Limits = Limits(), kinds: Sequence[str] = ORDER) -> tuple[DataFrame | None, int | None]:
    """(kind, pos, more, file_id, path, line, text, start, end) of the kinds asked for, and the context the query asks for.

    pos: rank within the kind; more: how many of the kind the limit cut. A path hit in the file name of a file that is
    also a file hit shows the same place twice, and goes before the limit.
    """
    terms, context = tokenize(query.strip())
    if not terms:
        return None, context
    also = {"file"} if "path" in kinds else set()  # a path hit may show the same place as a file hit
    found = {k: m for k in ORDER if k in {*kinds, *also} and (m := matches(ix, terms, k)) is not None}
    if "path" in found and "file" in found:
        named = found["file"].select("file_id").withColumn("_named", F.lit(True))
        in_name = F.col("start") >= F.greatest(F.length("path") - F.length("name"), F.lit(0))
        found["path"] = found["path"].join(named, "file_id", "left").filter(F.col("_named").isNull() | ~in_name).drop("_named")
    parts = []
    for kind, rows in found.items():
        if kind not in kinds:
            continue
        limit = getattr(limits, kind)
        rows = rows.select("file_id", "path", "line", "text", "start", "end", "doc")
        if limit is None:  # every hit, numbered without one task for all
            numbered = dense_ids(rows, *ranking(kind), name="pos", start=1)
            parts.append(numbered.select(F.lit(kind).alias("kind"), F.col("pos").cast("int").alias("pos"), F.lit(0).cast("bigint").alias("more"), "file_id", "path", "line", "text", "start", "end"))
            continue
        top = rows.orderBy(*ranking(kind)).limit(limit)  # top-k: no task sorts all
        total = rows.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
        pos = F.row_number().over(Window.partitionBy("more").orderBy(*ranking(kind)))
        parts.append(top.crossJoin(F.broadcast(total)).select(F.lit(kind).alias("kind"), pos.alias("pos"), "more", "file_id", "path", "line", "text", "start", "end"))
    return (reduce(DataFrame.unionByName, parts) if parts else None), context


def visible(found: DataFrame, entities: DataFrame, tree: DataFrame, show_tests: bool = True, hidden: list[int] = (), scope: int | None = None) -> DataFrame:
    """Hits in files that a view shows."""
    files = entities.select(F.col("id").alias("file_id"), "is_test")
    out = found.join(files if show_tests else files.filter("not is_test"), "file_id", "left_semi")
    if hidden:
        under = tree.filter(F.col("anc").isin(list(hidden))).select(F.col("id").alias("file_id"))
        out = out.join(under, "file_id", "left_anti")
    if scope is not None:
        out = out.join(tree.filter(F.col("anc") == scope).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return out


def windows(marks: DataFrame, sizes: DataFrame, context: int) -> DataFrame:
    """marks (file_id, line, …) with first and last of the run they are shown in; sizes: (file_id, n_lines).

    Windows of `context` lines either side that overlap, or leave no line between, are one run.
    """
    context = min(context, MAX_CONTEXT)
    lo, hi = F.greatest(F.col("line") - context, F.lit(0)), F.least(F.col("line") + context, F.col("n_lines") - 1)
    rows = marks.join(sizes.filter("n_lines > 0"), "file_id").withColumn("lo", lo).withColumn("hi", hi)
    order = Window.partitionBy("file_id").orderBy("line", "start")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("lo") > before + 1).cast("int"), F.lit(1)))
    run = Window.partitionBy("file_id", "run")
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("first_line", F.min("lo").over(run)).withColumn("last_line", F.max("hi").over(run)).drop("lo", "hi", "new", "n_lines")


def line_marks(ix: Index, found: DataFrame) -> DataFrame:
    """(file_id, path, line, start, end) in bytes of the line: content hits where they are, symbols where their name is."""
    start, end = byte_span(F.col("text"), F.col("start"), F.col("end") - F.col("start"))
    content = found.filter("kind = 'content'").select("file_id", "path", "line", start.alias("start"), end.alias("end"))
    at = F.greatest(F.instr("body", F.col("text")) - 1, F.lit(0))
    symbols = found.filter("kind = 'symbol'").join(ix.lines.withColumnRenamed("text", "body"), ["file_id", "line"])
    begin = F.octet_length(F.substring("body", F.lit(1), at))
    return content.unionByName(symbols.select("file_id", "path", "line", begin.alias("start"), (begin + F.octet_length("text")).alias("end")))


def excerpts(ix: Index, found: DataFrame, context: int) -> DataFrame:
    """(file_id, path, first_line, text, matched): runs of lines with the marks in them, in file and line order."""
    sizes = ix.lines.groupBy("file_id").agg((F.max("line") + 1).alias("n_lines"))
    runs = windows(line_marks(ix, found), sizes, context)
    marked = runs.groupBy("file_id", "path", "first_line", "last_line").agg(F.array_sort(F.collect_list(F.struct("line", "start", "end"))).alias("matched"))
    wanted = marked.withColumn("line", F.explode(F.sequence("first_line", "last_line"))).join(ix.lines, ["file_id", "line"])
    text = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return wanted.groupBy("file_id", "path", "first_line").agg(text.alias("text"), F.first("matched").alias("matched"))


def pages(results: DataFrame, height: int, chrome: int = 2) -> DataFrame:
    """results (pos from 0, rows) with the page they are on: as many as fit in `height`, one at least.

    Where a page starts depends on all before it, so the walk runs over one group; a result list is limited.
    """

    def walk(pdf):
        pdf, page, used, out = pdf.sort_values("pos"), 0, 0, []
        for i, rows in enumerate(pdf["rows"]):
            cost = rows + chrome
            if used and used + cost > height:
                page, used = page + 1, 0
            used += cost
            out.append(page)
        return pdf.assign(page=out)

    return results.select("pos", "rows").groupBy().applyInPandas(walk, "pos int, rows int, page int")
