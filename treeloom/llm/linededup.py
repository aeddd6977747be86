"""Line dedup by a segment-partition edit join, with DataFrame operations only.

All lines but empty ones are compared. Two are near if few enough insertions, deletions and substitutions part them:
EDITS where the shorter has MIN_CHARS code points or more, and in proportion, rounded down, where it has fewer (one
from 16, none under 16, where equal lines alone meet, by their hash). A line that allows e edits is cut into e + 1
segments of even length; by the pigeonhole principle a near line, at most e longer, has one of them intact. Each
distinct line is indexed under (length, segment number, segment) and probes, for its own and each shorter length, the
substrings that can be that segment (those whose shift leaves enough edits on both sides). What meets is verified by
the universal Levenshtein automaton: bit vectors of the 2 * EDITS + 1 diagonals around the main one, one for each
number of edits, advanced a character at a time.

A line goes if an equal line, or a near one, stands earlier (by doc_id, then line number); each line is compared with
all others, not only with those that stay.

Lines that share a key with no other are dropped at once; the letters of the rest are counted, and compared where two
lines meet, before a pair of them is written or read.

Defined cases: null is an empty text, of one empty line; an empty table gives an empty one; a text of any length is
split and compared whole; of equal or near lines the earliest stays, and lines at the same place (of rows that repeat
a doc_id) tie and do not exclude each other; other columns are ignored, whatever their names. In line_report()
documents without doc_id are not compared, and rows that repeat a doc_id are one document. without_lines() judges each
row by itself: rows of one doc_id stand one after the other, those without doc_id last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, discard, materialize, order_of, sealed, unsealed

MIN_CHARS, EDITS = 32, 2
#: Letters that are counted: a pair whose counts are further apart than its edits allow is none.
LETTERS = " etaonirshdlcm"
#: Size of the bitmap that keeps lines without a candidate out of a shuffle: 8 MB, whatever the input.
BITMAP_BITS = 26
#: Lines with one key that a part of a join takes.
SALTED = 1 << 14


def lines_of(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc (what is judged as one: a row if its key is named, else a doc_id), at (where a line stands), line_no, line."""
    if row is None:
        docs, doc, order = docs.filter("doc_id is not null"), F.col("doc_id"), [F.col("doc_id")]
    else:
        doc, order = F.col(row), order_of(row)
    lines = docs.select(doc.alias("doc"), F.struct(*order).alias("order"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    return lines.filter(F.length("line") > 0).select("doc", F.struct("order.*", "line_no").alias("at"), "line_no", "line")


def hashed(lines: DataFrame) -> DataFrame:
    """lines with h1 and h2, their 128-bit name, points (their code points, four bytes each) and length."""
    points = lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.encode("line", "UTF-32").alias("points"))
    return points.withColumn("length", (F.octet_length("points") / 4).cast("int"))


def allowed(length: Column, min_chars: int, edits: int) -> Column:
    """Edits that may part a line of this length from one as long or longer."""
    return F.least(F.lit(edits), F.floor(length * edits / min_chars).cast("int"))


def places(edits: int) -> list[tuple[int, int, int, int]]:
    """Where a line meets others: (how much shorter they are, segment, shift, least edits that allow it), its own first."""
    out = []
    for i in range(edits + 1):
        for less in range(edits + 1):
            for shift in range(-edits, edits + 1):
                fits = [e for e in range(max(1, i), edits + 1) if less <= e and max(-i, less - (e - i)) <= shift <= min(i, less + e - i)]
                out += [(less, i, shift, fits[0])] if fits else []
    return sorted(out, key=lambda x: bool(x[0] or x[2]))


def keyed(lines: DataFrame, carried: list[str], min_chars: int, edits: int) -> DataFrame:
    """The carried columns of hashed lines, their length, and k0, k1, ...: a key for each of places(), whether allowed or not.

    A line that allows e edits has e + 1 even segments, the longer ones last. Bytes of points are cut at once, while a
    string is walked to its n-th character. What keys share are columns of their own, and held_keys() drops what isn't
    allowed: the code for a line must stay under 8,000 bytes, beyond which the JVM interprets it.
    """
    for less in range(edits + 1):
        lines = lines.withColumn(f"n{less}", F.expr(f"least({edits}, (length - {less}) * {edits} div {min_chars}) + 1").cast("int"))
        lines = lines.withColumn(f"short{less}", F.expr(f"(length - {less}) div n{less} * 4").cast("int")).withColumn(f"over{less}", F.expr(f"((length - {less}) % n{less} - n{less}) * 4"))
    found = places(edits)
    for less, i in dict.fromkeys((less, i) for less, i, _, _ in found if i):
        longer = f"over{less} + {4 * i}"  # four for each longer segment before this one
        lines = lines.withColumn(f"start{less}_{i}", F.expr(f"short{less} * {i} + greatest({longer}, 0)")).withColumn(f"size{less}_{i}", F.expr(f"IF({longer} >= 0, short{less} + 4, short{less})"))

    def key(less: int, i: int, shift: int) -> Column:
        part = f"substring(points, start{less}_{i} + {4 * shift + 1}, size{less}_{i})" if i else f"substring(points, {4 * shift + 1}, short{less})"
        return F.expr(f"xxhash64((length - {less}) * {edits + 1} + {i}, {part})")

    return lines.select(*carried, "length", *(key(*place).alias(f"k{i}") for i, (*place, _) in enumerate(found)))


def held_keys(min_chars: int, edits: int) -> list[Column]:
    """The keys of keyed(), null where a line's length doesn't allow one; its own segments come first."""
    return [F.when(allowed(F.col("length") - less, min_chars, edits) >= least, F.col(f"k{i}")) for i, (less, _, _, least) in enumerate(places(edits))]


def letter_counts(line: str, length: str) -> Column:
    """Length and how often each of LETTERS stands in a line, modulo 16, four bits each, the length on top.

    An edit moves the counts by two at most.
    """
    out = F.shiftleft((F.col(length) % 16).cast("bigint"), 4 * len(LETTERS))
    for i, c in enumerate(LETTERS):
        n = (F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(c), F.lit("")))) % 16
        out = out.bitwiseOR(F.shiftleft(n.cast("bigint"), 4 * i))
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """By how much two such counts differ at least."""
    out = F.lit(0)
    for i in range(len(LETTERS)):
        x, y = (F.shiftrightunsigned(c, 4 * i).bitwiseAND(15) for c in (a, b))
        out = out + F.least(F.abs(x - y), 16 - F.abs(x - y))
    return out


def letters_near(a: Column, b: Column, edits: int) -> Column:
    return letters_apart(a, b) <= 2 * edits


def held_bits(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of hashes of a key, as at most 2048 rows of 4 KB: (bucket, bits)."""
    return keys.select(_bit(key).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def may_be_held(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """rows without (most of) those whose key is not among the keys of a bitmap, found before any shuffle."""
    at = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.withColumn("bucket", F.bitmap_bucket_number(_bit(key))).join(F.broadcast(bits), "bucket")
    return near.filter(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8 + 1).cast("int"))) != 0).select(*rows.columns)


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS)) + 1


def differing_parts(a: str, b: str) -> Column:
    """struct(x, y): code points of columns a and b without what both begin and end with.

    The common prefix, then suffix, grows by powers of two from the largest that fits. transform() over one element
    names a value, so that it is computed once.
    """
    grow = "aggregate(transform(sequence(0, cast(log2(1 + {most}) AS int)), e -> shiftleft(1, cast(log2(1 + {most}) AS int) - e)), 0, (n, w) -> IF(n + w <= {most} AND {equal}, n + w, n))"
    prefix = grow.format(most=f"least(length({a}), length({b}))", equal=f"substring({a}, n + 1, w) = substring({b}, n + 1, w)")
    suffix = grow.format(most="least(length(s.x), length(s.y))", equal="substring(s.x, length(s.x) - n - w + 1, w) = substring(s.y, length(s.y) - n - w + 1, w)")
    points = "IF(length(s.{0}) = q, cast(array() AS array<int>), transform(split(substring(s.{0}, 1, length(s.{0}) - q), ''), c -> ascii(c)))"
    parts = f"struct({points.format('x')} AS x, {points.format('y')} AS y)"
    return F.expr(f"get(transform(array({prefix}), p -> get(transform(array(struct(substring({a}, p + 1) AS x, substring({b}, p + 1) AS y)), s -> get(transform(array({suffix}), q -> {parts}), 0)), 0)), 0)")


def with_distance(pairs: DataFrame, edits: int) -> DataFrame:
    """pairs whose columns x and y (arrays of code points) are at most `edits` apart, with that distance as `edits`.

    r holds, for each number of edits e, the diagonals on which the automaton can be after j characters of y with e
    edits; bit d stands for j + d - edits characters of x. v has the diagonals whose next characters are equal. With
    no diagonal left, nothing more is computed.
    """
    width = 2 * edits + 1
    begin = ", ".join(str(sum(1 << (edits + d) for d in range(e + 1))) for e in range(edits + 1))
    equal = " + ".join(f"coalesce(cast(get(x, j + {d - edits - 1}) = c AS int), 0) * {1 << d}" for d in range(width))
    steps = ["r[0] & v"]
    for e in range(1, edits + 1):
        steps.append(f"((r[{e}] & v) | r[{e - 1}] | shiftright(r[{e - 1}], 1) | shiftleft({steps[-1]}, 1)) & {(1 << width) - 1}")
    step = f"aggregate(array(get(y, j - 1)), r, (r, c) -> aggregate(array({equal}), r, (r, v) -> array({', '.join(steps)})))"
    run = f"aggregate(slice(sequence(0, size(y)), 2, size(y)), array({begin}), (r, j) -> IF(r[{edits}] = 0, r, {step}))"
    end = f"shiftleft(1, size(x) - size(y) + {edits})"
    found = "CASE " + " ".join(f"WHEN (r[{e}] & {end}) <> 0 THEN {e}" for e in range(edits + 1)) + " END"
    alike = pairs.filter(F.abs(F.size("x") - F.size("y")) <= edits)
    return alike.withColumn("r", F.expr(run)).withColumn("edits", F.expr(found)).filter("edits is not null").drop("r")


def crowds(posted: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """(key, h1, own, parts): lines that share a key with another line, one of which has it as an own segment."""
    held = F.array(*held_keys(min_chars, edits))
    rows = posted.select("h1", F.posexplode(held).alias("n", "key")).filter("key is not null").select("h1", "key", (F.col("n") <= edits).alias("own"))
    of = Window.partitionBy("key")
    found = rows.select("*", F.min("h1").over(of).alias("low"), F.max("h1").over(of).alias("high"), F.max("own").over(of).alias("owned"), F.count("*").over(of).alias("n"))
    return found.filter("low <> high and owned").select("key", "h1", "own", F.ceil(F.col("n") / SALTED).cast("int").alias("parts"))


def meetings(crowded: DataFrame, letters: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of the h1 of lines that share a key and whose letters allow it, each once.

    Letters are compared within the join, so that lines of one template are not written out as pairs; where very many
    lines share a key, each part of those looking up meets a copy of those that have it.
    """
    rows = crowded.join(letters, "h1")
    few = rows.filter("own").select("key", F.col("h1").alias("a"), F.col("letters").alias("a_letters"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    many = rows.select("key", F.col("h1").alias("b"), F.col("letters").alias("b_letters"), F.pmod(F.xxhash64(F.lit(2), "h1"), "parts").cast("int").alias("part"))
    near = few.join(many, ["key", "part"]).filter((F.col("a") != F.col("b")) & letters_near(F.col("a_letters"), F.col("b_letters"), edits))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_lines(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (h1, h2, first: where each stands first), and pairs (a, b, edits) of near ones as (h1, h2)."""
    lines = hashed(lines_of(docs, row))
    rows = keyed(lines, ["h1", "h2", "at"], min_chars, edits)
    # the keys are equal in all rows of a line, so any will do; aggregated before the shuffle, however often a line stands
    once = rows.groupBy("h1", "h2").agg(F.min("at").alias("first"), *(F.first(c).alias(c) for c in rows.columns[3:]))
    posted = materialize(once, **{"parquet.enable.dictionary": "false"})
    crowded = materialize(crowds(posted, min_chars, edits))
    needed = crowded.select("h1").distinct()
    texts = may_be_held(lines.select("h1", "h2", "line", "length"), "h1", held_bits(needed, "h1")).dropDuplicates(["h1", "h2"])
    # a semi-join would be moved below the bitmap, and shuffle every line
    texts = materialize(texts.join(needed, "h1").select("h1", "h2", "line", letter_counts("line", "length").alias("letters")))
    pairs = meetings(crowded, texts.select("h1", "letters"), edits)
    side = lambda x: texts.select(F.col("h1").alias(x), F.struct("h1", "h2").alias(f"{x}_id"), F.col("line").alias(f"{x}_line"))
    may = allowed(F.least(F.length("a_line"), F.length("b_line")), min_chars, edits)
    close = pairs.join(side("a"), "a").join(side("b"), "b")
    # written first: the automaton reads its arrays once for each character
    both = materialize(close.select("a_id", "b_id", may.alias("may"), differing_parts("a_line", "b_line").alias("parts")).select("a_id", "b_id", "may", "parts.x", "parts.y"))
    near = materialize(with_distance(both, edits).filter("edits <= may").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "edits"))
    discard(crowded, texts, both)
    return posted.select("h1", "h2", "first"), near


def judged_lines(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS, row: str | None = None) -> DataFrame:
    """(doc, line_no, links, goes) of every compared line: how many different lines are near, and whether it goes."""
    distinct, near = near_lines(docs, min_chars, edits, row)
    where = distinct.select(F.struct("h1", "h2").alias("id"), "first")
    ends = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(where.select(F.col("id").alias("b"), F.col("first").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"), F.count("*").alias("links"))
    linked = others.select("id.h1", "id.h2", "other", "links")
    # written, so that both sides of the next join are plain exchanges, of which a very common line's can be split
    known = materialize(distinct.join(linked, ["h1", "h2"], "left").select("h1", "h2", "links", F.least("first", "other").alias("first")))
    stands = lines_of(docs, row).select("doc", "at", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    return stands.join(known, ["h1", "h2"]).select("doc", "line_no", F.coalesce("links", F.lit(0)).alias("links"), (F.col("at") > F.col("first")).alias("goes"))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_compared, n_links (near lines of its lines), n_dropped, dropped (their numbers) for every row."""
    number = F.when(F.col("goes"), F.col("line_no"))
    lines = judged_lines(docs, min_chars, edits).distinct()
    by = lines.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_compared"), F.sum("links").alias("n_links"), F.count(number).alias("n_dropped"), F.array_join(F.array_sort(F.collect_list(number)), ",").alias("dropped"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint")
    out = docs.select("doc_id", n_lines.alias("n_lines")).join(by, "doc_id", "left")
    return out.select("doc_id", "n_lines", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_compared", "n_links", "n_dropped")), F.coalesce("dropped", F.lit("")).alias("dropped"))


def without_lines(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """docs with the lines that go cut out of text; n_chars follows where docs has it. Texts that lose all are left out."""
    keyed = sealed(docs)
    gone = judged_lines(keyed, min_chars, edits, ROW).filter("goes").groupBy(F.col("doc").alias(ROW)).agg(F.collect_set("line_no").alias("_gone"))
    joined = keyed.join(gone, ROW, "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    out = out.filter(F.col("_gone").isNull() | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return unsealed(out.select(keyed.columns), docs)
