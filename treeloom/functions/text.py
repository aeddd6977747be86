"""Text functions: case folding, lines, query terms, spans in characters, bytes and UTF-16 units, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("file", "path", "content", "symbol")


def fold(text: Column) -> Column:
    """Lower case with one character for each: of a character that lowers to several, the first.

    Only texts whose length lowering changes take the slow way, a character at a time.
    """
    low = F.lower(text)
    slow = F.array_join(F.transform(F.split(text, ""), lambda c: F.substring(F.lower(c), 1, 1)), "")
    return F.when(F.length(low) == F.length(text), low).otherwise(slow)


def lines(text: Column) -> Column:
    """Array of lines: a last empty one is none, a carriage return at an end is cut. The empty text has no line."""
    parts = F.split(text, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def inclusive_line_count(text: Column) -> Column:
    """Pieces that end at a line feed, and a last one without."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def byte_span(text: Column, start: Column, size: Column) -> tuple[Column, Column]:
    """Byte bounds of `size` characters from character `start`, clamped to the text."""
    return F.octet_length(F.substring(text, F.lit(1), start)), F.octet_length(F.substring(text, F.lit(1), start + size))


def utf16_units(text: Column) -> Column:
    """UTF-16 units: characters outside the basic plane count twice."""
    return F.length(text) + F.length(text) - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""))


def utf16_span(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    return utf16_units(F.substring(text, F.lit(1), start)), utf16_units(F.substring(text, F.lit(1), end))


def trim_lead(text: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Text without leading white space, and the span moved with it, not below 0."""
    rest = F.regexp_replace(text, r"^\s+", "")
    cut = F.length(text) - F.length(rest)
    at = F.greatest(F.lit(0), start - cut)
    return rest, at, F.greatest(at, end - cut)


@dataclass(frozen=True)
class Term:
    tag: str | None
    needle: str

    @property
    def folded(self) -> str:
        return "".join(c.lower()[:1] or c for c in self.needle)


def tokenize(query: str) -> tuple[list[Term], int | None]:
    """Terms of a query and the lines of context that it asks for.

    White space parts terms, quotes hold one together; `file:`, `path:`, `content:` and `symbol:` tag a term unless it
    begins with a quote; `context:N` is a directive, of which the last wins; a tag or directive without payload goes.
    """
    terms: list[Term] = []
    context = None
    at = 0
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        quoted, inside, raw = query[at] == '"', False, []
        while at < len(query) and (inside or not query[at].isspace()):
            if query[at] == '"':
                inside = not inside
            else:
                raw.append(query[at])
            at += 1
        word = "".join(raw)
        head, colon, rest = word.partition(":")
        head = head.lower() if head.isascii() else head
        if colon and not quoted and head == "context":
            if not rest:
                continue
            number = rest.removeprefix("+")
            if number.isascii() and number.isdigit():
                context = int(number)
                continue
        tag, needle = (head, rest) if colon and not quoted and head in KINDS else (None, word)
        if needle:
            terms.append(Term(tag, needle))
    return terms, context


def percent_decode(text: str) -> str:
    """`%XX` and `+` decoded as UTF-8; a malformed escape stays as it is."""
    raw, out, at = text.encode(), bytearray(), 0
    while at < len(raw):
        pair = raw[at + 1 : at + 3]
        if raw[at] == 0x25 and len(pair) == 2 and all(c in b"0123456789abcdefABCDEF" for c in pair):
            out.append(int(pair, 16))
            at += 3
            continue
        out.append(0x20 if raw[at] == 0x2B else raw[at])
        at += 1
    return out.decode("utf-8", "replace")


def size_label(kind: Column, loc: Column, start: Column, end: Column) -> Column:
    """`1,234 loc` for folders and files that have lines, else the range, counted from one."""
    bulk = kind.isin("folder", "file") & (loc > 0)
    has_range = ~((start == 0) & (end == 0)) & (kind != "folder")
    return F.when(bulk, F.concat(F.format_number(loc, 0), F.lit(" loc"))).when(has_range, F.concat((start + 1).cast("string"), F.lit("–"), (end + 1).cast("string"))).otherwise("")


def detail_label(kind: Column, noun: Column, size: Column, is_test: Column) -> Column:
    """The line under a name: what it is, how large, and whether it is test code."""
    word = F.coalesce(noun, kind)
    return F.concat_ws(" · ", word, F.nullif(size, F.lit("")), F.when(is_test, "test"))


def head_label(name: Column, size: Column, with_size: bool = True) -> Column:
    return F.concat_ws(" · ", name, F.nullif(size, F.lit(""))) if with_size else name


def churn_label(added: Column, removed: Column) -> Column:
    return F.concat_ws(" ", F.when(added > 0, F.concat(F.lit("+"), added.cast("string"))), F.when(removed > 0, F.concat(F.lit("−"), removed.cast("string"))))


def sub_label(kind: Column, loc: Column, start: Column, end: Column, added: Column, removed: Column, is_test: Column) -> Column:
    """Kind, size (or the range of anything but a folder, whatever it is), churn and `test`."""
    size = F.when(kind.isin("folder", "file") & (loc > 0), F.concat(F.format_number(loc, 0), F.lit(" loc")))
    size = size.when(kind != "folder", F.concat((start + 1).cast("string"), F.lit("–"), (end + 1).cast("string")))
    return F.concat_ws(" · ", kind, size, F.nullif(churn_label(added, removed), F.lit("")), F.when(is_test, "test"))
