"""Source texts to constructs and raw references, file by file, and a whole tree of files to entities and references.

A text is read as tokens, once, from left to right. Bodies end at the partner of their bracket, or where indentation
goes back; what merely looks like a call (a header, a pattern, a type, a macro's argument) is passed over. References
get their scope in one sweep over constructs and references, both by place. What a scanner finds of a file needs no
other file; names are resolved over all of them afterwards, with joins.

It is no parser: without the grammar's full rules, unusual layouts of types and of missing semicolons can be misread.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import inclusive_line_count
from ..operators.tree import closure, dense_ids
from . import names
from .generations import spread, written
from .lexer import FAMILY, Tokens, tokens
from .scan import language, tree_order

CONSTRUCTS = "array<struct<kind: string, noun: string, name: string, byte_start: int, byte_end: int, line_start: int, line_end: int, depth: int, parent: int>>"
REFS = "array<struct<src: int, name: string, kind: string, line: int>>"

#: Words that are no name of what is called, by family of languages.
KEYWORDS = {
    "rust": frozenset("as async await box break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type union unsafe use where while yield Fn FnMut FnOnce".split()),
    "javascript": frozenset("async await break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof let new of return static switch throw try typeof var void while with yield super".split()),
    "python": frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()),
}
#: Words of a path that name nothing by themselves, and types that are built in.
PATHS = frozenset("self super crate this".split())
PRIMITIVE = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str _".split())
#: What may stand before a Rust item's own word.
MODIFIERS = frozenset("pub async unsafe const extern default crate".split())
MEMBER = frozenset("async static get set public private protected readonly override abstract declare accessor".split())
#: Words and signs after which a brace holds an object and not statements.
VALUE = frozenset("= ( , [ : ? => return && || ?? ... + - ! typeof in of default case ${ yield await".split())
#: Signs that go on with an expression of the line before, as the first or the last on a line.
GOES_ON = frozenset(". ?. ( [ ` ? : = == === != !== + - * / % & | ^ && || ?? < > <= => , instanceof in as".split())
OPEN = ("(", "[", "{", "${")


@dataclass
class Found:
    kind: str
    noun: str
    name: str
    start: int
    end: int
    parent: int | None = None
    depth: int = 0


class Reader:
    """What one text holds: its tokens, the constructs and references found, and where no call is looked for."""

    def __init__(self, text: str, lang: str, keywords: bool):
        self.t: Tokens = tokens(text, lang)
        self.word, self.kind, self.pair, self.n = self.t.word + ["", "", ""], self.t.kind + ["", "", ""], self.t.pair, len(self.t.word)
        self.lang, self.typed, self.keywords = lang, lang in ("typescript", "tsx"), keywords
        self.found: list[Found] = []
        self.refs: list[tuple[str, int, str]] = []
        self.quiet = bytearray(self.n + 1)
        self.begin = [-1] * (self.n + 1)  # where the operand begins that ends at a token
        self.opened: dict[int, int] = {}  # of angle brackets that close: their partner
        self.words = KEYWORDS.get(FAMILY[lang], frozenset())

    def end(self, at: int) -> int:
        return self.t.end[min(at, self.n - 1)]

    def line(self, at: int) -> str:
        """The line of a token, without blanks around it."""
        text, start = self.t.text, self.t.start[at]
        stop = text.find("\n", start)
        return text[text.rfind("\n", 0, start) + 1 : stop if stop >= 0 else len(text)].strip()

    def add(self, kind: str, noun: str, name: str, first: int, last: int) -> None:
        self.found.append(Found(kind, noun, name, self.t.start[first], self.end(last)))

    def keyword(self, at: int) -> None:
        """With `keywords`, the word that begins a class or function is a construct too, named by its line."""
        if self.keywords:
            kind = "class" if self.word[at] == "class" else "function"
            self.add(kind, kind, self.line(at), at, at)

    def until(self, at: int, *stops: str) -> int:
        """The next of these words that is in no bracket from here, or the end of what holds this place."""
        while at < self.n and self.word[at] not in stops:
            if self.kind[at] == "p" and self.word[at] in OPEN:
                at = self.pair[at]
            elif self.kind[at] == "p" and self.word[at] in (")", "]", "}"):
                return at
            at += 1
        return min(at, self.n)

    def angles(self, at: int) -> int:
        """The partner of an angle bracket among types, or -1."""
        depth, i = 0, at
        while i < self.n:
            w = self.word[i]
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if not depth:
                    self.opened[i] = at
                    return i
            elif w in ("(", "[") or w == "{" and self.typed:
                i = self.pair[i]
            elif w in (";", ")", "]", "}", "{"):
                return -1
            i += 1
        return -1

    def hush(self, first: int, past: int) -> None:
        self.quiet[first:past] = b"\1" * max(0, min(past, self.n) - first)

    def operand(self, i: int) -> None:
        """Note where the operand that ends with token i begins: names joined by dots, calls and indexes are one."""
        word, kind = self.word[i], self.kind[i]
        before = self.begin[i - 1] if i else -1
        if kind == "id":
            joined = i and self.word[i - 1] in (".", "::", "?.")
            sign = word in self.words or word in ("as", "is", "satisfies") and before >= 0
            self.begin[i] = before if joined and before >= 0 else (-1 if sign and not joined else i)
        elif kind in ("num", "str"):
            self.begin[i] = before if i and self.word[i - 1] == "." and before >= 0 else i
        elif word in (".", "::", "?.") or word == ("!" if self.typed else "?" if self.lang == "rust" else ""):
            self.begin[i] = before if before >= 0 else (i if word == "::" else -1)
        elif word in (")", "]", "}") and self.pair[i] >= 0:
            o = self.pair[i]
            self.begin[i] = self.begin[o - 1] if word != "}" and o and self.begin[o - 1] >= 0 else o

    def call(self, i: int) -> None:
        """A call, if the bracket at i follows an operand: of the last name in it, at the place where it begins."""
        if self.quiet[i] or not i or self.begin[i - 1] < 0:
            return
        first, at = self.begin[i - 1], i - 1
        if self.typed and at in self.opened:
            at = self.opened[at] - 1
        if first and self.word[first - 1] == "new" and not any(self.word[k] == "(" for k in range(first, i)):
            return
        while at >= first and not (self.kind[at] == "id" and self.word[at] not in PRIMITIVE and (self.word[at] not in self.words or self.word[at - 1] == ".")):
            at -= 1
        if at >= first and self.word[at] not in PATHS:
            self.refs.append((self.word[at].removeprefix("r#"), self.t.start[first], "call"))

    def bring(self, at: int) -> None:
        self.refs.append((self.word[at].removeprefix("r#"), self.t.start[at], "import"))


def rust(r: Reader) -> None:
    word, i, item = r.word, 0, 0  # item: where the item at hand may begin

    def begins(item: int, i: int) -> bool:
        """Only modifiers stand between."""
        return all(word[k] in MODIFIERS or r.kind[k] == "str" or word[k] in ("(", ")", *PATHS) for k in range(item, i))

    while i < r.n:
        w = word[i]
        if w == "#" and (word[i + 1] == "[" or word[i + 1] == "!" and word[i + 2] == "["):
            i = item = r.pair[i + 1 if word[i + 1] == "[" else i + 2] + 1
            continue
        if r.kind[i] == "id" and word[i + 1] == "!" and w not in r.words:
            o = i + 3 if w == "macro_rules" else i + 2
            if word[o] in ("(", "[", "{") and o < r.n:  # its argument is no code yet
                past = min(r.pair[o], r.n - 1)
                r.begin[past] = i
                i = past + 1
                item = i if word[past] == "}" else item
                continue
        if w == "use" and begins(item, i):
            stop = r.until(i, ";")
            _use(r, i + 1, stop)
            i = item = stop + 1
            continue
        if w in ("fn", "struct", "enum", "trait", "mod") and r.kind[i + 1] == "id" or w == "impl" and begins(item, i):
            i = item = _item(r, i, item if begins(item, i) else i)
            continue
        if w in ("let", "for") and word[i + 1] != "<":  # a pattern calls nothing
            r.hush(i, r.until(i + 1, *(("=", ";", "else") if w == "let" else ("in", "{"))))
        elif w == "match":
            o = r.until(i + 1, "{", ";")
            if word[o] == "{":
                _arms(r, o, r.pair[o])
        elif w == "::" and word[i + 1] == "<" and (close := r.angles(i + 1)) > 0:
            for k in range(i, close + 1):
                r.begin[k] = r.begin[i - 1] if i else -1
            i = close + 1
            continue
        r.operand(i)
        if w == "(":
            r.call(i)
        i += 1
        if w in (";", "{", "}"):
            item = i


def _item(r: Reader, i: int, first: int) -> int:
    """A Rust item from its word on; where reading goes on: in its body, or after it."""
    word, w = r.word, r.word[i]
    stop = r.until(i + 1, "{", ";")
    body = word[stop] == "{" and stop < r.n
    last = r.pair[stop] if body else (stop if word[stop] == ";" else stop - 1)
    if w == "impl":
        at = i + 1
        if word[at] == "<" and (close := r.angles(at)) > 0:
            at = close + 1
        through = r.until(at, "where", "{", ";")
        of = next((k for k in range(at, through) if word[k] == "for" and word[k + 1] != "<"), at - 1)
        if through > of + 1:
            r.add("class", "impl", r.t.text[r.t.start[of + 1] : r.t.end[through - 1]], first, last)
        return stop + 1
    noun = {"fn": "function", "mod": "module"}.get(w, w)
    kind = noun if w in ("fn", "mod") else "class"
    r.add(kind, noun, word[i + 1].removeprefix("r#"), first, last)
    return stop + 1 if w in ("fn", "mod", "trait") else last + 1


def _arms(r: Reader, o: int, close: int) -> None:
    at = o + 1
    while at < close:
        arrow = r.until(at, "=>")
        r.hush(at, min(arrow, r.until(at, "if")))
        at = arrow + 1
        at = r.pair[at] + 1 if r.word[at] == "{" and at < close else r.until(at, ",") + 1
        at += r.word[at] == "," if at < close else 0
        if arrow >= close:
            return


def _use(r: Reader, at: int, stop: int) -> None:
    """The names along the paths of a use: all parts but wildcards with their path, and aliases."""
    part: list[int] = []

    def flush(upto: int) -> None:
        nonlocal part
        for k in part if upto else ():
            if r.word[k] not in PATHS:
                r.bring(k)
        part = []

    while at < stop:
        w = r.word[at]
        if w == "*":
            flush(0)
        elif w == "as":
            at += 1
        elif r.kind[at] == "id":
            part.append(at)
        elif w in ("{", "}", ","):
            flush(1)
        at += 1
    flush(1)


def script(r: Reader) -> None:
    """JavaScript, and TypeScript with what it adds."""
    word, kind = r.word, r.kind
    shape: dict[int, str] = {}  # of braces: class, interface, object, or statements
    types: list[int] = []  # ends of stretches of types
    holds: list[list] = []  # of each open bracket: its place, and how many questions wait for their colon
    arrows: dict[int, tuple[int, bool]] = {}  # of each arrow: where it begins, and whether it is a type
    labels: set[int] = set()  # colons of cases
    waits = 0

    def typed_here(at: int) -> bool:
        """A function from `at` on would be a type."""
        before = word[at - 1] if at else ""
        if not r.typed or types and at < types[-1]:
            return r.typed
        if before == "=>":
            return arrows.get(at - 1, (0, False))[1]
        inside = shape.get(holds[-1][0]) if holds else None
        return before in ("|", "&", "<", "as", "extends", "is", "keyof") or before == ":" and inside != "object" and not waits and at - 1 not in labels

    def value_end(at: int) -> int:
        """The last token of an expression that begins at `at`."""
        k, asked = at, 0
        while k < r.n:
            w = word[k]
            if kind[k] == "p" and (w in (",", ";", ")", "]", "}") or w == ":" and not asked):
                break
            asked += (w == "?") - (w == ":")
            if k > at and "\n" in r.t.text[r.t.end[k - 1] : r.t.start[k]] and w not in GOES_ON and word[k - 1] not in GOES_ON:
                break
            k = min(r.pair[k], r.n - 1) + 1 if kind[k] == "p" and w in OPEN else k + 1
        return max(at, k - 1)

    def header(at: int) -> tuple[int, int]:
        """From the bracket of the parameters on: (brace of the body or -1, last token)."""
        k = min(r.pair[at], r.n - 1) + 1
        if word[k] == ":" and r.typed:
            k += 1
            if word[k] == "{":
                k = r.pair[k] + 1
            while k < r.n and word[k] not in ("{", ";", ",", "}", ")") and ("\n" not in r.t.text[r.t.end[k - 1] : r.t.start[k]] or word[k - 1] in GOES_ON):
                angle = r.angles(k) if word[k] == "<" else -1
                k = angle + 1 if angle > 0 else min(r.pair[k], r.n - 1) + 1 if word[k] in ("(", "[") else k + 1
        if word[k] == "{" and k < r.n:
            return k, r.pair[k]
        return -1, k if word[k] == ";" else k - 1

    def members(o: int, what: str) -> None:
        at, close = o + 1, r.pair[o]
        while at < close:
            if word[at] in (";", ","):
                at += 1
                continue
            while word[at] == "@" and at < close:
                at += 2
                while word[at] == ".":
                    at += 2
                at = r.pair[at] + 1 if word[at] == "(" else at
            first = at
            while word[at] in MEMBER and at + 1 < close and word[at + 1] not in ("(", "=", ":", ";", "?", ",", "<", "!"):
                at += 1
            at += word[at] == "*"
            past = r.pair[at] + 1 if word[at] == "[" else at + 1
            name = r.t.text[r.t.start[at] : r.end(past - 1)] if at < close else ""
            named = kind[at] in ("id", "str", "num") or word[at] == "["
            past += word[past] in ("?", "!")
            if word[past] == "<" and (angle := r.angles(past)) > 0:
                past = angle + 1
            if named and word[past] == "(" and past < close:
                body, last = header(past)
                if body >= 0 or what != "object":
                    r.add("function", "method", name, first, last)
                    r.hush(past, past + 1)
                    at = min(last, close) + 1
                    if body < 0:
                        r.hush(past, at)
                    continue
            if what == "class":
                colon = r.until(at, "=", ";")
                if word[colon] == "=" and colon < close:
                    at = value_end(colon + 1) + 1
                    continue
                k = at + 1
                while k < close and word[k] not in (";", "}") and ("\n" not in r.t.text[r.t.end[k - 1] : r.t.start[k]] or word[k - 1] in GOES_ON):
                    k = min(r.pair[k], r.n - 1) + 1 if word[k] in OPEN else k + 1
                at = k
            else:
                k = r.until(at, ",", ";")
                while what == "interface" and at < k and not (at > first and "\n" in r.t.text[r.t.end[at - 1] : r.t.start[at]] and word[at - 1] not in GOES_ON and word[at] not in GOES_ON):
                    at = min(r.pair[at], r.n - 1) + 1 if word[at] in OPEN else at + 1
                at = at if what == "interface" and at < k else k

    def arrow(first: int, at: int) -> None:
        start = first - 1 if word[first - 1] == "async" and first else first
        is_type = typed_here(start)
        arrows[at] = start, is_type
        r.hush(first, first + 1)
        if not is_type:
            body = at + 1
            if word[body] == "{" and body < r.n:
                shape[body] = "block"
                r.add("function", "function", r.line(start), start, r.pair[body])
            elif body < r.n:
                r.add("function", "function", r.line(start), start, value_end(body))

    for i in range(r.n):
        w, k = word[i], kind[i]
        while types and types[-1] <= i:
            types.pop()
        before = word[i - 1] if i else ";"
        new_line = i and "\n" in r.t.text[r.t.end[i - 1] : r.t.start[i]]
        statement = before in (";", "{", "}", "export", "default", "declare", "async", "abstract", "const", ")", ":", "else", "do") or new_line or not i
        if k == "id" and before not in (".", "?."):
            named = kind[i + 1] == "id"
            if w == "case" or w == "default" and word[i + 1] == ":":
                labels.add(r.until(i + 1, ":"))
            elif w == "import" and statement and word[i + 1] not in ("(", "."):
                _import(r, i + 1)
            elif w == "function" and word[i + 1] != ":":
                j = i + 1 + (word[i + 1] == "*")
                o = r.until(j, "(", "{", ";")
                if word[o] == "(":
                    body, last = header(o)
                    start = i - 1 if before == "async" else i
                    own = word[j] if kind[j] == "id" else r.line(i)
                    if kind[j] == "id" or not r.keywords:
                        r.add("function", "function", own, start, last)
                    r.keyword(i)
                    r.hush(o, o + 1)
                    if body >= 0:
                        shape[body] = "block"
            elif w == "class" and (named or word[i + 1] == "{") and word[i + 1] != ":":
                o = r.until(i + 1, "{", ";")
                if word[o] == "{":
                    own = word[i + 1] if named and word[i + 1] not in ("extends", "implements") else None
                    if own or not r.keywords:
                        r.add("class", "class", own or r.line(i), i, r.pair[o])
                    r.keyword(i)
                    shape[o] = "class"
            elif r.typed and statement and named and w in ("interface", "enum", "namespace"):
                o = r.until(i + 1, "{", ";")
                if word[o] == "{":
                    last = o - 1
                    name = r.t.text[r.t.start[i + 1] : r.t.end[last]].strip() if w == "namespace" else word[i + 1]
                    r.add("module" if w == "namespace" else "class", w, name, i, r.pair[o])
                    shape[o] = w if w == "interface" else "block"
            elif r.typed and w == "type" and statement and named and word[i + 2] in ("=", "<"):
                eq = r.until(i + 2, "=", ";")
                if word[eq] == "=":
                    last = value_end(eq + 1)
                    last += word[last + 1] == ";"
                    r.add("class", "type alias", word[i + 1], i, last)
                    types.append(last + 1)
        if k == "p" and w == "{":
            what = shape.get(i) or ("interface" if types or r.typed and before == ":" and typed_here(i) else "object" if before in VALUE and i - 1 not in labels and not (before == ":" and holds and shape.get(holds[-1][0]) != "object" and not waits) else "block")
            shape[i] = what
            if what in ("class", "interface", "object"):
                members(i, what)
        if k == "p" and w == "(":
            close = r.pair[i]
            after = close + 1
            if r.typed and word[after : after + 1] == [":"] and after < r.n:
                after += 1
                while after < r.n and (kind[after] in ("id", "str", "num") or word[after] in (".", "|", "&", "<", ">", "[", "{", "(", ",") and word[after] != ","):
                    after = min(r.pair[after], r.n - 1) + 1 if word[after] in OPEN else after + 1
            if after < r.n and word[after] == "=>" and (not i or r.begin[i - 1] < 0):  # what follows an operand calls it
                arrow(i, after)
            elif not (types and i < types[-1]):
                r.call(i)
        elif w == "=>" and k == "p" and i not in arrows and i and kind[i - 1] == "id" and before not in r.words:
            arrow(i - 1, i)
        elif r.typed and w == "<" and i and r.begin[i - 1] >= 0 and (close := r.angles(i)) > 0 and word[close + 1] == "(":
            r.begin[close] = r.begin[i - 1]
        if r.begin[i] < 0:
            r.operand(i)
        if k == "p":
            if w in OPEN:
                holds.append([i, waits])
                waits = 0
            elif w in (")", "]", "}") and holds:
                waits = holds.pop()[1]
            elif w == "?" and word[i + 1] not in (":", ")", ",", ";", "."):
                waits += 1
            elif w == ":" and waits:
                waits -= 0 if word[i + 1] == "(" else 1
            elif w == ";":
                waits = 0


def _import(r: Reader, at: int) -> None:
    """Names that an import statement brings in: what an alias stands for, or the name of the whole module."""
    braces = False
    while at < r.n and r.kind[at] != "str" and r.word[at] not in (";", "=", "from"):
        w = r.word[at]
        if w in ("{", "}"):
            braces = w == "{"
        elif w == "as":
            at += 1
            if not braces and at < r.n:
                r.bring(at)
        elif r.kind[at] == "id" and not (w in ("type", "typeof") and (r.kind[at + 1] == "id" and r.word[at + 1] not in ("as", "from") or r.word[at + 1] in ("{", "*"))):
            r.bring(at)
        at += 1


def python(r: Reader) -> None:
    t, word = r.t, r.word
    stack: list[tuple[int, list[int]]] = []  # of open bodies: how far they are set in, and their constructs
    marks: list[tuple[int, int]] = []  # decorators that wait for what they decorate
    firsts = [*t.first, r.n]

    def close(last: int) -> None:
        for at in stack.pop()[1]:
            r.found[at].end = t.end[last]

    for first, past in zip(firsts, firsts[1:]):
        begin = t.text.rfind("\n", 0, t.start[first]) + 1
        width = len(t.text[begin : t.start[first]].expandtabs())
        while stack and stack[-1][0] >= width:
            close(first - 1)
        at = first + (word[first] == "async" and word[first + 1] in ("def", "with", "for"))
        if word[first] == "@":
            marks = [m for m in marks if m[1] == width] or [(first, width)]
        elif word[at] in ("def", "class") and r.kind[at + 1] == "id":
            kind = "function" if word[at] == "def" else "class"
            own = []
            if marks and marks[0][1] == width:
                own.append(len(r.found))
                r.add("function", "function", r.line(marks[0][0]), marks[0][0], past - 1)
            own.append(len(r.found))
            r.add(kind, kind, word[at + 1], first, past - 1)
            if kind == "class":
                r.keyword(at)
            stack.append((width, own))
            if word[at + 2] == "(":
                r.hush(at + 2, at + 3)
            elif word[at + 2] == "[" and word[r.pair[at + 2] + 1 : r.pair[at + 2] + 2] == ["("]:
                r.hush(r.pair[at + 2] + 1, r.pair[at + 2] + 2)
            marks = []
        else:
            marks = []
        if word[first] == "import":
            _modules(r, first + 1, past)
        elif word[first] == "from" and word[first + 1] != "__future__":
            stop = next((k for k in range(first, past) if word[k] == "import"), past)
            path = [k for k in range(first + 1, stop) if r.kind[k] == "id"]
            if path and r.kind[stop - 1] == "id":
                r.bring(path[-1])
            _modules(r, stop + 1, past)
        for k in range(first, past):
            r.operand(k)
            if word[k] == "(" and r.kind[k] == "p":
                r.call(k)
    while stack:
        close(r.n - 1)


def _modules(r: Reader, at: int, past: int) -> None:
    """Of each item of a list of imports the last part of its path."""
    while at < past:
        stop = next((k for k in range(at, past) if r.word[k] in (",", ";")), past)
        own = next((k for k in range(at, stop) if r.word[k] == "as"), stop)
        ids = [k for k in range(at, own) if r.kind[k] == "id"]
        if ids:
            r.bring(ids[-1])
        if stop < past and r.word[stop] == ";":
            return
        at = stop + 1


def tables(r: Reader) -> None:
    word = [w.lower() for w in r.word]
    for i in range(r.n):
        if word[i] != "create" or i and word[i - 1] != ";":
            continue
        at = i + 1
        while word[at] in ("or", "replace", "temp", "temporary", "materialized", "unlogged"):
            at += 1
        if word[at] not in ("table", "view"):
            continue
        noun, at = word[at], at + 1
        while word[at] in ("if", "not", "exists"):
            at += 1
        past = at + 1
        while word[past] == ".":
            past += 2
        stop = next((k for k in range(past, r.n) if word[k] == ";"), r.n)
        if r.kind[at] == "id":
            r.add("class", noun, "".join(w.strip('"`') for w in r.word[at:past]), i, stop - 1)


READERS: dict[str, Callable[[Reader], None]] = {"rust": rust, "javascript": script, "python": python, "sql": tables}


def nested(found: list[Found]) -> list[Found]:
    """In pre-order, each with its nearest enclosing construct."""
    found.sort(key=lambda f: (f.start, -f.end))
    open_: list[int] = []
    for i, f in enumerate(found):
        while open_ and (found[open_[-1]].end < f.end or found[open_[-1]].end <= f.start):
            open_.pop()
        f.parent, f.depth = (open_[-1] if open_ else None), len(open_)
        open_.append(i)
    return found


def scopes(found: list[Found], places: list[int]) -> list[int | None]:
    """For ascending places the innermost class or function that holds each; found as nested() gives it."""
    out: list[int | None] = []
    open_: list[int] = []
    at = 0
    for place in places:
        while at < len(found) and found[at].start <= place:
            while open_ and found[open_[-1]].end <= found[at].start:
                open_.pop()
            if found[at].kind != "module":
                open_.append(at)
            at += 1
        while open_ and found[open_[-1]].end <= place:
            open_.pop()
        out.append(open_[-1] if open_ else None)
    return out


def scan(text: str, lang: str, keywords: bool = False) -> tuple[list[dict], list[dict]]:
    """Constructs (in pre-order) and raw references of one text, as rows of CONSTRUCTS and REFS.

    With `keywords`, a class or function has a construct of its own for the word that begins it, as some graphs have.
    """
    if lang not in FAMILY or not text:
        return [], []
    r = Reader(text, lang, keywords)
    if not r.n:
        return [], []
    READERS[FAMILY[lang]](r)
    found = nested(r.found)
    lines = [0, *accumulate(len(x) + 1 for x in text.split("\n"))]
    row = lambda at: bisect_right(lines, at) - 1
    sizes = None if text.isascii() else [0, *accumulate(len(c.encode()) for c in text)]
    byte = lambda at: at if sizes is None else sizes[at]
    constructs = [{"kind": f.kind, "noun": f.noun, "name": f.name, "byte_start": byte(f.start), "byte_end": byte(f.end), "line_start": row(f.start), "line_end": row(max(f.start, f.end - 1)), "depth": f.depth, "parent": f.parent} for f in found]
    refs = sorted(r.refs, key=lambda x: x[1])
    held = scopes(found, [at for _, at, _ in refs])
    return constructs, [{"src": None if kind == "import" else src, "name": name, "kind": kind, "line": row(at)} for (name, at, kind), src in zip(refs, held)]


def scanned(files: DataFrame, keywords: bool = False) -> DataFrame:
    """(path, constructs, refs) of files (path, text): each is scanned by itself, in a Python worker."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"path string, constructs {CONSTRUCTS}, refs {REFS}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [scan(text, lang, keywords) for text, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "lang")), strict=True)]
            columns = [pa.array(c, arrow.field(name).type) for c, name in zip(zip(*done), ("constructs", "refs"))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], schema=arrow)

    rows = files.filter("text is not null").select("path", "text", language(F.col("path")).alias("lang"))
    return spread(rows).mapInArrow(run, schema)


def spine(files: DataFrame, root: str) -> DataFrame:
    """(key, parent_key, kind, name, order, lines, bytes): the root, all folders once, and the files."""
    parts = F.split("path", "/")
    whole = files.select("path", parts.alias("p"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), F.greatest(inclusive_line_count(F.coalesce("text", F.lit(""))) - 1, F.lit(0)).alias("last"))
    upto = whole.select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("n")).select(F.slice("p", F.lit(1), F.col("n")).alias("q")).distinct()
    join = lambda x: F.array_join(x, "/")
    up = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    folder_order = F.transform("q", lambda x: F.struct(F.lit(False).alias("is_file"), x.alias("name")))
    folders = upto.select(join(F.col("q")).alias("key"), F.when(F.size("q") > 0, join(up(F.col("q")))).alias("parent_key"), F.lit("folder").alias("kind"), F.when(F.size("q") > 0, F.element_at("q", -1)).otherwise(F.lit(root)).alias("name"), folder_order.alias("order"), F.lit(0).alias("last"), F.lit(0).alias("bytes"))
    named = whole.select(F.col("path").alias("key"), join(up(F.col("p"))).alias("parent_key"), F.lit("file").alias("kind"), F.element_at("p", -1).alias("name"), tree_order(F.col("path")).alias("order"), "last", "bytes")
    return folders.unionByName(named)


def nodes_of(files: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """(node_id, parent, key, kind, noun, name, line_start, line_end, byte_start, byte_end): folders first, then files,
    each by name, and a file's constructs right after it."""
    own = lambda key, i: F.concat(key, F.lit("#"), i.cast("string"))
    none: Column = F.lit(None).cast("string")
    top = spine(files, root).select("key", "parent_key", "kind", none.alias("noun"), "name", "order", F.lit(-1).alias("nth"), F.lit(0).alias("line_start"), F.col("last").alias("line_end"), F.lit(0).alias("byte_start"), F.col("bytes").alias("byte_end"))
    rows = found.select("path", F.posexplode("constructs").alias("nth", "c"))
    inner = rows.select(own(F.col("path"), F.col("nth")).alias("key"), F.when(F.col("c.parent").isNull(), F.col("path")).otherwise(own(F.col("path"), F.col("c.parent"))).alias("parent_key"), "c.kind", "c.noun", "c.name", tree_order(F.col("path")).alias("order"), "nth", "c.line_start", "c.line_end", "c.byte_start", "c.byte_end")
    numbered = written(dense_ids(top.unionByName(inner), "order", "nth", name="node_id"))
    above = numbered.select(F.col("key").alias("parent_key"), F.col("node_id").alias("parent"))
    return numbered.join(above, "parent_key", "left").drop("parent_key", "order", "nth")


def project(files: DataFrame, root: str = ".", keywords: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities and references of files (path, text): scanned, resolved by name over all files, lifted to entities."""
    found = written(scanned(files, keywords))
    nodes = written(nodes_of(files, found, root))
    up = written(closure(nodes.select(F.col("node_id").alias("id"), "parent")))
    kept = written(names.select_entities(nodes, up))
    numbered = written(dense_ids(kept, "node_id", name="id"))
    place = numbered.select("node_id", "id")
    parents = place.select(F.col("node_id").alias("up"), F.col("id").alias("parent_id"))
    entities = numbered.join(parents, "up", "left").select("id", "kind", "noun", "name", F.col("parent_id").alias("parent"), F.col("id").alias("ord"), F.split("key", "#")[0].alias("path"), "byte_start", "byte_end", "line_start", "line_end")
    raw = found.select("path", F.explode("refs").alias("r")).select(F.when(F.col("r.src").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("#"), F.col("r.src").cast("string"))).alias("key"), "r.name", "r.kind", "r.line")
    sited = raw.join(nodes.select("key", F.col("node_id").alias("src")), "key").select("src", "name", "kind", "line")
    hits = names.resolve(names.without_trivial(sited), names.name_table(nodes))
    lifted = names.dedup(names.lift_refs(hits, up, kept, names.glue(nodes)))
    ends = lifted.join(place.select(F.col("node_id").alias("src"), F.col("id").alias("s")), "src").join(place.select(F.col("node_id").alias("dst"), F.col("id").alias("d")), "dst")
    refs = dense_ids(ends.select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind", "sites"), "src", "dst", "kind", name="ref_id")
    return entities, refs.select("ref_id", "src", "dst", "kind", "sites")
