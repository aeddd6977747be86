"""Source texts to tokens, in one pass with a stack of open brackets.

Comments and blanks give no token; strings give one, but for what they interpolate, whose tokens stand between brackets
of their own. Each bracket knows its partner, so that a reader of tokens steps over a body, or finds where it ends, at
once. Time is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}
WORD = r"[^\W\d]\w*"
NUMBER = r"\d\w*(?:\.\d\w*)?"
#: What a token may be, for each family of languages: the first that fits counts.
PATTERNS = {
    "rust": rf"(?P<skip>\s+|//[^\n]*)|(?P<note>/\*)|(?P<raw>b?r(?P<hash>#*)\")|(?P<str>[bc]?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^\\'\n])')|(?P<life>'{WORD})|(?P<id>(?:r#)?{WORD})|(?P<num>{NUMBER})|(?P<p>::|->|=>|==|!=|<=|>=|&&|\|\||\.\.=?|.)",
    "javascript": rf"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<tick>`)|(?P<id>\#?(?:[^\W\d]|\$)[\w$]*)|(?P<num>{NUMBER})|(?P<p>=>|\?\.(?!\d)|\?\?|\.\.\.|===?|!==?|<=|&&|\|\||.)",
    "python": rf"(?P<skip>[ \t\f\r]+|\#[^\n]*|\\\r?\n)|(?P<nl>\n)|(?P<str>(?P<mark>[rRbBuUfFtT]{{0,2}})(?P<q>\"\"\"|'''|\"|')(?P<body>(?:\\.|(?!(?P=q)).)*)(?:(?P=q)|\Z))|(?P<id>{WORD})|(?P<num>{NUMBER})|(?P<p>->|==|!=|:=|\*\*|.)",
    "sql": rf"(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>'(?:''|[^'])*(?:'|\Z))|(?P<id>\"[^\"]*\"|`[^`]*`|{WORD})|(?P<num>{NUMBER})|(?P<p>.)",
}
PATTERNS = {k: re.compile(v, re.DOTALL) for k, v in PATTERNS.items()}
FAMILY = {"rust": "rust", "javascript": "javascript", "typescript": "javascript", "tsx": "javascript", "python": "python", "sql": "sql"}
REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\n\\])*\]|[^/\n\\\[])+/[a-z]*")
NOTE = re.compile(r"/\*|\*/")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.DOTALL)
#: Words after which a slash begins a regular expression.
OPERATORS = frozenset("return typeof case in of do else void delete instanceof new yield await throw".split())


@dataclass
class Tokens:
    """Of each token its kind (id, num, str, life, p), word and place; of each bracket its partner, of others -1. An open
    bracket without partner has the number of all tokens."""

    text: str
    kind: list[str] = field(default_factory=list)
    word: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    pair: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # tokens that begin a logical line, in Python
    open: list[int] = field(default_factory=list)

    def add(self, kind: str, start: int, end: int, word: str | None = None) -> None:
        at = len(self.kind)
        word = self.text[start:end] if word is None else word
        self.kind.append(kind)
        self.word.append(word)
        self.start.append(start)
        self.end.append(end)
        self.pair.append(-1)
        if kind != "p":
            return
        if word in CLOSES:
            self.open.append(at)
        elif word in (")", "]", "}"):
            fits = next((i for i in range(len(self.open) - 1, max(-1, len(self.open) - 9), -1) if CLOSES[self.word[self.open[i]]] == word), None)
            if fits is not None:
                for i in self.open[fits:]:
                    self.pair[i] = at
                self.pair[at] = self.open[fits]
                del self.open[fits:]

    def done(self) -> Tokens:
        for i in self.open:
            self.pair[i] = len(self.kind)
        self.open = []
        return self


def tokens(text: str, lang: str) -> Tokens:
    out = Tokens(text)
    _read(out, FAMILY[lang], 0, len(text))
    return out.done()


def _read(out: Tokens, family: str, at: int, end: int) -> None:
    match, text = PATTERNS[family].match, out.text
    templates: list[int] = []  # how many brackets were open where an interpolation began
    fresh = family == "python" and at == 0
    while at < end:
        m = match(text, at, end)
        if m is None:
            at += 1
            continue
        kind, begin, at = m.lastgroup if m.lastgroup in ("skip", "nl", "id", "num", "p", "life", "note", "tick") else "str", at, m.end()
        if kind == "skip":
            continue
        if kind == "nl":
            fresh = fresh or not out.open
            continue
        if fresh:
            out.first.append(len(out.kind))
            fresh = False
        if kind == "note":  # comments nest
            depth = 1
            while depth and (n := NOTE.search(text, at, end)):
                depth, at = depth + (1 if n[0] == "/*" else -1), n.end()
            at = end if depth else at
        elif family == "rust" and m["raw"]:
            close = text.find('"' + m["hash"], at, end)
            at = end if close < 0 else close + 1 + len(m["hash"])
            out.add("str", begin, at)
        elif kind == "tick":
            at = _template(out, begin, at, end, templates)
        elif kind == "p" and m[0] == "/" and family == "javascript" and _value_next(out) and (r := REGEX.match(text, begin, end)):
            at = r.end()
            out.add("str", begin, at)
        elif kind == "p" and m[0] == "}" and templates and len(out.open) == templates[-1] + 1 and out.word[out.open[-1]] == "${":
            out.add("p", begin, at)
            templates.pop()
            at = _template(out, at, at, end, templates)
        elif kind == "str" and family == "python" and set(m["mark"]) & set("fFtT"):
            _interpolated(out, m.start("body"), m.end("body"), begin)
            out.add("str", m.end("body"), at)
        else:
            out.add(kind, begin, at)


def _value_next(out: Tokens) -> bool:
    """A value is due here, so that a slash divides nothing."""
    if not out.kind:
        return True
    kind, word = out.kind[-1], out.word[-1]
    return word in OPERATORS if kind == "id" else kind == "p" and word not in (")", "]", "}")


def _template(out: Tokens, begin: int, at: int, end: int, templates: list[int]) -> int:
    at = TEMPLATE.match(out.text, at, end).end()
    if out.text.startswith("${", at, end):
        out.add("str", begin, at)
        templates.append(len(out.open))
        out.add("p", at, at + 2)
        return at + 2
    at = min(end, at + 1)
    out.add("str", begin, at)
    return at


def _interpolated(out: Tokens, at: int, end: int, begin: int) -> None:
    """The tokens of a formatted string: what stands in single braces is read as code."""
    while at < end:
        c = out.text[at]
        if out.text[at : at + 2] in ("{{", "}}") or c == "\\":
            at += 2
        elif c == "{":
            stop, depth = at + 1, 1
            while stop < end and depth:
                depth += (out.text[stop] == "{") - (out.text[stop] == "}")
                stop += 1
            out.add("str", begin, at)
            out.add("p", at, at + 1)
            _read(out, "python", at + 1, stop - 1)
            out.add("p", stop - 1, stop, "}")
            at = begin = stop
        else:
            at += 1
