"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and runs of words. Every word scores by what surrounds it: the names, classes,
ids and roles of its enclosing elements, whether it is in a link, and whether its box has buttons or fields; every tag
scores less than nothing. The weights are fitted to labelled pages (mainpage.py; the tables label none) by logistic
regression for words, and by the odds of standing inside content for tags. One scan finds the contiguous regions with
the largest sums: the best one, and others that score a fifth of it or more, as an article in two parts has. Within
them, words in elements that score as surroundings (an advert in the middle of an article, say) do not belong to the
text and count as nothing, nor do those of buttons and fields.

Blocks are what block-level elements bound; `br` is white space. Character references are decoded, white space in
a block becomes one space, and blocks are joined by an empty line.

Defined cases: null and empty pages, and pages without words, have an empty text; an empty table gives an empty one;
equal regions (ties) all belong to the text; unclosed and stray tags are borne, and a tag with a broken quote ends at
the next `>`; a page of any length is read whole; repeated rows get equal texts; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from . import common, mainpage

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title|iframe)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*+(?=>|\Z)|[^>]*)(?:>|\Z)|<(?=[^a-zA-Z/!?])|</[^>]*>", re.DOTALL | re.IGNORECASE)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta q ruby s samp small span strike strong sub sup time tt u var wbr link input button select option textarea".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
BOXES = frozenset("div section aside dialog li td".split())
#: Elements that tell nothing, and those whose words are a form's.
PLAIN = frozenset("html body div section span p b strong em i h1 h2 h3 h4 h5 h6 table tbody tr td th pre blockquote br".split())
CONTROLS = frozenset("button input select textarea".split())
CONTROL = "+control"
PAGES = 800
#: What a further region scores at least, as a share of the best one.
SHARE = 0.2


def features(tag: str, attributes: str, inside_article: bool) -> tuple[str, ...]:
    """What an element tells about the words in it; a header or footer of an article is not that of the page.

    The last word of a name says what the element is, those before it of what kind: `ad-free-article` is an article. Names
    of inline elements tell how words look and not what they are.
    """
    if tag in PLAIN:
        out = []
    else:
        out = [f"<article {tag}>" if inside_article and tag in ("header", "footer") else f"<{tag}>"]
    if attributes and tag not in INLINE:
        for m in NAMES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                *kinds, what = PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) or [""]
                out += [f".{what}", *(f".{k}-" for k in kinds)]
    return tuple(f for f in out if f != ".")


@dataclass(frozen=True, slots=True)
class Element:
    """An open element with what all that enclose it have told."""

    tag: str
    around: frozenset[str]
    box: int
    in_article: bool
    control: bool


TOP = Element("", frozenset(), 0, False, False)


def read(page: str, known: Container[str] | None = None):
    """Yields (place, "tag", name, is it a block bound?) and (place, "words", text, features of what encloses them).

    Words whose nearest box holds a button or a field, wherever in it, have the feature CONTROL; words of buttons and fields
    themselves are none of the page's. Features that are not known are left out, so that an element adds to a small set,
    however deep it lies: time is linear in the page.
    """
    stack: list[Element] = [TOP]
    depth: Counter[str] = Counter()
    events, operated, at = [], set(), 0

    def close() -> str:
        depth[stack[-1].tag] -= 1
        return stack.pop().tag

    def words(place: int, text: str) -> None:
        if not stack[-1].control:
            events.append((place, "words", text, stack[-1].around, stack[-1].box))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            words(at, page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[0] == "<":  # a sign, not a tag
                words(m.start(), "<")
            elif m[1]:
                events.append((m.start(), "tag", m[1].lower(), False, 0))
            continue
        name = name.lower()
        events.append((m.start(), "tag", name, name not in INLINE, 0))
        if m[2]:
            if depth[name] > 0:
                while close() != name:
                    pass
            continue
        if name in CONTROLS and stack[-1].box:
            operated.add(stack[-1].box)
        if name not in VOID and not m[4].rstrip().endswith("/"):
            while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].tag, ()):
                close()
            top = stack[-1]
            told = [f for f in features(name, m[4], top.in_article) if known is None or f in known]
            around = top.around if top.around.issuperset(told) else top.around.union(told)
            stack.append(Element(name, around, at if name in BOXES else top.box, top.in_article or name == "article", top.control or name in CONTROLS))
            depth[name] += 1
    if at < len(page):
        words(at, page[at:])
    for place, kind, value, more, of in events:
        yield place, kind, value, (more | {CONTROL} if of in operated else more)


Model = tuple[dict[str, float], float, dict[str, float]]


@cache
def trained(n: int = PAGES) -> Model:
    """Weights of the features of words, their bias, and the weights of tags."""
    names: dict[str, int] = {}
    rows, y, size = [], [], []
    inside: dict[str, list[int]] = {}
    for parts in mainpage.pages(n):
        bounds = np.cumsum([len(h) for h, _ in parts])
        for place, kind, value, more in read("".join(h for h, _ in parts)):
            label = parts[int(np.searchsorted(bounds, place, side="right"))][1]
            if kind == "words":
                rows.append([names.setdefault(f, len(names)) for f in set(more)])
                y.append(label)
                size.append(len(value.split()))
            else:
                inside.setdefault(value, [1, 1])[label] += 1
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    y, weight, at = np.array(y, float), np.array(size, float) / np.mean(size), np.zeros(len(names) + 1)
    for _ in range(25):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(at))
        at = at + np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.3 * at)
    totals = np.sum(list(inside.values()), axis=0)
    tags = {t: min(-0.02, 0.2 * float(np.log(b / totals[1] / (a / totals[0])))) for t, (a, b) in inside.items()}
    return {f: float(at[i]) for f, i in names.items()}, float(at[-1]), tags


def best_regions(scores: list[float], share: float = SHARE) -> list[tuple[int, int]]:
    """Bounds of the contiguous regions that score most, in order: every region that no longer one beats and none within
    does, found in one scan, as far as its sum is positive and a `share` of the best one's.

    Each region on the stack has the sum before it and the sum at its end. A new score makes a region; while the last region
    that begins lower ends lower, too, the two are one.
    """
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        lo, low, high = i, before, total
        while True:
            # the nearest region that begins lower; those passed on the way begin no lower, and end no later
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= high:
                break
            lo, low = found[k][0], found[k][2]
            del found[k:]
        found.append((lo, i + 1, low, high))
    most = max((high - low for _, _, low, high in found), default=0.0)
    return [(lo, hi) for lo, hi, low, high in found if high - low >= share * most]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous region with the largest positive sum, the first of several; empty where there is none."""
    return next(iter(best_regions(scores, 1.0)), (0, 0))


def main_text(page: str, model: Model | None = None) -> str:
    weights, bias, tags = model or trained()
    tokens, scores, kept = [], [], []
    memo: dict[frozenset[str], tuple[float, bool]] = {}
    for _, kind, value, more in read(page, weights):
        if kind == "tag":
            scores.append(tags.get(value, -0.05))
            kept.append(False)
        else:
            if more not in memo:
                known = [weights.get(f, 0.0) for f in sorted(more)]
                total = bias + sum(known)
                # surroundings inside something that speaks for content count as nothing
                memo[more] = (max(-1.0, min(1.0, total)) if total > 0 or max(known, default=0.0) <= 0 else 0.0, total > 0)
            score, keep = memo[more]
            scores.append(score * len(value.split()))
            kept.append(keep)
        tokens.append((kind, value, more))
    blocks: list[str] = []
    for lo, hi in best_regions(scores):
        block: list[str] = []
        for (kind, value, more), keep in zip(tokens[lo:hi], kept[lo:hi], strict=True):
            if kind == "words":
                if keep:
                    block.append(html.unescape(value))
            elif more:
                blocks.append(" ".join("".join(block).split()))
                block = []
            elif value == "br":
                block.append(" ")
        blocks.append(" ".join("".join(block).split()))
    return "\n\n".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for every row of pages."""

    model = trained()  # once, on the driver: a few hundred numbers go to the tasks

    def run(part):
        texts = [main_text(p or "", model) for p in part.column("html").to_pylist()]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_batches(pages.select("page_id", "url", "html"), run, common.fields(pages, ["page_id", "url"], "text string, n_chars bigint"), "html")
