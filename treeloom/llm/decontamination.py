"""Benchmark decontamination over a distributed positional inverted index.

The index is parted by document: for each training text it holds the terms that it has and the positions of each,
written to the shared folder and read for every block of test items. Of the terms it keeps those whose place is set in
a bitmap of all items' terms, of VOCABULARY_BITS bits whatever the number of items. A test item's windows are phrases;
a phrase's terms are ordered by their number of postings in the whole corpus, and the list of the rarest, shifted by
its offset, is intersected with the shifted lists of the others, rarest first. The same lists answer proximity queries
(all terms within so many positions of the rarest, in any order).

Items are searched in blocks of BLOCK_BYTES of text at most (one longer item is a block of its own), which bounds
what a worker holds.

Defined cases: null, empty and wordless texts have no words and no hits; an empty table gives an empty one, and
without items nothing is hit; a text of any length is indexed whole; an item under ten words is one window, one
without words none; items without item_id mark hits but are not listed; rows that repeat an item_id are one item
with the windows of all; repeated documents, with or without doc_id, get equal rows; of equally rare terms (ties) the
first in the phrase is looked up first, which changes no result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import split_words

WINDOW = 10
BLOCK_BYTES = 1 << 20
#: Bits, as a power of two, of the bitmap of terms that are indexed.
VOCABULARY_BITS = 24
#: Candidates that one step of an intersection holds.
SLICE = 1 << 18
#: Between the texts of one batch, so that no phrase reaches over their bounds.
GAP = 1 << 12

#: Bytes between words once A-Z are lower case: ASCII other than digits and a-z.
SEPARATES = np.zeros(256, bool)
SEPARATES[:0x80] = True
SEPARATES[0x30:0x3A] = False
SEPARATES[0x61:0x7B] = False


@dataclass
class Phrases:
    """Distinct phrases of a block of items: terms (0 beyond the length), lengths, and the items of each."""

    terms: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
        words, counts = split_words([t for _, t in rows], SEPARATES)
        found: dict[tuple, set[str]] = {}
        at = 0
        for (item, _), n in zip(rows, counts.tolist(), strict=True):
            w, at = words[at : at + n].view(np.int64).tolist(), at + n
            for i in range(max(1, n - window + 1) if n else 0):
                found.setdefault(tuple(w[i : i + window]), set()).update([] if item is None else [item])
        terms = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            terms[i, : len(p)] = p
        return cls(terms, np.array([len(p) for p in found], np.int64), [sorted(x) for x in found.values()])

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms[np.arange(self.terms.shape[1]) < self.lengths[:, None]])


def bitmap(vocabularies: list[np.ndarray]) -> np.ndarray:
    """Which terms are to be indexed, by their upper bits."""
    bits = np.zeros(1 << VOCABULARY_BITS, bool)
    for terms in vocabularies:
        bits[place_of(terms)] = True
    return np.packbits(bits)


def place_of(terms: np.ndarray) -> np.ndarray:
    return (terms.view(np.uint64) >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)


def build_index(docs: DataFrame, indexed: np.ndarray | None = None) -> DataFrame:
    """row (its number), doc_id, n_words, terms (ascending), counts, positions (of each term in turn), for every row of docs.

    indexed: a bitmap of the terms to keep; None keeps all.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(indexed)

    def run(part):
        words, n_words = split_words(part.column("text").to_pylist(), SEPARATES)
        terms = words.view(np.int64)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        position = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        if shipped.value is not None:
            place = place_of(terms)
            keep = (shipped.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            terms, doc, position = terms[keep], doc[keep], position[keep]
        order = np.lexsort((position, terms, doc))
        terms, doc, position = terms[order], doc[order], position[order]
        first = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])))) if len(terms) else np.zeros(0, np.int64)
        lists = np.searchsorted(doc[first], np.arange(len(n_words) + 1))
        every = np.searchsorted(doc, np.arange(len(n_words) + 1))
        return {
            "doc_id": part.column("doc_id"),
            "n_words": n_words,
            "terms": common.ragged(terms[first], lists),
            "counts": common.ragged(np.diff(first, append=len(terms)).astype(np.int32), lists),
            "positions": common.ragged(position.astype(np.int32), every),
        }

    lists = common.map_batches(docs.select("doc_id", "text"), run, common.fields(docs, ["doc_id"], "n_words bigint, terms array<bigint>, counts array<int>, positions array<int>"))
    return common.materialize(lists.select(F.monotonically_increasing_id().alias("row"), "*"))


def postings(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of the index: term and place of each posting, and where each document begins."""
    n_words = part.column("n_words").to_numpy(zero_copy_only=False)
    base = np.cumsum(n_words + GAP) - (n_words + GAP)
    positions = part.column("positions")
    sizes = np.diff(positions.offsets.to_numpy())
    counts = part.column("counts").flatten().to_numpy()
    return np.repeat(part.column("terms").flatten().to_numpy(), counts), positions.flatten().to_numpy() + np.repeat(base, sizes), base


def corpus_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings of each term of the vocabulary in the whole index."""

    def run(part):
        terms, _, _ = postings(part)
        place = np.searchsorted(vocabulary, terms)
        hit = vocabulary[np.minimum(place, len(vocabulary) - 1)] == terms if len(vocabulary) else np.zeros(len(terms), bool)
        n = np.bincount(place[hit], minlength=len(vocabulary))
        some = np.flatnonzero(n)
        return {"place": some, "n": n[some]}

    rows = common.map_batches(index.select("n_words", "terms", "counts", "positions"), run, "place bigint, n bigint", "positions").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        out[r.place] = r.n
    return out


class Plan:
    """The order in which a block's phrases are intersected."""

    def __init__(self, phrases: Phrases, vocabulary: np.ndarray, counts: np.ndarray):
        self.phrases, self.vocabulary = phrases, vocabulary
        places = np.searchsorted(vocabulary, phrases.terms)
        beyond = np.arange(phrases.terms.shape[1]) >= phrases.lengths[:, None]
        rarity = np.where(beyond, np.iinfo(np.int64).max, np.append(counts, 0)[np.minimum(places, len(counts))])
        self.order = np.argsort(rarity, axis=1, kind="stable")  # offsets, the rarest first
        self.terms = np.take_along_axis(np.where(beyond, -1, places), self.order, axis=1)
        by = np.argsort(self.terms[:, 0], kind="stable")
        self.by_anchor = by
        self.bounds = np.searchsorted(self.terms[by, 0], np.arange(len(vocabulary) + 1))

    def anchors(self, term: np.ndarray, place: np.ndarray):
        """In slices: phrase, and place of its rarest term, for each posting of that term."""
        n = np.diff(self.bounds)[term]
        term, place, n = term[n > 0], place[n > 0], n[n > 0]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, side="right")))
            k = n[lo:hi]
            at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            yield self.by_anchor[np.repeat(self.bounds[term[lo:hi]], k) + at], np.repeat(place[lo:hi], k)
            lo = hi

    def local(self, terms: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Postings of this block's terms, and the same as one sorted array of term * span + place."""
        at = np.searchsorted(self.vocabulary, terms)
        hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == terms if len(self.vocabulary) else np.zeros(len(terms), bool)
        term, place = at[hit], places[hit]
        span = int(places.max(initial=0)) + 2 * GAP
        return term, place, np.sort(term * span + place + GAP), span

    def exact(self, terms: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first place of every occurrence."""
        term, place, lists, span = self.local(terms, places)
        out = [np.zeros((2, 0), np.int64)]
        for phrase, at in self.anchors(term, place):
            start = at - self.order[phrase, 0]
            for k in range(1, self.terms.shape[1]):
                more = self.terms[phrase, k] >= 0
                key = self.terms[phrase, k] * span + start + self.order[phrase, k] + GAP
                found = np.searchsorted(lists, key)
                stays = ~more | (lists[np.minimum(found, len(lists) - 1)] == key)
                phrase, start = phrase[stays], start[stays]
            out.append(np.stack([phrase, start]))
        return tuple(np.concatenate(out, axis=1))

    def near(self, terms: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and place of its rarest term wherever all its terms lie within slop (under GAP) positions of that."""
        term, place, lists, span = self.local(terms, places)
        out = [np.zeros((2, 0), np.int64)]
        for phrase, at in self.anchors(term, place):
            for k in range(1, self.terms.shape[1]):
                more = self.terms[phrase, k] >= 0
                key = self.terms[phrase, k] * span + at + GAP
                found = np.searchsorted(lists, key - slop)
                stays = ~more | ((found < len(lists)) & (lists[np.minimum(found, len(lists) - 1)] <= key + slop))
                phrase, at = phrase[stays], at[stays]
            out.append(np.stack([phrase, at]))
        return tuple(np.concatenate(out, axis=1))


def item_blocks(items: DataFrame) -> list[DataFrame]:
    """Items with a text, in blocks of about BLOCK_BYTES."""
    usable = items.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = -(-int(usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    return [usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [usable]


SEARCHED = "starts array<bigint>, ends array<bigint>, items array<string>"
CARRIED = ("row", "doc_id", "n_words")


def occurrences(plan: Plan, part) -> dict:
    """Columns of CARRIED and SEARCHED for a batch of the index."""
    terms, places, base = postings(part)
    phrase, start = plan.exact(terms, places)
    doc = np.searchsorted(base, start, side="right") - 1
    order = np.argsort(doc, kind="stable")
    phrase, start, doc = phrase[order], start[order] - base[doc[order]], doc[order]
    bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
    items = [sorted({x for p in np.unique(phrase[a:b]).tolist() for x in plan.phrases.items[p]}) if b > a else [] for a, b in zip(bounds[:-1], bounds[1:])]
    kept = {n: part.column(n) for n in CARRIED}
    return kept | {"starts": common.ragged(start, bounds), "ends": common.ragged(start + plan.phrases.lengths[phrase], bounds), "items": items}


def search_block(index: DataFrame, plan: Plan) -> DataFrame:
    """For every row of the index the spans [start, end) of occurrences and the items that they belong to."""
    return common.map_batches(index, lambda part: occurrences(plan, part), common.fields(index, CARRIED, SEARCHED), "positions")


def covered(starts: np.ndarray, ends: np.ndarray) -> int:
    """Positions inside any of the spans."""
    if not len(starts):
        return 0
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    return int((ends - np.maximum(starts, np.concatenate(([0], ends[:-1])))).clip(0).sum())


def planned(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, list[Plan]]:
    """The index of docs, and a plan for each block of items."""
    blocks = [Phrases.of(sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] or "", r[1]))) for block in item_blocks(items)]
    vocabularies = [phrases.vocabulary() for phrases in blocks]
    index = build_index(docs, bitmap(vocabularies))
    return index, [Plan(phrases, terms, corpus_counts(index, terms)) for phrases, terms in zip(blocks, vocabularies, strict=True)]


def search(index: DataFrame, plans: list[Plan]) -> DataFrame:
    """CARRIED and SEARCHED, for every row of the index, over all blocks; each block gives one row for each row of the index."""
    found = [search_block(index, plan) for plan in plans]
    if len(found) == 1:
        return found[0]
    merged = reduce(DataFrame.unionByName, found).groupBy(*CARRIED)
    return merged.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    index, plans = planned(docs, items)
    if len(plans) == 1:  # found and summed up in one step: a task then needs one Python worker
        return common.map_batches(index, lambda part: digest(occurrences(plans[0], part)), common.fields(index, ["doc_id"], DIGEST), "positions")
    found = search(index, plans)
    return common.map_batches(found, lambda part: digest({n: part.column(n) for n in part.schema.names}), common.fields(found, ["doc_id"], DIGEST), "starts")


def proximity(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """doc_id, items and position of the rarest term, wherever all terms of a phrase lie within slop positions of it."""
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    vocabulary = phrases.vocabulary()
    plan = Plan(phrases, vocabulary, corpus_counts(index, vocabulary))

    def run(part):
        terms, places, base = postings(part)
        phrase, at = plan.near(terms, places, slop)
        doc = np.searchsorted(base, at, side="right") - 1
        ids = part.column("doc_id").to_pylist()
        return {"doc_id": [ids[d] for d in doc.tolist()], "items": [plan.phrases.items[p] for p in phrase.tolist()], "position": at - base[doc]}

    return common.map_batches(index, run, common.fields(index, ["doc_id"], "items array<string>, position bigint"), "positions")


DIGEST = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def digest(found: dict) -> dict:
    hits = [covered(np.array(s, np.int64), np.array(e, np.int64)) for s, e in zip(found["starts"].to_pylist(), found["ends"].to_pylist(), strict=True)]
    items = found["items"] if isinstance(found["items"], list) else found["items"].to_pylist()
    return {
        "doc_id": found["doc_id"],
        "n_words": found["n_words"],
        "n_hit": hits,
        "n_items": [len(x) for x in items],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
        "contaminated": [h > 0 for h in hits],
    }
