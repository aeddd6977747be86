"""The operators of the subpackage against brute force, on small tables with the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import common, components, decontamination, extraction, fingerprints, language, linededup, mainpage, neardup, pieces, secrets, sharding, shingles, stages, toxicity

MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


def docs(spark, texts, start=0):
    rows = [(i + start if i is not None else None, t, None, None, None, 0.5) for i, t in (enumerate(texts) if not isinstance(texts, dict) else texts.items())]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n ", "x", "İß 日本 😀", "word " * 30000, "same text", "same text"]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, r=rng: " ".join(r.choice(vocabulary) for _ in range(n))


def test_every_operator_bears_odd_rows_and_empty_tables(spark):
    table = docs(spark, ODD)
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (None, "word word"), (3, "same text"), (3, "same text")], "item_id bigint, text string")
    for t in (table, table.limit(0)):
        n = t.count()
        assert secrets.scan(t, secrets.fit(t)).count() == n
        assert fingerprints.compare_with_next(t, 3).count() == n
        assert neardup.near_duplicates(t).count() == n
        assert toxicity.score(t, toxicity.fit(t, labels)).count() == n
        assert language.predict(t, language.fit(t)).count() == n
        assert sharding.shards(t, 1000).count() == n
        assert decontamination.contamination(t, items).count() == n
        assert decontamination.contamination(t, items.limit(0)).count() == n
        assert linededup.line_report(t).count() == n
        assert pieces.encode(t, MODEL.read_bytes()).count() == n
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>x &lt; y"), (None, "u", "</b><<p")], "page_id bigint, url string, html string")
    assert {(r.page_id, r.text) for r in extraction.extract(pages).collect()} >= {(1, ""), (2, ""), (3, "x < y")}
    assert extraction.extract(pages.limit(0)).count() == 0


def plain_ratio(value, model):
    """The log likelihood ratio, symbol by symbol."""
    def chance(automaton):
        at, total, n = 0, 0.0, secrets.SYMBOLS
        for c in value:
            s = automaton.states[at]
            total += np.log((s.counts.get(c, 0) + 0.5 / n) / (s.visits + 0.5))
            at = s.to.get(c, at)
        s = automaton.states[at]
        return total + np.log((s.stops + 0.5 / n) / (s.visits + 0.5))

    return max(chance(model[k]) for k in secrets.KINDS if k in model) - max(chance(model[k]) for k in ("other", "numbered") if k in model)


def test_secrets_of_every_length_are_scored_in_linear_time(spark, prose):
    import time

    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("ABCDEFGHKMNPQRSTUVWXYZ") for _ in range(n))
    model = {"assign": secrets.Automaton([key(9) for _ in range(200)]), "other": secrets.Automaton([w for w in prose(900).split() if len(w) >= 6])}
    bare, text = key(9), prose(30)
    odd = {0: None, 1: "", 2: f"{text} {bare} {text}", 3: f"{text} {bare} {text}", 4: text, 5: f"token={bare} secret: {'ab' * 12}"}
    rows = {r.doc_id: r for r in secrets.scan(docs(spark, odd).withColumn("n_hex", F.lit("x")), model).collect()}
    at = len(text) + 1
    assert rows[2].spans == rows[3].spans == f"format:{at}:{at + 9}" and rows[2].n_format == 1 and rows[4].spans == ""
    assert rows[0][1:] == rows[1][1:] == (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert rows[5].spans == "assign:0:15,assign:16:48,hex:24:48"
    took = []
    for n in (2000, 8000):
        big, began = f"token={bare} {bare} plainword " * n, time.process_time()
        assert sum(1 for _ in secrets.candidates(big, secrets.base_spans(big), {bare})) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_secret_samples_are_the_smallest_of_all(spark, prose):
    texts = [f"token={i:08d}x {prose(20)}" for i in range(300)]
    some = secrets.fit(docs(spark, texts).repartition(7), sample_values=50)
    again = secrets.fit(docs(spark, texts + texts).repartition(2), sample_values=50)
    assert set(some) == {"assign", "other"} and all(some[k].states == again[k].states for k in some)


def test_samples_are_distinct_and_full(spark):
    same = spark.createDataFrame([(7, "x", f"t{i}") for i in range(3000)] + [(8, "y", "one")] * 3000, "doc_id bigint, lang string, text string")
    for most in (5, 40):
        got = common.bounded_sample(same, "lang", ["doc_id", "text"], most).groupBy("lang").count().collect()
        assert {r[0]: r[1] for r in got} == {"x": most, "y": 1}
    assert common.bounded_sample(same.limit(0), "lang", ["doc_id", "text"], 5).count() == 0


def test_base_secrets_and_learned_formats():
    text = 'é password: "abc123" token=tok:abcdef api_KEY = zzzzzz AKIA' + "A1" * 8 + " AKIAshort " + "0af" * 8 + " ſecret=abcdefg"
    got = [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.base_spans(text)]
    assert got == [("assign", 'password: "abc123'), ("assign", "api_KEY = zzzzzz"), ("access", "AKIA" + "A1" * 8), ("hex", "0af" * 8)]
    rng = random.Random(2)
    keys = ["sk-" + "".join(rng.choice("ABCDEFGHJK0123456789") for _ in range(20)) for _ in range(120)]
    other = ["-".join(str(rng.randint(1000, 9999)) for _ in range(4)) for _ in range(120)]
    model = {"assign": secrets.Automaton(keys[:100]), "other": secrets.Automaton(other[:100])}
    assert len(model["assign"].states) < 12
    assert (secrets.ratios(keys[100:], model) > secrets.MARGIN).all() and (secrets.ratios(other[100:], model) < 0).all()
    mixed = [*keys[100:110], "x", *other[100:110], "unseen~é"]
    assert np.allclose(secrets.ratios(mixed, model), [plain_ratio(v, model) for v in mixed])


def test_secret_spans_in_a_table(spark):
    text = "x token=abcdef " + "12ab" * 7
    row = secrets.scan(docs(spark, [text]), {}).first()
    line = "assign:2:14,hex:15:43"
    assert (row.spans, row.base_sha256) == (line, hashlib.sha256(line.encode()).hexdigest())


def test_fingerprints_share_interiors_and_follow_the_next_row(spark, prose):
    a, b, c = prose(300), prose(300), prose(300)
    one, shifted, other = fingerprints.fingerprint([a, "zz " + a, b])
    assert fingerprints.likeness(one, shifted) > 0.8 > 0.2 > fingerprints.likeness(one, other)
    assert fingerprints.fingerprint([a])[0] == fingerprints.fingerprint([c, b, a])[2]
    texts = {5: a, 2: "", 9: b, 1: "ab", 7: None, 3: c}
    order = sorted(texts, reverse=True)
    for cells in (1, 3, 20):
        got = {r.doc_id: r for r in fingerprints.compare_with_next(docs(spark, texts), cells).collect()}
        for i, following in zip(order, [*order[1:], order[0]], strict=True):
            mine, after = texts[i] or "", texts[following] or ""
            m = len(mine) // 3
            changed = mine[: len(mine) - m] + after[:m]
            assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(mine)
            assert got[i].near_next == fingerprints.likeness(*fingerprints.fingerprint([mine, after]))


def plain_phrases(text):
    """The parse of one text, symbol by symbol: names level by level."""
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        x = ((x ^ (x >> 29)) * 0xA3B195354A39B70D) & mask
        return x ^ (x >> 32)

    def toss(labels, wide):
        out = []
        for i, a in enumerate(labels):
            b = labels[i - 1] if i else ~a & (mask if wide else 255)
            k = ((a ^ b) & -(a ^ b)).bit_length() - 1
            out.append(2 * k + (a >> k & 1))
        return out

    names, found = [mix(ord(c) + 1) for c in text], []
    while names and (len(found) < 3 or len(found[-1]) > 1):
        level = len(found) + 1
        runs = [(k, len(list(g))) for k, g in itertools.groupby(names)]
        symbols = [k if n == 1 else mix((k + n * 0x9FB21C651E98DF25) & mask) for k, n in runs]
        labels = symbols
        for step in range(4):
            labels = toss(labels, step == 0)
        starts = [i for i in range(len(symbols)) if i == 0 or i + 1 < len(symbols) and labels[i - 1] < labels[i] > labels[i + 1]]
        names = []
        for a, b in zip(starts, [*starts[1:], len(symbols)]):
            parts = [mix((symbols[i] + (i - a + 64 * level + 1) * 0x9E3779B97F4A7C15) & mask) for i in range(a, b)]
            names.append(mix((sum(parts) + level) & mask))
        found.append(names)
    return found


def plain_fingerprint(text):
    found = plain_phrases(text)
    groups = [found[:1], found[1:2], found[2:]]
    words = [sorted({n >> 32 for names in g for n in names})[:k] for g, k in zip(groups, fingerprints.KEPT, strict=True)]
    return ".".join("".join(f"{w:08x}" for w in ws) for ws in words)


def test_fingerprints_are_those_of_each_text_alone(spark, prose):
    rng = random.Random(21)
    texts = [prose(n) for n in (0, 1, 2, 5, 30, 150)] + ["", "a", "aa", "ab", "aaaab", "İß 日本 😀", "x" * 500]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    expected = [plain_fingerprint(t) for t in texts]
    assert fingerprints.fingerprint(texts) == expected
    assert [fingerprints.fingerprint([t])[0] for t in texts] == expected
    for other in (prose(400), "", "b"):
        assert [fingerprints.fingerprint([t, other])[0] for t in texts] == [fingerprints.fingerprint([other, t])[1] for t in texts] == expected
    names = {r.doc_id: r.names for r in fingerprints.phrases(docs(spark, texts), 2).collect()}
    assert all(names[i] == [n - 2**64 if n >> 63 else n for n in (plain_phrases(t) or [[], []])[1]] for i, t in enumerate(texts))


def test_equal_neighbours_are_alike(spark, prose):
    a, b = prose(40), prose(6)
    ids = [9, 9, 8, 7, 7, 7, None, None, None, 3]
    texts = [a, a, a, b, b, b, b, a, a, b]
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    for cells in (1, 4, 30):
        rows = fingerprints.compare_with_next(table, cells).collect()
        assert len({(r.n_chars, r.fingerprint) for r in rows}) == 2 and len(rows) == 10
        assert sum(r.near_next == 1 for r in rows) in (6, 8)  # those without id stand as their hashes do: a a b, or b a a
    many = spark.createDataFrame([(None, f"{a} {i}") for i in range(200)] + [(5, b)], "doc_id bigint, text string")
    rows = fingerprints.compare_with_next(many, 8).collect()
    assert len(rows) == 201 and sum(r.doc_id is None for r in rows) == 200
    assert fingerprints.with_next(many, 8).filter("not follows").groupBy("cell").count().agg(F.max("count")).first()[0] < 60


def brute_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_agree_with_brute_force(spark, prose, monkeypatch):
    rng = random.Random(8)
    texts, base = {}, [prose(120) for _ in range(6)]
    for i in range(140):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(10**6)
        texts[i] = " ".join(w)
    texts |= {200: None, 201: "  ", 202: "One two", 203: "one TWO", 204: base[0].upper(), 205: base[0]}
    expected = brute_groups(texts)
    for block in (1024, 8):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
        assert got == expected


def test_bayesian_bound_is_the_posterior_tail():
    n, m = 64, neardup.least_matches(64)
    draws = np.random.default_rng(1).beta(m + 1, n - m + 1, 400_000)
    assert (draws >= 0.75).mean() < 1e-4 and neardup.least_matches(32) <= 24


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 40), (40, 45), (60, 60)], "u bigint, v bigint")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {50: 40, 45: 40}


def test_toxic_spans_and_scores(prose):
    rng = random.Random(4)
    clean = [prose(60) for _ in range(160)]
    toxic = [" ".join(c.split()[:30] + ["vileword", "nastyish"][: rng.randint(1, 2)] + c.split()[30:]) for c in clean[:60]]
    model = toxicity.train(toxic[:40] + clean[60:140], np.array([1] * 40 + [0] * 80), np.ones(120))
    chain = toxicity.Chain.of(np.array([len(t.split()) for t in (toxic[50], clean[150])]))
    p = chain.marginals(model.evidence((toxic[50] + " " + clean[150]).split(), {}), model.trans)
    assert (p >= 0.5).sum() == sum(w in ("vileword", "nastyish") for w in toxic[50].split())
    assert toxicity.train(clean[:3], np.zeros(3), np.ones(3)) is None


def test_forward_backward_agrees_with_enumeration():
    rng = np.random.default_rng(3)
    lengths, trans = np.array([4, 0, 2, 5]), rng.normal(size=(2, 2))
    evidence = rng.normal(size=lengths.sum())
    got, at = toxicity.Chain.of(lengths).marginals(evidence, trans), 0
    for n in lengths:
        e, total, marginal = evidence[at : at + n], 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] for i, s in enumerate(states) if s) + sum(trans[a, b] for a, b in zip(states, states[1:])))
            total, marginal = total + w, marginal + w * np.array(states)
        assert np.allclose(got[at : at + n], marginal / total)
        at += n


def test_languages_are_told_apart(spark, prose):
    rng = random.Random(6)
    texts = {i: " ".join("".join(rng.choice("aeiou" if i % 2 else "bcdfg") for _ in range(5)) for _ in range(40)) for i in range(40)}
    labelled = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "v").otherwise("c"))
    model = language.fit(labelled.filter("doc_id < 20"))
    got = {r.doc_id: r.lang_pred for r in language.predict(labelled, model).collect()}
    assert got == {i: "v" if i % 2 else "c" for i in texts}
    assert language.predict(docs(spark, ["123 !"]), model).first()[1:] == ("und", 0.0)
    assert np.array_equal(language.profiles(["abc", "de"])[1], language.profiles(["de"])[0])


def test_main_text_of_labelled_layouts():
    good = 0
    for parts in mainpage.pages(60, seed=99):
        words = re.sub(r"<[^>]*>", " ", "".join(h if c else " " for h, c in parts)).split()
        good += extraction.main_text("".join(h for h, _ in parts)).split() == words
    assert good >= 54
    page = '<div class="ad">buy</div><article><h1>A &amp; b</h1><p>One  two <a href="x">three</a><script>var t="</p>"</script></p><p>4 < 5</p></article><div class="comments"><article class="comment"><p>me too, a long comment of many words</p></article></div>'
    assert extraction.main_text(page) == "A & b\n\nOne two three\n\n4 < 5"


def test_regions_titles_notices_and_broken_quotes(spark):
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.choice([-2.0, -1.0, 0.5, 1.0]) for _ in range(rng.randint(0, 12))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        lo, hi = extraction.best_region(scores)
        assert abs(sum(scores[lo:hi]) - max([0.0, *sums.values()])) < 1e-9
    assert extraction.best_region([1.0, -5.0, 1.0]) == (0, 1)  # of equal regions the first
    body = "<p>one two three four five six seven eight</p>"
    kept = "one two three four five six seven eight"
    assert extraction.main_text(f"<article><header><h1>Title here</h1></header>{body}</article>") == f"Title here\n\n{kept}"
    for notice in ('<div class="cookie-bar">we use cookies here</div>', '<div class="gdpr">we use cookies here</div>', '<div class="zzz"><p>we use cookies on this site</p><button>fine</button></div>'):
        assert extraction.main_text(f"<body>{notice}<article>{body}</article></body>") == kept
    for broken in ('<a href="x>link</a>', '<a href="x>link</a> "said" so', "<a title='x>link</a>"):
        text = extraction.main_text(f"<article>{body}<p>{broken} and more words to read</p></article>")
        assert "<" not in text and "href" not in text and "more words to read" in text and text.startswith(kept)
    long = "<p>" + "word " * 30_000 + "</p>"
    rows = [(1, "u", f"<article>{long}</article>", 1), (2, "u", f"<main>{body}</main>", 2), (3, None, f"<main>{body}</main>", 3), (4, "u", None, 4)]
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()}
    assert got[1].n_chars == 149_999 and got[2].text == got[3].text == kept and (got[4].text, got[4].n_chars) == ("", 0)


def plain_regions(scores, first=0):
    """The region with the largest sum, and the same of what is left and right of it."""
    sums = [(sum(scores[a:b]), a - b, -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    best = max(sums, default=(0,))
    if best[0] <= 1e-12:
        return []
    a, b = best[3:]
    return [*plain_regions(scores[:a], first), (first + a, first + b), *plain_regions(scores[b:], first + b)]


def test_all_regions_in_one_scan():
    rng = random.Random(6)
    for _ in range(400):
        scores = [rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 14))]
        found = plain_regions(scores)
        assert extraction.best_regions(scores, 0.0) == found
        most = max((sum(scores[a:b]) for a, b in found), default=0)
        assert extraction.best_regions(scores) == [(a, b) for a, b in found if sum(scores[a:b]) >= 0.2 * most]


WORDS = "Some long sentence of plain words that reads like an article and goes on for a while. "
LONG = " ".join((WORDS * 4).split())
#: Pages in the layouts of the web, with names that are in no list that the model learns from; text outside of `{}` goes.
LAYOUTS = {
    f'<div class="post"><p>{{}}</p></div><div class="ad">{"buy this now " * 30}</div><div class="post"><p>{{}}</p></div>': 2,
    '<div class="ad-free-article"><p>{}</p></div>': 1,
    '<div class="navigation-main"><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></div><article><p>{}</p></article>': 1,
    '<nav class="zq"><a href="/">Start</a></nav><main class="qz"><p>{}</p><p>{}</p></main><footer>All rights kept by us</footer>': 2,
    '<div class="navbar">Home Blog About</div><div id="qq"><p>{}</p></div>': 1,
    '<header class="masthead"><h1>The Daily</h1></header><div class="story-text"><p>{}</p></div>': 1,
    '<article><p>{}</p></article><section class="discussion"><p>I do not agree with this at all</p></section>': 1,
    '<article><p>{}</p></article><section id="responses"><article class="comment"><p>So true, I say</p></article></section>': 1,
    '<article><p>{}</p></article><div class="site-info">Made by us in 1999</div>': 1,
    '<article><p>{}</p><button>Copy</button><p>{}</p></article>': 2,
    '<article><p>{}</p><form><label>Mail</label><input><button>Send</button></form></article>': 1,
    '<table><tr><td class="menu"><a href="/">Home</a></td><td class="content"><p>{}</p></td></tr></table>': 1,
    '<article><p>{}<p>{}<ul><li>{}<li>{}</ul></article>': 4,
    '<aside class="related"><a href="/1">Next story</a></aside><div class="entryContent"><p>{}</p></div>': 1,
    '<div class="cookie-consent"><p>We use cookies to count you</p><button>Fine</button></div><article><p>{}</p></article>': 1,
    '<article><script>var a = "<p>no</p>"</script><style>p {{color: red}}</style><p>{}</p></article>': 1,
    '<article><!-- <p>no</p> --><p>{}</p></article>': 1,
    '<article><p>{}</p><div class="share-buttons"><a href="#">Share this</a></div></article>': 1,
    '<main><h2>{}</h2><blockquote>{}</blockquote><pre>{}</pre></main>': 3,
    '<div class="sidebar-left">Links and more links</div><div class="blogPost"><p>{}</p></div><div class="sidebar-right">Other links</div>': 1,
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_pages_written_by_hand(layout):
    parts = [f"Part {'abcd'[i]}. {LONG}" for i in range(LAYOUTS[layout])]
    assert extraction.main_text("<html><body>" + layout.format(*parts) + "</body></html>") == "\n\n".join(parts)


def test_inline_words_stay_and_depth_costs_no_square():
    import time

    assert extraction.main_text(f'<article><p>{WORDS}See <a class="button share">the original paper</a> for more.</p></article>').endswith("See the original paper for more.")
    for page in ("<div class='x y-z'>" * 30000 + "word", "".join(f"<div class='q{i}'>" for i in range(30000)) + "</p>" * 30000):
        began = time.process_time()
        extraction.main_text(page)
        assert time.process_time() - began < 10


def brute_shards(rows, limit):
    """rows (doc_id, text): the shard of each, by splitting one bucket at a time."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = lambda r: int(md5(f"{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")[:15], 16)

    def split(members, depth, prefix):
        if not members:
            return []
        if sum(len((t or "").encode()) for _, t in members) <= limit or len({key(r) for r in members}) == 1:
            return [(i, len((t or "").encode()), prefix) for i, t in members]
        return [x for bit in "01" for x in split([m for m in members if bin(key(m))[2:].zfill(60)[depth] == bit], depth + 1, prefix + bit)]

    return sorted(split(rows, 0, ""), key=str)


def test_shards_agree_with_splitting_one_by_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice("xyz") * rng.choice([0, 5, 40, 300])) for i in range(150)]
    rows += [(None, f"n{i}" * 20) for i in range(8)] + [(7, f"r{i}é" * 20) for i in range(6)] + [(9, "same" * 30)] * 4 + [(None, None), (3, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("x")).withColumn("a.b", F.lit(1))
    for spare, rise in ((6, 4), (0, 1), (0, 60)):
        monkeypatch.setattr(sharding, "SPARE", spare)
        monkeypatch.setattr(sharding, "RISE", rise)
        found = sharding.shards(table, 310).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.shard) for r in found), key=str) == brute_shards(rows, 310)
    assert {(r.doc_id, r.shard_bytes, r.oversized) for r in found if r.shard_bytes > 310} == {(9, 480, True)}
    over = [r for r in sharding.shards(table, 100).collect() if r.oversized]
    assert over and all(r.shard_docs == 1 or r.doc_id == 9 for r in over)


def test_shards_are_written(spark, tmp_path):
    rows = [(i % 40, f"text {i} " * 5) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("mine"))
    column = sharding.write_shards(table, 400, str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).schema(f"doc_id bigint, text string, shard string, {column} string").parquet(str(tmp_path / "out"))
    assert column == "shard_" and sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows) and back.select("shard").distinct().count() == 1
    assert back.groupBy(column).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] <= 400


def test_phrases_in_blocks_and_proximity(spark, prose, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng.choice([3, 10, 14]))) for i in range(25)]
    texts = {i: " ".join([prose(20), rng.choice(items)[1].upper() if i % 3 else "", prose(20)]) for i in range(40)}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = {}
    for i, t in texts.items():
        w, hit, found = word.findall(t.lower()), set(), set()
        for item, s in items:
            v = word.findall(s)
            n = min(10, len(v))
            for g in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == g:
                        hit |= set(range(k, k + n))
                        found.add(str(item))
        expected[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    table, bench = docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1 << 20, 200):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontamination.contamination(table, bench).collect()}
        assert got == expected
    odd = docs(spark, {1: None, 2: "", 3: "word " * 30_000 + items[0][1], 4: items[0][1], 5: items[0][1]}).withColumn("items", F.lit("x"))
    for size in (1 << 20, 200):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        rows = sorted(decontamination.contamination(odd, bench).collect(), key=lambda r: r.doc_id)
        assert [r.n_hit for r in rows[:2]] == [0, 0] and rows[2].n_hit == len(items[0][1].split()) and rows[3][1:] == rows[4][1:] and rows[2].contaminated
    assert not any(r.n_hit for r in decontamination.contamination(odd, bench.limit(0)).collect())
    with pytest.raises(ValueError):
        decontamination.proximity(odd, decontamination.Phrases.of([("q", "far near")]), 5000)
    phrases = decontamination.Phrases.of([("q", "far near")])
    near = decontamination.proximity(decontamination.build_index(docs(spark, ["near x far", "near x y z far", "far"])), phrases, 2)
    assert {r.doc_id for r in near.collect()} == {0}


def test_line_join_agrees_with_brute_force(spark):
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    texts = {i: "\n".join("".join(rng.choice("aé") for _ in range(rng.randint(6, 9))) for _ in range(3)) for i in range(30)}
    firsts = {}
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            firsts.setdefault(line, (i, k))
    for edits in (1, 2):
        expected = {}
        for i, t in texts.items():
            lines = t.split("\n")
            near = [[f for other, f in firsts.items() if other != x and distance(x, other) <= edits] for x in lines]
            gone = [k for k, x in enumerate(lines) if (i, k) > min([firsts[x], *near[k]])]
            expected[i] = (sum(map(len, near)), ",".join(map(str, gone)))
        got = {r.doc_id: (r.n_links, r.dropped) for r in linededup.line_report(docs(spark, texts), 6, edits).collect()}
        assert got == expected


def test_lines_of_every_length_are_compared(spark):
    rng = random.Random(12)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def changed(line):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(line) + 1)
            line = line[:k] + rng.choice(["", "a", "é", "bé"]) + line[k + rng.randint(0, 1) :]
        return line

    base = ["".join(rng.choice("aéb c") for _ in range(n)) for n in (1, 2, 9, 15, 16, 17, 18, 30, 31, 32, 33, 34, 40)]
    texts = {i: "\n".join([changed(rng.choice(base)) for _ in range(5)] + ["", "All rights reserved."][: i % 3]) for i in range(60)}
    firsts, expected = {}, {}
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            firsts.setdefault(line, (i, k))
    allowed = lambda x, y: min(2, min(len(x), len(y)) // 16)
    for i, t in texts.items():
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x]
        near = {k: [f for y, f in firsts.items() if y and y != x and distance(x, y) <= allowed(x, y)] for k, x in lines}
        gone = [k for k, x in lines if (i, k) > min([firsts[x], *near[k]])]
        expected[i] = (len(lines), sum(map(len, near.values())), ",".join(map(str, gone)))
    assert sum(links for _, links, _ in expected.values()) > 100
    got = {r.doc_id: (r.n_compared, r.n_links, r.dropped) for r in linededup.line_report(docs(spark, texts)).collect()}
    assert got == expected
    cut = linededup.without_lines(docs(spark, {1: "own\nAll rights reserved.", 2: "other\nAll rights reserved."}))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "own\nAll rights reserved.", 2: "other"}


def test_lines_that_go_are_cut(spark):
    long = "a line that is long enough to be compared with others"
    out = linededup.without_lines(docs(spark, {1: f"{long}\nshort", 2: f"{long}!\nown line of the second document, long too", 3: long, 4: None}).withColumn("n_chars", F.lit(9).cast("bigint")))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (f"{long}\nshort", 9), 2: ("own line of the second document, long too", 41), 4: (None, 9)}


@pytest.mark.skipif(not MODEL.exists(), reason="no tokenizer file")
def test_pieces_are_the_librarys():
    import sentencepiece

    fst, library = pieces.compiled(MODEL.read_bytes()), sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    rng = random.Random(1)
    texts = ["", " ", "   a  b", "\n\nx\n", "日本語 😀\x00", "a" * 3000, " " * 200 + "b", "▁x"]
    texts += ["".join(rng.choice("etaoin shrdlu,.'()éñ12\n") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += ["".join(fst.text[rng.randint(259, 31999)] for _ in range(5)).replace("▁", " ") for _ in range(2000)]
    ours = fst.encode(texts)
    assert ours == library.encode(texts)
    assert [fst.decode(i) for i in ours] == library.decode(ours)
    assert all(fst.decode(i) == t for t, i in zip(texts, ours, strict=True) if "▁" not in t)


@pytest.mark.skipif(not MODEL.exists(), reason="no tokenizer file")
def test_pieces_do_not_depend_on_the_memo(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(60)]
    fst = pieces.Transducer(MODEL.read_bytes())
    expected = fst.encode(texts)
    monkeypatch.setattr(pieces, "MEMO", 40)  # less than a batch has, so that generations change at each
    assert [fst.encode(texts[i : i + 7]) for i in range(0, 60, 7)] == [expected[i : i + 7] for i in range(0, 60, 7)]
    odd = [None, "", "İß 日本 😀", "word " * 30_000, "same", "same"]
    rows = sorted(pieces.encode(docs(spark, odd).withColumn("round_trip", F.lit(1)), MODEL.read_bytes()).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[4][1:] == rows[5][1:] and all(r.round_trip for r in rows)
    assert [r.decoded_sha256 for r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for t in odd]
    assert [r.ids for r in rows] == fst.encode([t or "" for t in odd])


def test_shingles_are_those_of_the_words():
    sets, digests = shingles.shingle_sets(["A b\tc d e f", "a B c d e f", "a b", "b a", None])
    assert len(sets[0]) == 2 and np.array_equal(sets[0], sets[1]) and digests[0] == digests[1]
    assert len(sets[2]) == 1 and not np.array_equal(sets[2], sets[3]) and len(sets[4]) == 0


def test_stages_judge_each_row(spark, prose, tmp_path):
    item, a, b, c = prose(12), prose(60), prose(60), prose(60)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "doc_id bigint, text string")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    leaked = f"{a} {item} {b}"
    got = pairs(stages.without_benchmark(spark, rows((None, leaked), (None, a), (3, leaked), (3, b), (4, c), (4, c)), str(tmp_path)))
    assert got == sorted([(None, a), (3, b), (4, c), (4, c)], key=str)
    got = pairs(stages.one_of_each_group(spark, rows((None, a), (None, a), (9, b), (2, b), (2, b), (None, b), (5, c), (5, prose(3)), (None, None)), ""))
    assert [x for x in got if x[1] in (a, b, c)] == sorted([(None, a), (2, b), (5, c)], key=str) and len(got) == 5
    got = pairs(stages.without_repeated_lines(spark, rows((None, f"{a}\nnew"), (7, a), (7, a), (None, "new\nown"), (7, f"{b}\n{a}")), ""))
    assert sorted(t for i, t in got if i == 7) == sorted([a, b]) and len(got) in (3, 4)
    assert sorted("\n".join(t for i, t in got if i is None).split("\n")) == ["new", "own"]


def test_stages_bear_empty_tables_and_any_column_name(spark, prose, tmp_path):
    spark.createDataFrame([(1, prose(12))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, names = prose(60), ["doc_id", "text", "lang", "source", "n_chars", "a.b", "_gone", "_row", "c1", "_metadata"]
    rows = [(1, a, "x", None, 9, 1, 2, 3, 4, 5), (2, f"{a}\nmore", "x", None, 9, 1, 2, 3, 4, 5), (3, None, "x", None, 9, 1, 2, 3, 4, 5), (4, "", None, None, 9, 1, 2, 3, 4, 5)]
    table = spark.createDataFrame(rows, "a bigint, b string, c string, d string, e bigint, f int, g int, h int, i int, j int").toDF(*names)
    kept = {"known_language": {1, 2}, "without_repeated_lines": {1, 2, 3, 4}, "one_of_each_group": {1, 3, 4}, "without_benchmark": {1, 2, 3, 4}}
    for read in (table, common.materialize(table)):
        for name, ids in kept.items():
            out = getattr(stages, name)(spark, read, str(tmp_path))
            assert out.columns == names and {r[0] for r in out.collect()} == ids, name
            assert all(r[5:] == (1, 2, 3, 4, 5) for r in out.collect())
            assert getattr(stages, name)(spark, read.limit(0), str(tmp_path)).count() == 0
    assert stages.tokens(spark, table.limit(0), "").count() == 0


def test_scores_of_odd_rows(spark, prose):
    rng = random.Random(8)
    clean = [prose(40) for _ in range(60)]
    texts = dict(enumerate(clean + [f"{c} vileword nastyish" for c in clean[:30]]))
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in texts] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(spark, texts), labels)
    odd = {0: None, 1: "", 2: "123", 3: "vileword " * 20_000, 4: "vileword", 5: "vileword", None: clean[0]}
    got = {r.doc_id: r for r in toxicity.score(docs(spark, odd).withColumn("spans", F.lit(1)), model).collect()}
    assert got[0].score == got[1].score == got[2].score and got[4].score == got[5].score and len(got) == 7
    assert got[3].spans.count(":") == 20_000 and got[4].spans == "0:8" and got[None].score < 0.3 < got[3].score
    langs = docs(spark, {i: "".join(rng.choice("aeiou" if i % 2 else "bcdfg") for _ in range(200)) for i in range(20)}).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "v").otherwise("c"))
    odd = {0: None, 1: "", 2: "12 !", 3: "aeiou" * 30_000, 4: "bcd", 5: "bcd", None: "aei"}
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predict(docs(spark, odd).withColumn("lang_pred", F.lit(1)), language.fit(langs)).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "v" and got[4] == got[5] and got[4][0] == "c" and got[None][0] == "v"
    same = language.fit(langs.withColumn("lang", F.lit("b")).unionByName(langs.withColumn("lang", F.lit("a"))))
    assert {r.lang_pred for r in language.predict(docs(spark, ["aei", "bcd"]), same).collect()} == {"a"}  # equal cosines


def test_lines_and_groups_of_odd_rows(spark, prose):
    line, long = prose(9), "\n".join(prose(8) for _ in range(3000))
    table = spark.createDataFrame([(1, None), (2, ""), (3, f"{line}\n{line}"), (None, line), (4, long), (5, long), (5, long)], "doc_id bigint, text string").withColumn("at", F.lit(1)).withColumn("line", F.lit(2))
    got = sorted(linededup.line_report(table).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.n_lines, r.n_compared, r.n_dropped, r.dropped) for r in got[:3]] == [(1, 0, 0, ""), (1, 0, 0, ""), (2, 2, 1, "1")]
    assert got[3].n_compared == 3000 and got[4].n_dropped >= 3000 and got[5] == got[4] and got[6].n_compared == 0
    rows = {(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in neardup.near_duplicates(table).collect()}
    assert rows == {(1, False, 1, True), (2, False, 2, True), (3, True, 3, True), (None, True, None, True), (4, True, 4, True), (5, True, 4, False)}


def test_pipeline_decides_stage_by_stage(spark, prose, tmp_path):
    a, b, item = prose(80), prose(80), prose(12)
    texts = {1: a, 2: "\n".join(["new start of some length, to be kept as it is", a]), 3: b, 4: "123 456", 5: f"{prose(30)} {item} {prose(30)}", 6: prose(3), 7: " ".join([*b.split()[:40], "changed", *b.split()[41:]])}
    docs(spark, texts).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = []
    at = common.table(spark, str(tmp_path), "documents")
    for stage in (stages.known_language, stages.without_repeated_lines, stages.one_of_each_group, stages.without_benchmark):
        at = common.materialize(stage(spark, at, str(tmp_path)))
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in at.collect()})
    assert set(kept[0]) == {1, 2, 3, 5, 6, 7}  # no language is labelled, so letters decide
    labelled = common.table(spark, str(tmp_path), "documents").withColumn("lang", F.lit("en"))
    one = stages.known_language(spark, labelled, "")
    assert {r.doc_id for r in one.collect()} == {1, 2, 3, 5, 6, 7}
    two = stages.without_repeated_lines(spark, one, "")
    assert {r.doc_id: r.text for r in two.collect()}[2] == "new start of some length, to be kept as it is"
    three = stages.one_of_each_group(spark, two, "")
    assert {r.doc_id for r in three.collect()} == {1, 2, 3, 5, 6}
    four = stages.without_benchmark(spark, three, str(tmp_path))
    assert {r.doc_id for r in four.collect()} == {1, 2, 3, 6}
    assert all(r.round_trip for r in stages.tokens(spark, four, "").collect())
