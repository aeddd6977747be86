"""Labelled pages that the HTML extraction is trained on: made from a seed, in the common layouts of the web."""

from __future__ import annotations

import random

#: Containers of an article, and of what surrounds one, as (tag, class) pairs that are usual on the web.
CONTENT = [("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("div", "article-body"), ("section", "main-text"), ("div", "story"), ("article", "post"), ("main", "page"), ("div", ""), ("section", ""), ("td", ""), ("div", "article"), ("div", "blog-article")]
TOP = [("nav", ""), ("nav", "menu"), ("header", ""), ("header", "site-header"), ("div", "nav"), ("div", "breadcrumb"), ("ul", "menu"), ("div", "topbar"), ("div", "cookie-notice"), ("div", "notice"), ("div", "banner"), ("div", "ad"), ("div", "advert"), ("form", "search"), ("div", "popup"), ("div", "consent"), ("div", "cookie-bar"), ("div", "cookies"), ("section", "cookie"), ("div", "gdpr"), ("div", "privacy-banner"), ("div", "alert"), ("div", "navbar"), ("div", "masthead"), ("nav", "breadcrumbs"), ("ul", "nav"), ("div", "navigation")]
SIDE = [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "ad"), ("div", "ads"), ("div", "promo"), ("div", "sponsored"), ("form", "newsletter"), ("form", ""), ("div", "subscribe"), ("div", "share"), ("div", "social")]
BOTTOM = [("footer", ""), ("footer", "footer"), ("div", "footer"), ("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment-list"), ("div", "related"), ("form", "comment-form"), ("div", "copyright"), ("div", "pagination"), ("div", "disqus"), ("section", "discussion"), ("section", "responses"), ("div", "replies"), ("div", "site-info")]


#: What is added to names to say where or how a thing stands; it tells nothing of what it is.
PLACES = "left right top bottom main wrap wrapper box area list links buttons block inner outer section one two".split()


def pages(n: int, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Each page as (html, is it content?) parts in order."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(lo, hi)))

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(3, 7))) + "</ul>"

    def placed(name: str) -> str:
        return f"{name}-{rng.choice(PLACES)}" if name and rng.random() < 0.3 else name

    def boiler(where) -> str:
        tag, name = rng.choice(where)
        name = placed(name)
        if rng.random() < 0.15:  # a notice of a name that no other page has
            return f'<div class="{words(1, 1)}"><p>{words(4, 25)}</p><button>{words(1, 2)}</button></div>'
        inner = rng.choice([links(), f"<p>{words(6, 40)}</p>", words(3, 15), f'<label>{words(1, 2)}</label><input type="text"><button>{words(1, 2)}</button>', f"<div><p>{words(5, 30)}</p><p>{words(5, 30)}</p></div>"])
        if "comment" in name and rng.random() < 0.5:
            inner = "".join(f'<article class="comment"><p>{words(5, 40)}</p></article>' for _ in range(rng.randint(1, 4)))
        return f"<{tag}{f' class="{name}"' if name else ''}>{inner}</{tag}>"

    def block() -> str:
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", f'<p>{words(2, 20)} <a href="/x">{words(1, 5)}</a> {{}}</p>', f'<p><a href="/y">{words(1, 5)}</a> {{}}</p>', "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"]).format(words(4, 60))

    out = []
    for _ in range(n):
        tag, name = rng.choice(CONTENT)
        name = placed(name)
        parts = [("<html><body>", False), *((boiler(TOP), False) for _ in range(rng.randint(1, 4)))]
        if rng.random() < 0.3:
            parts += [(boiler(SIDE), False)]
        parts += [(f"<{tag}{f' class="{name}"' if name else ''}>", True)]
        title = f"<h1>{words(3, 9)}</h1>"
        parts.append((f"<header>{title}<p>{words(2, 12)}</p></header>" if tag == "article" and rng.random() < 0.5 else title, True))
        for _ in range(rng.randint(2, 8)):
            parts.append((block(), True))
            if rng.random() < 0.1:
                parts.append((boiler(SIDE), False))
        parts.append((f"</{tag}>", True))
        parts += [(boiler(SIDE if rng.random() < 0.4 else BOTTOM), False) for _ in range(rng.randint(1, 3))]
        parts += [("<footer>" + words(3, 12) + "</footer></body></html>", False)]
        out.append(parts)
    return out
