"""Made-up pages whose nodes are known, to fit the trees of html_extraction.

Every page mixes an article with menus, headers, footers, sidebars, notices,
adverts, forms and reader comments. Their elements carry telling tags, telling
class names, both, or (rarely) neither, so that the trees learn to weigh text
and link density as well. What stays misleads, too: wrappers named after the
sidebar or the comments that a layout has, articles with a header, links or
tables of their own, pages laid out in tables. What a node is stands in the
attribute ``data-k``, which no feature looks at.

Pages are made, read and turned into features by many tasks, and the trees
fitted by one, which holds ``TRAINING_PAGES`` pages' nodes, some 10 MB whatever
the corpus holds; the driver gets the trees.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .boosting import BoostedTrees
from .common import arrow_map

#: Pages, their seed, and the pages made by one task.
TRAINING_PAGES, SEED, A_TASK = 1600, 7, 100
#: Names of wrappers say what a layout has, not what the wrapper is.
HAS = ["has", "with", "no", "is", "page", "site", "layout", "post", "content", "main", "wrap", "body", "single", "template"]
PARTS = ["sidebar", "comments", "nav", "menu", "header", "footer", "ads", "notice", "search", "widgets", "share", "popup", "banner", "aside", "related", "comments-open", "header-fixed", "sidebar-right", "nav-open", "footer-sticky"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.stop = 0.12
        self.tail = ""

    def words(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            out.append("".join(self.r.choice(["ta", "ri", "on", "el", "es", "mo", "ver", "in", "de", "lu"]) for _ in range(self.r.randint(1, 4))))
            if self.r.random() < self.stop:
                out[-1] += self.r.choice([",", ".", ".", ";", "?"])
            out[-1] += self.tail
        return " ".join(out).capitalize() + self.r.choice([".", ".", ""])

    def el(self, tag: str, k: int, inner: str, names: list[str] | None = None, how: float = 1.0) -> str:
        """An element of kind ``k`` (1 stays), with one of ``names`` as class or id by chance ``how``."""
        attr = ""
        if names and self.r.random() < how:
            name = self.r.choice(names)
            name += self.r.choice(["", "", "-wrap", "-box", " col-4", "_1"])
            attr = f' {self.r.choice(["class", "class", "id"])}="{name}"'
        elif k and tag in ("div", "section", "main", "article") and self.r.random() < 0.25:
            attr = f' {self.r.choice(["class", "class", "id"])}="{self.misleading()}"'
        elif self.r.random() < 0.2:
            attr = f' class="{self.r.choice(["row", "col", "container", "inner", "wrap", "c1", "block"])}"'
        return f'<{tag}{attr} data-k="{k}">{inner}</{tag}>'

    def misleading(self) -> str:
        r = self.r
        names = [f"{r.choice(HAS)}-{r.choice(PARTS)}" for _ in range(r.choice([1, 1, 2, 3]))]
        return " ".join(names + r.choice([[], ["post"], ["single"], ["wide"]]))

    def links(self, k: int, low: int, high: int) -> str:
        return "".join(self.el("li", k, f'<a href="/x">{self.words(1, 4)}</a>') for _ in range(self.r.randint(low, high)))

    def paragraphs(self, k: int, low: int, high: int, long: int = 60) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            text = self.words(1, long)
            if self.r.random() < 0.2:
                text += f' <a href="/y">{self.words(1, 3)}</a> ' + self.words(3, 20)
            if self.r.random() < 0.15:
                text = f"<b>{text}<br>"
            out.append(self.el("p", k, text))
        return "".join(out)

    def junk(self, kind: str = "") -> str:
        """One part that goes. A telling tag, or a div with a telling class; sometimes only its content tells."""
        r = self.r
        kind = kind or r.choice("nav nav header footer aside ad ad comments comments notice notice form social related".split())
        semantic = r.random() < 0.5
        tag = lambda t: t if semantic else r.choice(["div", "div", "section", "p" if kind == "ad" else "div"])
        how = 0.35 if semantic else 0.97
        if kind == "nav":
            return self.el(tag("nav"), 0, self.el(r.choice(["ul", "ol"]), 0, self.links(0, r.choice([1, 3]), 12)), ["nav", "menu", "navbar", "breadcrumb", "navigation"], how)
        if kind == "header":
            return self.el(tag("header"), 0, self.el(r.choice(["div", "p", "h2"]), 0, self.words(1, 8)) + self.el("p", 0, self.words(1, 10)), ["header", "masthead", "topbar", "banner", "logo"], how)
        if kind == "footer":
            inner = r.choice([lambda: f"&copy; {self.words(1, 10)} &middot; {self.words(1, 40)}", lambda: self.el("p", 0, f"&copy; {self.words(2, 30)}"), lambda: self.el("ul", 0, self.links(0, 2, 8)) + self.el("p", 0, self.words(3, 20))])()
            return self.el(tag("footer"), 0, inner, ["footer", "copyright", "legal", "bottom"], how)
        if kind in ("aside", "related"):
            inner = self.el("h3", 0, self.words(1, 4)) + r.choice([lambda: self.el("ul", 0, self.links(0, 2, 8)), lambda: self.paragraphs(0, 1, 3, 30)])()
            return self.el(tag("aside"), 0, inner, ["sidebar", "related", "widget", "popular", "aside", "recommended"], how)
        if kind == "ad":
            inner = r.choice([lambda: self.words(2, 25), lambda: self.el("p", 0, self.words(2, 25)), lambda: f'<a href="/ad">{self.words(2, 12)}</a>'])()
            return self.el(r.choice(["div", "div", "aside", "section", "ins"]), 0, inner, ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"], 0.97)
        if kind == "comments":
            one = lambda: self.el(r.choice(["div", "div", "li", "li", "li", "article"]), 0, self.el("p", 0, self.words(2, 4)) + self.paragraphs(0, 1, 3, 50), ["comment", "reply", "comment-body"], 0.8)
            inner = self.el("h2", 0, self.words(1, 3)) + "".join(one() for _ in range(r.randint(1, 8)))
            return self.el(r.choice(["section", "div", "div", "ol"]), 0, inner, ["comments", "comment-list", "commentlist", "discussion", "replies", "reader-comments"], 0.97)
        if kind == "notice":
            inner = r.choice([lambda: self.words(4, 40), lambda: self.el("p", 0, self.words(4, 40)) + "<button>Ok</button>"])()
            return self.el(r.choice(["div", "div", "section", "aside", "dialog", "p"]), 0, inner, ["cookie-notice", "notice", "consent", "gdpr", "alert", "cookie", "popup"], 0.97)
        if kind == "form":
            label = r.choice([lambda: f"<label>{self.words(1, 4)}</label>", lambda: self.el("p", 0, self.words(1, 4)), lambda: self.words(1, 6)])()
            inner = label + '<input type="text">' + r.choice([lambda: "", lambda: self.el("p", 0, self.words(1, 20))])() + "<button>Go</button>"
            tag = r.choice(["form", "form", "form", "div"])
            return self.el(tag, 0, inner, ["newsletter", "subscribe", "search", "login", "signup"], 0.35 if tag == "form" else 0.97)
        return self.el(r.choice(["div", "ul"]), 0, self.links(0, 2, 6), ["share", "social", "sharing"], 0.97)

    def article(self) -> str:
        r = self.r
        parts = [self.el(r.choice(["h1", "h1", "h2"]), 1, self.words(2, 12))] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts = [self.el("header", 1, parts[0] + (self.el("p", 1, self.words(3, 12)) if r.random() < 0.4 else ""), ["entry-header", "post-header", "article-header"], 0.4)]
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6])):
            parts.append(self.paragraphs(1, 1, 4, r.choice([3, 10, 25, 60, 150])))
            x = r.random()
            if x < 0.08:
                parts.append(self.el(r.choice(["ul", "ol"]), 1, "".join(self.el("li", 1, self.words(3, 20)) for _ in range(r.randint(2, 5)))))
            elif x < 0.14:
                parts.append(self.el("blockquote", 1, self.el("p", 1, self.words(4, 30))))
            elif x < 0.2:
                parts.append(self.el(r.choice(["h2", "h3"]), 1, self.words(1, 6)))
            elif x < 0.25:
                parts.append(self.el("table", 1, "".join(self.el("tr", 1, "".join(self.el("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(r.randint(1, 4)))))
            elif x < 0.28:
                parts.append(self.el("pre", 1, self.words(3, 20)))
            elif x < 0.31:
                parts.append(self.el("figure", 1, "<img src='x.png'>" + self.el("figcaption", 1, self.words(2, 10))))
            elif x < 0.34:
                parts.append(self.el("div", 1, self.paragraphs(1, 1, 3)))
            elif x < 0.40:
                parts.append(self.el(r.choice(["ul", "ol"]), 1, self.links(1, 1, 6)))
            elif x < 0.42:
                parts.append(self.el("dl", 1, "".join(self.el("dt", 1, self.words(1, 3)) + self.el("dd", 1, self.words(3, 20)) for _ in range(r.randint(1, 4)))))
            elif x < 0.44:
                parts.append(self.el("section", 1, self.el("h2", 1, self.words(1, 6)) + self.paragraphs(1, 1, 4)))
            elif x < 0.56:
                parts.append(self.junk())
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        return self.el(tag, 1, "".join(parts), ["article", "content", "post", "story", "main-content", "entry-content", "post-body"], 0.7 if tag in ("div", "section") else 0.3)

    def page(self) -> str:
        r = self.r
        self.stop, self.tail = r.choice([0.0, 0.05, 0.12, 0.12, 0.3]), r.choice(["", "", "", "", "", "!!", "%%%", " |"])
        if r.random() < 0.04:  # text with hardly any markup
            body = self.words(5, 200) + self.paragraphs(1, 0, 3)
        else:
            before = [self.junk() for _ in range(r.randint(0, 3))] + [self.junk(k) for k in ("header", "nav", "ad") if r.random() < 0.4]
            after = [self.junk() for _ in range(r.randint(0, 3))] + [self.junk(k) for k in ("comments", "footer") if r.random() < 0.5]
            r.shuffle(before)
            core = [] if r.random() < 0.05 else [self.article()]
            if core and r.random() < 0.2:
                core = [self.el("div", 1, core[0])]
            if core and r.random() < 0.06:  # laid out in a table
                cells = [self.el("td", 0, "".join(before))] * bool(before) + [self.el("td", 1, core[0] if r.random() < 0.5 else self.paragraphs(1, 1, 6))] + [self.el("td", 0, "".join(after))] * bool(after)
                before, after, core = [], [], [self.el("table", 1, self.el("tr", 1, "".join(cells)))]
            elif core and r.random() < 0.15:  # columns
                core = [self.el("div", 1, core[0] + "".join(after))]
                after = [self.junk("footer")]
            body = "".join([*before, *core, *after])
            for _ in range(r.randint(0, 2)):
                k = 1 if core else 0
                body = r.choice([lambda: self.el("div", k, body), lambda: self.el("main", k, body), lambda: self.el("div", k, body, ["page", "wrapper", "site", "container"])])()
        return f'<html data-k="1"><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body data-k="1">{body}</body></html>'


def nodes(maker: Maker, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of ``pages`` made-up pages, and whether they stay."""
    from .html_extraction import Page

    xs, ys = [], []
    for _ in range(pages):
        page = Page(maker.page())
        xs.append(page.features()[1:])
        ys += [float('data-k="1"' in a) for a in page.attrs[1:]]
    return np.vstack(xs), np.array(ys)


def fit(pages: int = TRAINING_PAGES, seed: int = SEED) -> BoostedTrees:
    """The trees of ``pages`` pages, made in parts as ``fit_on_executors`` does, with equal results."""
    parts = [nodes(Maker(seed + at), min(A_TASK, pages - at)) for at in range(0, pages, A_TASK)]
    return BoostedTrees().fit(np.vstack([x for x, _ in parts]), np.concatenate([y for _, y in parts]))


def fit_on_executors(spark: SparkSession, pages: int = TRAINING_PAGES, seed: int = SEED) -> BoostedTrees:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                x, y = nodes(Maker(seed + at), min(A_TASK, pages - at))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["at", "x", "y"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted((r["at"], r["x"], r["y"]) for b in batches for r in b.to_pylist())
        y = np.concatenate([np.frombuffer(p[2]) for p in parts])
        x = np.concatenate([np.frombuffer(p[1], np.float32) for p in parts]).reshape(len(y), -1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(BoostedTrees().fit(x, y))], pa.binary())], ["trees"])

    tasks = -(-pages // A_TASK)
    made = arrow_map(spark.range(0, pages, A_TASK, tasks), make, "at long, x binary, y binary")
    return pickle.loads(arrow_map(made.repartition(1), grow, "trees binary").first()["trees"])
