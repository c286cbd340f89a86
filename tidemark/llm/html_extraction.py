"""Main text of web pages: boosted trees over DOM-node features, decoded as a hierarchy.

A page becomes a tree of block elements (and of inline elements that carry a
class, an id or a role). Each node has features: its subtree's text and link
density, attribute tokens of its own and of what it stands in, depth, and how
it compares with its siblings. The trees' scores are decoded together: a node
that goes takes its whole subtree along, so the choice that maximises the
summed log-likelihood under this rule is found from the leaves up, and no node
stays inside one that goes. ``html`` and ``body`` are the page itself, whatever
their classes, and always stay.

No page comes with its answer, so the trees are fitted on ``TRAINING_PAGES``
made-up pages from a fixed seed, whose nodes are known (module html_training).
They are made and fitted on executors; the driver gets the trees alone.

Defined results: a null, empty or text-free page gives an empty text, an empty
table no rows; rows that repeat, with the same or a null id, are read each for
itself; only the id, ``keep`` and the markup are read, so that further columns
may have any name. Broken markup is read as far as it goes: unclosed elements
end with their parent, an unclosed head with the first thing that can't stand
in it, and elements whose content isn't text count only if they are closed.
Pages are read whole, without recursion, in time proportional to their length,
however deep, long or broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8

# Elements without content, whose content isn't text of the page, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("head noscript template svg canvas select option datalist button object audio video annotation".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "script style textarea title iframe noscript template svg canvas select option optgroup datalist button object audio video input output progress meter map area link meta picture source track embed "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mspace mtable mtr mtd semantics annotation".split()
)
#: What may stand in a head.
OF_HEAD = frozenset("base link meta title noscript style script template basefont bgsound noframes".split())
#: What an opening tag closes, up to the element that holds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "a": ({"a"}, {"table"}), "button": ({"button"}, set())}
#: Elements that other elements than these end, if they were left open.
ONLY = {"select": frozenset("option optgroup hr script template".split()), "option": frozenset()}
#: Groups of tags; each is a feature of a node, and of what it stands in.
TAGS = ["article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table tbody tr td th thead", "blockquote pre figure figcaption", "address dialog details summary", "span a em b i small time label"]
GROUP = {t: i for i, group in enumerate(TAGS) for t in group.split()}
#: Groups of attribute tokens, likewise.
TOKENS = [
    "article articlebody content main story post entry text body maincontent prose",
    "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pagination pager toolbar",
    "header masthead banner top logo branding",
    "footer foot bottom copyright legal colophon",
    "sidebar aside side rail secondary widget related recommended recommendations popular trending tags",
    "ad ads advert advertisement adverts sponsor sponsored promo promotion adslot dfp",
    "comment comments commentlist reply replies discussion disqus respond thread",
    "cookie cookies notice consent gdpr alert popup modal overlay warning message",
    "form login signup signin subscribe subscription newsletter search share sharing social contact",
    "hidden none meta byline author date tools print skip",
]
TOKEN = {t: i for i, group in enumerate(TOKENS) for t in group.split()}
#: All groups but the first.
PLAIN_JUNK = (1 << len(TOKENS)) - 2
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
BARE_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
CLOSED = re.compile(rf"</({'|'.join(sorted(SKIPPED))})(?=[\s/>])", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Log-odds against dropping a node from one that stays.
CUT = 1.0


class Page:
    """Nodes in page order; node 0 is the page itself and always stays."""

    def __init__(self, html: str):
        self.parent, self.depth, self.group, self.tokens = [0], [0], [-1], [0]
        self.attrs = [""]
        self.own, self.link, self.stops, self.tags = [0], [0], [0], [0]
        #: (block number, node, text) of each piece of text.
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self._read(html)

    def _node(self, parent: int, tag: str, attrs: str) -> int:
        bits = 0
        for name, a, b, c in ATTRIBUTE.findall(attrs) if attrs else ():
            value = a or b or c
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                bits |= 1 << 9
            elif name in ("class", "id", "role"):
                for w in WORD.findall(value):
                    if (k := TOKEN.get(w.lower())) is not None:
                        bits |= 1 << k
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.group.append(GROUP.get(tag, -1))
        self.tokens.append(bits)
        self.attrs.append(attrs)
        for column in (self.own, self.link, self.stops, self.tags):
            column.append(0)
        return len(self.parent) - 1

    def _text(self, raw: str) -> None:
        if self.where.get("head") and not raw.isspace():
            self._pop(self.where["head"][-1])
        if self.skip:
            return
        text, node = unescape(raw) if "&" in raw else raw, self.stack[-1][1]
        self.pieces.append((self.block, node, text))
        n = len(text.strip())
        if n:
            self.own[node] += n
            self.link[node] += n * (self.links > 0)
            self.stops[node] += sum(map(text.count, ".,;:?!"))

    def _push(self, tag: str, node: int, skipped: bool) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node, skipped))
        self.skip += skipped
        self.links += tag == "a"

    def _pop(self, at: int) -> None:
        """Ends the open elements from ``at`` on."""
        while len(self.stack) > at:
            tag, _, skipped = self.stack.pop()
            self.where[tag].pop()
            self.skip -= skipped
            self.links -= tag == "a"
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def _innermost(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def _read(self, html: str) -> None:
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements with their nodes, and whether their content is left out
        self.where: dict[str, list[int]] = {}  # by tag: the places of open elements in the stack
        self.blocks = [0]  # the places of those that aren't inline
        self.skip = self.links = at = text_from = 0
        closed = {m[1].lower(): m.start() for m in CLOSED.finditer(html)}  # the last end of each
        end, last, quotes, cdata = len(html), html.rfind(">"), True, True
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if start > last and not html.startswith("<!--", start):
                break
            follows = html[at : at + 1]
            if follows in "!?":
                stop, inside = -1, ""
                if html.startswith("<!--", start):
                    stop = html.find("-->", start + 4)
                    stop = end if stop < 0 else stop + 3
                elif cdata and html.startswith("<![CDATA[", start):
                    stop = html.find("]]>", start)
                    cdata = stop >= 0
                    inside, stop = (html[start + 9 : stop], stop + 3) if cdata else ("", -1)
                if stop < 0:
                    stop = html.find(">", at) + 1
                if start > text_from:
                    self._text(html[text_from:start])
                if inside:
                    self._text(inside.replace("&", "&amp;"))
                at = text_from = stop
                continue
            if not (follows == "/" or follows.isascii() and follows.isalpha()):
                continue
            m = TAG.match(html, at) if quotes else None
            if m is None:
                m = BARE_TAG.match(html, at)
                quotes = quotes and m is None  # a quote without an end: tags end at > from here on
            if m is None:
                continue
            if start > text_from:
                self._text(html[text_from:start])
            at = text_from = m.end()
            tag, attrs = m[2].lower(), m[3]
            if m[1]:
                self._end_tag(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = html.find(">", close.start()) + 1 if close else end
                text_from = at = at or end
            else:
                self._start_tag(tag, attrs, closed.get(tag, -1) > at)
        if text_from < end:
            self._text(html[text_from:])
        del self.stack, self.where, self.blocks

    def _end_tag(self, tag: str) -> None:
        places = self.where.get(tag)
        if places and (tag not in INLINE or places[-1] > self.blocks[-1] or self.stack[places[-1]][2]):
            self._pop(places[-1])
        if tag not in INLINE and not self.skip:
            self.block += 1

    def _start_tag(self, tag: str, attrs: str, is_closed: bool) -> None:
        if self.where.get("head") and tag not in OF_HEAD:
            self._pop(self.where["head"][-1])
        for t, allowed in ONLY.items():
            if self.where.get(t) and tag not in allowed and not (t == "option" and tag in ONLY["select"]):
                self._pop(self.where[t][-1])
        if tag in ("html", "body"):  # the page itself
            self.block += 1
            return
        if self.skip:
            if tag not in VOID and not attrs.endswith("/"):
                self._push(tag, self.stack[-1][1], False)
            return
        if tag not in INLINE:
            self.block += 1
            if self.stack[self.blocks[-1]][0] == "p":
                self._pop(self.blocks[-1])
        if tag in CLOSES:
            ends, holders = CLOSES[tag]
            if (place := self._innermost(ends)) > self._innermost(holders) and (tag not in INLINE or place > self.blocks[-1]):
                if tag == "tr":  # the row, not only its cell
                    place = self.where["tr"][-1] if self.where.get("tr") and self.where["tr"][-1] > self._innermost(holders) else place
                self._pop(place)
        node = self.stack[-1][1]
        self.tags[node] += 1
        if tag in VOID:
            if tag == "br":
                self.pieces.append((self.block, node, " "))
            return
        if attrs.endswith("/") and self.where.get("math"):
            return
        skipped = tag == "head" or tag in SKIPPED and is_closed
        if not skipped and tag not in SKIPPED and (tag not in INLINE or "class" in attrs or "id=" in attrs or "role" in attrs):
            node = self._node(node, tag, attrs)
        self._push(tag, node, skipped)

    def text(self, keep: np.ndarray) -> str:
        blocks: list[str] = []
        last, parts = -1, []
        for block, node, text in [*self.pieces, (-2, 0, "")]:
            if block != last:
                if line := " ".join("".join(parts).split()):
                    blocks.append(line)
                last, parts = block, []
            if block >= 0 and keep[node]:
                parts.append(text)
        return "\n".join(blocks)

    def features(self) -> np.ndarray:
        n = len(self.parent)
        own, links, stops, tags = (list(x) for x in (self.own, self.link, self.stops, self.tags))
        paragraphs = [int(g == GROUP["p"]) for g in self.group]
        children = [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            own[p] += own[i]
            links[p] += links[i]
            stops[p] += stops[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
            children[p] += 1
        inside, above, order, seen = [0] * n, [0] * n, [0] * n, [0] * n
        # text before a node; the largest kinds that its subtree holds; its neighbours
        starts, holds, last, previous, following = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        ahead = 0
        for i in range(n - 1, 0, -1):
            holds[i] |= self.group[i] == 0 or 2 * (self.group[i] == GROUP["h1"])
            holds[self.parent[i]] |= holds[i]
        for i in range(1, n):
            p = self.parent[i]
            starts[i] = ahead
            ahead += self.own[i]
            if last[p]:
                previous[i], following[last[p]] = last[p], i
            last[p] = i
            inside[i] = inside[p] | (1 << self.group[p] if self.group[p] >= 0 else 0)
            above[i] = above[p] | self.tokens[p]
            order[i] = seen[p]
            seen[p] += 1
        parent = np.array(self.parent)
        own, links, stops, tags, paragraphs, children, order = (np.array(x, float) for x in (own, links, stops, tags, paragraphs, children, order))
        total = max(1.0, own[0])
        siblings = children[parent]
        columns = [
            np.array(self.depth),
            np.log1p(own),
            links / np.maximum(1, own),
            stops / np.maximum(1, own),
            np.log1p(tags),
            np.log1p(own / (1 + tags)),
            own / total,
            own / np.maximum(1, own[parent]),
            np.log1p(np.array(self.own)),
            np.log1p(paragraphs),
            np.log1p(children),
            np.log1p(siblings),
            order / np.maximum(1, siblings),
            np.log1p(own[parent] / np.maximum(1, siblings)),
            links[parent] / np.maximum(1, own[parent]),
        ]
        group, tokens, inside, above = np.array(self.group), np.array(self.tokens), np.array(inside), np.array(above)
        before, after = np.array(previous), np.array(following)
        columns += [
            np.array(starts) / total,
            (np.array(starts) + own) / total,
            np.log1p(paragraphs[parent]),
            np.log1p(own[before]) * (before > 0),
            np.log1p(own[after]) * (after > 0),
            links[before] / np.maximum(1, own[before]) * (before > 0),
        ]
        columns += [(np.array(holds) >> k) & 1 for k in range(2)]
        columns += [(group[near] == k) & (near > 0) for near in (before, after) for k in (GROUP["p"], GROUP["h2"])]
        columns += [(tokens[near] & PLAIN_JUNK > 0) & (near > 0) for near in (before, after)]
        columns += [group == k for k in range(len(TAGS))]
        columns += [(inside >> k) & 1 for k in range(len(TAGS))]
        columns += [(tokens >> k) & 1 for k in range(len(TOKENS))]
        columns += [(above >> k) & 1 for k in range(len(TOKENS))]
        return np.stack(columns, axis=1).astype(np.float32)

    def decode(self, margin: np.ndarray, cut: float = 0.0) -> np.ndarray:
        """The most likely choice in which whatever stands in a node that goes, goes too; ``cut`` is the log-odds against a node that goes in one that stays."""
        n = len(self.parent)
        stay, go = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
        best, gone = stay.tolist(), go.tolist()
        chosen = [True] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chosen[i] = best[i] > gone[i] - cut
            best[p] += max(best[i], gone[i] - cut)
            gone[p] += gone[i]
        for i in range(1, n):
            chosen[i] = chosen[i] and chosen[self.parent[i]]
        return np.array(chosen)


def extract_text(pages: DataFrame, trees=None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, the columns of ``keep``, text, n_chars): one row per input row."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(trees or fitted(spark))
    names = ["page_id", *keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in batches:
            read = [Page(h.decode()) for h in utf8(b.column(b.num_columns - 1))]
            features = [p.features() for p in read]
            margin = trees.margin(np.vstack(features))
            cuts = np.cumsum([len(f) for f in features])[:-1]
            texts = [p.text(p.decode(m, CUT)) for p, m in zip(read, np.split(margin, cuts))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), *(F.col(c).cast("string").alias(c) for c in keep), F.col(html_col).cast("string").alias("html"))
    return arrow_map(slim, run, "page_id long, " + "".join(f"`{c}` string, " for c in keep) + "text string, n_chars long")


def fitted(spark):
    from .html_training import fit_on_executors

    return fit_on_executors(spark)


def op7_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
