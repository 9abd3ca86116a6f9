"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

A page is read into nodes in document order, so a subtree is a range of nodes and its figures are differences of
running sums over a whole batch of pages. The trees see, for every node, the density of its subtree (text, links,
tags, sentence marks), attribute tokens and tags on the path to it, depth and its place among its siblings.
Decoding labels a whole tree at once: a node is in, out or mixed; all below an ``in`` node is in, all below an ``out``
node is out, and only a mixed node may have children of either kind. The labelling with the largest likelihood wins,
so an ancestor and a descendant cannot contradict one another.

Training needs no labelled pages: on at most ``sample_pages`` pages that mark up their article, wherever in the table they are, the article is known.
Each is also rebuilt a few times with other markup around the same texts (menus, sidebars, notices, adverts, forms,
reader comments, plain containers) and with tables, lists, definitions, details, figures and code inside, which makes the labels of the rebuilt pages known as well.

Null and empty pages, and pages without an article, give the empty text. Character references are decoded, white space
within a block becomes one blank, blocks are joined by one blank. Broken markup never fails: open elements end where
their parent ends, stray end tags are skipped, the elements html and body are taken for granted. A head ends at its
end tag or at the first tag or text that cannot stand in one; a button, noscript, svg, select or datalist without an
end tag ends at the next block as well. Formulas and the fallback of objects are text. Repeated rows give repeated
result rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stayrate.llm import gbt

# HTML element kinds, and words in class, id and role by what they say about an element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head template noscript svg select button datalist dialog".split())
IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())
#: Hidden elements that the next block ends if they have no end tag of their own.
BROKEN_BY_BLOCKS = {name: re.compile(rf"<(/?){name}(?![^\s/>])", re.I) for name in ("noscript", "svg", "select", "button", "datalist")}
BLOCKS = frozenset("address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
                   "h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
                   "ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr object math semantics mrow mi mn mo ms "
                   "mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded "
                   "mphantom mmultiscripts annotation annotation-xml".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "td", "blockquote",
        "pre", "figure", "nav", "header", "footer", "aside", "form", "tr", "th", "dl", "dt", "dd", "details", "summary",
        "caption", "figcaption")
TOKENS = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored",
    "comment": "comment comments commentlist disqus discussion reply replies respond response responses feedback reader",
    "content": "article body content entry main post prose story text",
    "foot": "bottom colophon copyright foot footer legal",
    "form": "form input login newsletter register search signin signup subscribe subscription",
    "head": "brand head header hero logo masthead top topbar",
    "menu": "breadcrumb breadcrumbs links menu nav navbar navigation pager pagination toc toolbar",
    "notice": "alert consent cookie cookies gdpr message modal notice notification overlay popup privacy warning",
    "related": "more popular readmore recommended related suggested teaser trending",
    "share": "follow share sharing social",
    "side": "aside complementary rail side sidebar widget widgets",
}
GROUP = {token: i for i, words in enumerate(TOKENS.values()) for token in words.split()}
TAG = {tag: i for i, tag in enumerate(TAGS)}
NUMBERS = 15
WIDTH = NUMBERS + 2 * len(TAGS) + len(TOKENS)

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = re.compile(r"[.!?,;:]")


class Page:
    """Nodes of one page as parallel lists, and its pieces of text in order."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.depth, self.end, self.groups, self.path = [], [], [], [], [], []
        self.chars, self.link_chars, self.stops = [], [], []
        self.children, self.index = [], []
        self.pieces: list[tuple[int, str]] = []
        self._read(source or "")

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        groups = 0
        if attributes:
            for found in _NAMED.finditer(attributes):
                for word in _WORDS.findall(found.group(1) or found.group(2) or found.group(3) or ""):
                    place = GROUP.get(word.lower())
                    if place is not None:
                        groups |= 1 << place
        node = len(self.tag)
        code = TAG.get(tag, -1)
        self.tag.append(code)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(0)
        self.groups.append(groups)
        own = groups << len(TAGS) | (1 << code if code >= 0 else 0)
        self.path.append(own | (self.path[parent] if parent >= 0 else 0))
        self.chars.append(0)
        self.link_chars.append(0)
        self.stops.append(0)
        self.children.append(0)
        self.index.append(self.children[parent] if parent >= 0 else 0)
        if parent >= 0:
            self.children[parent] += 1
        return node

    def _say(self, node: int, text: str, linked: bool) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((node, text))
        size = len(text) if not text.isspace() else 0
        if size:
            self.chars[node] += size
            self.total += size
            if linked:
                self.link_chars[node] += size
            self.stops[node] += len(_STOPS.findall(text))

    def _read(self, source: str) -> None:
        self.total, hidden, links, at = 0, 0, 0, 0
        stack: list[tuple[str, int]] = [("", self._open("", "", -1))]
        broken: list[int] = []  # places in the stack of hidden elements without an end tag

        def leave() -> None:
            nonlocal hidden, links
            tag, node = stack.pop()
            if tag in HIDDEN:
                hidden -= 1
            elif tag == "a":
                links -= 1
            if node != stack[-1][1]:
                self.end[node] = len(self.tag)
            if tag not in INLINE:
                self.pieces.append((stack[-1][1], " "))

        def say(text: str) -> None:
            if stack[-1][0] == "head" and not text.isspace():
                leave()
            if not hidden:
                self._say(stack[-1][1], text, links > 0)

        match = _TOKEN.search(source)
        while match:
            if match.start() > at:
                say(source[at : match.start()])
            at = match.end()
            closing, name, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
            if name:
                name = name.lower()
                if not closing:
                    while broken and broken[-1] >= len(stack):
                        broken.pop()
                    if broken and name in BLOCKS:
                        while len(stack) > broken[0]:
                            leave()
                        broken.clear()
                    if stack[-1][0] == "head" and name not in IN_HEAD and name not in ("html", "head"):
                        leave()
                if name in ("html", "body"):
                    if not closing:
                        self._implied(name, stack, leave)
                elif closing:
                    if any(name == tag for tag, _ in stack):
                        while stack[-1][0] != name:
                            leave()
                        leave()
                elif name == "head" and (len(stack) > 1 or self.total) or name == "svg" and attributes.endswith("/"):
                    pass
                elif name in RAW:
                    stop = re.compile(f"</{name}[^>]*>", re.I).search(source, at)
                    at = stop.end() if stop else len(source)
                elif name in VOID:
                    if name in ("br", "hr"):
                        self.pieces.append((stack[-1][1], " "))
                else:
                    self._implied(name, stack, leave)
                    inline, parent = name in INLINE, stack[-1][1]
                    if not inline:
                        self.pieces.append((parent, " "))
                    plain = inline and (name == "a" or not attributes)
                    stack.append((name, parent if plain else self._open(name, attributes, parent)))
                    hidden += name in HIDDEN
                    if name in BROKEN_BY_BLOCKS:
                        following = BROKEN_BY_BLOCKS[name].search(source, at)
                        if not following or not following.group(1):
                            broken.append(len(stack) - 1)
                    links += name == "a"
            match = _TOKEN.search(source, at)
        if at < len(source):
            say(source[at:])
        while len(stack) > 1:
            leave()
        self.end[0] = len(self.tag)

    @staticmethod
    def _implied(name: str, stack: list[tuple[str, int]], leave) -> None:
        """End what a start tag ends: a paragraph before a block, an item before the next one."""
        ends = CLOSES.get(name, ())
        wanted = {"p"} | set(ends) if name not in INLINE else set()
        if not wanted:
            return
        for back in range(len(stack) - 1, 0, -1):
            tag = stack[back][0]
            if tag in wanted:
                while len(stack) > back:
                    leave()
            elif tag not in INLINE:
                return


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages; see WIDTH."""
    n = [len(p.tag) for p in pages]
    first = np.repeat(np.cumsum([0, *n[:-1]]), n)
    get = lambda name: np.fromiter((v for p in pages for v in getattr(p, name)), dtype=np.int64, count=sum(n))
    tag, parent, depth = get("tag"), get("parent"), get("depth")
    chars, linked, stops, index, children = (get(k) for k in ("chars", "link_chars", "stops", "index", "children"))
    path, rows = get("path"), np.arange(sum(n))
    end, up = get("end") + first, np.maximum(parent, 0) + first
    below = lambda v: (s := np.concatenate(([0], np.cumsum(v))))[end] - s[rows]
    size, links, marks, inner = below(chars), below(linked), below(stops), end - rows
    whole = np.maximum(np.repeat([p.total for p in pages], n), 1)
    share = links / np.maximum(size, 1)
    siblings = np.maximum(children[up], 1)
    # text of the paragraphs and headings that stand directly in a node: what kind of company its other children are
    prose = np.isin(tag, [TAG[t] for t in ("p", "h1", "h2", "h3")]) & (rows != first)
    company = np.bincount(up, weights=np.where(prose, size, 0), minlength=len(rows))
    over = up[up]
    out = np.zeros((len(rows), WIDTH))
    out[:, :NUMBERS] = np.stack([
        np.log1p(size), share, np.log1p(inner), np.log1p(size / inner), depth, marks / np.maximum(size, 1),
        chars / np.maximum(size, 1), size / whole, index / siblings,
        np.log1p(siblings), share[up], np.log1p(size[up] / inner[up]), np.log1p(company[up]),
        company[up] / np.maximum(size[up], 1), company[over] / np.maximum(size[over], 1)], axis=1)
    known = tag >= 0
    out[rows[known], NUMBERS + tag[known]] = 1
    for bit in range(len(TAGS) + len(TOKENS)):
        out[:, NUMBERS + len(TAGS) + bit] = path >> bit & 1
    return out


#: Price, in log-likelihood, of a node with children of either kind.
MIXED = 3.0


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """Whether the own text of each node is in, for the most likely consistent labelling of the tree.

    A node weighs as much as the logarithm of its own text; a node without text of its own only weighs a little.
    """
    n = len(page.tag)
    weight = 0.1 + np.log1p(np.array(page.chars))
    yes = (-np.logaddexp(0.0, -margin) * weight).tolist()
    no = (-np.logaddexp(0.0, margin) * weight).tolist()
    parent, inside, outside, apart = page.parent, yes[:], no[:], [0.0] * n
    for i in range(n - 1, 0, -1):
        up = parent[i]
        inside[up] += inside[i]
        outside[up] += outside[i]
        apart[up] += max(inside[i], outside[i], apart[i] + max(yes[i], no[i]) - MIXED)
    state, text_in = [0] * n, np.zeros(n, dtype=bool)
    for i in range(n):
        above = state[parent[i]] if i else 0
        if above:
            state[i] = above
        else:
            mixed = apart[i] + max(yes[i], no[i]) - MIXED
            best = max(inside[i], outside[i], mixed)
            state[i] = -1 if best == outside[i] else 1 if best == inside[i] else 0
        text_in[i] = state[i] == 1 or state[i] == 0 and yes[i] > no[i]
    return text_in


def text_of(page: Page, text_in: np.ndarray) -> str:
    return " ".join("".join([text if text_in[node] or text == " " else "" for node, text in page.pieces]).split())


# ------------------------------------------------------------------------------ training
def _article(page: Page) -> int:
    """The node that marks the article: the largest article element, or else the largest main; -1 without one."""
    for tag in ("article", "main"):
        found = [i for i, code in enumerate(page.tag) if code == TAG[tag]]
        if found:
            total = np.concatenate(([0], np.cumsum(page.chars)))
            return max(found, key=lambda i: total[page.end[i]] - total[i])
    return -1


MARKED = r"(?i)<(?:article|main)[\s/>]"
_SAYS_OUT = sum(1 << i for i, name in enumerate(TOKENS) if name != "content")
_TAGS_OUT = sum(1 << TAG[t] for t in ("nav", "header", "footer", "aside", "form"))


def labels(page: Page) -> tuple[list[int], list[int]]:
    """Nodes that can be told, and whether they are in; nodes around the article are neither."""
    top, nodes, found = _article(page), [], []
    if top < 0:
        return nodes, found
    above, up = set(), page.parent[top]
    while up >= 0:
        above.add(up)
        up = page.parent[up]
    for i in range(len(page.tag)):
        if i in above:
            continue
        within = top <= i < page.end[top]
        own = page.path[i] & ~page.path[top] if i != top else 0
        out = own & (_TAGS_OUT | _SAYS_OUT << len(TAGS))
        nodes.append(i)
        found.append(int(within and not out))
    return nodes, found


def _texts(page: Page, node: int) -> list[str]:
    """Texts of the blocks below a node."""
    joined = "".join("\n" if t == " " else t for i, t in page.pieces if node <= i < page.end[node])
    return [" ".join(block.split()) for block in joined.split("\n") if block.strip()]


def _name(rng: random.Random, group: str) -> str:
    words = rng.choice(TOKENS[group].split())
    return f'{rng.choice(("class", "id", "class"))}="{rng.choice(("", "page-", "site-", "c-"))}{words}"'


def figured(kind: str, words, rng: random.Random) -> str:
    """A block of an article that is no paragraph, of texts that ``words(most)`` makes up."""
    some = lambda low, high, make: "".join(make() for _ in range(rng.randint(low, high)))
    cell = lambda tag, most: f"<{tag}>{words(most)}</{tag}>"
    most = rng.choice((2, 6, 20))
    if kind == "table":
        width, head = rng.randint(2, 4), rng.random()
        row = lambda tag: f"<tr>{''.join(cell(tag, most) for _ in range(width))}</tr>"
        rows = (row("th") if head < 0.6 else "") + some(1, 7, lambda: row("td"))
        body = f"<thead>{row('th')}</thead><tbody>{rows}</tbody>" if head < 0.2 else rows
        return f"<table>{cell('caption', 6) if rng.random() < 0.3 else ''}{body}</table>"
    if kind in ("ul", "ol"):
        return f"<{kind}>{some(2, 8, lambda: cell('li', most))}</{kind}>"
    if kind == "dl":
        return f"<dl>{some(1, 5, lambda: cell('dt', 3) + cell('dd', 20))}</dl>"
    if kind == "details":
        return f"<details>{cell('summary', 5)}{some(1, 3, lambda: cell('p', 40))}</details>"
    if kind == "figure":
        return f'<figure><img src="x.png" alt="">{cell("figcaption", 12)}</figure>'
    return f"<pre>{'<code>' * (rng.random() < 0.5)}{some(1, 6, lambda: words(6) + chr(10))}</pre>"


FIGURED = ("table", "table", "ul", "ul", "ol", "dl", "details", "figure", "pre")


def rebuilt(blocks: list[str], others: list[str], rng: random.Random) -> tuple[str, str]:
    """A page with the given article and boilerplate made of other texts; the article marked by the tag ``article``.

    Returns the page to learn from (the article under other markup at random) and the one that tells the labels.
    """
    if rng.random() < 0.4:
        blocks = blocks[: rng.randint(1, 3)]
    elif rng.random() < 0.5:
        blocks = blocks[1:] or blocks
    short = lambda most: html.escape(" ".join(rng.choice(others).split()[: rng.randint(1, most)]))
    links = lambda k: "".join(f'<li><a href="/{i}">{short(3)}</a></li>' for i in range(rng.randint(2, k)))
    inner = lambda kind: {
        "menu": lambda: f"<ul>{links(10)}</ul>",
        "head": lambda: f'<a href="/">{short(3)}</a><p>{short(8)}</p>',
        "foot": lambda: f"<p>&copy; {short(5)}</p><ul>{links(4)}</ul>",
        "side": lambda: f"<h3>{short(3)}</h3><ul>{links(6)}</ul><p>{short(20)}</p>",
        "advert": lambda: f"{short(14)}", "notice": lambda: f"<p>{short(25)}</p><button>OK</button>",
        "form": lambda: f'<label>{short(3)}</label><input name="q"><p>{short(10)}</p><button>{short(2)}</button>',
        "related": lambda: f"<h3>{short(3)}</h3><ul>{links(6)}</ul>", "share": lambda: f"<ul>{links(4)}</ul>",
        "comment": lambda: "<h3>" + short(2) + "</h3>" + "".join(
            f"<div {_name(rng, 'comment')}><b>{short(2)}</b><p>{short(40)}</p></div>" for _ in range(rng.randint(1, 6))),
    }[kind]()
    element = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}

    def part(kind: str) -> str:
        tag = element.get(kind, "section") if rng.random() < 0.5 else "div"
        name = _name(rng, kind) if tag in ("div", "section") or rng.random() < 0.4 else ""
        return f"<{tag} {name}>{inner(kind)}</{tag}>"

    busy = rng.choice((0.0, 0.2, 0.5, 0.8))
    pick = lambda *kinds: "".join(part(k) for k in kinds if rng.random() < busy)
    before, after = pick("notice", "head", "menu", "advert"), pick("related", "side", "share", "form")
    late, body, plenty = pick("comment", "foot"), [], rng.choice((0.0, 0.1, 0.3))
    for i, block in enumerate(blocks):
        tag = "h1" if not i and len(block) < 200 else rng.choice(("p", "p", "p", "p", "div", "li", "blockquote", "h2"))
        body.append(f"<{tag}>{html.escape(block)}</{tag}>")
        if rng.random() < plenty:
            body.append(figured(rng.choice(FIGURED), short, rng))
        if rng.random() < 0.1 * busy:
            body.append(part(rng.choice(("advert", "related", "share", "notice", "form"))))
    if rng.random() < 0.5 * busy:
        body.append(part("comment"))
    marked, wrap = f"<article>{''.join(body)}</article>", rng.choice(("", "<div>", f"<div {_name(rng, 'content')}>"))
    deeper = rng.choice((0, 0, 1, 2))
    outer = "<div>" * deeper + f"{before}{wrap}{{}}{'</div>' if wrap else ''}{after}{late}" + "</div>" * deeper
    shown = rng.choice(("article", "main", "div", "section", f"div {_name(rng, 'content')}", f"section {_name(rng, 'content')}",
                        "article"))
    other = f"<{shown}>{''.join(body)}</{shown.split()[0]}>"
    return outer.replace("{}", other), outer.replace("{}", marked)


def train(pages: DataFrame, sample_pages: int = 250, variants: int = 4, html_col: str = "html") -> gbt.Boosted:
    """Fit on at most ``sample_pages`` pages, those with the smallest hash of their html, and their rebuilt variants.

    Only pages with an article or main tag are drawn. A table with pages but none of these is an error; one without
    any page gives a model that finds nothing.
    """
    sample = pages.where(F.col(html_col).rlike(MARKED)).select(F.xxhash64(html_col).alias("h")).distinct().orderBy(
        "h").limit(sample_pages)
    found = pages.withColumn("h", F.xxhash64(html_col)).join(F.broadcast(sample), "h").groupBy("h").agg(
        F.min(html_col).alias("html")).orderBy("h").collect()
    learned, x, y = [Page(r["html"]) for r in found], [], []
    tops = [_article(p) for p in learned]
    if max(tops, default=-1) < 0 and not pages.where(F.trim(html_col) != "").isEmpty():
        raise ValueError("no page to learn from: none of the pages drawn has an article or main element")
    texts = [_texts(p, top) if top >= 0 else [] for p, top in zip(learned, tops)]
    others = [t for blocks in texts for t in blocks[:20]] or ["text"]

    def learn(shown: Page, nodes: list[int], found: list[int]) -> None:
        if nodes:
            x.append(features([shown])[nodes])
            y.append(np.array(found, dtype=np.float64))

    for page, blocks in zip(learned, texts):
        learn(page, *labels(page))
        for i in range(variants if blocks else 0):
            shown, told = rebuilt(blocks, others, random.Random(crc32(f"{i}{blocks[0]}".encode())))
            learn(Page(shown), *labels(Page(told)))
    if not x:
        return gbt.fit(np.zeros((0, WIDTH)), np.zeros(0))
    return gbt.fit(np.concatenate(x), np.concatenate(y), trees=60, rate=0.3)


def extract_batch(sources: list[str | None], model: gbt.Boosted) -> list[str]:
    pages = [Page(source) for source in sources]
    margins, at, out = model.margin(features(pages)), 0, []
    for page in pages:
        n = len(page.tag)
        out.append(text_of(page, decode(page, margins[at : at + n])))
        at += n
    return out


def extracted(pages: DataFrame, model: gbt.Boosted, keep: tuple[str, ...] = ("page_id", "url"),
              html_col: str = "html") -> DataFrame:
    """``keep`` plus ``text`` (never null) and ``n_chars``."""
    kept = pages.select(*keep)
    n = len(kept.columns)
    schema = StructType([*kept.schema, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                texts = extract_batch(batch.column(n).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    schema.names)

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)
