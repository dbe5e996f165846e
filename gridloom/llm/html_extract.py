"""Main-text extraction by wrapper induction over pages of one host.

Pages become light DOM trees. For each host a bounded sample of pages (documented parameter)
is aligned by simple tree matching, which finds the largest order-preserving mapping of equal
elements between two trees: nodes whose text nearly all sampled pages share are template, nodes
whose text varies are slots, and the slot that holds most of the varying text is the content.
Pages that repeat nearly all of another sample's text are copies and teach nothing. The wrapper of a
host is compiled to its element paths, each with the digests of its constant texts, so any page
of the host is read in one walk: the content slot is taken where its path leads, template texts
are left out, whole, however long they are.

Varying text alone cannot tell an article from a menu or an advert whose words also vary, so
elements that HTML itself or their class or id names, whole, as page furniture are never
content, unless an element so named holds most of the page's text and is built like an article. A page without a wrapper, or
without its slot, is read by itself: ``article`` or ``main`` if that holds half of its text, or
else the deepest element that holds most of it.

Defined results: null or empty html gives an empty text; repeated pages are extracted as
often as they occur; a page whose url has no host, or whose host has too few different pages
to align, is extracted by itself; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|</?[a-zA-Z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_CLASS = re.compile(r"(?<![\w\-:.])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[_\-:]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold an article's text.
FURNITURE = frozenset(
    "head nav header footer aside form script style noscript template iframe object embed svg canvas button select option input textarea "
    "label dialog menu audio video map title".split()
)
#: Words that mark page furniture as a class, id or role, alone or with each other and QUALIFIERS.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu menubar nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "comment comments disqus replies reply respond share sharing social related recommended widget toolbar pagination pager skip search login".split()
)
QUALIFIERS = frozenset(
    "site top bottom left right main primary secondary global box block wrapper wrap container content list area section slot bar unit links link posts items "
    "item inner outer fixed sticky mobile desktop col column zone holder group panel message text form js the my".split()
)
CONTENT = ("article", "main")
#: Share of the samples that must agree, and of the text that an element must hold to be the content.
AGREE, MOST = 0.8, 0.7
#: Share of equal text from which a page is a copy of another one, and from which constant text is no template.
COPY = 0.9
#: What an opening tag closes implicitly, as far as no table or list stands between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body article main section div td th".split())


_named: dict[str, bool] = {}


def names_furniture(name: str) -> bool:
    """Whether a class, id or role is made of words for page furniture."""
    if name not in _named:
        if len(_named) > 100_000:
            _named.clear()
        parts = [w for w in _SPLIT.split(name) if w]
        _named[name] = any(w in CUES for w in parts) and all(w in CUES or w in QUALIFIERS or w.isdigit() for w in parts)
    return _named[name]


class Node:
    """An element: its children are nodes and strings, in page order."""

    __slots__ = ("tag", "names", "children")

    def __init__(self, tag: str, names: tuple[str, ...] = ()) -> None:
        self.tag, self.names = tag, names
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]

    def own_text(self) -> str:
        return _SPACE.sub(" ", " ".join(c for c in self.children if isinstance(c, str))).strip()

    def label(self) -> str:
        """What makes two elements comparable: the tag and its names, whatever their numbers."""
        return " ".join((self.tag, *(_DIGITS.sub("#", x) for x in self.names)))

    def by_tag(self) -> bool:
        return self.tag in FURNITURE

    def by_name(self) -> bool:
        return self.tag not in ("html", "body", "#root") and any(names_furniture(x) for x in self.names)


def _postorder(root: Node) -> list[Node]:
    """All elements, children before their parents."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += x.elements()
    return out[::-1]


def _like_an_article(x: Node) -> bool:
    """Whether it holds a headline, an article, or several paragraphs."""
    tags = Counter(c.tag for c in _postorder(x)[:-1])
    return tags["p"] > 1 or bool(tags["h1"] or tags["article"] or tags["main"])


class Page:
    """A tree with the amount of text of each element, furniture left out."""

    def __init__(self, root: Node, skip: dict[int, int] | None = None) -> None:
        """``skip`` has the characters of an element's own text that do not count."""
        self.root = root
        every: dict[int, int] = {}  # text outside elements that are furniture by tag
        for x in _postorder(root):
            own = sum(len(c) for c in x.children if isinstance(c, str) and not c.isspace())
            own -= (skip or {}).get(id(x), 0)
            every[id(x)] = 0 if x.by_tag() else own + sum(every[id(c)] for c in x.elements())
        half = every[id(root)] / 2
        self.furniture: set[int] = set()
        self.size: dict[int, int] = {}
        for x in _postorder(root):
            if x.by_tag() or (x.by_name() and not (every[id(x)] > half and _like_an_article(x))):
                self.furniture.add(id(x))
                self.size[id(x)] = 0
            else:
                own = every[id(x)] - sum(every[id(c)] for c in x.elements())
                self.size[id(x)] = own + sum(self.size[id(c)] for c in x.elements())

    def outermost(self, tag: str) -> list[Node]:
        """Elements of the tag in page order, outside page furniture and each other."""
        out, todo = [], [self.root]
        while todo:
            x = todo.pop()
            if x.tag == tag:
                out.append(x)
            elif id(x) not in self.furniture:
                todo += reversed(x.elements())
        return out

    def region(self) -> list[Node]:
        """The content of a page without a wrapper."""
        for tag in CONTENT:
            found = self.outermost(tag)
            if found and 2 * sum(self.size[id(x)] for x in found) >= self.size[id(self.root)]:
                return found
        return [deepest(self.root, self.size)]


def deepest(root: Node, size: dict[int, int]) -> Node:
    """The deepest element with blocks of its own that holds most of the text, below others that do."""
    node, whole = root, size[id(root)]
    while whole:
        below = [x for x in node.elements() if size.get(id(x), 0) >= MOST * whole and any(c.tag in BLOCKS for c in x.elements())]
        if not below:
            break
        node = below[0]
    return node


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed and stray tags never lose text."""
    root = Node("#root")
    stack = [root]
    at = 0
    raw_end: re.Pattern | None = None
    while at < len(page):
        if raw_end is not None:
            m = raw_end.search(page, at)
            stop = m.start() if m else len(page)
            if stop > at:
                stack[-1].children.append(page[at:stop])
            stack.pop()
            raw_end, at = None, m.end() if m else len(page)
            continue
        m = _TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            stack[-1].children.append(entities.unescape(token))
            continue
        if token[1] in "!?":
            continue
        named = _NAME.match(token)
        tag = named[1].lower()
        if token[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCKS:  # a block closes an open paragraph with all that is open inside
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in _CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE:
                    break
        node = Node(tag, tuple(x for g in _CLASS.findall(token) for y in g for x in y.lower().split()))
        stack[-1].children.append(node)
        if tag in VOID or token.endswith("/>"):
            continue
        stack.append(node)
        if tag in RAW:
            raw_end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|$)", re.I)
    return root


class Alignment:
    """Simple tree matching of trees whose elements are interned, so equal subtrees are equal numbers."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.whole: dict[int, int] = {}  # number of the subtree, by element
        self.text: dict[int, int] = {}
        self.kind: dict[int, int] = {}
        self.count: dict[int, int] = {}
        self.held: list[Node] = []  # keeps the elements alive, whose ids are keys here

    def _number(self, *key) -> int:
        return self.numbers.setdefault(key, len(self.numbers))

    def add(self, root: Node) -> None:
        for x in _postorder(root):
            below = x.elements()
            self.held.append(x)
            self.kind[id(x)], self.text[id(x)] = self._number("kind", x.label()), self._number("text", x.own_text())
            self.whole[id(x)] = self._number(self.kind[id(x)], self.text[id(x)], *(self.whole[id(c)] for c in below))
            self.count[id(x)] = 1 + sum(self.count[id(c)] for c in below)

    def match(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The pairs of a largest mapping that keeps order and ancestry; equal text counts half a node more."""
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 10_000 + 4 * min(len(_postorder(a)), len(_postorder(b)))))
        try:
            memo: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}
            out: list[tuple[Node, Node]] = []
            todo = [(a, b)] if self._weigh(a, b, memo) else []
            while todo:
                x, y = todo.pop()
                out.append((x, y))
                xs, ys = x.elements(), y.elements()
                if self.whole[id(x)] == self.whole[id(y)]:
                    todo += zip(xs, ys, strict=True)
                else:
                    todo += [(xs[i], ys[j]) for i, j in memo.get((id(x), id(y)), (0.0, []))[1]]
            return out
        finally:
            sys.setrecursionlimit(limit)

    def _weigh(self, x: Node, y: Node, memo: dict) -> float:
        if self.kind[id(x)] != self.kind[id(y)]:
            return 0.0
        if self.whole[id(x)] == self.whole[id(y)]:
            return 1.5 * self.count[id(x)]
        known = memo.get((id(x), id(y)))
        if known is not None:
            return known[0]
        own = 1.0 + 0.5 * (self.text[id(x)] == self.text[id(y)])
        xs, ys = x.elements(), y.elements()
        # Equal subtrees at both heads, or both tails, are mapped in some largest mapping.
        wx, wy = [self.whole[id(c)] for c in xs], [self.whole[id(c)] for c in ys]
        head, most = 0, min(len(xs), len(ys))
        while head < most and wx[head] == wy[head]:
            head += 1
        tail = 0
        while tail < most - head and wx[-1 - tail] == wy[-1 - tail]:
            tail += 1
        ends = [(i, i) for i in range(head)] + [(len(xs) - 1 - i, len(ys) - 1 - i) for i in range(tail)]
        total = own + sum([1.5 * self.count[id(xs[i])] for i, _ in ends])
        n, m = len(xs) - head - tail, len(ys) - head - tail
        pairs: list[tuple[int, int]] = []
        if n and m:
            inner_x, inner_y = xs[head : head + n], ys[head : head + m]
            kinds, texts = (np.array([of[id(c)] for c in inner_y]) for of in (self.kind, self.text))
            flat = np.array([not c.elements() for c in inner_y])
            best = np.zeros((n + 1, m + 1), dtype=np.float32)
            for i, c in enumerate(inner_x):
                same = kinds == self.kind[id(c)]
                gain = np.where(same, 1.0 + 0.5 * (texts == self.text[id(c)]), 0.0).astype(np.float32)
                if c.elements():
                    for j in np.flatnonzero(same & ~flat).tolist():
                        gain[j] = self._weigh(c, inner_y[j], memo)
                # The best that ends before each place: without this child, or with it there.
                np.maximum.accumulate(np.maximum(best[i, 1:], np.where(same, best[i, :-1] + gain, 0.0)), out=best[i + 1, 1:])
            total += float(best[-1, -1])
            i, j = n, m
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((head + i, head + j))
        memo[id(x), id(y)] = (total, ends + pairs)
        return total


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _different(pages: list[str], most: int) -> list[Node]:
    """Trees of up to ``most`` pages, none of which repeats nearly all text of another one, furniture aside."""
    found: list[tuple[Node, dict[str, int]]] = []
    for page in dict.fromkeys(p for p in pages if p):
        root = parse(page)
        whole, texts = Page(root), {}
        todo = [root]
        while todo:
            x = todo.pop()
            if id(x) not in whole.furniture:
                texts[x.own_text()] = len(x.own_text())
                todo += x.elements()
        size = sum(texts.values())
        if all(sum(n for t, n in texts.items() if t in known) < COPY * max(1, min(size, sum(known.values()))) for _, known in found):
            found.append((root, texts))
        if len(found) == most:
            break
    return [root for root, _ in found]


def induce(pages: list[str], most: int = 5) -> str | None:
    """The wrapper of one host as JSON, or None with fewer than three different pages.

    A wrapper is a tree of [digests of constant texts, whether it is the content, children by label].
    """
    trees = _different(pages, most)
    if len(trees) < 3:
        return None
    base, aligned = max(trees, key=lambda t: Page(t).size[id(t)]), Alignment()
    for tree in trees:
        aligned.add(tree)
    mapped = [(other, aligned.match(base, other)) for other in trees if other is not base]
    matched: Counter = Counter()
    equal: Counter = Counter()
    for _, pairs in mapped:
        for x, y in pairs:
            matched[id(x)] += 1
            equal[id(x)] += aligned.text[id(x)] == aligned.text[id(y)]
    need = math.ceil(AGREE * len(trees)) - 1  # besides the base itself
    constant = {id(x): len(x.own_text()) for x in _postorder(base) if equal[id(x)] >= need and x.own_text()}
    # Varying text below each element that enough samples have, all samples together.
    varying = Counter({k: n for k, n in Page(base, constant).size.items() if matched[k] >= need})
    for other, pairs in mapped:
        size = Page(other, {id(y): constant[id(x)] for x, y in pairs if id(x) in constant and aligned.text[id(x)] == aligned.text[id(y)]}).size
        for x, y in pairs:
            if matched[id(x)] >= need:
                varying[id(x)] += size[id(y)]
    content = deepest(base, varying)
    top: list = [[], 0, {}]
    todo = [(base, top)]
    while todo:
        x, place = todo.pop()
        if id(x) in constant:
            place[0].append(_digest(x.own_text()))
        if x is content and x.tag not in ("#root", "html", "body"):
            place[1] = 1
        todo += [(c, place[2].setdefault(c.label(), [[], 0, {}])) for c in x.elements()]
    return json.dumps(top)


def locate(root: Node, wrapper: list | None) -> tuple[list[Node], set[int]]:
    """The content slots of a page and its template elements, in one walk along the wrapper's paths."""
    slots: list[Node] = []
    template: set[int] = set()
    todo: list[tuple[Node, list, bool]] = [(root, wrapper, False)] if wrapper else []
    while todo:
        x, (texts, content, below), inside = todo.pop()
        if content and not inside:
            slots.append(x)
            inside = True
        if texts and _digest(x.own_text()) in texts:
            template.add(id(x))
        for c in reversed(x.elements()):
            place = below.get(c.label())
            if place:
                todo.append((c, place, inside))
    return slots, template


def extract(page: str, wrapper: list | None) -> str:
    """The main text: blocks in page order, joined by one newline."""
    return read(page, wrapper)[0]


def read(page: str, wrapper: list | None) -> tuple[str, str]:
    """The main text, and what decided its place: ``wrapper`` or ``page``; ``none`` without html."""
    if not page:
        return "", "none"
    root = parse(page)
    slots, template = locate(root, wrapper)
    whole = Page(root)
    regions = [x for x in slots if id(x) not in whole.furniture and whole.size[id(x)]]
    how = "wrapper" if regions else "page"
    regions = regions or whole.region()
    amount = sum(whole.size[id(x)] for x in regions)
    # A page that repeats nearly all of its text from others is a copy, not a template.
    if sum(len(c) for r in regions for x in _postorder(r) if id(x) in template for c in x.children if isinstance(c, str)) > COPY * amount:
        template = set()
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    for region in regions:
        # Without recursion, so that no page is too deep.
        todo: list[Node | str | None] = [region]
        while todo:
            x = todo.pop()
            if x is None:
                close()
                continue
            if isinstance(x, str):
                line.append(x)
                continue
            # The header of an article is its own; an article inside another one is a reader's comment.
            kept_header = x.tag == "header" and region.tag not in ("#root", "html", "body")
            aside = (id(x) in whole.furniture and not kept_header) or (x.tag == "article" and 2 * whole.size[id(x)] < amount and region.tag == "article")
            block = x.tag in BLOCKS
            if x is not region and aside:
                if block:
                    close()
                continue
            if block:
                close()
                todo.append(None)
            elif x.tag == "br":
                line.append(" ")
            gone = id(x) in template
            todo += [c for c in reversed(x.children) if not (gone and isinstance(c, str))]
        close()
    return "\n".join(blocks), how


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loaded: dict[str, list] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            texts = []
            for page, wrapper in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                if wrapper and wrapper not in loaded:
                    if len(loaded) >= 200:
                        loaded.clear()
                    loaded[wrapper] = json.loads(wrapper)
                texts.append(extract(page.as_py() or "", loaded[wrapper] if wrapper else None))
            yield pa.RecordBatch.from_pydict(
                {"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )


def _induce_host(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [induce(pdf.sort_values("row")["html"].tolist(), most)]})

    return run


def extract_pages(
    pages: DataFrame, samples: int = 8, aligned: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Of each host ``samples`` pages are chosen by hashes of id and html, and up to ``aligned``
    different ones of them are matched: enough to tell constant nodes from varying ones. The
    choice is a partial aggregate, so a hot host, or a page repeated often, costs no more.
    """
    stage = Stage(pages.sparkSession, "wrappers")
    host = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][\w+.\-]*://([^/?#]+)", 1)
    page_id = F.col(id_col).cast("long")
    p = pages.select(
        page_id.alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.lower(host).alias("host"), F.xxhash64(F.col(html_col), page_id).alias("row")
    )
    some = p.where("host <> '' and html is not null")
    drawn = some.groupBy("host").agg(*[F.min_by("row", F.xxhash64("row", F.lit(k))).alias(f"s{k}") for k in range(samples)])
    chosen = stage.table(drawn.select(F.col("host").alias("of"), F.explode(F.array_distinct(F.array(*[F.col(f"s{k}") for k in range(samples)]))).alias("id")))
    sampled = some.select("row", "html", "host").join(chosen, (F.col("row") == F.col("id")) & (F.col("host") == F.col("of")))
    once = sampled.groupBy("host", "row").agg(F.first("html").alias("html"))
    wrappers = stage.table(once.groupBy("host").applyInPandas(_induce_host(aligned), "host string, wrapper string").where("wrapper is not null"))
    joined = p.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_extract_rows, "page_id long, url string, text string, n_chars long")
