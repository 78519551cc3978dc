"""Main text of web pages by wrapper induction.

Pages of one host whose bodies are built from the same parts form a layout, and the page of a layout with the smallest hash is its
reference. Every other page's tree of blocks is aligned with the reference's by simple tree matching: the largest set of
node pairs that keeps tags, parents and the order of siblings. The reference's nodes, with what was aligned to them on
all pages, are the wrapper. A node whose text is the same as that of its partner counts for template, one that differs
is a slot, and a node without a partner belongs to the slot around it.

The content is the lowest element of the wrapper below which most of the varying text stands, links apart, with the
headings beside the way to it. An element marked as the article only says where that content ends. In it, elements that by their tag,
role or name are menus, adverts, forms and the like are left out, and so are blocks that most of the layout's pages
share. Where a layout has one page, or copies of one, nothing can be aligned, and marks and names alone tell.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table

# Elements by what they do, from the HTML standard, and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
DROPPED_TAGS = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select textarea input dialog menu noembed noframes audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion"
    " banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay paywall"
    " newsletter subscribe subscription signup login nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs"
    " sidebar sidebars sidebox aside widget widgets related recommended recommendations share sharing social"
    " comment comments commentlist disqus reply replies respond discussion responses footer footers header headers masthead topbar toolbar"
    " pagination pager search searchform searchbox skip skiplink copyright disclaimer form forms".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
P_SCOPE = frozenset("table td th caption button object template html".split())
# outside quotes a tag holds no "<", so that a stray one ends the attempt and no page takes quadratic time
TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^<>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Parts of names that tell where something stands or how it looks, not what it is.
PLAIN_PARTS = frozenset(
    "area article bar block body bottom box button buttons center col column container content desktop entry fixed global group inner item items"
    " js left link links list main mobile module outer page panel post posts primary right row secondary section site slot sticky text title top unit view wrap wrapper".split()
)
#: Elements that hold others, in which the search for the content goes on, and headings.
CONTAINERS = frozenset("# html body div main article section center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Parts of a body that don't tell layouts apart, as their number and kind are the text's own.
TEXTUAL = frozenset("p ul ol dl pre blockquote hr table figure address details".split()) | HEADINGS
#: A block is template if at least so many pages of its layout could tell, and this share of them has it.
LEAST_PAGES, SHARE = 8, 0.5
#: A page that agrees with the reference in more than this share of its text is a near copy, which tells text from template no better than a copy.
NEAR_COPY = 0.8
#: An element is where the search for the content goes on if this share of the varying text is below it.
MOST = 0.8
#: Cells of an alignment that are held at once; longer lists of siblings are aligned in halves, with the same result.
CELLS = 1 << 21


class Tree:
    """A page in document order: for each node its tag ("" for text), attributes, parent, text, and where its subtree ends."""

    __slots__ = ("tag", "attrs", "parent", "text", "end", "names")

    def __init__(self) -> None:
        self.tag, self.attrs, self.parent, self.text, self.end = ["#"], [""], [-1], [""], [0]
        self.names: dict[int, dict[str, str]] = {}

    def add(self, tag: str, parent: int, attrs: str = "", text: str = "") -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.text.append(text)
        self.end.append(0)
        return len(self.tag) - 1

    def named(self, i: int) -> dict[str, str]:
        if i not in self.names:
            a = self.attrs[i]
            self.names[i] = {k.lower(): _html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(a)} if a.strip() else {}
        return self.names[i]


def parse(source: str) -> Tree:
    """The tree of a page: void and raw elements, comments and implied ends as in HTML; stray ends are passed over.

    Open elements are counted by tag, so that no end that closes nothing walks up a deep page.
    """
    t = Tree()
    here, at, n = 0, 0, len(source)
    opened: dict[str, int] = {}
    paragraph = [-1]  # for each node the paragraph that a block in it would close

    def say(text: str) -> None:
        if text:
            t.add("", here, text=_html.unescape(text))
            paragraph.append(-1)

    def leave(stop: int) -> None:
        """Closes what is open up to and with ``stop``."""
        nonlocal here
        while here != stop:
            opened[t.tag[here]] -= 1
            here = t.parent[here]
        opened[t.tag[stop]] -= 1
        here = t.parent[stop]

    def shut(tags: set[str], scope: set[str]) -> None:
        if not any(opened.get(x) for x in tags):
            return
        found, up = -1, here
        while up > 0 and t.tag[up] not in scope:
            if t.tag[up] in tags:
                found = up
            up = t.parent[up]
        if found > 0:
            leave(found)

    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened.get(tag):
                up = here
                while t.tag[up] != tag:
                    up = t.parent[up]
                leave(up)
            continue
        if tag in BLOCK and tag not in ("option", "optgroup") and paragraph[here] > 0:
            leave(paragraph[here])
        if tag in CLOSES:
            shut(*CLOSES[tag])
        node = t.add(tag, here, m[3] or "")
        paragraph.append(node if tag == "p" else -1 if tag in P_SCOPE else paragraph[here])
        if tag in VOID:
            continue
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            t.add("", node, text=source[at : end.start() if end else n])
            paragraph.append(-1)
            at = end.end() if end else n
            continue
        if not ((m[3] or "").endswith("/") and tag in ("path", "use", "circle", "rect", "line")):
            opened[tag] = opened.get(tag, 0) + 1
            here = node
    size = len(t.tag)
    t.end = list(range(1, size + 1))
    for i in range(size - 1, 0, -1):
        if t.end[i] > t.end[t.parent[i]]:
            t.end[t.parent[i]] = t.end[i]
    return t


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def boilerplate(t: Tree, i: int) -> bool | None:
    """Whether tag, role, name or state tells that an element isn't part of an article; None if its name might."""
    if t.tag[i] in DROPPED_TAGS:
        return True
    if not t.attrs[i] or t.tag[i] in ("html", "body", "article", "main"):
        return False
    a = t.named(i)
    if a.get("role", "").lower() in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    return boilerplate_name(f"{a.get('class', '')} {a.get('id', '')}")


@lru_cache(maxsize=4096)
def boilerplate_name(names: str) -> bool | None:
    """True if one word of a class or id is made of listed names (and plain parts) and the others are plain; None if others mean something."""
    listed = other = False
    for word in names.split():
        parts = [x.lower() for x in NAME_PART.findall(word)]
        if any(x in DROPPED_NAMES for x in parts) and all(x in DROPPED_NAMES or x in PLAIN_PARTS or x.isdigit() for x in parts):
            listed = True
        elif not all(x in PLAIN_PARTS or x.isdigit() for x in parts) and re.fullmatch(r"[A-Za-z_-]{3,}", word):
            other = True
    return (None if other else True) if listed else False


def is_article(t: Tree, i: int) -> bool:
    if t.tag[i] in ("article", "main"):
        return True
    a = t.attrs[i]
    return "main" in a and t.named(i).get("role", "").lower() == "main" or "articleBody" in a


class Blocks(NamedTuple):
    """Block elements in document order (the root first), by node; and blocks of text: owner (place in nodes), text, length outside links."""

    nodes: list[int]
    parent: list[int]
    texts: list[tuple[int, str, int]]


def blocks(t: Tree, start: int = 0, skip=None) -> Blocks:
    """Blocks below a node, without raw text and what ``skip`` says of nodes."""
    nodes, parent, texts = [start], [-1], []
    parts: list[str] = []
    linked = 0
    open_blocks, links = [0], []
    stop = t.end[start]
    i = start + 1

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                texts.append((open_blocks[-1], whole, max(0, len(whole) - linked)))
            parts.clear()
            linked = 0

    while True:
        while len(open_blocks) > 1 and (i >= stop or i >= t.end[nodes[open_blocks[-1]]]):
            flush()
            open_blocks.pop()
        while links and (i >= stop or i >= t.end[links[-1]]):
            links.pop()
        if i >= stop:
            flush()
            return Blocks(nodes, parent, texts)
        tag = t.tag[i]
        if not tag:
            parts.append(t.text[i])
            if links:
                linked += len(t.text[i].strip())
        elif tag in RAW or tag == "head" or (skip is not None and skip(i)):
            i = t.end[i]
            continue
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            nodes.append(i)
            parent.append(open_blocks[-1])
            open_blocks.append(len(nodes) - 1)
        elif tag == "a":
            links.append(i)
        i += 1


# -- alignment -----------------------------------------------------------------------------------------------------


def key_of(*parts: str) -> int:
    """Signed 64 bits of a hash."""
    import xxhash

    n = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace"), 42)
    return n - (1 << 64) if n >> 63 else n


@lru_cache(maxsize=1 << 14)
def _key(tag: str, names: str) -> int:
    return key_of(tag, re.sub(r"\d{2,}", "0", names)) >> 32


class Skeleton(NamedTuple):
    """Block elements of a page: key (tag and class), parent, hash of the own text (0: none), its length outside links, and whether it can hold content or is a heading."""

    key: np.ndarray
    parent: np.ndarray
    text: np.ndarray
    mass: np.ndarray
    kind: np.ndarray

    def dump(self) -> bytes:
        return b"".join(x.astype(k).tobytes() for x, k in zip(self, ("<i4", "<i4", "<i4", "<i4", "<i1")))

    @staticmethod
    def load(raw: bytes) -> Skeleton:
        n = len(raw) // 17
        return Skeleton(*(np.frombuffer(raw, "<i4", n, 4 * n * i).astype(np.int64) for i in range(4)), np.frombuffer(raw, "<i1", n, 16 * n))


CAN_HOLD, HEADING = 1, 2


def skeleton(t: Tree, b: Blocks) -> Skeleton:
    n = len(b.nodes)
    own: list[list[str]] = [[] for _ in range(n)]
    mass = np.zeros(n, np.int64)
    for owner, text, plain in b.texts:
        own[owner].append(text)
        mass[owner] += plain
    key = [_key(t.tag[i], t.named(i).get("class", "") if "class" in t.attrs[i] else "") for i in b.nodes]
    kind = [CAN_HOLD if t.tag[i] in CONTAINERS else HEADING if t.tag[i] in HEADINGS else 0 for i in b.nodes]
    text = [((key_of(*x) >> 32) or 1) if x else 0 for x in own]
    return Skeleton(np.array(key, np.int64), np.array(b.parent, np.int64), np.array(text, np.int64), mass, np.array(kind, np.int8))


def layout_of(t: Tree, b: Blocks) -> int:
    """Hash of the parts that the body is built from, text elements apart; a lone part is looked into."""
    below: dict[int, list[int]] = {}
    for i, p in enumerate(b.parent):
        below.setdefault(p, []).append(i)
    here = 0
    names = lambda i: (t.tag[b.nodes[i]], t.named(b.nodes[i]).get("class", "") if "class" in t.attrs[b.nodes[i]] else "")
    seen: list[str] = []
    while True:
        parts = [i for i in below.get(here, []) if t.tag[b.nodes[i]] not in TEXTUAL]
        seen.append("|".join(sorted({str(_key(*names(i))) for i in parts})))
        if len(parts) != 1:
            return key_of(*seen)
        here = parts[0]


class Shape:
    """Children and shapes of the elements of a skeleton; equal shapes have equal keys below them."""

    def __init__(self, s: Skeleton):
        self.key, self.text = s.key.tolist(), s.text.tolist()
        n = len(self.key)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.size, self.shape = [1] * n, [0] * n
        for i, p in enumerate(s.parent.tolist()):
            if p >= 0:
                self.children[p].append(i)
        for i in range(n - 1, -1, -1):
            below = self.children[i]
            self.shape[i] = hash((self.key[i], *(self.shape[c] for c in below)))
            self.size[i] = 1 + sum(self.size[c] for c in below)


def _rows(sizes, first: Sequence[int], second: Sequence[int]) -> Iterator[np.ndarray]:
    """Rows of the table of best alignments of two lists, one after another; sizes: gives the weights of a row."""
    row = np.zeros(len(second) + 1, np.int64)
    yield row
    for x in first:
        new = row.copy()
        np.maximum(new[1:], row[:-1] + sizes(x), out=new[1:])
        row = np.maximum.accumulate(new)
        yield row


class Matching:
    """Simple tree matching of two skeletons."""

    def __init__(self, a: Skeleton, b: Skeleton):
        self.a, self.b = Shape(a), Shape(b)
        self.known: dict[tuple[int, int], int] = {}

    def best(self, x: int, y: int) -> int:
        """Size of the largest match of the subtrees of two elements that keeps parents and order, their roots being matched."""
        a, b = self.a, self.b
        if a.key[x] != b.key[y]:
            return 0
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        if a.size[x] == 1 or b.size[y] == 1:
            return 1
        pair = a.shape[x], b.shape[y]
        if pair not in self.known:
            xs, ys = a.children[x], b.children[y]
            lo, hx, hy = 0, len(xs), len(ys)
            total = 1
            # equal shapes at either end can be matched without loss
            while lo < hx and lo < hy and a.shape[xs[lo]] == b.shape[ys[lo]]:
                total += a.size[xs[lo]]
                lo += 1
            while hx > lo and hy > lo and a.shape[xs[hx - 1]] == b.shape[ys[hy - 1]]:
                hx, hy = hx - 1, hy - 1
                total += a.size[xs[hx]]
            xs, ys = xs[lo:hx], ys[lo:hy]
            if xs and ys:
                for row in _rows(self._sizes(ys), xs, ys):
                    pass
                total += int(row[-1])
            self.known[pair] = total
        return self.known[pair]

    def _sizes(self, ys: Sequence[int]):
        """Function that gives the sizes of an element's matches with each of ys; equal shapes are matched once."""
        shapes: dict[int, int] = {}
        at = np.array([shapes.setdefault(self.b.shape[y], len(shapes)) for y in ys], np.int64)
        stand = [ys[int(k)] for k in np.unique(at, return_index=True)[1]]
        rows: dict[int, np.ndarray] = {}

        def sizes(x: int) -> np.ndarray:
            shape = self.a.shape[x]
            if shape not in rows:
                rows[shape] = np.array([self.best(x, y) for y in stand], np.int64)[at]
            return rows[shape]

        return sizes

    def _chosen(self, xs: Sequence[int], ys: Sequence[int]) -> list[tuple[int, int]]:
        """Pairs of two lists of siblings in a largest match; of equally large ones one with most equal texts."""
        if not xs or not ys:
            return []
        a, b = self.a, self.b
        pairs, lo, hx, hy = [], 0, len(xs), len(ys)
        same = lambda x, y: a.shape[x] == b.shape[y] and a.text[x] == b.text[y] and a.size[x] == 1
        while lo < hx and lo < hy and same(xs[lo], ys[lo]):
            pairs.append((xs[lo], ys[lo]))
            lo += 1
        while hx > lo and hy > lo and same(xs[hx - 1], ys[hy - 1]):
            hx, hy = hx - 1, hy - 1
            pairs.append((xs[hx], ys[hy]))
        pairs += self._aligned(xs[lo:hx], ys[lo:hy])
        return pairs

    def _aligned(self, xs: Sequence[int], ys: Sequence[int]) -> list[tuple[int, int]]:
        if not xs or not ys:
            return []

        def weights(ys: Sequence[int]):
            sizes, texts = self._sizes(ys), np.array([self.b.text[y] for y in ys], np.int64)

            def of(x: int) -> np.ndarray:
                w = sizes(x)
                # a match by size counts first, then equal texts
                return (w << 24) + ((texts == self.a.text[x]) & (w > 0))

            return of

        n, m = len(xs), len(ys)
        if n > 1 and n * m > CELLS:
            half = n // 2
            for head in _rows(weights(ys), xs[:half], ys):
                pass
            for tail in _rows(weights(ys[::-1]), xs[half:][::-1], ys[::-1]):
                pass
            k = int((head + tail[::-1]).argmax())
            return self._aligned(xs[:half], ys[:k]) + self._aligned(xs[half:], ys[k:])
        of = weights(ys)
        rows = list(_rows(of, xs, ys))
        i, j, pairs = n, m, []
        while i and j:
            w = of(xs[i - 1])[j - 1]
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return pairs

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Matched elements of a largest match."""
        if self.a.key[0] != self.b.key[0]:
            return
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            yield x, y
            todo += self._chosen(self.a.children[x], self.b.children[y])


def partners(page: Skeleton, reference: Skeleton) -> np.ndarray:
    """For each element of the page the matched one of the reference, or -1."""
    deepest = 4 * (len(page.key) + len(reference.key)) + 1000
    if sys.getrecursionlimit() < deepest:
        sys.setrecursionlimit(deepest)
    out = np.full(len(page.key), -1)
    for x, y in Matching(page, reference).pairs():
        out[x] = y
    return out


# -- wrapper -------------------------------------------------------------------------------------------------------


def votes(page: Skeleton, reference: Skeleton) -> list[tuple[int, int, int, int, int]]:
    """What a page says of the reference's elements: (element, aligned, told, same, varying length). Nothing if it is a near copy.

    told: both have text there; same: the same text. Text of elements without partner counts for the element around it.
    """
    to = partners(page, reference)
    equal = (to >= 0) & (page.text != 0) & (page.text == reference.text[to])
    if page.mass[equal].sum() > NEAR_COPY * page.mass.sum():
        return []
    around = to.copy()
    for i in range(len(around)):
        if around[i] < 0:
            around[i] = around[page.parent[i]]
    n = len(reference.key)
    hit = to >= 0
    count = lambda which: np.bincount(to[which], minlength=n)
    told, same, aligned = count(hit & (page.text != 0) & (reference.text[to] != 0)), count(equal), count(hit)
    mass = np.bincount(around[~equal], page.mass[~equal], n).astype(np.int64)
    return [(int(i), int(aligned[i]), int(told[i]), int(same[i]), int(mass[i])) for i in np.flatnonzero(aligned | (mass > 0))]


class Wrapper(NamedTuple):
    reference: Skeleton
    content: tuple[int, ...]  # the element with the content, and headings beside the way to it
    template: frozenset[int]
    usual: frozenset[int]  # elements that most pages have


def wrapper(reference: Skeleton, said: Sequence[tuple[int, int, int, int, int]]) -> Wrapper | None:
    """The wrapper from the sums of all pages' votes; None if nothing varies."""
    n = len(reference.key)
    aligned, told, same, mass = np.zeros((4, n), np.int64)
    for i, *x in said:
        aligned[i], told[i], same[i], mass[i] = x
    whole = mass.copy()
    for i in range(n - 1, 0, -1):
        whole[reference.parent[i]] += whole[i]
    if not whole[0]:
        return None
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[reference.parent[i]].append(i)
    here, headings = 0, []
    while below := children[here]:
        best = max(below, key=lambda i: whole[i])
        if not reference.kind[best] == CAN_HOLD or whole[best] < MOST * whole[here]:
            break
        headings += [i for i in below if i < best and reference.kind[i] == HEADING and whole[i]]
        here = best
    template = np.flatnonzero((told >= LEAST_PAGES) & (same >= SHARE * told))
    usual = np.flatnonzero((aligned[0] >= LEAST_PAGES) & (aligned >= SHARE * aligned[0]))
    return Wrapper(reference, (here, *headings), frozenset(template.tolist()), frozenset(usual.tolist()))


def _outer(t: Tree, found: list[int]) -> list[int]:
    """Nodes that aren't below others of the list, in page order."""
    out: list[int] = []
    for i in sorted(found):
        if not out or i >= t.end[out[-1]]:
            out.append(i)
    return out


def marked(t: Tree, start: int = 0) -> list[int]:
    """Marked articles below a node, outermost first; a main element gives way to articles in it. Boilerplate holds none."""
    found, i = [], start + 1
    while i < t.end[start]:
        if t.tag[i] and t.tag[i] not in VOID:
            if t.tag[i] in RAW or boilerplate(t, i):
                i = t.end[i]
                continue
            if is_article(t, i):
                inner = [k for k in marked(t, i) if t.tag[k] == "article"] if t.tag[i] == "main" else []
                found += inner or [i]
                i = t.end[i]
                continue
        i += 1
    return found


def _enclosing(t: Tree, i: int) -> int:
    """The innermost marked article around a node, or the node."""
    up = i
    while up > 0:
        if is_article(t, up) and t.tag[up] != "main":
            return up
        up = t.parent[up]
    return i


def page_text(source: str, w: Wrapper | None) -> str:
    """Main text of one page with the wrapper of its layout (None: there is none)."""
    t = parse(source)
    b = blocks(t)
    slot: dict[int, int] = {}
    regions: list[int] = []
    if w is not None:
        to = partners(skeleton(t, b), w.reference)
        slot = {node: int(y) for node, y in zip(b.nodes, to) if y >= 0}
        at = {y: node for node, y in slot.items()}
        if w.content[0] in at:
            here = at[w.content[0]]
            inside = marked(t, here)
            regions = inside if inside else _outer(t, [_enclosing(t, here), *(at[y] for y in w.content[1:] if y in at)])
    if not regions:
        regions = marked(t)
        regions = [r for r in regions if blocks(t, r, _skipped(t, r, slot, w)).texts] or [0]
    found: list[tuple[bool, str]] = []
    for r in regions:
        got = blocks(t, r, _skipped(t, r, slot, w))
        found += [(w is not None and slot.get(got.nodes[owner]) in w.template, text) for owner, text, _ in got.texts]
    return "\n".join([x for fixed, x in found if not fixed] or [x for _, x in found])


def _skipped(t: Tree, region: int, slot: dict[int, int], w: Wrapper | None):
    """Whether a node of a region is left out: boilerplate, and all but the headings of a header.

    A name that may mean something else counts where most pages of the layout have the element.
    """
    in_article = region > 0

    def skip(i: int) -> bool:
        said = boilerplate(t, i)
        if said is None:
            return w is not None and slot.get(i) in w.usual
        if said or t.tag[i] != "header":
            if not said and t.tag[t.parent[i]] == "header":
                return t.tag[i] not in HEADINGS
            return said
        return not in_article and not any(is_article(t, k) for k in _ups(t, i))

    return skip


def _ups(t: Tree, i: int) -> Iterator[int]:
    while i > 0:
        i = t.parent[i]
        yield i


def main_text(source: str, others: Sequence[str] = ()) -> str:
    """Main text of one page, with other pages of its layout."""
    pages = [source, *(x for x in dict.fromkeys(others) if x and x != source)]
    found = None
    if len(pages) > 1:
        shapes = [skeleton(t, blocks(t)) for t in map(parse, pages)]
        sums: dict[int, np.ndarray] = {}
        for s in [shapes[0], *shapes[2:]]:
            for i, *x in votes(s, shapes[1]):
                sums[i] = sums.get(i, 0) + np.array(x)
        found = wrapper(shapes[1], [(i, *x.tolist()) for i, x in sums.items()])
    return page_text(source, found)


@lru_cache(maxsize=256)
def _loaded(raw: bytes) -> Skeleton:
    return Skeleton.load(raw)


@lru_cache(maxsize=256)
def _wrapper(raw: bytes, content: bytes, template: bytes, usual: bytes) -> Wrapper:
    ints = lambda x: np.frombuffer(x, "<i4").tolist()
    return Wrapper(_loaded(raw), tuple(ints(content)), frozenset(ints(template)), frozenset(ints(usual)))


VOTES = ("aligned", "told", "same", "mass")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, reference, content, template, usual): a row for each layout of which several pages tell something.

    pages: __host, __layout, __hash, __skeleton. Pages are joined with their layout's reference, of which there is one for each
    layout, and their votes are added up within each batch and then by partial aggregates.
    """
    first = pages.groupBy("__host", "__layout").agg(F.min("__hash").alias("least"))
    own = pages.withColumnsRenamed({"__host": "host", "__layout": "layout", "__skeleton": "reference"}).select("host", "layout", "__hash", "reference")
    chosen = own.join(first, (F.col("host") == F.col("__host")) & (F.col("layout") == F.col("__layout")) & (F.col("__hash") == F.col("least")), "left_semi")
    references = stored(chosen.groupBy("host", "layout").agg(F.min("reference").alias("reference"), F.min("__hash").alias("least")), "references")
    # of a layout with one page, or copies of one, there is nothing to tell
    both = pages.join(references, (F.col("__host") == F.col("host")) & (F.col("__layout") == F.col("layout")) & (F.col("__hash") != F.col("least")))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[int, int, int], np.ndarray] = {}
            for host, layout, page, reference in zip(*(b.column(i).to_pylist() for i in range(4))):
                for i, *x in votes(Skeleton.load(page), _loaded(reference)):
                    k = (host, layout, i)
                    sums[k] = sums.get(k, 0) + np.array(x)
            cols = list(zip(*((*k, *x.tolist()) for k, x in sums.items()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["host", "layout", "i", *VOTES])

    said = both.select("__host", "__layout", "__skeleton", "reference").mapInArrow(tell, "host long, layout long, i long, aligned long, told long, same long, mass long")
    sums = said.groupBy("host", "layout", "i").agg(*(F.sum(c).alias(c) for c in VOTES))
    # as many as the reference has elements
    each = sums.groupBy("host", "layout").agg(F.collect_list(F.struct("i", *VOTES)).alias("said"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, layout, said, reference in zip(*(b.column(i).to_pylist() for i in range(4))):
                w = wrapper(_loaded(reference), [tuple(x.values()) for x in said])
                if w is not None:
                    rows.append((host, layout, reference, *(np.array(list(x), "<i4").tobytes() for x in (w.content, sorted(w.template), sorted(w.usual)))))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "layout", "reference", "content", "template", "usual"])

    whole = each.join(references.withColumnsRenamed({"host": "h", "layout": "l"}), (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l")))
    return whole.select("host", "layout", "said", "reference").mapInArrow(decide, "host long, layout long, reference binary, content binary, template binary, usual binary")


def extract_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages without the html, with the main text in ``text`` (empty if none) and its code points in ``n_chars``.

    Every page of a layout but its reference, copies of it and near copies votes on the wrapper. Wrappers are joined with
    the pages by host and layout, in a join that Spark makes a broadcast only below its size limit and that may split a frequent
    host otherwise. A null or empty html gives an empty text; pages without a host share the empty one. Whole pages are
    read, of any depth and length; repeated rows stay, columns named text or n_chars are replaced, and an empty table
    gives an empty table.
    """
    rest = dropped(pages, "text", "n_chars", html)
    names = rest.columns
    kept = [*(F.col(f"`{c}`") for c in names)]
    after = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    host = F.xxhash64(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    df = pages.select(*kept, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("__html"), host.alias("__host"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            layout, raw = [], []
            for source in b.column(b.num_columns - 3).to_pylist():
                t = parse(source)
                found = blocks(t)
                layout.append(layout_of(t, found))
                raw.append(skeleton(t, found).dump())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(layout, pa.int64()), pa.array(raw, pa.binary())], names=[*b.schema.names, "__layout", "__skeleton"])

    hashed = df.select(*kept, "__html", "__host", F.xxhash64("__html").alias("__hash"))
    made = stored(hashed.mapInArrow(shapes, ", ".join([*kinds, "__html string, __host long, __hash long, __layout long, __skeleton binary"])), "skeletons")
    found = stored(wrappers(made.select("__host", "__layout", "__hash", "__skeleton").filter("__hash is not null")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(names)
            rows = zip(*(b.column(n + i).to_pylist() for i in range(5)))
            texts = [page_text(source, _wrapper(*w) if w[0] is not None else None) for source, *w in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    renamed = found.select(*(F.col(c).alias(f"__w_{c}") for c in found.columns))
    joined = made.join(renamed, (F.col("__host") == F.col("__w_host")) & (F.col("__layout") == F.col("__w_layout")), "left")
    picked = [*kept, "__html", *(f"__w_{c}" for c in ("reference", "content", "template", "usual"))]
    return joined.select(*picked).mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"]))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


ORACLE: dict[str, str] = {}
