"""HTML extraction by composite text density.

Every DOM node gets characters per tag, adjusted for links: text that sits in links counts for little. A
node's density sum is the sum over its children. The node of highest density gives a path to the body, and
the lowest density on that path is the threshold that a region must reach; of the nodes that reach it, the
subtree with the largest density sum is the core of the main text. An `article` or `main` element around the
core only sets how far the region reaches (its heading and byline belong to it), and sibling articles that
reach the threshold belong to it as well. Below the region, subtrees that are mostly links are left out.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot html body".split())
_SCOPE = frozenset("html body table td th article section div button".split())
#: For each kind of element that a start tag may end: its tags, and tags beyond which it isn't looked for. Nodes know their nearest of each.
_KINDS = (
    (frozenset(["p"]), _SCOPE),
    (frozenset(["li"]), _SCOPE | {"ul", "ol", "menu"}),
    (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    (frozenset(["tr"]), frozenset(["table"])),
    (frozenset(["option"]), frozenset(["select"])),
    (frozenset(["table", "td", "th", "article", "body"]), frozenset()),  # beyond these, end tags of inline elements have no effect
)
#: start tag -> the kinds that it ends.
_ENDS = {"li": (1,), "dt": (2,), "dd": (2,), "td": (3,), "th": (3,), "tr": (3, 4), "option": (5,)}
_LOCAL_END = frozenset("p li b i a span em strong".split())
#: Elements that never hold main text.
_SKIP_TAGS = frozenset("head script style nav header footer aside form noscript template svg math button select input textarea iframe object canvas audio video menu dialog title xmp noembed noframes datalist label fieldset".split())
#: Words of class and id that mark what is not main text: these as any part of a name, such as cookie-banner ...
_SKIP_PARTS = frozenset("nav navbar navigation masthead footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup overlay comment comments disqus newsletter breadcrumb breadcrumbs pagination pager".split())
#: ... these as a whole name only, since names like form-text or search-results may hold main text ...
_SKIP_NAMES = _SKIP_PARTS | frozenset("menu header aside banner notice notices alert modal respond reply replies share sharing social related recommended subscribe subscription signup login search toolbar widget copyright contentinfo complementary form disclaimer".split())
#: ... and these as a part if at least half of the text is in links.
_SKIP_LINKED = _SKIP_NAMES
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
#: Share of link text from which a subtree of several links is no main text.
LINKED = 0.6
#: Characters of a link, on average, from which a list of links is kept as references.
TITLE = 30


class Node:
    __slots__ = ("tag", "kids", "skip", "main", "weak", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "up", "depth", "near")

    def __init__(self, tag: str, up: Node | None, skip: bool = False, main: bool = False, weak: bool = False, named: int = 0):
        self.tag, self.up, self.skip, self.main, self.weak, self.named, self.kids = tag, up, skip, main, weak, named, []
        self.depth = up.depth + 1 if up is not None else 0
        over = up.near if up is not None else (None,) * len(_KINDS)
        if tag in _TRACKED:
            over = tuple(self if tag in own else None if tag in stops else n for (own, stops), n in zip(_KINDS, over, strict=True))
        self.near = over


_TRACKED = frozenset().union(*(own | stops for own, stops in _KINDS))


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool, int]:
    """Whether the element is to be left out, whether it is named as the main text, whether it is to be left out if it is mostly links, and
    whether it is left out for a class or id alone: 2 for a whole name, 1 for a part of one. That is a vote; see _open_named()."""
    if tag in _SKIP_TAGS:
        return True, False, False, 0
    named = tag in ("article", "main")
    if not attrs or attrs.isspace():
        return False, named, False, 0
    found = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) or role in _SKIP_ROLES:
        return True, False, False, 0
    if tag in ("html", "body", "main") or role == "main":
        return False, tag == "main" or role == "main", False, 0
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    parts = {w.lower() for x in names for w in _PARTS.findall(x)}
    vote = 2 if any(x.lower() in _SKIP_NAMES for x in names) else 1 if parts & _SKIP_PARTS else 0
    main = named or role == "article"
    return vote > 0, main, bool(parts & _SKIP_LINKED) or vote > 0, vote


def parse(page: str) -> Node:
    """A tree of the page; end tags that may be left out are implied. Leaves are decoded strings. Time is linear in the page:
    whatever a tag looks for among the open elements is known without a search, and an element is closed once."""
    top = cur = Node("html", None)
    pos, n, find = 0, len(page), page.find
    open_: dict[str, list[Node]] = {}

    def close(node: Node) -> Node:
        """Closes everything up to and with `node`."""
        at = cur
        while True:
            open_[at.tag].pop()
            at = at.up
            if at is node.up:
                return at

    while pos < n:
        at = find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            cur.kids.append(page[pos:at])
        if at >= n:
            break
        nxt = page[at + 1 : at + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", at):
                end = find("-->", at + 4)
                pos = n if end < 0 else end + 3
            else:
                end = find(">", at)
                pos = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            if nxt.isalpha() and nxt.isascii() or nxt == "/":
                end = find(">", at)
                if end < 0:
                    break  # a tag that the page's end cuts off
                pos = end + 1
                continue
            cur.kids.append("<")
            pos = at + 1
            continue
        pos, tag = m.end(), m[2].lower()
        if m[1]:
            if (held := open_.get(tag)) and tag not in ("html", "body"):
                wall = cur.near[6]
                if not (tag in _LOCAL_END and wall is not None and wall.depth > held[-1].depth):
                    cur = close(held[-1])
            continue
        if tag in ("html", "body") and cur.up is None:
            if tag == "body":
                child = Node("body", cur)
                open_.setdefault("body", []).append(child)
                cur.kids.append(child)
                cur = child
            continue
        for kind in (0, *_ENDS.get(tag, ())) if tag in _CLOSES_P else _ENDS.get(tag, ()):
            while (node := cur.near[kind]) is not None:
                cur = close(node)
        child = Node(tag, cur, *_marks(tag, m[3]))
        cur.kids.append(child)
        if tag in _RAW:
            end = _raw_end(tag).search(page, pos)
            if end is None:
                break
            after = find(">", end.start())
            pos = n if after < 0 else after + 1
        elif tag not in _VOID and not m[3].endswith("/"):
            open_.setdefault(tag, []).append(child)
            cur = child
    return top


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I | re.A)


def _kept(node: Node) -> list[Node]:
    return [k for k in node.kids if isinstance(k, Node) and not k.skip]


def _down(top: Node) -> list[Node]:
    """All kept nodes, parents before children."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += _kept(node)
    return out


def measure(top: Node) -> list[Node]:
    """Characters and tags of every kept node, all and in links, its density and its children's sum."""
    for node in reversed(_down(top)):
        kids = _kept(node)
        node.chars = sum(len(k) - k.count(" ") - k.count("\n") for k in node.kids if isinstance(k, str)) + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
        if node.weak and node.link_chars and 2 * node.link_chars >= node.chars:
            node.skip = True  # parents come later and don't count it
    order = _down(top)
    ratio = top.link_chars / max(1, top.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c == 0:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9) / math.log(base + math.e - 1))
    for node in order:
        node.total = sum(k.density for k in _kept(node))
    return order


def _open_named(top: Node) -> None:
    """Takes back what class names and ids alone left out, where it holds the page's text.

    Such an element stays in if only parts of its names speak against it and it is an article or main element; if it holds at least a
    quarter of the page's plain text and in it a main heading, a main element or, unless a whole name speaks against it, an article; or if
    it holds more than half of the plain text while no heading, article or main element with a tenth as much stands elsewhere.
    """
    order, at, votes = [], {}, []
    stack = [top]
    while stack:
        node = stack.pop()
        at[node] = len(order)
        order.append(node)
        if node.named:
            votes.append(node)
        stack += [k for k in node.kids if isinstance(k, Node) and (not k.skip or k.named)]
    if not votes:
        return
    plain, last, mains, articles = {}, {}, {}, {}
    for node in reversed(order):
        kids = [k for k in node.kids if k in at] if len(node.kids) > 0 else []
        own = 0 if node.tag == "a" else sum(len(k) - k.count(" ") - k.count("\n") for k in node.kids if isinstance(k, str))
        plain[node] = own + (0 if node.tag == "a" else sum(plain[k] for k in kids))
        last[node] = max((last[k] for k in kids), default=at[node])
        mains[node] = node.tag in ("h1", "main") or (node.main and node.tag != "article") or any(mains[k] for k in kids)
        articles[node] = node.tag == "article" or any(articles[k] for k in kids)
    total = plain[top]
    anchors = [(at[n], plain[n]) for n in order if n.main and not n.named] + [(at[n.up], plain[n.up]) for n in order if n.tag == "h1" and n.up is not None and not n.up.named]

    def alone(node: Node) -> bool:
        inside = lambda i: at[node] <= i <= last[node]
        around = lambda i: i < at[node] and last[order[i]] >= last[node]
        return not any(10 * n >= plain[node] and not inside(i) and not around(i) for i, n in anchors)

    for node in votes:  # outer ones first
        share = plain[node] / max(1, total)
        held = mains[node] or (node.named == 1 and articles[node])
        if (node.named == 1 and node.tag in ("article", "main")) or (share >= 0.25 and held) or (share > 0.5 and alone(node)):
            node.skip = False


def _line(node: Node) -> list[Node]:
    """A node and what stands above it."""
    out = [node]
    while out[-1].up is not None:
        out.append(out[-1].up)
    return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = _HEADINGS | frozenset("p ul ol dl pre blockquote figure table hr br img center address b i em strong".split())


def _of_sections(node: Node) -> Node | None:
    """What is above `node` if that is one text in sections of the same tag: each has a heading or paragraphs of its own (under the body:
    headings), none is mostly links, and nothing stands between them but blocks of plain text."""
    up = node.up
    if up is None or node.main or node.tag not in ("section", "div"):
        return None
    kids = [k for k in _kept(up) if k.chars]
    like = [k for k in kids if k.tag == node.tag]
    if len(like) < 2:
        return None
    needed = _HEADINGS if up.tag in ("body", "html") else _HEADINGS | {"p"}
    for k in kids:
        if 10 * k.link_chars > 3 * k.chars or (k.tag == node.tag and not any(x.tag in needed for x in _kept(k))) or (k.tag != node.tag and k.tag not in _PLAIN):
            return None
    return up


def region(top: Node) -> list[Node]:
    """The main text's subtrees in page order: the one of largest density sum among nodes that reach the body path's lowest density, with
    the article around it, the sections beside it, and its likes."""
    order = measure(top)
    if top.chars == 0:
        return []
    peak = max(order, key=lambda x: (x.density, x.chars))
    threshold = min(x.density for x in _line(peak))
    core = max((x for x in order if x.density >= threshold and x.chars), key=lambda x: (max(x.total, x.density), x.main), default=top)
    named = [x for x in _line(core) if x.main and x.density >= threshold]
    found = ([x for x in named if x.tag == "article"] or named or [core])[-1]  # the outermost: a section of an article may be an article too
    if found.tag not in _BLOCK or found.tag in ("p", "li", "td", "tr"):
        found = found.up or found
    while (wider := _of_sections(found)) is not None:
        found = wider
    if found.up is None:
        return [found]
    plain = found.chars - found.link_chars
    alike = [k for k in _kept(found.up) if k is found or k.tag == found.tag and found.tag in _BLOCK and k.density >= threshold and 4 * (k.chars - k.link_chars) >= plain]
    if not found.main and found.tag != "body":  # its headings may stand before it
        before = found.up.kids[: found.up.kids.index(alike[0])]
        alike = [k for k in before if isinstance(k, Node) and not k.skip and k.tag in ("h1", "h2")] + alike
    return alike


def _references(node: Node) -> bool:
    """Whether a list of links reads like references, not like a menu: its entries are long, or numbered and not all link."""
    long = node.link_chars >= TITLE * node.link_tags
    return node.tag in ("ol", "ul", "li", "dl", "dd", "p") and (long or (node.tag == "ol" and node.link_chars < node.chars))


def blocks(root: Node) -> list[str]:
    """Texts of the blocks below `root` in page order, white space turned into single spaces. Blocks below it that are mostly links are left out."""
    out, line = [], []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif x is root or not x.skip:
            if x.tag == "br":
                line.append(" ")
                continue
            if x.tag in _BLOCK:
                if x is not root and x.link_tags >= 3 and x.link_chars >= LINKED * x.chars and not _references(x):
                    flush()
                    continue
                flush()
                stack.append(None)
            stack += reversed(x.kids)
    flush()
    return out


def _open_forms(top: Node) -> None:
    """A form that holds an article or more than half of the page's text is a wrapper: only its controls are left out."""
    forms, stack, total = [], [top], 0
    while stack:
        node = stack.pop()
        total += sum(len(k) for k in node.kids if isinstance(k, str))
        for k in node.kids:
            if isinstance(k, Node):
                if k.tag == "form":
                    forms.append(k)
                elif not k.skip:
                    stack.append(k)
    for form in forms:
        inner, main, below = 0, False, [form]
        while below:
            node = below.pop()
            inner += sum(len(k) for k in node.kids if isinstance(k, str))
            kids = [k for k in node.kids if isinstance(k, Node) and not k.skip]
            main = main or any(k.main for k in kids)
            below += kids
        if main or inner > total:
            form.skip = False


def extract(page: str | None) -> str:
    if not page:
        return ""
    top = parse(page)
    _open_forms(top)
    _open_named(top)
    return "\n".join(line for root in region(top) for line in blocks(root))


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with a column `out_col`: the main text of `html_col`.

    Null, empty or text-free pages give an empty text. Repeated rows stay; other columns pass through, and
    a column of `out_col`'s name is replaced. No shuffle: each page is read whole in its own row.
    """
    kept = [c for c in pages.columns if c not in (html_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(x.as_py()) for x in b.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*kept, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema), f"`{out_col}` string"])
    return pages.select(*kept, html_col).mapInArrow(run, schema)
