"""Main text of web pages by a tree-structured graphical model of their DOM.

Every element that can hold a block, or that bears a class, id or role, is a
node with a hidden label, content or not.  Its tag, names, amount of text and
share of links give a node potential; each parent and child share a potential
by the child's kind.  Sum-product messages upward and downward give exact
marginals.  Weights are trained by the likelihood of labelled pages, which
``labelled_page`` writes from a grammar of page parts; no page of the input is
learnt from.

Defined cases: a null or empty html gives an empty text; unclosed elements end
where their parents do; an end tag without a start is ignored; text outside any
element belongs to the page's root; only HTML's raw-text elements run to the end
of the page if unclosed; the text of ``math`` is its surroundings'; that of
``svg``, ``select``, ``button``, ``template`` and ``noscript`` is left out up to
their own end tag, and without one it belongs to the element around; white space is what Unicode calls so, the
no-break space included; repeated rows get equal results.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import small_batches, tidy

#: A node whose marginal reaches this is content.
THRESHOLD = 0.5
#: Deeper elements stand beside those of this depth instead of in them, as in browsers.
DEPTH = 512
#: Labelled pages to train on, and passes over them.
PAGES, PASSES = 500, 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_ATTRS = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style)(?![\w:.-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_LABEL = re.compile(r' data-k="([01])"$')  # of training pages only
_IMPRINT = re.compile(r"\s*+(?:©|\(c\)\s|copyright\b)", re.I)
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: HTML's raw-text elements: text up to their end tag, or to the page's end.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Not content if closed by their own end tag; the others of ``_LOOSE`` are ordinary then.  None of them counts if unclosed.
_APART = frozenset("svg select button template".split())
_LOOSE = _APART | frozenset("object option optgroup".split())
_NOSCRIPT = re.compile(r"<(/?)noscript(?![a-zA-Z0-9])[^>]*>", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag closes open ones of these names, up to the nearest of the second.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "body": (("head",), ()), "option": (("option",), ("select",)),
    "button": (("button",), ("table", "td", "th")), "select": (("select",), ("table", "td", "th")),
}
#: What no opening tag but that of the body closes from inside.
_SCOPE = frozenset("template object button".split())
#: Elements of svg and math that hold HTML, tags that end svg and math, and cells whose text stands apart.
_POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_BREAKOUT = _ENDS_P | _CLOSES.keys() | frozenset("b big br code em embed head i img meta nobr noscript object optgroup ruby s small span strong strike sub sup template tt u var".split())
_CELLS = frozenset("text mtr mtd".split())
_KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 4, "ol": 4, "div": 5, "section": 5, "article": 5, "main": 5, "td": 6, "tr": 6, "table": 6, "blockquote": 1, "pre": 1, "dd": 3, "dt": 3}
N_KINDS = 8


@lru_cache(maxsize=32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*>", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...]
    words: int = 0
    linked: int = 0
    imprint: bool = False
    label: int | None = None


@dataclass
class Page:
    """A page's nodes, parents first, and its pieces of text as (node, block, text)."""

    nodes: list[Node] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def parse(source: str, labelled: bool = False) -> Page:
    """Read a page, well-formed or not, in one pass; only of a ``labelled`` one are labels read."""
    page = Page([Node("html", -1, ())])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the node that each belongs to
    block, at, links = 0, 0, 0
    loose: dict[int, bool] = {}  # nodes of ``_LOOSE`` and of raw names within svg or math, and whether they were closed
    islands = False  # whether an svg or math is open
    opened: Counter[str] = Counter()  # open elements by name
    unclosed: set[str] = set()  # names of which no more tag comes

    def foreign() -> bool:
        if islands:
            for t, _ in reversed(stack):
                if t in _POINTS:
                    return False
                if t == "svg" or t == "math":
                    return True
        return False

    def add(raw: str) -> None:
        if not raw:
            return
        node = stack[-1][1]
        text = entities.unescape(raw) if "&" in raw else raw
        page.pieces.append((node, block, text))
        n = len(text.split())
        page.nodes[node].words += n
        if n < 30 and _IMPRINT.match(text):
            page.nodes[node].imprint = True
        if links:
            page.nodes[node].linked += n

    def cut(k: int) -> None:
        for t, _ in stack[k:]:
            opened[t] -= 1
        del stack[k:]

    def push(tag: str, owner: int) -> None:
        if len(stack) >= DEPTH:
            cut(DEPTH - 1)
        stack.append((tag, owner))
        opened[tag] += 1

    last = source.rfind(">") + 1  # no tag ends after it
    while m := _TOKEN.search(source, at, last):
        add(source[at : m.start()])
        at = m.end()
        if at == last and (m["cdata"] is not None and source[at - 3 : at] != "]]>" or source.startswith("<!--", m.start()) and source[at - 3 : at] != "-->"):
            if m["cdata"] is not None:
                add(entities.unescape(source[m.start("cdata") :]))
            at = len(source)
            break
        if start := m["start"]:
            tag = start.lower()
            if tag == "html":
                continue
            inside = foreign()
            if inside and tag in _BREAKOUT:
                inside, least = False, len(stack)
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _POINTS:
                        break
                    if stack[k][0] == "svg" or stack[k][0] == "math":
                        least = k
                cut(least)
            if inside or tag == "svg" or tag == "math":
                if tag == "svg" or tag in _CELLS:
                    block += 1
                if not m["attrs"].rstrip().endswith("/"):
                    owner = stack[-1][1]
                    if tag == "svg" or tag in _RAW:
                        page.nodes.append(Node(tag, owner, ()))
                        owner = len(page.nodes) - 1
                        loose[owner] = False
                    push(tag, owner)
                    links += tag == "a"
                    islands = True
                continue
            inline = tag in _INLINE
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                    if stack[k][0] == "p":
                        cut(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            elif tag in _CLOSES:
                names, stop = _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1) if any(opened[n] for n in names) else ():
                    if stack[k][0] in names:
                        cut(k)
                        if tag not in ("tr", "tbody"):
                            break
                    elif stack[k][0] in stop or (stack[k][0] in _SCOPE and tag != "body"):
                        break
            if not inline:
                block += 1
            if tag in _VOID:
                if tag == "br":
                    page.pieces.append((stack[-1][1], block, " "))
                continue
            if tag in _RAW:
                end = None if tag in unclosed else _raw_end(tag).search(source, at, last)
                at = end.end() if end else len(source)
                continue
            if tag == "noscript":
                end = None if tag in unclosed else _NOSCRIPT.search(source, at, last)
                if end and end[1]:
                    at = end.end()
                elif not end:
                    unclosed.add(tag)
                continue
            names, label, unseen = (), None, False
            if "=" in m["attrs"] or "hidden" in m["attrs"]:
                found: list[str] = []
                for a in _ATTRS.finditer(m["attrs"]):
                    value = a[2] or a[3] or a[4] or ""
                    key = a[1].lower()
                    if key == "hidden" or key == "style":
                        unseen |= key == "hidden" or "display:none" in value.replace(" ", "").lower()
                    else:
                        found += _NAMES.findall(_CAMEL.sub(" ", value).lower())
                names = tuple(dict.fromkeys(found))
            if labelled and (mark := _LABEL.search(m["attrs"])):
                label = int(mark[1])
            if unseen:
                names = (*names, "hidden")
            owner = stack[-1][1]
            if not inline or names:
                page.nodes.append(Node(tag, owner, names, label=label))
                owner = len(page.nodes) - 1
            if tag in _LOOSE:
                loose[owner] = False
            if not m["attrs"].rstrip().endswith("/") or inline or tag in _ENDS_P:
                push(tag, owner)
                links += tag == "a"
        elif end_name := m["end"]:
            tag = end_name.lower()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    if stack[k][1] in loose and (tag in _LOOSE or tag in _RAW):
                        loose[stack[k][1]] = True
                    links -= sum(t == "a" for t, _ in stack[k:])
                    cut(k)
                    break
            if tag in _CELLS or (tag not in _INLINE and not foreign()):
                block += 1
        elif m["cdata"]:
            add(entities.unescape(m["cdata"]))
        if links and not opened["a"]:
            links = 0
        if islands and not opened["svg"] and not opened["math"]:
            islands = False
    rest = source.find("<!--", at)
    add(source[at:] if rest < 0 else source[at:rest])
    return _settled(page, loose) if loose else page


def _settled(page: Page, loose: dict[int, bool]) -> Page:
    """``page`` without the nodes that were closed and are no content; unclosed ones give what they hold to their parent."""
    out, to = Page(), []
    for i, node in enumerate(page.nodes):
        at = to[node.parent] if i else -1
        closed = loose.get(i)
        if i and at < 0 or closed and (node.tag in _APART or node.tag in _RAW):
            at = -1
        elif closed is False:
            out.nodes[at].words += node.words
            out.nodes[at].linked += node.linked
        else:
            node.parent = at
            out.nodes.append(node)
            at = len(out.nodes) - 1
        to.append(at)
    out.pieces = [(to[node], block, text) for node, block, text in page.pieces if to[node] >= 0]
    return out


def features(page: Page) -> list[list[str]]:
    """What is seen of each node: itself, its names, and how much of the page's unlinked text it holds with all below it."""
    out = []
    below = [node.words - node.linked for node in page.nodes]
    for i in range(len(below) - 1, 0, -1):
        below[page.nodes[i].parent] += below[i]
    for node, held in zip(page.nodes, below, strict=True):
        parent = page.nodes[node.parent].tag if node.parent >= 0 else "-"
        w, share = node.words, node.linked / node.words if node.words else 0.0
        size = 0 if not w else 1 if w < 4 else 2 if w < 12 else 3 if w < 30 else 4
        seen = ["bias", f"tag={node.tag}", f"in={parent}>{node.tag}", f"words={size}", f"links={size and math.ceil(share * 3)}", f"links={size and math.ceil(share * 3)} {node.tag}"]
        part = held / below[0] if below[0] else 0.0
        part = sum(part > x for x in (0.0, 0.05, 0.2, 0.5, 0.8))
        seen += [f"part={part}", f"part={part} {node.tag}"]
        if node.imprint:
            seen.append("imprint")
        if not node.names:
            seen.append(f"unnamed {node.tag}")
        for name in node.names:
            seen += [f"name={name}", f"stem={name[:5]}"]
        out.append(seen)
    return out


@dataclass
class TreeModel:
    """Log-potentials: by node feature for the label content, and by the child's kind for (parent, child) labels."""

    weights: dict[str, float] = field(default_factory=dict)
    edges: list[list[list[float]]] = field(default_factory=lambda: [[[0.0, 0.0], [0.0, 0.0]] for _ in range(N_KINDS)])

    def marginals(self, page: Page, seen: list[list[str]]) -> tuple[list[float], list[tuple[float, ...]]]:
        """P(content) of each node, and of each node and its parent the joint P(parent, child) as 00, 01, 10, 11.

        Messages go up from the leaves, then down from the root; all are
        scaled to sum to one, so deep trees don't underflow.
        """
        get, nodes, n = self.weights.get, page.nodes, len(page.nodes)
        table = [[[math.exp(v) for v in row] for row in kind] for kind in self.edges]
        up0, up1 = [0.5] * n, [0.5] * n
        for i, names in enumerate(seen):
            u = sum(get(x, 0.0) for x in names)
            up1[i] = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, u))))
            up0[i] = 1.0 - up1[i] or 1e-13
        message: list[tuple[float, float]] = [(0.5, 0.5)] * n
        for i in range(n - 1, 0, -1):
            t, a, b, p = table[_KINDS.get(nodes[i].tag, 0)], up0[i], up1[i], nodes[i].parent
            m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            s = m0 + m1
            message[i] = m0, m1 = m0 / s, m1 / s
            x, y = up0[p] * m0, up1[p] * m1
            s = x + y
            up0[p], up1[p] = x / s, y / s
        down0, down1 = [1.0] * n, [1.0] * n
        out, joint = [up1[0]] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        for i in range(1, n):
            t, p = table[_KINDS.get(nodes[i].tag, 0)], nodes[i].parent
            m0, m1 = message[i]
            q0, q1 = up0[p] * down0[p] / m0, up1[p] * down1[p] / m1  # the parent's belief without this child
            d0, d1 = q0 * t[0][0] + q1 * t[1][0], q0 * t[0][1] + q1 * t[1][1]
            s = d0 + d1
            down0[i], down1[i] = d0 / s, d1 / s
            j = (q0 * t[0][0] * up0[i], q0 * t[0][1] * up1[i], q1 * t[1][0] * up0[i], q1 * t[1][1] * up1[i])
            s = sum(j)
            joint[i] = tuple(x / s for x in j)
            out[i] = joint[i][1] + joint[i][3]
        return out, joint


def train(pages: list[str], passes: int = PASSES, rate: float = 0.3, decay: float = 1e-4) -> TreeModel:
    """Ascend the likelihood of labelled pages (``data-k`` on every element), with steps scaled by past gradients."""
    model = TreeModel()
    parsed = [(p := parse(s, True), features(p)) for s in pages]
    squares: dict[object, float] = {}

    def step(key: object, value: float, g: float) -> float:
        squares[key] = squares.get(key, 1e-2) + g * g
        return value + rate * (g - decay * value) / math.sqrt(squares[key])

    for _ in range(passes):
        for page, seen in parsed:
            p, joint = model.marginals(page, seen)
            labels = [1 if i == 0 or nd.label is None else nd.label for i, nd in enumerate(page.nodes)]
            grads: dict[str, float] = {}
            for i, names in enumerate(seen):
                for x in names:
                    grads[x] = grads.get(x, 0.0) + labels[i] - p[i]
            for x, g in grads.items():
                model.weights[x] = step(x, model.weights.get(x, 0.0), g)
            pair: dict[tuple[int, int, int], float] = {}
            for i in range(1, len(page.nodes)):
                kind, yp, yc = _KINDS.get(page.nodes[i].tag, 0), labels[page.nodes[i].parent], labels[i]
                for k, q in enumerate(joint[i]):
                    at = (kind, k >> 1, k & 1)
                    pair[at] = pair.get(at, 0.0) + ((yp, yc) == at[1:]) - q
            for (kind, a, b), g in pair.items():
                model.edges[kind][a][b] = step((kind, a, b), model.edges[kind][a][b], g)
    return model


# -- labelled pages --------------------------------------------------------

# Names that page authors give to parts, by part.  Fixed values.
_PART_NAMES = {
    "menu": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs tabs toolbar site-nav skip-links pagination pager",
    "header": "header site-header page-header masthead top topbar branding logo banner hero-banner",
    "footer": "footer site-footer page-footer bottom copyright legal colophon credits disclaimer",
    "sidebar": "sidebar side aside widget widgets related related-posts recommended trending popular more-stories secondary rail tags tag-list author-box bio social share share-buttons sharing",
    "notice": "notice cookie-notice cookie-banner cookies consent gdpr privacy-notice alert popup modal overlay newsletter subscribe signup paywall message announcement warning",
    "advert": "ad ads advert advertisement adsense ad-slot banner-ad sponsor sponsored promo promotion promoted outbrain commercial",
    "form": "form search search-form login contact-form poll survey newsletter-form",
    "comments": "comments comment-list comment comment-thread discussion responses replies reader-comments disqus reviews respond feedback",
}
_MAIN_NAMES = "content main main-content article article-body post post-content entry entry-content story story-body text body-text page-content container wrapper page primary prose"
_PART_TAGS = {"menu": "nav div ul section", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section aside dialog p", "advert": "div aside section ins", "form": "form div", "comments": "section div article ol"}


class _Writer:
    """Writes a labelled page from a grammar of parts."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, n: int) -> str:
        r = self.rng
        syllables = ["an", "ber", "co", "der", "en", "for", "gu", "hi", "in", "jo", "ka", "lo", "mi", "ne", "or", "pa", "qui", "re", "st", "tion", "un", "ver", "wi", "ya", "zu", "é", "ß", "ñ"]
        out = ["".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3, 4)))) + r.choice(("", "", "", "", ",", "&amp;", "$$$", " 12")) for _ in range(n)]
        return " ".join(out).capitalize() + r.choice((".", ".", "!", ""))

    def el(self, tag: str, label: int, inner: str, attrs: str = "") -> str:
        return f'<{tag}{attrs} data-k="{label}">{inner}</{tag}>'

    def names(self, pool: str, likely: float) -> str:
        r = self.rng
        if r.random() > likely:
            return ""
        got = r.choice(pool.split())
        got += r.choice(("", "", "", " clearfix", " col-md-8", " js-x", "-1", " block", " inner"))
        return f' {r.choice(("class", "class", "class", "id"))}="{got}"'

    def links(self, n: int) -> str:
        return "".join(self.el("li", 0, f'<a href="/x">{self.words(self.rng.randint(1, 3))}</a>') for _ in range(n))

    def part(self, kind: str) -> str:
        r = self.rng
        tag = r.choice(_PART_TAGS[kind].split())
        telling = tag in ("nav", "header", "footer", "aside", "form", "dialog", "ins")
        attrs = self.names(_PART_NAMES[kind], 0.5 if telling else 1.0)
        p = lambda lo, hi: self.el("p", 0, self.words(r.randint(lo, hi)))
        if kind == "menu":
            inner = self.links(r.randint(2, 9)) if tag == "ul" else self.el("ul", 0, self.links(r.randint(2, 9)))
        elif kind == "header":
            inner = r.choice((self.el("h1", 0, self.words(2)), self.el("div", 0, self.words(3)), f'<a href="/">{self.words(2)}</a>')) + r.choice(("", self.el("ul", 0, self.links(4)), p(3, 8)))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.words(3)} &middot; {self.words(8)}", p(4, 15), self.el("ul", 0, self.links(4)) + p(2, 6)))
        elif kind == "sidebar":
            inner = self.el("h3", 0, self.words(2)) + r.choice((self.el("ul", 0, self.links(5)), p(5, 30), p(5, 20) + p(5, 20)))
        elif kind in ("notice", "advert"):
            inner = r.choice((self.words(r.randint(4, 30)), p(4, 40), self.el("h4", 0, self.words(3)) + p(4, 25) + "<button>OK</button>", f"<span>{self.words(6)}</span>"))
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input name=q>{r.choice(('', p(3, 12)))}<button>{self.words(1)}</button>"
        else:
            one = lambda: self.el(r.choice(("div", "li", "article", "section")), 0, r.choice(("", f"<b>{self.words(1)}</b>", self.el("h4", 0, self.words(2)))) + p(4, 50), self.names("comment reply comment-body response review", 0.8))
            inner = r.choice(("", self.el("h2", 0, self.words(1)), self.el("h3", 0, self.words(2)))) + "".join(one() for _ in range(r.randint(1, 4))) + r.choice(("", "", self.part("form")))
        return self.el(tag, 0, inner, attrs)

    def body(self) -> str:
        """Blocks of main text, now and then with a part among them that isn't."""
        r, out = self.rng, []
        if r.random() < 0.85:
            title = self.el("h1", 1, self.words(r.randint(2, 10)))
            out.append(title if r.random() < 0.85 else self.el("header", 1, title + r.choice(("", self.el("p", 1, self.words(12))))))
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            n = r.choice((1, 2, 4, 9, 20, 40, 80))
            if kind < 0.7:
                text = self.words(n)
                if r.random() < 0.2:
                    text = f'{self.words(3)} <a href="/y">{self.words(2)}</a> {text}'
                out.append(r.choice((self.el("p", 1, text), self.el("p", 1, text), self.el("p", 1, f"<b>{text}</b>"), f'<p data-k="1"><b>{text}<br>', f'<p data-k="1">{text}')))
            elif kind < 0.78:
                out.append(self.el(r.choice(("h2", "h3")), 1, self.words(4)))
            elif kind < 0.85:
                out.append(self.el(r.choice(("ul", "ol")), 1, "".join(self.el("li", 1, self.words(r.randint(1, 15))) for _ in range(3))))
            elif kind < 0.88:
                out.append(self.el("p", 1, self.words(r.randint(3, 12))) + self.el(r.choice(("ul", "ol")), 1, "".join(self.el("li", 1, f'<a href="/z">{self.words(r.randint(1, 6))}</a>') for _ in range(r.randint(2, 5)))))
            elif kind < 0.9:
                out.append(self.el(r.choice(("blockquote", "pre", "div")), 1, self.words(n)))
            elif kind < 0.93:
                out.append(self.el("table", 1, "".join(self.el("tr", 1, self.el("td", 1, self.words(2)) + self.el("td", 1, self.words(2))) for _ in range(2))))
            elif kind < 0.95:
                out.append(self.el("figure", 1, "<img src=x>" + self.el("figcaption", 1, self.words(6))))
            else:
                out.append(self.part(r.choice(("advert", "advert", "sidebar", "notice", "form"))))
        return "".join(out)

    def unnamed(self) -> str:
        """What a page without names has beside its text: a box of links, or a line of imprint."""
        r = self.rng
        if r.random() < 0.5:
            inner = r.choice((" ", " | ", "")).join(f'<a href="/u">{self.words(r.randint(1, 3))}</a>' for _ in range(r.randint(2, 8)))
            return self.el(r.choice(("div", "div", "p", "ul")), 0, inner)
        return self.el(r.choice(("div", "div", "p")), 0, r.choice(("&copy; ", "Copyright ", "(c) ")) + self.words(r.randint(2, 9)))

    def plain(self) -> str:
        """The body of a page that hardly names anything: blocks in it as they are, or in unnamed boxes, maybe in boxes."""
        r = self.rng
        main = self.body()
        for _ in range(r.choice((0, 0, 1, 1, 1, 2))):
            main = self.el(r.choice(("div", "div", "div", "section")), 1, main)
        before = [r.choice((self.unnamed, lambda: self.part(r.choice(("menu", "header", "notice", "advert")))))() for _ in range(r.choice((0, 0, 1, 2)))]
        after = [r.choice((self.unnamed, lambda: self.part(r.choice(("footer", "comments", "sidebar", "form", "advert")))))() for _ in range(r.choice((0, 0, 1, 2, 3)))]
        return "".join(before) + main + "".join(after)

    def page(self) -> str:
        r = self.rng
        some = lambda kind, share: self.part(kind) if r.random() < share else ""
        main = self.el(r.choice(("article", "article", "main", "div", "section")), 1, self.body(), "")
        if not main.startswith(("<article", "<main")) or r.random() < 0.3:
            tag = main[1 : main.index(" ")]
            misleading = tag in ("article", "main") and r.random() < 0.15
            pool = " ".join(_PART_NAMES[k] for k in ("menu", "header", "sidebar", "notice")) if misleading else _MAIN_NAMES
            main = main.replace(f"<{tag} ", f"<{tag}{self.names(pool, 1.0)} ", 1)
        elif r.random() < 0.3:  # the text in a box of the article that bears some other name
            tag = main[1 : main.index(" ")]
            main = self.el(tag, 1, self.el(r.choice(("section", "div")), 1, self.body(), self.names(_PART_NAMES[r.choice(("header", "sidebar", "notice"))], 1.0)))
        if r.random() < 0.4:
            main = self.el(r.choice(("main", "div", "div", "section")), 1, some("menu", 0.1) + main + some("comments", 0.3) + some("sidebar", 0.2), self.names(_MAIN_NAMES, 0.7))
        top = [some("notice", 0.3), some("header", 0.5), some("menu", 0.6), some("advert", 0.4)]
        rest = [some("advert", 0.2), some("sidebar", 0.4), some("form", 0.25), some("comments", 0.4), some("notice", 0.2), some("footer", 0.7)]
        r.shuffle(top)
        shell = "".join(top) + main + "".join(rest)
        if r.random() < 0.12:  # a table for layout: the menu beside the text
            menu = self.el("td", 0, " ".join(f'<a href="/m">{self.words(1)}</a>' for _ in range(r.randint(2, 8))))
            shell = "".join(top) + self.el("table", 1, self.el("tr", 1, menu + self.el("td", 1, self.body()))) + some("footer", 0.7)
        if r.random() < 0.25:
            shell = self.plain()
        if r.random() < 0.2:
            shell = self.el("div", 1, shell, self.names("page wrapper container site root app", 0.9))
        return f'<!DOCTYPE html><html><head data-k="0"><title>{self.words(3)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body data-k="1">{shell}</body></html>'


def labelled_page(seed: int) -> str:
    """A page with ``data-k`` 1 or 0 on every element: part of the main text (or around it) or not."""
    return _Writer(random.Random(seed)).page()


@lru_cache(maxsize=2)
def default_model(pages: int = PAGES, passes: int = PASSES) -> TreeModel:
    """The model trained on ``pages`` labelled pages; the same numbers give the same model."""
    return train([labelled_page(s) for s in range(pages)], passes)


# -- extraction ------------------------------------------------------------


def main_text(source: str, model: TreeModel, threshold: float = THRESHOLD) -> str:
    """The main text of one page: content blocks in page order, joined by one space."""
    page = parse(source)
    p, _ = model.marginals(page, features(page))
    blocks: list[str] = []
    current, parts = -1, []
    for node, block, text in page.pieces:
        if p[node] >= threshold:
            if block != current:
                blocks.append("".join(parts))
                current, parts = block, []
            parts.append(text)
    blocks.append("".join(parts))
    return " ".join(w for b in blocks for w in b.split())


def extract(pages: DataFrame, model: TreeModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html), in one pass without a shuffle."""
    small_batches(pages.sparkSession)
    model = model or default_model()
    fields = [pages.schema[c] for c in ("page_id", "url")]
    schema = StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, model, threshold) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(tidy(work), schema)
