"""HTML extraction: a tree-structured graphical model over DOM nodes, solved by sum-product messages.

Every element is a node with two states, content or not. Its evidence is a set of discrete features (tag,
words of its class, id and role, link density, text length); each edge couples a child's state
with its parent's through a table for the child's kind of element. Messages pass upward from the leaves and
downward from the root, which gives every node's exact marginal. Text whose element is content with more than
half the mass is kept. Evidence and tables are smoothed counts from labelled pages; make_pages() writes such
pages by rules of its own, from no text of the corpus.

Scripts, styles, comments, forms and the like hold no text at all. Decoded character references and white
space follow the contract: runs of white space inside a block are one space, blocks are trimmed and joined by
one newline, empty blocks vanish.

The parser reads a page once, whatever its tags: what it must know of the open elements it keeps in stacks. A
tag ends at the first > outside quotes. If one tag of a page never does, this and all later tags of the page end
at the first >; where there is none, the rest is text.

Defined cases: null or empty html gives the empty text; unclosed and stray tags are repaired; repeated rows
are extracted one by one; nothing is cut from long pages; an element is kept if its mass is above one half, so
a tie is dropped; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe template svg select option button".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body html caption tbody td tfoot th thead tr".split())
#: Open elements that a new one of the same kind ends, and those that keep it from looking further up.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "inner", "link", "names", "own", "parent", "tag")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...] = ()) -> None:
        self.tag, self.parent, self.names = tag, parent, names
        self.own = self.inner = self.link = 0  # letters of its own text, of all below, and of links below
        self.children = 0


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, slash, name, attributes) of each piece of markup; the name of a comment and the like is empty.

    Whoever reads may send a place from which to go on.
    """
    at, size, quoted = 0, len(page), True
    while True:
        begin = page.find("<", at)
        if begin < 0:
            return
        follow = page[begin + 1 : begin + 4]
        slash = name = attributes = ""
        if follow == "!--":
            end = page.find("-->", begin + 4)
            end = size if end < 0 else end + 3
        elif follow[:1] in ("!", "?"):
            end = page.find(">", begin) + 1
            if not end:
                return  # no tag can end any more
        else:
            m = _NAME.match(page, begin + 1)
            if m is None:
                at = begin + 1
                continue
            close = _TAG_END.match(page, m.end()) if quoted else None
            if close is None:
                quoted = False
                end = page.find(">", m.end()) + 1
                if not end:
                    return
            else:
                end = close.end()
            slash, name, attributes = m[1], m[2].lower(), page[m.end() : end - 1]
        at = (yield begin, end, slash, name, attributes) or end


def unescape(text: str) -> str:
    """Character references decoded; numbers too long for a code point give the replacement character."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """Nodes, parents first, and in page order what they hold: (node, text, whether it only marks a block's edge)."""
    nodes, runs = [Node("#root", -1)], []
    path = [0]
    depths: dict[str, list[int]] = defaultdict(list)  # where each tag's open elements stand on the path
    blocks: list[int] = []  # where the open blocks do
    endless: set[str] = set()  # raw elements that don't end on the rest of the page

    def text(a: int, b: int) -> None:
        if b > a:
            k = path[-1]
            runs.append((k, unescape(page[a:b]), False))
            nodes[k].own += b - a

    def leave(depth: int) -> None:
        while len(path) > depth:
            k = path.pop()
            tag = nodes[k].tag
            depths[tag].pop()
            if tag in _BLOCK:
                blocks.pop()
                runs.append((k, "", True))

    def innermost(tags: set[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    at = 0
    pieces = markup(page)
    go_on = None
    while True:
        try:
            begin, end, slash, tag, attributes = pieces.send(go_on)
        except StopIteration:
            break
        go_on = None
        text(at, begin)
        at = end
        if not tag:
            continue
        if slash:
            if depths.get(tag):
                leave(depths[tag][-1])
            continue
        if tag in _ENDS_P and blocks and nodes[path[blocks[-1]]].tag == "p":
            leave(blocks[-1])
        if tag in _ENDED_BY:
            near = innermost(_ENDED_BY[tag])
            if near > innermost(_FENCE[tag]):
                leave(near)
        if tag in ("body", "head") and depths.get(tag):
            continue
        if tag == "body" and depths.get("head"):
            leave(depths["head"][-1])
        names: tuple[str, ...] = ()
        if attributes and not attributes.isspace():
            names = tuple(w for a in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower()))
        if tag in _VOID:
            runs.append((path[-1], " ", tag == "hr"))
            continue
        k = len(nodes)
        nodes.append(Node(tag, path[-1], names))
        nodes[path[-1]].children += 1
        if tag in _BLOCK:
            runs.append((k, "", True))
        if tag in _RAW:  # its text is nobody's
            if attributes.rstrip().endswith("/"):
                continue
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*+>", re.IGNORECASE).search(page, at)
            if close is None:
                endless.add(tag)
                if tag in ("script", "style"):
                    at = len(page)
                    break
            else:
                at = go_on = close.end()
            continue
        depths[tag].append(len(path))
        if tag in _BLOCK:
            blocks.append(len(path))
        path.append(k)
    text(at, len(page))
    leave(1)
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        n.inner += n.own
        if n.tag == "a":
            n.link = n.inner
        up = nodes[n.parent]
        up.inner += n.inner
        up.link += n.link
    return nodes, runs


def features(n: Node) -> list[str]:
    out = [f"tag:{n.tag}"]
    out += [f"name:{w}" for w in dict.fromkeys(n.names)]
    out.append(f"link:{0 if not n.inner else 1 + min(3, 4 * n.link // n.inner)}")
    if n.own:
        out.append(f"own:{min(4, n.own.bit_length() // 2)}")
    return out


def edge_kind(n: Node) -> str:
    return n.tag if n.tag in _BLOCK or n.tag in _RAW or n.tag == "a" else "inline"


class Model:
    """Log potentials from smoothed counts over labelled trees."""

    def __init__(self, smooth: float = 0.5) -> None:
        self.smooth = smooth
        self.feature: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.state = [0.0, 0.0]
        self.edge: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
        self.evidence: dict[str, tuple[float, float]] = {}
        self.coupling: dict[str, tuple[float, float, float, float]] = {}

    def see(self, nodes: list[Node], labels: list[int]) -> None:
        for k in range(1, len(nodes)):
            n, y = nodes[k], labels[k]
            self.state[y] += 1
            for f in features(n):
                self.feature[f][y] += 1
            self.edge[edge_kind(n)][2 * labels[n.parent] + y] += 1

    def fit(self) -> Model:
        s = self.smooth
        self.evidence = {f: tuple(math.log((c[y] + s) / (self.state[y] + 2 * s)) for y in (0, 1)) for f, c in self.feature.items()}
        for kind, c in [*self.edge.items(), ("", [sum(c[i] for c in self.edge.values()) for i in range(4)])]:
            self.coupling[kind] = tuple((c[2 * p + y] + s) / (c[2 * p] + c[2 * p + 1] + 2 * s) for p in (0, 1) for y in (0, 1))
        self.feature, self.edge = {}, {}
        return self

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content, by one pass upward and one downward."""
        n = len(nodes)
        own0, own1 = [1.0] * n, [1.0] * n
        seen: dict[tuple, float] = {}
        for k in range(1, n):
            key = tuple(features(nodes[k]))
            ratio = seen.get(key)
            if ratio is None:
                d = sum(e[1] - e[0] for e in map(self.evidence.get, key) if e is not None)
                ratio = seen[key] = math.exp(max(-30.0, min(30.0, d)))
            own0[k], own1[k] = 1 / (1 + ratio), ratio / (1 + ratio)
        own0[0], own1[0] = 1.0, 1e-6
        table = [self.coupling.get(edge_kind(x), self.coupling[""]) for x in nodes]
        up0, up1 = [1.0] * n, [1.0] * n  # message from each node to its parent
        in0, in1 = own0[:], own1[:]  # evidence times all messages from below
        for k in range(n - 1, 0, -1):
            a, b = in0[k], in1[k]
            t = table[k]
            u0, u1 = t[0] * a + t[1] * b, t[2] * a + t[3] * b
            z = u0 + u1
            up0[k], up1[k] = u0 / z, u1 / z
            p = nodes[k].parent
            x, y = in0[p] * up0[k], in1[p] * up1[k]
            z = x + y
            in0[p], in1[p] = max(x / z, 1e-300), max(y / z, 1e-300)
        out = [0.0] * n
        full0, full1 = in0, in1
        for k in range(n):
            if k:
                p = nodes[k].parent
                t = table[k]
                q0, q1 = full0[p] / up0[k], full1[p] / up1[k]  # the parent's belief without this branch
                d0, d1 = t[0] * q0 + t[2] * q1, t[1] * q0 + t[3] * q1
                x, y = in0[k] * d0, in1[k] * d1
                z = x + y
                full0[k], full1[k] = max(x / z, 1e-300), max(y / z, 1e-300)
            out[k] = full1[k] / (full0[k] + full1[k])
        return out


def extract(page: str, model: Model, least: float = 0.5) -> str:
    nodes, runs = parse(page)
    content = model.marginals(nodes)
    blocks: list[str] = []
    open_: list[str] = []
    for k, text, edge in runs:
        if edge:
            blocks.append("".join(open_))
            open_ = []
        elif content[k] > least:
            open_.append(text)
        elif text.isspace():
            open_.append(" ")
    blocks.append("".join(open_))
    return "\n".join(b for b in (_WHITE.sub(" ", x).strip() for x in blocks) if b)


# ---- labelled pages -----------------------------------------------------------------------------------

_WRAP = [("article", ""), ("article", "post"), ("main", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry-content main"), ("section", "story text"), ("div", "content")]
_JUNK = [
    ("nav", ""), ("nav", "menu"), ("div", "nav navbar"), ("ul", "menu"), ("header", ""), ("header", "site-header"), ("div", "header masthead"), ("footer", ""), ("div", "footer copyright"),
    ("aside", ""), ("div", "sidebar"), ("aside", "related widget"), ("div", "ad"), ("div", "ads advert banner"), ("div", "sponsored promo"), ("div", "cookie notice"), ("div", "notice alert"),
    ("div", "newsletter subscribe"), ("form", "search"), ("form", ""), ("section", "comments"), ("div", "comment-list comments"), ("div", "comment reply"), ("ol", "comments"), ("div", "share social"),
    ("div", "breadcrumb"), ("p", "ad"), ("p", "notice"), ("div", "popup modal"), ("div", "login"), ("div", "pagination"), ("div", "author-box bio"),
]


def make_pages(n: int, seed: int = 7) -> list[tuple[list[Node], list[int]]]:
    """n labelled trees, written by rules: a main part among menus, notices, adverts, comments and the like."""
    r = random.Random(seed)
    return [_make_page(r) for _ in range(n)]


def _make_page(r: random.Random) -> tuple[list[Node], list[int]]:
    out: list[str] = []
    marks: list[int] = []  # the label of each element in the order of its start tag

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) for _ in range(r.randint(lo, hi)))

    def element(tag: str, y: int, body: Callable[[], None], names: str = "") -> None:
        marks.append(y)
        out.append(f"<{tag}" + (f' class="{names}"' if names else "") + ">")
        body()
        out.append(f"</{tag}>")

    def say(t: str) -> Callable[[], None]:
        return lambda: out.append(t)

    def links(k: int) -> None:
        for _ in range(k):
            element("li", 0, lambda: element("a", 0, say(words(1, 3))))

    def junk_body(tag: str, names: str) -> None:
        kind = r.random()
        if tag in ("ul", "ol") and "comment" not in names:
            links(r.randint(1, 8))
        elif tag == "ol" or "comment" in names:
            for _ in range(r.randint(1, 4)):
                element("li" if tag == "ol" else r.choice(["div", "p"]), 0, lambda: element("p", 0, say(words(2, 60) + ".")) if r.random() < 0.6 else out.append(words(2, 60) + "."), r.choice(["", "comment"]))
        elif kind < 0.35 or tag == "nav":
            element("ul", 0, lambda: links(r.randint(1, 8)))
        elif kind < 0.6:
            element("p", 0, say(words(1, 30) + r.choice([".", "!", ""])))
        elif kind < 0.7:
            element(r.choice(["h2", "h3", "h4"]), 0, say(words(1, 4)))
            element("p", 0, say(words(2, 30)))
        else:
            out.append(words(1, 25) + r.choice([".", ""]))

    def junk() -> None:
        tag, names = r.choice(_JUNK)
        element(tag, 0, say(words(1, 25)) if tag == "p" else lambda: junk_body(tag, names), names)

    def inline() -> None:
        out.append(words(0, 12))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            element(r.choice(["b", "i", "em", "strong", "a", "span", "code", "a", "b"]), 1, say(words(1, 6)))
            out.append(words(0, 12))

    def paragraph() -> None:
        kind = r.random()
        if kind < 0.75:
            element("p", 1, inline if r.random() < 0.4 else say(words(1, 90) + "."))
        elif kind < 0.82:
            element(r.choice(["ul", "ol"]), 1, lambda: [element("li", 1, inline if r.random() < 0.5 else say(words(1, 25))) for _ in range(r.randint(1, 5))])
        elif kind < 0.88:
            element("blockquote", 1, say(words(3, 40)) if r.random() < 0.5 else lambda: element("p", 1, say(words(3, 40))))
        elif kind < 0.91:
            element("pre", 1, say(words(3, 20)))
        elif kind < 0.94:
            element("table", 1, lambda: [element("tr", 1, lambda: [element("td", 1, say(words(1, 4))) for _ in range(2)]) for _ in range(r.randint(1, 4))])
        elif kind < 0.97:
            element("figure", 1, lambda: element("figcaption", 1, say(words(2, 12))))
        else:
            element("div", 1, say(words(1, 60) + "."))

    def main() -> None:
        head = r.random() < 0.85
        if head:
            element("h1", 1, say(words(1, 12)))
        for _ in range(r.randint(1, 10)):
            if r.random() < 0.15:
                element(r.choice(["h2", "h3"]), 1, say(words(1, 8)))
            paragraph()
            if r.random() < 0.06:
                junk()

    def body() -> None:
        for _ in range(r.randint(1, 4)):
            junk()
        tag, names = r.choice(_WRAP)
        if r.random() < 0.3:
            # a wrapper that holds the main part and its surroundings
            def mixed() -> None:
                element(tag, 1, main, names)
                for _ in range(r.randint(0, 3)):
                    junk()
            element(r.choice(["div", "section", "main"]), 0, mixed, r.choice(["", "wrapper", "container", "page", "layout"]))
        else:
            element(tag, 1, main, names)
        for _ in range(r.randint(0, 4)):
            junk()

    def page() -> None:
        element("head", 0, lambda: element("title", 0, say(words(1, 9))))
        element("body", 0, body)

    element("html", 0, page)
    nodes, _ = parse("".join(out))
    if len(nodes) != len(marks) + 1:
        raise AssertionError("a made page must be read back as it was written")
    return nodes, [0, *marks]


#: Pages that the model is trained on.
TRAINING_PAGES = 1500


def train(pages: int = TRAINING_PAGES, seed: int = 7) -> Model:
    m = Model()
    for nodes, labels in make_pages(pages, seed):
        m.see(nodes, labels)
    return m.fit()


FIELDS = [("text", T.StringType()), ("n_chars", T.LongType())]


def extract_pages(df: DataFrame, keep: list[str], page: str = "html", model: Model | None = None, least: float = 0.5) -> DataFrame:
    """Columns `keep`, text and n_chars for every row."""
    found = model or train()

    def make() -> Callable:
        def f(pages: list[bytes | None]) -> list[list]:
            texts = [extract(str(p or b"", "utf-8", "replace"), found, least) for p in pages]
            return [texts, list(map(len, texts))]

        return f

    return common.per_row(df, make, FIELDS, keep, page)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
