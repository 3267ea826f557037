"""Main text of web pages by wrapper induction.

Pages of one host come from a few templates. Each page's DOM tree is folded (like siblings far from both ends of
a list become one repeated node) and aligned by simple tree matching with a reference tree of its host; blocks
whose text is the same on nearly all differing pages that have them are template, varying blocks are slots.
Slots become content unless their place says otherwise (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments). Counts are taken over all pages.

A host has a reference for each layout (tag paths of the upper levels) that SAME_PAGES of its pages have; pages
of rarer layouts, too few for a template, are aligned with the most common one. Blocks without a partner in the
reference are known by their tag path, so an optional block that the reference lacks can still be found to be
template. Besides, every block is judged by its text within its list (the like children of one folded element),
wherever it stands there: so folding loses no block in the middle of a long list.

What an element's class or id says is evidence only. It never drops the element that holds the article, words
that tell a state (``no-sidebar``, ``menu-open``) say nothing, and inside an article only words that always name
something else count; the others are left to the template.

A null or empty html has an empty text; a page whose host has too few pages is judged by place alone. Html
may be broken: unclosed and stray tags, missing ends and bare ampersands are read as browsers do; a tag cut off
at the end of the page is dropped. Reading is linear in the page's size, matching bounded by the folded sizes. A
null or malformed url has the host "". Repeated rows and ids are read row by row; pages with equal texts count
once for the template, so copies cannot turn an article into template. Blank pages are never references. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages
from .url_filter import split_url

SAME_SHARE, SAME_PAGES, LAYOUT_SHARE = 0.9, 8, 0.3
"""A block is template if its text is equal on SAME_SHARE of the differing pages that have it, on at least
SAME_PAGES of them, and at least LAYOUT_SHARE of the pages of its layout have it. The same holds for a text in a
list, by the pages that have the list."""
LAYOUTS, LAYOUT_DEPTH = 8, 3
"""References of the LAYOUTS most common layouts go to all pages of a host, others to the pages of their layout only."""
ENDS = (6, 3, 1, 0)
MOST_NODES = 600
"""Of like siblings the first and last ENDS stay single; the next smaller number is taken while a folded tree has
more than MOST_NODES nodes. With none single, siblings differ in tag and matching takes linear time."""
BROADCAST_HOSTS = 5_000
BROADCAST_BYTES = 64 << 20
CACHE = 200_000

# HTML element names and the words that mark the parts a reader would not call the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark meter noscript object output picture "
    "progress q rp rt ruby s samp select small span strike strong sub sup template time tt u var video audio svg math map canvas head".split())
NEVER = frozenset(
    "script style noscript template svg math canvas object embed iframe button select input textarea dialog menu head title xmp "
    "noembed noframes video audio map".split())
PLACES = frozenset("nav aside footer form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer comment comments disqus respond replies cookie cookies consent gdpr popup modal newsletter signup "
    "login share sharing social related recommended recommendations pagination pager skip".split())
WEAK = frozenset(
    "banner aside widget notice notices notification alert overlay subscribe subscription promotion teaser toolbar copyright "
    "disclaimer header masthead topbar search".split())
STATE = frozenset(
    "no not non without with has have is in on off open opened close closed show shown hide visible active enabled disabled "
    "collapsed expanded toggled layout free".split())
KNOWN = BLOCK | INLINE | VOID | RAW
"""Element names of HTML; in folded trees all others are alike, so that a list has few kinds of children."""
CLOSED_BY: dict[str, frozenset] = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "tr", "td", "th"]),
}
"""A start tag ends the open elements of these names in the same list or table."""
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
NO_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend title dd dt li summary figcaption".split())
"""Start tags that end an open paragraph."""
WALLS = frozenset(["table", "article", "main"])
"""The end tag of an inline element does not reach beyond these."""

MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)(>?)|[/!?])")
REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+>")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++)))?+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAIN_ROLE = re.compile(r"role\s*+=\s*+[\"']?+main\b", re.I)
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "parts", "folded")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts, self.folded = tag, attrs, [], -1

class OpenElements:
    """The stack of open elements, with the places of each tag, so that no end tag walks along it."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.walls: list[int] = []

    def push(self, node: Node) -> None:
        at, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.places[tag].append(at)
        if tag in BLOCK:
            self.blocks.append(at)
            if tag in WALLS:
                self.walls.append(at)

    def cut(self, at: int) -> None:
        stack, places = self.stack, self.places
        for _ in range(len(stack) - at):
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                if tag in WALLS:
                    self.walls.pop()

    def end(self, tag: str) -> None:
        found = self.places.get(tag)
        if found and (tag in BLOCK or not self.walls or self.walls[-1] <= found[-1]):
            self.cut(found[-1])

    def start(self, tag: str) -> None:
        """Ends what this start tag ends."""
        if tag in NO_P and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        ended = CLOSED_BY.get(tag)
        if ended:
            stop = max((self.places[s][-1] for s in SCOPE.get(tag, ("table",)) if self.places.get(s)), default=0)
            first = [p[i] for t in ended if (p := self.places.get(t)) and (i := bisect_right(p, stop)) < len(p)]
            if first:
                self.cut(min(first))


def parse(text: str) -> Node:
    """The element tree; texts are decoded strings among an element's parts. Linear in the text."""
    elements = OpenElements()
    at, end, last = 0, len(text), text.rfind(">")
    quoted = True  # whether quotes are honoured: until a tag is found whose quotes never close
    while at < end:
        m = MARKUP.search(text, at)
        upto = m.start() if m else end
        if upto > at:
            piece = text[at:upto]
            elements.stack[-1].parts.append(html_lib.unescape(piece) if "&" in piece else piece)
        if not m or upto > last:
            break
        if not m[2]:  # comments, doctypes, instructions and ends of nothing
            if text.startswith("<!--", upto):
                found = COMMENT_END.search(text, upto + 2)
                at = found.end() if found else end
            else:
                at = text.index(">", upto) + 1
            continue
        named = at = m.end()
        if not m[3]:
            rest = REST.match(text, named) if quoted else None
            if rest:
                at = rest.end()
            else:
                quoted, at = False, text.index(">", named) + 1
        tag = m[2].lower()
        if m[1]:
            elements.end(tag)
            continue
        elements.start(tag)
        node = Node(tag, "" if m[3] else text[named:at - 1])
        elements.stack[-1].parts.append(node)
        if tag in RAW:
            close = RAW_END[tag].search(text, at)
            if tag in ("textarea", "title"):
                node.parts.append(html_lib.unescape(text[at:close.start() if close else end]))
            at = close.end() if close else end
        elif tag not in VOID:
            elements.push(node)
    return elements.root


def digest(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "replace")), "big", signed=True)


class Outline:
    """A page's folded tree: ``label`` and ``up`` (parent) of each node, and the hash of each block's text."""

    def __init__(self, root: Node):
        for ends in ENDS:
            members = self._fold(root, ends)
            if len(members) <= MOST_NODES:
                break
        lines = block_lines(root)
        self.blocks = {n: digest(t) for n, t in lines.items()}
        self.hashes: list[int | None] = []
        self.mixed: list[tuple[int, int]] = []  # (node, hash) of each block folded with others
        texts = []
        for i, group in enumerate(members):
            found = [lines[n] for n in group if n in lines]
            texts += found
            same = found and len(found) == len(group) and all(t == found[0] for t in found)
            self.hashes.append(self.blocks[group[0]] if same else None)
            if not same:
                self.mixed += sorted({(i, self.blocks[n]) for n in group if n in lines})
        self.blank = not texts
        self.sig = digest("\n".join(texts))
        paths: list[tuple] = []
        for i, p in enumerate(self.up):
            paths.append((*paths[p], self.label[i]) if p >= 0 and len(paths[p]) <= LAYOUT_DEPTH else paths[p] if p >= 0 else ())
        self.layout = digest(repr(sorted({p for p in paths if p[:1] == ("html",)} or set(paths))))

    def _fold(self, root: Node, ends: int) -> list[list[Node]]:
        self.label, self.up = ["#root"], [-1]
        members = [[root]]
        root.folded = 0
        at = 0
        while at < len(members):
            groups: list[tuple[str, list[Node]]] = []
            own = members[at]
            kids = [(k.tag if k.tag in KNOWN else "#other", k) for n in own for k in n.parts if not isinstance(k, str)]
            if not kids:
                at += 1
                continue
            total = Counter([t for t, _ in kids])
            keep = ends if len(own) == 1 else 0
            seen: dict[str, int] = defaultdict(int)
            middle: dict[str, list[Node]] = {}
            for t, k in kids:
                i = seen[t]
                seen[t] = i + 1
                if i < keep or total[t] - i <= keep or total[t] == 1:
                    groups.append((t, [k]))
                elif t in middle:
                    middle[t].append(k)
                else:
                    middle[t] = [k]
                    groups.append((t, middle[t]))
            for t, g in groups:
                for k in g:
                    k.folded = len(members)
                members.append(g)
                self.label.append(t)
                self.up.append(at)
            at += 1
        return members

    @property
    def shape(self) -> str:
        return " ".join(f"{t}:{p}" for t, p in zip(self.label, self.up, strict=True))


def block_lines(root: Node) -> dict[Node, str]:
    """Text of each block: the strings whose nearest block it is, in a fixed order."""
    found: dict[Node, list[str]] = {}
    todo = [(root, root)]
    while todo:
        n, block = todo.pop()
        if n.tag in NEVER:
            continue
        if n.tag in BLOCK:
            block = n
        for p in reversed(n.parts):
            if not isinstance(p, str):
                todo.append((p, block))
            elif block in found:
                found[block].append(p)
            else:
                found[block] = [p]
    lines = {k: " ".join(" ".join(v).split()) for k, v in found.items()}
    return {k: v for k, v in lines.items() if v}


class Aligner:
    """Simple tree matching of folded trees, with shapes of subtrees and their matches remembered."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.kinds: list[tuple] = []
        self.sizes: list[int] = []
        self.matches: dict[tuple[int, int], tuple[int, list]] = {}

    def shapes(self, label: list[str], up: list[int]) -> tuple[list[int], list[list[int]]]:
        """Shape number and children of each node; parents come before their children."""
        kids: list[list[int]] = [[] for _ in label]
        for i, p in enumerate(up):
            if p >= 0:
                kids[p].append(i)
        shape = [0] * len(label)
        for i in range(len(label) - 1, -1, -1):
            kind = (label[i], tuple(shape[k] for k in kids[i]))
            found = self.ids.get(kind)
            if found is None:
                found = self.ids[kind] = len(self.kinds)
                self.kinds.append(kind)
                self.sizes.append(1 + sum(self.sizes[k] for k in kind[1]))
            shape[i] = found
        return shape, kids

    def middle(self, a: int, b: int) -> tuple[int, int, tuple, tuple]:
        """Children between what is equal at both ends: (equal heads, equal tails, rest of a, rest of b)."""
        x, y = self.kinds[a][1], self.kinds[b][1]
        most = min(len(x), len(y))
        head = next((i for i in range(most) if x[i] != y[i]), most)
        tail = next((i for i in range(most - head) if x[-1 - i] != y[-1 - i]), most - head)
        return head, tail, x[head:len(x) - tail], y[head:len(y) - tail]

    def match(self, a: int, b: int) -> tuple[int, list]:
        """Size of the best order-preserving match of two trees with equal roots, and the matched children."""
        if a == b:
            return self.sizes[a], [(i, i) for i in range(len(self.kinds[a][1]))]
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.matches:
                todo.pop()
                continue
            head, tail, mx, my = self.middle(x, y)
            ahead = {(p, q) for p in set(mx) for q in set(my) if p != q and self.kinds[p][0] == self.kinds[q][0] and (p, q) not in self.matches}
            if ahead:
                todo += ahead
            else:
                self.matches[x, y] = self._best(x, head, tail, mx, my, len(self.kinds[y][1]))
                todo.pop()
        return self.matches[a, b]

    def _best(self, a: int, head: int, tail: int, mx: tuple, my: tuple, size_b: int) -> tuple[int, list]:
        def weight(p, q):
            return self.sizes[p] if p == q else self.matches[p, q][0] if self.kinds[p][0] == self.kinds[q][0] else 0

        table = [[0] * (len(my) + 1)]
        for p in mx:
            above, row = table[-1], [0]
            for j, q in enumerate(my):
                row.append(max(above[j + 1], row[j], above[j] + weight(p, q)))
            table.append(row)
        i, j, between = len(mx), len(my), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                between.append((head + i, head + j))
        x = self.kinds[a][1]
        pairs = [(k, k) for k in range(head)] + between[::-1] + [(len(x) - k, size_b - k) for k in range(tail, 0, -1)]
        ends = sum(self.sizes[x[k]] for k in [*range(head), *range(len(x) - tail, len(x))])
        return 1 + ends + table[-1][-1], pairs

    def partners(self, page: tuple[list[str], list[int]], other: tuple[list[str], list[int]]) -> list[int]:
        """For each node of ``page`` its partner in ``other``, or -1."""
        if len(self.kinds) > CACHE or len(self.matches) > CACHE:
            self.__init__()
        (a, ka), (b, kb) = self.shapes(*page), self.shapes(*other)
        out, todo = [-1] * len(a), [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            todo += [(ka[x][i], kb[y][j]) for i, j in self.match(a[x], b[y])[1]]
        return out


def read_shape(shape: str) -> tuple[list[str], list[int]]:
    label, up = zip(*(x.rsplit(":", 1) for x in shape.split(" ")), strict=True)
    return list(label), list(map(int, up))


def path_keys(label: list[str], up: list[int]) -> list[int]:
    """A number below -1 for each node's tag path."""
    paths: list[int] = []
    for t, p in zip(label, up, strict=True):
        paths.append(digest(f"{paths[p] if p >= 0 else ''}/{t}"))
    return [-2 - (h & (1 << 62) - 1) for h in paths]


def list_keys(label: list[str], up: list[int], keys: list[int]) -> list[int]:
    """A number below -1 for each node's list: its parent's key and its tag."""
    hashes = [digest(f"list {keys[p] if p >= 0 else ''}/{t}") for t, p in zip(label, up, strict=True)]
    return [-2 - (h & (1 << 62) - 1) for h in hashes]


class Wrappers:
    """References of hosts (JSON as the tables hold it), and the alignment of outlines with them."""

    def __init__(self):
        self.aligner, self.known = Aligner(), {}

    def of(self, bundle: str) -> list[dict]:
        if bundle not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[bundle] = [dict(r, tree=read_shape(r["shape"])) for r in sorted(json.loads(bundle), key=lambda r: r["r"])]
        return self.known[bundle]

    def place(self, bundle: str, layout: int, label: list[str], up: list[int]) -> tuple[dict, list[int]]:
        """The reference for a layout, and each node's key: its partner's number, or a number for its path."""
        refs = self.of(bundle)
        ref = next((r for r in refs if r["layout"] == layout), refs[0])
        partner = self.aligner.partners((label, up), ref["tree"])
        return ref, [p if p >= 0 else k for p, k in zip(partner, path_keys(label, up), strict=True)]


def marks(n: Node) -> str:
    """What an element's tag and attributes say: never, place, strong, weak, or nothing."""
    if n.tag in NEVER:
        return "never"
    said = "place" if n.tag in PLACES else "weak" if n.tag == "header" else ""
    if not n.attrs or n.tag in ("html", "body") or not TELLING.search(n.attrs):
        return said
    for m in ATTRIBUTE.finditer(n.attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return "never"
        if name == "role" and value.lower() in ROLES:
            said = "place"
        elif name in ("class", "id") and n.tag not in ("article", "main"):
            for token in value.split():
                words = {w.lower() for w in WORD.findall(CAMEL.sub(" ", token))}
                if words & STATE:
                    continue
                if words & STRONG:
                    said = said if said == "place" else "strong"
                elif words & WEAK:
                    said = said or "weak"
        elif name in ("class", "id") and not said:
            words = {w.lower() for w in WORD.findall(CAMEL.sub(" ", value))}
            if words & {"comment", "comments", "teaser", "related", "ad", "ads", "promo"}:
                said = "strong"
    return said


def is_article(n: Node) -> str:
    if n.tag in ("article", "main"):
        return n.tag
    if not n.attrs:
        return ""
    return "article" if "articlebody" in n.attrs.lower() else "main" if MAIN_ROLE.search(n.attrs) else ""


H1, ARTICLE = 1, 2
"""What an element holds: a main heading, an article or main element."""


class Judge:
    """Places of a page: what each element says, and how much text, headings and articles it holds."""

    def __init__(self, root: Node):
        self.said: dict[Node, str] = {}
        self.size: dict[Node, int] = {}
        self.holds: dict[Node, int] = {}
        order, todo = [], [(root, -1)]
        while todo:
            n, up = todo.pop()
            self.said[n] = said = marks(n)
            at = len(order)
            order.append((n, up))
            if said != "never":
                todo += [(p, at) for p in n.parts if not isinstance(p, str)]
        size, holds = [0] * len(order), [0] * len(order)
        for i in range(len(order) - 1, -1, -1):
            n, up = order[i]
            if self.said[n] != "never":
                size[i] += sum(len(p.strip()) for p in n.parts if isinstance(p, str))
                holds[i] |= H1 if n.tag == "h1" else ARTICLE if is_article(n) else 0
                if up >= 0:
                    size[up] += size[i]
                    holds[up] |= holds[i]
            self.size[n], self.holds[n] = size[i], holds[i]
        self.whole = size[0]

    def drops(self, n: Node, inside: bool) -> bool:
        """Whether an element isn't the article's text by its place."""
        said = self.said[n]
        if said in ("", "never"):
            return bool(said)
        if inside and said == "weak":
            return False
        holds, most = self.holds[n], 2 * self.size[n] > self.whole
        if not inside and holds & ARTICLE:
            return False
        return not (most and not inside and (n.tag == "form" or said == "weak" and n.tag != "header" or said == "strong" and holds & H1))


def main_root(root: Node, judge: Judge) -> Node:
    """The article outside dropped parts (of several the one with the heading, then with most text); else the
    main element; else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        n = todo.pop()
        if judge.drops(n, False):
            continue
        kind = is_article(n)
        if kind:
            found[kind].append(n)
        if kind != "article":
            todo += [p for p in reversed(n.parts) if not isinstance(p, str)]
    some = found["article"] or found["main"]
    return max(some, key=lambda n: (judge.holds[n] & H1, judge.size[n])) if some else root


def text_of(root: Node, template: set[Node | int] = frozenset()) -> str:
    """Blocks of the content in page order; ``template`` holds elements, or numbers of folded nodes, whose own text
    isn't content."""
    judge = Judge(root)
    top = main_root(root, judge)
    inside = top is not root
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        joined = " ".join("".join(line).split())
        if joined:
            blocks.append(joined)
        line.clear()

    todo: list = [(top, False)]
    while todo:
        n, fixed = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            if not fixed:
                line.append(n)
        elif n is not top and judge.drops(n, inside):
            if n.tag in BLOCK:
                flush()
        elif n.tag == "br":
            line.append(" ")
        else:
            if n.tag in BLOCK or n is root:
                flush()
                todo.append((None, False))
                fixed = n in template or n.folded in template
            # inline elements belong to the text of their block
            todo += [(p, fixed) for p in reversed(n.parts)]
    flush()
    return "\n".join(blocks)


def outlines(rows: DataFrame) -> DataFrame:
    """``_host, _page, layout, key, sig, shape, hashes, mixed`` of each page that isn't blank."""
    names = ["_host", "_page", "layout", "key", "sig", "shape", "hashes", "mixed"]
    pair = pa.list_(pa.struct([("node", pa.int64()), ("hash", pa.int64())]))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pair]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, known, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                o = Outline(parse(page))
                if not o.blank:
                    mixed = [{"node": n, "hash": h} for n, h in o.mixed]
                    out.append((host, known, o.layout, digest(page), o.sig, o.shape, o.hashes, mixed))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = "_host string, _page string, layout long, key long, sig long, shape string, hashes array<long>, mixed array<struct<node:long,hash:long>>"
    return rows.select("_host", "_page", "_html").mapInArrow(run, kind)


def references(pages: DataFrame) -> DataFrame:
    """``_host, r, layout, shape, own``: for the most common layout of a host and each that SAME_PAGES pages have, the
    page with the smallest hash, whatever the order of rows. ``own`` is the layout if r > LAYOUTS, else null."""
    each = pages.groupBy("_host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "shape")).alias("m"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("_host").orderBy(F.desc("n"), "layout")))
    own = F.when(F.col("r") > LAYOUTS, F.col("layout")).alias("own")
    return each.where((F.col("r") == 1) | (F.col("n") >= SAME_PAGES)).select("_host", "r", "layout", F.col("m.shape").alias("shape"), own)


def bundled(refs: DataFrame, stages: Stages, *more: str) -> DataFrame:
    """``_bhost, _bown, _bundle``: a host's references as JSON, those with ``own`` each by itself; marked for broadcast
    if rows and bytes are few, else joined by shuffle, where Spark splits hosts with very many pages."""
    df = stages.put(refs.groupBy(F.col("_host").alias("_bhost"), F.col("own").alias("_bown")).agg(
        F.to_json(F.collect_list(F.struct("r", "layout", "shape", *more))).alias("_bundle")))
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.length("_bundle"))).first()
    return F.broadcast(df) if n <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_BYTES else df


def with_bundle(rows: DataFrame, bundles: DataFrame, rest: DataFrame | None, how: str, *by: str) -> DataFrame:
    """``rows`` with the bundle of their host, or of their own layout where ``rest`` (*by, own) has it."""
    if rest is None:
        return rows.join(bundles.where("_bown is null"), F.col("_host") == F.col("_bhost"), how)
    rows = rows.join(rest, list(by), "left")
    return rows.join(bundles, (F.col("_host") == F.col("_bhost")) & F.col("own").eqNullSafe(F.col("_bown")), how)


def templates(pages: DataFrame, refs: DataFrame, known: DataFrame, rest: DataFrame | None, stages: Stages) -> DataFrame:
    """``_host, r, layout, shape, own, same``: references with the blocks that are constant, as (node or list, text
    hash). A page counts once for each text in a list; ``first`` marks one of them, so its sum counts pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = Wrappers()
        found = pa.list_(pa.struct([("node", pa.int64()), ("hash", pa.int64()), ("first", pa.int64())]))
        for batch in batches:
            at, nodes = [], []
            for layout, shape, hashes, mixed, bundle in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                tree = read_shape(shape)
                ref, keys = wrappers.place(bundle, layout, *tree)
                single = [(i, h) for i, h in enumerate(hashes) if h is not None]
                lists = list_keys(*tree, keys)
                inside = sorted({(lists[i], h) for i, h in [*single, *((x["node"], x["hash"]) for x in mixed)]})
                at.append(ref["r"])
                nodes.append([{"node": -1, "hash": 0, "first": 1}] + [{"node": keys[i], "hash": h, "first": 1} for i, h in single] + [
                    {"node": k, "hash": h, "first": int(not i or inside[i - 1][0] != k)} for i, (k, h) in enumerate(inside)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(nodes, found)], names=["_host", "r", "nodes"])

    seen = with_bundle(pages.dropDuplicates(["_host", "sig"]), known, rest, "inner", "_host", "layout")
    seen = seen.select("_host", "sig", "layout", "shape", "hashes", "mixed", "_bundle")
    rows = seen.mapInArrow(run, "_host string, r int, nodes array<struct<node:long,hash:long,first:long>>").select("_host", "r", F.explode("nodes").alias("x"))
    counts = stages.put(rows.groupBy("_host", "r", "x.node", "x.hash").agg(F.count(F.lit(1)).alias("n"), F.sum("x.first").alias("first")))
    every = counts.groupBy("_host", "r", "node").agg(F.sum("first").alias("all"))
    of_layout = every.where("node = -1").select("_host", "r", F.col("all").alias("pages"))
    often = counts.where((F.col("node") != -1) & (F.col("n") >= SAME_PAGES)).join(every, ["_host", "r", "node"]).join(of_layout, ["_host", "r"])
    often = often.where((F.col("n") >= SAME_SHARE * F.col("all")) & (F.col("all") >= LAYOUT_SHARE * F.col("pages")))
    return refs.join(often.groupBy("_host", "r").agg(F.collect_list(F.struct("node", "hash")).alias("same")), ["_host", "r"], "left")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: ``<id>, <url>, text, n_chars``."""
    stages = Stages(pages.sparkSession)
    host, _ = split_url(F.col(url))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), host.alias("_host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    rows = rows.withColumn("_page", F.md5("_html"))
    seen = stages.put(outlines(rows))
    refs = stages.put(references(seen))
    rest = refs.where("own is not null").select("_host", "layout", "own")
    rest = None if rest.isEmpty() else rest
    found = stages.put(templates(seen, refs, bundled(refs, stages), rest, stages))
    # hosts without any constant block need no alignment
    some = found.where("size(same) > 0").select("_host").distinct()
    wrappers = bundled(found.join(some, "_host", "left_semi"), stages, "same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wrappers()
        for batch in batches:
            texts = []
            for page, bundle in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tree = parse(page)
                texts.append(text_of(tree, template_nodes(tree, bundle, known) if bundle else frozenset()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url, "text", "n_chars"])

    # a page's layout is known by its html's digest
    own = None if rest is None else seen.join(rest, ["_host", "layout"]).select("_host", "_page", "own").dropDuplicates(["_host", "_page"])
    joined = with_bundle(rows, wrappers, own, "left", "_host", "_page").select("_id", "_url", "_html", "_bundle")
    kind = rows.schema["_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url}` string, text string, n_chars long")


def template_nodes(tree: Node, bundle: str, known: Wrappers) -> set[Node]:
    """Elements of a page whose own text is the template's."""
    o = Outline(tree)
    if o.blank:
        return set()
    ref, keys = known.place(bundle, o.layout, o.label, o.up)
    same = {(x["node"], x["hash"]) for x in ref.get("same") or ()}
    lists = list_keys(o.label, o.up, keys)
    return {n for n, h in o.blocks.items() if (lists[n.folded], h) in same or o.hashes[n.folded] == h and (keys[n.folded], h) in same}
