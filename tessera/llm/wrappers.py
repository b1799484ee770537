"""Page wrappers by union-free regular expressions.

The token streams of pages of one host are aligned one after another. Where they
differ, text becomes a slot; a stretch of tags that only some pages have becomes
an optional group; a stretch that stands several times in a row becomes a
repeated group. What results is a wrapper: a sequence of tags, constant texts,
slots, optional and repeated groups, without unions.

A wrapper tells which tag paths hold the article (the region with most varying
text outside of page furniture). It is made of all pages of the host, and which texts
are constant is counted over all of them. Pages are then read whole with what it tells.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections import Counter
from difflib import SequenceMatcher

#: HTML elements without content, with raw content, that don't part
#: blocks, that hold page furniture, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
FURNITURE = frozenset("nav header footer aside form button select option menu dialog script style noscript template svg math iframe object textarea title head figure-nav".split())
ENDS_P = frozenset("address article aside blockquote body div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul html".split())
#: Words of class, id and role names that mark page furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup "
    "promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets alert warning toc disclaimer".split()
)
#: Words that stand beside those in the id of page furniture. A heading's id
#: that has other words too ("related-work") is an anchor.
BESIDE = frozenset("area articles bar block bottom box button container content form item items left links list main page panel posts right section site top us widget wrap wrapper".split())
REGION_TAGS = frozenset({"article", "main"})

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")

#: Elements whose names a path holds; those further in share the path.
DEEPEST = 200

#: A text is constant if it stands on this share of a host's different pages, and on so many.
CONSTANT_SHARE = 0.9
CONSTANT_PAGES = 3

TEXT, OPEN, CLOSE = "t", "o", "c"


def furniture(tag: str, attrs: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attrs:
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name = name.lower()
        words = [w for w in re.split(r"[^a-z]+", (a or b or c).lower()) if w]
        if name in ("class", "role") and any(w in MARKS for w in words) or name == "id" and any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
            return True
        if name == "aria-hidden" and (a or b or c).lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (a or b or c).lower()):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs)) and "hidden" not in {n.lower() for n, *_ in ATTR.findall(attrs) if n.lower() != "hidden"}


def tokens(page: str):
    """(kind, tag, attributes or text): tags in lower case, text still encoded.
    Raw elements' content is skipped."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield TEXT, "", page[at:]
            return
        if m.start() > at:
            yield TEXT, "", page[at : m.start()]
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                yield TEXT, "", m[0][9:].removesuffix("]]>")
            continue
        tag = tag.lower()
        if m["end"]:
            yield CLOSE, tag, ""
            continue
        attrs = m["attrs"] or ""
        yield OPEN, tag, attrs
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if close is None:
                if tag in ("script", "style", "textarea", "title"):  # goes on to the end, as in browsers
                    return
            else:
                at = close.end()
                yield CLOSE, tag, ""
        elif tag in VOID or attrs.endswith("/"):
            yield CLOSE, tag, ""


class Piece:
    """A text with its place: path of open elements, block number, furniture or not."""

    __slots__ = ("block", "bad", "path", "text")

    def __init__(self, text, path, block, bad):
        self.text, self.path, self.block, self.bad = text, path, block, bad


def pieces(page: str) -> list[Piece]:
    """All texts in page order. Unclosed elements end with the element around them;
    a stray end tag ends nothing."""
    stack: list[tuple[str, bool]] = []
    opened: Counter = Counter()
    path, bad, block = "", False, 0
    paths: list[tuple[str, bool]] = []
    out: list[Piece] = []
    for kind, tag, more in tokens(page):
        if kind == TEXT:
            out.append(Piece(more, path, block, bad))
            continue
        if tag not in INLINE:
            block += 1
        if kind == OPEN:
            if tag in ENDS_P:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in INLINE:
                    k -= 1
                if k >= 0 and stack[k][0] == "p":
                    path, bad = paths[k]
                    opened.subtract(x for x, _ in stack[k:])
                    del stack[k:], paths[k:]
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        path, bad = paths[k]
                        opened.subtract(x for x, _ in stack[k:])
                        del stack[k:], paths[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "table", "tbody", "dl", "select", "article", "div"):
                        break
            paths.append((path, bad))
            stack.append((tag, bad))
            opened[tag] += 1
            if tag not in INLINE and len(stack) <= DEEPEST:
                path = f"{path}/{tag}"
            # The page's own <header> holds menus; an article's may hold its title.
            bad = bad or (furniture(tag, more) and not (tag == "header" and "/article" in path and not re.search(r"class|id", more)))
        elif opened[tag]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    path, bad = paths[k]
                    opened.subtract(x for x, _ in stack[k:])
                    del stack[k:], paths[k:]
                    break
    return out


def squeeze(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def raw_blocks(page: str) -> list[tuple[str, str, bool]]:
    """(path, text as it stands, furniture) of each block."""
    out: list[tuple[str, str, bool]] = []
    block, texts, where = None, [], None
    for p in pieces(page):
        if p.block != block:
            if texts:
                out.append((where.path, "".join(texts), where.bad))
            block, texts, where = p.block, [], p
        texts.append(p.text)
    if texts:
        out.append((where.path, "".join(texts), where.bad))
    return out


# A wrapper's nodes: ("const", path, key of the text, furniture), ("slot", path, furniture), ("opt", [nodes]), ("plus", [nodes]).

#: Nodes that are aligned with as many at once, beyond the common beginning and end.
BAND = 1000


def shape_of(node: tuple) -> str:
    if node[0] in ("opt", "plus"):
        inner = [shape_of(n) for n in node[1]]
        return inner[0] if len(inner) == 1 else "(" + " ".join(inner) + ")"
    return node[1]


def slotted(node: tuple) -> tuple:
    return ("slot", node[1], node[3]) if node[0] == "const" else node


def leaves(node: tuple) -> list:
    """Its constants and slots, as slots."""
    return [x for n in node[1] for x in leaves(n)] if node[0] in ("opt", "plus") else [slotted(node)]


def any_of(nodes: list) -> tuple:
    """A repeated group of the nodes' different leaves, each optional."""
    kinds = {x[1]: x for n in nodes for x in leaves(n)}
    return ("plus", [("opt", [x]) for _, x in sorted(kinds.items())])


def squares(nodes: list) -> list:
    """Squares (the same shape twice or more in a row) become one repeated group. One
    that holds groups becomes a group of their leaves, so groups don't nest."""
    out, i = [], 0
    shapes = [f"{'x' if n[0] in ('const', 'slot') else n[0]} {shape_of(n)}" for n in nodes]
    while i < len(nodes):
        for width in (1, 2, 3, 4):
            k = 1
            while i + (k + 1) * width <= len(nodes) and shapes[i + k * width : i + (k + 1) * width] == shapes[i : i + width]:
                k += 1
            if k > 1:
                first = nodes[i : i + width]
                if any(n[0] in ("opt", "plus") for n in first):
                    out.append(any_of(first))
                else:
                    same = all(nodes[i + j * width : i + (j + 1) * width] == first for j in range(k))
                    out.append(("plus", first if same else [slotted(n) for n in first]))
                i += k * width
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def gathered(nodes: list) -> list:
    """A run of optional nodes in which a path returns becomes one repeated group. So a
    wrapper can't grow with the number of pages: between two nodes that all pages have,
    each path stands once."""
    out, i = [], 0
    while i < len(nodes):
        j = i
        while j < len(nodes) and (nodes[j][0] == "opt" or nodes[j][0] == "plus" and all(m[0] == "opt" for m in nodes[j][1])):
            j += 1
        paths = [x[1] for n in nodes[i:j] for x in leaves(n)]
        if j > i + 1 and len(set(paths)) < len(paths):
            out.append(any_of(nodes[i:j]))
        else:
            out += nodes[i : max(j, i + 1)]
        i = max(j, i + 1)
    return out


def folded(nodes: list) -> list:
    """Squares and gathered runs, until there are no more."""
    while len(less := gathered(squares(nodes))) < len(nodes):
        nodes = less
    return nodes


def merge(wrapper: list, other: list) -> list:
    """Aligns two wrappers (a page is one without slots) by shape. Equal texts stay,
    others become slots; what one side lacks becomes optional; one against several
    becomes repeated. Between the common beginning and end, BAND nodes of one are
    aligned with BAND of the other at a time, so that the work grows with the length."""
    a, b = [shape_of(n) for n in wrapper], [shape_of(n) for n in other]
    least, head, tail = min(len(a), len(b)), 0, 0
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [joined(x, y) for x, y in zip(wrapper[:head], other[:head], strict=True)]
    for at in range(head, max(len(a), len(b)) - tail, BAND):
        u, v = wrapper[at : min(at + BAND, len(a) - tail)], other[at : min(at + BAND, len(b) - tail)]
        for op, i, j, k, m in SequenceMatcher(None, [shape_of(n) for n in u], [shape_of(n) for n in v], autojunk=False).get_opcodes():
            if op == "equal":
                out += [joined(x, y) for x, y in zip(u[i:j], v[k:m], strict=True)]
            else:
                out += [x if x[0] == "opt" else ("opt", [x]) for x in (*u[i:j], *v[k:m])]
    out += [joined(x, y) for x, y in zip(wrapper[len(a) - tail :], other[len(b) - tail :], strict=True)]
    return folded(out)


def joined(x: tuple, y: tuple) -> tuple:
    if x[0] == "opt" or y[0] == "opt":
        u, v = (x[1] if x[0] == "opt" else [x]), (y[1] if y[0] == "opt" else [y])
        return ("opt", [joined(p, q) for p, q in zip(u, v, strict=True)] if len(u) == len(v) else [slotted(p) for p in u])
    if x[0] == "plus" or y[0] == "plus":
        u, v = (x[1] if x[0] == "plus" else [x]), (y[1] if y[0] == "plus" else [y])
        return ("plus", [joined(p, q) for p, q in zip(u, v, strict=True)] if len(u) == len(v) else [slotted(p) for p in u])
    return x if x == y else slotted(x)


def constant_places(nodes: list):
    """(path, text's key) of the wrapper's constants outside furniture; what is optional isn't constant."""
    for n in nodes:
        if n[0] == "const" and not n[3]:
            yield n[1], n[2]
        elif n[0] == "plus":
            yield from constant_places(n[1])


class Layout:
    """What some pages of a host have in common: their wrapper, the characters outside
    furniture under each path, and how many of them are in each constant of the wrapper.

    Layouts add up: tasks make one of their pages each, and those are added in turn.
    """

    __slots__ = ("held", "mass", "nodes")

    def __init__(self, nodes: list, mass: Counter, held: Counter):
        self.nodes, self.mass, self.held = nodes, mass, held

    @staticmethod
    def of(blocks: list[tuple]) -> Layout:
        """Of one page. blocks: (path, text, text's key, furniture)."""
        mass, held = Counter(), Counter()
        for path, text, key, bad in blocks:
            if not bad:
                mass[path] += len(text)
                held[path, key] += len(text)
        return Layout(folded([("const", path, key, bad) for path, _, key, bad in blocks]), mass, held)

    def add(self, other: Layout) -> None:
        self.nodes = merge(self.nodes, other.nodes)
        self.mass.update(other.mass)
        places = set(constant_places(self.nodes))
        self.held = Counter({k: self.held[k] + other.held[k] for k in places})

    @property
    def size(self) -> int:
        return len(self.nodes) + len(self.mass) + len(self.held)

    def region(self) -> str:
        """That of the texts in slots and optional groups; of all texts if none vary."""
        vary = Counter(self.mass)
        for path, key in set(constant_places(self.nodes)):
            vary[path] -= self.held[path, key]
        return region_of(+vary) or region_of(self.mass)

    def dumped(self) -> str:
        return json.dumps([self.nodes, sorted(self.mass.items()), sorted((p, k, n) for (p, k), n in self.held.items())])

    @staticmethod
    def loaded(text: str) -> Layout:
        thaw = lambda n: (n[0], [thaw(m) for m in n[1]]) if n[0] in ("opt", "plus") else tuple(n)
        nodes, mass, held = json.loads(text)
        return Layout([thaw(n) for n in nodes], Counter(dict(mass)), Counter({(p, k): n for p, k, n in held}))


def region_of(texts: dict[str, int]) -> str:
    """The path under which the article is, from the characters of text outside
    furniture under each: an <article> or <main> that holds a quarter of it, else the
    deepest element with three quarters of it."""
    mass: Counter = Counter()
    total = sum(texts.values())
    for path, n in texts.items():
        parts = path.split("/")
        for k in range(2, len(parts) + 1):
            mass["/".join(parts[:k])] += n
    named = [p for p in mass if p.rsplit("/", 1)[1] in REGION_TAGS and 4 * mass[p] >= total]
    if named:
        return min(named, key=lambda p: (-mass[p], p.rsplit("/", 1)[1] != "article", -p.count("/"), p))
    wide = [p for p in mass if 4 * mass[p] >= 3 * total and p.rsplit("/", 1)[1] not in ("p", "h1", "h2", "h3", "li", "td", "span")]
    return max(wide, key=lambda p: (p.count("/"), mass[p], p), default="")


def block_key(text: str) -> int:
    """64 bits that stand for a block's text."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def page_blocks(page: str) -> list[tuple]:
    """(path, text, text's key, furniture) of a whole page's blocks that aren't empty."""
    return [(path, t, block_key(t), bad) for path, text, bad in raw_blocks(page) if (t := squeeze(text))]


def text_keys(blocks: list[tuple]) -> list[int]:
    """The keys of the different texts outside furniture."""
    return list(dict.fromkeys(key for _, _, key, bad in blocks if not bad))


def learn(pages: list[str]) -> dict:
    """What extract() needs to know of a host, from all its pages: the region of the
    article, and the keys of the texts on nearly all of the different pages."""
    layout, counts, kept = None, Counter(), list(dict.fromkeys(pages))
    for page in kept:
        blocks = page_blocks(page)
        counts.update(text_keys(blocks))
        if layout is None:
            layout = Layout.of(blocks)
        else:
            layout.add(Layout.of(blocks))
    least = max(CONSTANT_PAGES, math.ceil(CONSTANT_SHARE * len(kept)))
    return {"region": layout.region() if layout else "", "constants": sorted(k for k, n in counts.items() if n >= least), "wrapper": layout.nodes if layout else []}


def under(path: str, region: str) -> bool:
    return not region or path == region or path.startswith(region + "/")


def extract(page: str | None, known: dict | None) -> str:
    """The article's text: blocks in page order joined by one space. A page whose
    layout lacks its host's region is read by a region of its own."""
    if not page:
        return ""
    blocks = raw_blocks(page)
    region = known["region"] if known else ""
    if not region or not any(not bad and under(path, region) and text.strip() for path, text, bad in blocks):
        mass: Counter = Counter()
        for path, text, bad in blocks:
            if not bad and text.strip():
                mass[path] += len(text)
        region = region_of(mass)
    fixed = set(known["constants"]) if known else ()
    texts = (squeeze(text) for path, text, bad in blocks if not bad and under(path, region))
    return " ".join(t for t in texts if t and not (fixed and block_key(t) in fixed))
