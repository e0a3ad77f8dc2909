"""HTML main text by a tree-structured graphical model.

Every element and text block of a page is a node with a hidden state: does its subtree
hold main content or not. A node's own evidence (tag, class and id words, text length,
share of link text) is a learned log-odds; parent and child states are tied by learned
potentials. Sum-product messages go from the leaves to the root and back, which on a
tree gives the exact marginals; text blocks that are more likely content than not are
the page's text. Both parts are trained from labelled pages, written by :func:`labelled_pages`.
"""

from __future__ import annotations

import html
import math
import pickle
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn, map_arrow, tune

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
#: Tags that end at the next ``>`` whatever quotes say, and how tags begin.
_LOOSE = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_OPENS = re.compile("</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")

# HTML's own element classes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Phrasing elements that are not shown: the text around them is one run.
PHRASING = {"svg", "object", "canvas", "audio", "video", "select", "button", "datalist", "option", "template", "annotation", "annotation-xml", "mphantom", "foreignobject"}
#: Elements that a drawing can't hold: it ends before them.
LEAVES_SVG = {"blockquote", "body", "center", "dd", "div", "dl", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "article", "table", "ul"}
#: Formulas are shown as text.
MATH = {"math", "mi", "mo", "mn", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "semantics", "mstyle", "mspace", "mpadded", "menclose", "merror", "mmultiscripts", "mprescripts"}
INLINE |= PHRASING | MATH
#: Inline elements whose end tags also count within blocks that they hold.
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "tt", "u"}
#: What a browser does not show as text.
UNSEEN = {"script", "style", "noscript", "head", "iframe", "textarea", "title"} | PHRASING
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
#: A start tag ends these open elements; second, where to stop looking.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "button", "object", "html"}


#: What a start tag closes and where the search for it stops, by the place in Node.near.
NEAR = [({"p"}, SCOPE), *dict.fromkeys((frozenset(a), frozenset(b)) for a, b in CLOSES.values())]
_NEAR_OF = {tag: [frozenset(x) for x, _ in NEAR].index(frozenset(ends)) for tag, (ends, _) in CLOSES.items()}


class Node:
    """An element or run of text; ``near``, ``scope`` and ``box`` tell what is open around it without a walk up the stack."""

    __slots__ = ("tag", "names", "parent", "text", "linked", "hidden", "label", "size", "links", "article", "depth", "near", "scope", "box", "around", "ended")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = (), hidden: bool = False, label: str | None = None):
        self.tag, self.parent, self.names, self.hidden, self.label = tag, parent, names, hidden, label
        self.text, self.linked, self.size, self.links, self.around, self.ended = [], 0, 0, 0, None, False
        self.article = None if parent is None else parent if parent.tag in ("article", "main") else parent.article


class _Stack:
    """The open elements. Each step takes constant time on average, whatever is open."""

    def __init__(self, root: Node):
        root.depth, root.near, root.scope, root.box = 0, (None,) * len(NEAR), 0, root
        self.open, self.by_tag, self.hidden, self.first, self.unseen = [root], defaultdict(list), [], 0, 0

    def push(self, node: Node) -> None:
        top, tag = self.open[-1], node.tag
        node.depth, node.near, node.scope, node.box = len(self.open), top.near, top.scope, top.box
        if tag not in INLINE:
            node.box = node
        if tag in SCOPE:
            node.scope = node.depth
        if tag in _MARKS:
            node.near = tuple(node if tag in ends else None if tag in stop else was for (ends, stop), was in zip(NEAR, top.near))
        self.open.append(node)
        self.by_tag[tag].append(node)
        if node.hidden:
            self.hidden.append(node)
            self.unseen += 1

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            same = self.by_tag[node.tag]
            if same and same[-1] is node:
                same.pop()
            if self.hidden and self.hidden[-1] is node:
                self.hidden.pop()
                self.unseen -= not node.ended

    def unseen_below(self, depth: int) -> bool:
        """Whether a hidden element is open further out."""
        if not self.unseen:
            return False
        self.first = min(self.first, len(self.hidden) - 1)
        while self.hidden[self.first].ended:
            self.first += 1
        return self.hidden[self.first].depth < depth

    def last(self, tag: str) -> Node | None:
        """The innermost open element of this tag."""
        same = self.by_tag[tag]
        while same and same[-1].ended:
            same.pop()
        return same[-1] if same else None


_MARKS = set().union(*(set(a) | set(b) for a, b in NEAR))


def _closed(rest: str) -> bool:
    """Whether a start tag ends itself: by a slash that isn't the end of an unquoted value."""
    if not rest.endswith("/"):
        return False
    before, _, last = rest.rpartition(" ") if not rest[:-1].endswith((" ", "\t", "\n", "\r", "\f")) else ("", "", "/")
    name, equals, value = last.partition("=")
    return not (value[:1] not in ("'", '"') and value[-2:-1] not in ("'", '"') if equals else before.rstrip().endswith("="))


def parse(source: str) -> list[Node]:
    """The page's block elements and, as ``#text`` nodes, its runs of inline text, parents first.

    Markup that browsers don't show is left out; unclosed and misnested tags are put
    right in the usual way: a new block ends an open paragraph, an end tag without a
    start is ignored. A hidden inline element ends at its own end tag, and the text
    around it is one run; inline elements are on the stack only within hidden ones. One
    that ends before blocks that it holds stays on the stack without effect. Time and
    memory grow with the page's length, however its tags are nested.
    """
    root = Node("#root", None)
    nodes, stack, at, n = [root], _Stack(root), 0, len(source)
    inline: Counter[str] = Counter()
    leaf: Node | None = None
    tags, begin, last_tag = _TAG, 0, source.rfind(">")

    def put(text: str) -> None:
        nonlocal leaf
        if stack.unseen or not text:
            return
        if leaf is None:
            if not text.strip():
                return
            leaf = Node("#text", stack.open[-1].box)
            nodes.append(leaf)
        text = html.unescape(text)
        leaf.text.append(text)
        if inline["a"]:
            leaf.linked += len(text)

    def end_inline(tag: str) -> None:
        """Ends the last inline element of this tag on the stack; blocks that it holds stay open."""
        nonlocal leaf, inline
        node, top = stack.last(tag), stack.open[-1]
        if node is None or top.scope > node.depth and tag not in SCOPE or tag not in FORMATTING | PHRASING and top.box.depth > node.depth:
            return
        if tag in PHRASING:  # what it holds ends with it
            leaf, inline = node.around[0], Counter(node.around[1])
            stack.pop_to(node.depth)
            return
        below = stack.unseen_below(node.depth)
        leaf, inline = node.around[0], Counter(node.around[1])
        if node is top:
            stack.pop_to(node.depth)
            return
        node.ended = True
        stack.unseen -= node.hidden
        for k in range(node.depth + 1, len(stack.open)):
            x = stack.open[k]
            if below or x.hidden and not x.ended:  # what follows stays unseen
                leaf, inline = None, Counter()
                break
            if x.tag in INLINE:
                if not x.ended:
                    x.ended = True
                    inline[x.tag] += 1
                continue
            leaf, inline = None, Counter()
            nodes.append(x)

    while at < n:
        start = source.find("<", begin, n)
        m = None
        if start >= 0:
            opens = _OPENS.match(source, start)
            m = None if opens and start > last_tag else tags.match(source, start)
            if m is None and tags is _TAG and opens and start < last_tag:
                # Its quotes leave it open up to the page's end: from here on tags are read without them.
                tags = _LOOSE
                m = tags.match(source, start)
            if m is None:
                begin = start + 1
                continue
        put(source[at : start if m else n])
        if m is None:
            break
        at = begin = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                if inline[tag]:
                    inline[tag] -= 1
                else:
                    end_inline(tag)
                continue
            node = stack.last(tag)
            if node is not None and (stack.open[-1].scope <= node.depth or tag in SCOPE or tag in ("body", "html")):
                stack.pop_to(node.depth)
                leaf, inline = None, Counter()
            continue
        rest = m[3]
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}
        hidden = tag in UNSEEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = begin = end.end() if end else n
            continue
        if stack.unseen and tag == "a":
            end_inline(tag)
        if stack.unseen and tag != "svg" and (svg := stack.last("svg")) is not None and stack.last("foreignobject") is None:
            if tag not in LEAVES_SVG:
                continue  # a shape ends nothing around it
            stack.pop_to(svg.depth)
            leaf, inline = svg.around[0], Counter(svg.around[1])
        if tag in INLINE and tag not in VOID and (hidden or stack.unseen):
            if not _closed(rest):
                node = Node(tag, stack.open[-1].box, hidden=hidden)
                node.around = leaf, dict(inline)
                stack.push(node)
                leaf, inline = None, Counter()
            continue
        if tag in INLINE:
            if tag == "br":
                put(" ")
            elif tag not in VOID and not _closed(rest):
                inline[tag] += 1
            continue
        if tag in VOID:
            if tag == "hr":
                leaf = None
            continue
        which = _NEAR_OF.get(tag, 0)
        while (open_one := stack.open[-1].near[which]) is not None:
            stack.pop_to(open_one.depth)
            if not which:
                break
        leaf, inline = None, Counter()
        names = names_of(f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}")
        node = Node(tag, stack.open[-1].box, names, hidden, attributes.get("data-label"))
        if not stack.unseen and not hidden:
            nodes.append(node)
        if not _closed(rest):
            stack.push(node)
    for node in nodes:
        if node.tag == "#text":
            node.text = [_WHITE.sub(" ", "".join(node.text)).strip()]
            node.size = len(node.text[0])
            node.linked = min(node.size, node.linked)
            node.links = node.linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
    return [x for x in nodes if x.tag != "#text" or x.size]


#: Names that boxes of each sort commonly bear, for the labelled pages.
CONTENT_NAMES = ["content", "main", "article", "post", "entry", "story", "body", "text", "page", "container", "wrapper", "row", "col", "section", "hentry", "prose", "markdown", "document", "primary"]
BOILERPLATE = {
    "nav": ["nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "toc", "topbar", "toolbar", "pagination", "pager", "skip", "links"],
    "header": ["header", "masthead", "top", "banner", "brand", "logo", "site", "hero"],
    "footer": ["footer", "foot", "bottom", "copyright", "legal", "colophon", "credits"],
    "aside": ["sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "recent", "rail", "tags", "meta", "author", "bio", "secondary", "complementary"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "banner", "popup", "modal", "overlay", "alert", "privacy", "disclaimer", "paywall", "announcement", "notification"],
    "ad": ["ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "adsense", "adsbygoogle", "commercial", "dfp", "outbrain", "taboola"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact", "subscription"],
    "comments": ["comments", "comment", "reply", "replies", "respond", "disqus", "commentlist", "reviews", "responses", "feedback"],
    "share": ["share", "sharing", "social", "follow", "buttons", "icons", "twitter", "facebook"],
}


#: Words of names that say only that something is a box.
BOX_WORDS = {"box", "area", "inner", "outer", "list", "wrap", "wrapper", "container", "block", "panel", "module", "item", "group", "region", "holder", "div"}
#: What boxes beside an article often list.
LISTED = ["posts", "articles", "stories", "news", "entries", "pages"]
KNOWN = {*LISTED, *CONTENT_NAMES, *(w for names in BOILERPLATE.values() for w in names)}


@lru_cache(1 << 14)
def names_of(value: str) -> tuple[str, ...]:
    """What the class, id and role of a box say of it.

    A name of one word, but for words and numbers that only say that it is a box, is
    evidence of another weight than a word among others: "related-work" is not "related".
    Words that are in no list of names are all alike.
    """
    out = []
    for token in value.split():
        found = [w.lower() for w in _NAME.findall(token)]
        own = [w for w in found if w not in BOX_WORDS]
        kind = "name" if len(own) < 2 else "part"
        out += [f"{kind} {w}" if w in KNOWN else f"{kind} other" for w in own] or ["name box"] * bool(found)
        if kind == "name":
            out += [f"name of {sort}" for w in own for sort, names in BOILERPLATE.items() if w in names]
    return tuple(dict.fromkeys(out))


#: Parts of lists: a list is judged as a whole, not by the number of its items.
ITEMS = {"li", "dt", "dd"}
_SENTENCE = re.compile(r"""[.!?…。:;]["'”’»)\]]*$""")


def evidence(node: Node) -> list[str]:
    """The node's own features and whether it stands in an article; what its relatives hold comes by the messages."""
    if node.tag == "#root":
        return ["root"]
    share = node.links / node.size if node.size else 0
    linked = 0 if share < 0.2 else 1 if share < 0.6 else 2
    above = node.article.tag if node.article is not None else "page"
    if node.tag == "#text":
        if node.parent.tag in ITEMS:
            return []
        long = min(5, int(math.log2(1 + node.size / 16)))
        return ["text", f"text links {linked}", f"text links {linked} in {above}", f"text long {long}", f"text ends {bool(_SENTENCE.search(node.text[0][-8:]))} {min(long, 2)}"]
    if node.tag in ITEMS:
        return list(node.names)
    return [f"tag {node.tag}", f"{node.tag} in {above}", f"{node.tag} under {node.parent.tag}", f"box links {linked}", f"{node.tag} links {linked}", f"{node.tag} links {linked} in {above}", *node.names]


def labelled_pages(n: int = 500, seed: int = 17) -> Iterator[str]:
    """Pages of random words in which ``data-label`` says of each box whether it is content."""
    rng = random.Random(seed)
    syllables = ["an", "er", "tion", "the", "is", "re", "ver", "que", "en", "ein", "la", "do"]
    words = lambda a, b: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    brief = 0.15

    def sentence(a: int, b: int) -> str:
        return words(a, b) + (rng.choice([".", ".", ".", "?", "!", ":", '."']) if rng.random() < (0.85 if brief < 0.5 else 0.4) else "")

    def prose() -> str:
        out = sentence(1, 3) if rng.random() < brief else sentence(4, 80)
        if rng.random() < 0.15:
            out += f' <a href="/x">{words(1, 4)}</a> {words(3, 20)}'
        if rng.random() < 0.15:
            out = f"<b>{words(1, 5)}</b> {out}"
        return out

    def piece() -> str:
        kind = rng.choices(["p", "h2", "ul", "blockquote", "table", "pre", "figure", "div", "section", "dl"], [60, 9, 6, 4, 3, 3, 3, 8, 5, 1])[0]
        if rng.random() < 0.05:  # sources, references, further reading
            return rng.choice(["", f"<h2>{words(1, 3)}</h2>"]) + listed()
        if kind in ("ul", "table", "dl"):
            inner = "".join(f"<li>{prose()}</li>" if kind == "ul" else f"<tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr>" if kind == "table" else f"<dt>{words(1, 2)}</dt><dd>{prose()}</dd>" for _ in range(rng.randint(1, 5)))
            return f"<{kind}>{inner}</{kind}>"
        if kind == "figure":
            return f"<figure><img src=x><figcaption>{words(2, 12)}</figcaption></figure>"
        if kind in ("div", "section"):
            inner = "".join(f"<p>{prose()}</p>" for _ in range(rng.choice([1, 1, 1, 2, 3]))) if rng.random() < 0.85 else f"<h3>{words(1, 4)}</h3>" + (listed() if rng.random() < 0.4 else f"<p>{prose()}</p>")
            return f"<{kind}{titled()}>{inner}</{kind}>"
        return f"<{kind}>{words(1, 8) if kind == 'h2' else prose()}</{kind}>"

    def titled() -> str:
        """A box of an article may be called anything, also by a word that other boxes are called by if another word stands beside it."""
        how = rng.random()
        if how < 0.3:
            return ""
        if how < 0.55:
            name = words(1, 1)
        elif how < 0.7:
            name = rng.choice(CONTENT_NAMES)
        else:
            name = "-".join(rng.sample([rng.choice([*KNOWN]), words(1, 1)], 2))
        return f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "", "2", "-box", "-block", "_inner"])}"'

    def listed() -> str:
        kind = rng.choice(["ul", "ul", "ol"])
        return f"<{kind}>" + "".join(f'<li><a href="/{i}">{words(1, 9)}</a></li>' for i in range(rng.choice([1, 1, 2, 2, 3, 5, 9, 20]))) + f"</{kind}>"

    def links(a: int, b: int) -> str:
        each = [f'<a href="/{i}">{words(1, 3)}</a>' for i in range(rng.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if rng.random() < 0.7 else " | ".join(each)

    def named(names: list[str]) -> str:
        if rng.random() < 0.1:
            return ""
        name = rng.choice(names)
        if rng.random() < 0.2:  # two words of its sort, or one and what it belongs to
            name = rng.choice([name + "-" + rng.choice(names), rng.choice(["site", "page", "main", "post", "entry", "article", "global"]) + "-" + name, name + "-" + rng.choice(["section", "content", "text", "row"]), name + "-" + rng.choice(LISTED)])
        name += rng.choice(["", "", "", "-box", "-area", "-1", "-inner", "-list", "_wrap", "-container"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def boiler(kind: str) -> str:
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = own if own and rng.random() < 0.6 else "section" if kind == "comments" and rng.random() < 0.5 else rng.choice(["div", "div", "div", "section", "ul"] if kind not in ("comments", "notice", "ad") else ["div", "div", "section", "aside"])
        name = named(BOILERPLATE[kind]) if own != tag or rng.random() < 0.6 else ""
        if own != tag and not name:
            name = f' class="{BOILERPLATE[kind][0]}"'
        inner = {
            "nav": lambda: rng.choice([links(2, 9), links(2, 9), links(1, 1), words(1, 6)]),
            "header": lambda: rng.choice([f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", f'<a href="/">{words(1, 2)}</a>', f"<div>{words(1, 5)}</div>{links(2, 6)}"]),
            "footer": lambda: rng.choice([f"&copy; {words(2, 8)}", f"<p>{sentence(3, 20)}</p>{links(1, 5)}"]),
            "aside": lambda: rng.choice([f"<h3>{words(1, 3)}</h3>{links(2, 7)}", f"<p>{sentence(4, 40)}</p>", f"<h3>{words(1, 3)}</h3><p>{sentence(5, 40)}</p>"]),
            "notice": lambda: f"<p>{sentence(5, 40)}</p>" + rng.choice(["", '<a href="/p">ok</a>']),
            "ad": lambda: rng.choice([sentence(3, 30), f"<p>{sentence(3, 30)}</p>", f'<a href="/a">{words(2, 10)}</a>']),
            "form": lambda: f"<label>{words(1, 3)}</label><input><p>{sentence(2, 12)}</p>",
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(rng.choice([f"<div><p>{prose()}</p></div>", f'<div class="comment"><p>{prose()}</p><p>{prose()}</p></div>', f"<li>{prose()}</li>", f"<article><p>{prose()}</p></article>"]) for _ in range(rng.randint(1, 5))),
            "share": lambda: links(2, 5),
        }[kind]()
        return f'<{tag}{name} data-label="0">{inner}</{tag}>'

    kinds = list(BOILERPLATE)
    for _ in range(n):
        brief = 0.8 if rng.random() < 0.12 else 0.15  # some articles are nothing but short lines
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        tiny = brief > 0.5 and rng.random() < 0.5
        body = "".join(f"<p>{prose()}</p>" if tiny else piece() for _ in range(rng.randint(1, 3 if tiny else 14)))
        if rng.random() < 0.8 and not tiny:
            title = f"<h1>{words(2, 9)}</h1>"
            if tag in ("article", "main") and rng.random() < 0.35:
                title = f'<header{rng.choice(["", ' class="entry-header"', ' class="post-header"', ' class="article-header"'])} data-label="1">{title}{rng.choice(["", f"<p>{words(3, 12)}</p>"])}</header>'
            body = title + body
        if rng.random() < 0.25:  # boxes within the article
            body += boiler(rng.choice(["share", "ad", "aside", "comments", "form"]))
        if rng.random() < 0.15:
            body = boiler(rng.choice(["share", "ad", "nav", "notice"])) + body
        if rng.random() < 0.2:
            body = f'<div class="{rng.choice(CONTENT_NAMES)}" data-label="1">{body}</div>'
        name = named(CONTENT_NAMES) if tag != "div" else f' class="{rng.choice(CONTENT_NAMES)}-{rng.choice(CONTENT_NAMES)}"'
        body = f'<{tag}{name} data-label="1">{body}</{tag}>'
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "layout", "app"])}">{body}</div>'
        if rng.random() < (0.5 if tiny else 0.08):  # a fragment of a page
            yield body
            continue
        before = [boiler(k) for k in rng.sample(kinds, rng.randint(0, 4))]
        after = [boiler(k) for k in rng.sample(kinds, rng.randint(0, 4))]
        yield f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


#: States of parent and child that can't be: what holds content is held by what holds content.
NEVER = -30.0
#: Labelled pages to train on, and passes over them.
PAGES, EPOCHS = 1500, 8


def messages(own: list[float], parent: list[int], tie: list[float]) -> tuple[list[float], list[float]]:
    """(P(content) of each node, P(content of both) of each node and its parent) by sum-product over the tree.

    ``own`` has each node's log-odds and ``tie`` the log potential of it and its parent
    both holding content; nodes stand after their parents, node 0 is the root.
    """
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    n = len(own)
    low, high = [0.0] * n, list(own)  # belief in 0 and 1 from below
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        up[i] = (add(low[i], NEVER + high[i]), add(low[i], tie[i] + high[i]))
        k = parent[i]
        low[k] += up[i][0]
        high[k] += up[i][1]
    both, pairs, full = [0.0] * n, [0.0] * n, [(0.0, 0.0)] * n
    for i in range(n):
        a, b = low[i], high[i]
        if i:
            above = full[parent[i]]
            off, on = above[0] - up[i][0], above[1] - up[i][1]
            a += add(off, on)
            b += add(off + NEVER, on + tie[i])
            pairs[i] = math.exp(min(0.0, on + tie[i] + high[i] - add(a, b)))
        shift = add(a, b)
        full[i] = (a - shift, b - shift)
        both[i] = math.exp(min(0.0, b - shift))
    return both, pairs


def _states(nodes: list[Node]) -> list[int]:
    """1 where the subtree holds text whose nearest label says content."""
    label: dict[int, bool] = {}
    for x in nodes:
        above = label.get(id(x.parent), False) if x.parent is not None else False
        label[id(x)] = x.label == "1" if x.label is not None else above
    holds = {id(x): x.tag == "#text" and label[id(x)] for x in nodes}
    for x in reversed(nodes):
        if x.parent is not None and holds[id(x)]:
            holds[id(x.parent)] = True
    return [int(holds[id(x)]) for x in nodes]


def _tree(nodes: list[Node]) -> tuple[list[list[int]], list[int], list[str]]:
    at = {id(x): i for i, x in enumerate(nodes)}
    return [[crc32(f.encode()) for f in evidence(x)] for x in nodes], [at[id(x.parent)] if x.parent is not None else -1 for x in nodes], ["item" if x.tag in ITEMS or x.parent is not None and x.parent.tag in ITEMS else "text" if x.tag == "#text" else "box" for x in nodes]


def _odds(found: list[list[int]], parent: list[int], kinds: list[str], weights: dict[int, float], ties: dict[str, float]) -> list[float]:
    """Each node's log-odds. A list's are less what its items could add by their mere number."""
    own = [sum(weights.get(f, 0.0) for f in fs) for fs in found]
    free = math.log1p(math.exp(ties["item"]))
    for i, kind in enumerate(kinds):
        if kind == "item":
            own[parent[i]] -= free
    return own


#: The model, once an executor has trained it.
_fitted: list[tuple[dict[int, float], dict[str, float]]] = []


@lru_cache(1)
def model() -> tuple[dict[int, float], dict[str, float]]:
    """(log-odds of each piece of evidence, tie of each kind of child), by gradient ascent on the labelled pages' likelihood."""
    pages = []
    for source in labelled_pages(PAGES):
        nodes = parse(source)
        pages.append((*_tree(nodes), _states(nodes)))
    weights, past, ties = {}, {}, {"text": 1.0, "box": 1.0, "item": 1.0}
    rng = random.Random(1)
    for epoch in range(EPOCHS):
        rng.shuffle(pages)
        for found, parent, kinds, y in pages:
            p, pairs = messages(_odds(found, parent, kinds, weights, ties), parent, [ties[k] for k in kinds])
            slope: dict[int, float] = {}
            for fs, want, have in zip(found, y, p):
                for f in fs:
                    slope[f] = slope.get(f, 0.0) + want - have
            for f, g in slope.items():
                past[f] = past.get(f, 0.1) + g * g
                weights[f] = weights.get(f, 0.0) * (1 - 1e-4) + 0.3 * g / math.sqrt(past[f])
            for i in range(1, len(y)):
                step = y[i] * y[parent[i]] - pairs[i]
                if kinds[i] == "item":
                    step -= (y[parent[i]] - p[parent[i]]) / (1 + math.exp(-ties["item"]))
                ties[kinds[i]] += 0.01 / (1 + epoch) * step
    return weights, ties


def marginals(nodes: list[Node], weights: dict[int, float], ties: dict[str, float]) -> list[float]:
    """P(content) of each node of a page."""
    found, parent, kinds = _tree(nodes)
    return messages(_odds(found, parent, kinds, weights, ties), parent, [ties[k] for k in kinds])[0]


def main_text(source: str | None, weights: dict[int, float], ties: dict[str, float]) -> str:
    """The page's content blocks in page order."""
    if not source:
        return ""
    nodes = parse(source)
    return "\n\n".join(x.text[0] for x, p in zip(nodes, marginals(nodes, weights, ties)) if x.tag == "#text" and p > 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty html gives an empty text, as does a page without content blocks.
    Pages of any size are read whole; repeated rows repeat; null ids and urls are carried
    as they are. Other columns are ignored.
    """
    tune(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not _fitted:
        _fitted.append(pickle.loads(learn(pages.sparkSession.range(1), lambda _: pickle.dumps(model()))))  # noqa: S301  our own
    known = pages.sparkSession.sparkContext.broadcast(_fitted[0])

    def extracted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(x.as_py(), *known.value) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages, extracted, "page_id long, url string, text string, n_chars long")
