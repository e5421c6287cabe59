"""A tolerant document tree on the standard library's parser, with the selectors that pages need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Fixed values of the document format: elements without content, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSHOWN = frozenset("script style template noscript".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The elements below, in order of the document."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self, skip: frozenset[str] = UNSHOWN) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in skip:
                stack += reversed(c.children)

    def text(self, sep: str = " ", skip: frozenset[str] = UNSHOWN) -> str:
        """Stripped pieces of text, empty ones dropped."""
        return sep.join(s for s in (x.strip() for x in self.strings(skip)) if s)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close({"p"}, {"table", "li", "td", "div", "section", "body"})
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _WALLS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def _close(self, tags, walls):
        n, last = self.at, None
        while n is not None and n.tag not in walls:
            if n.tag in tags:
                last = n
            n = n.parent
        if last is not None:
            self.at = last.parent or self.root

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a document; broken markup gives the tree that can be made of it."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_SIMPLE = re.compile(r"(\*|[A-Za-z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|:(not|has)\(([^)]*)\)")


def _compile(selector: str) -> list[list[tuple[str, list]]]:
    out = []
    for part in re.split(r",(?![^(\[]*[)\]])", selector):
        chain: list[tuple[str, list]] = []
        how = " "
        for word in re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s>\[(])+|>", part):
            if word == ">":
                how = ">"
                continue
            if _SIMPLE.sub("", word):
                raise ValueError(f"selector {selector!r}: {word!r} isn't understood")
            tests = []
            for m in _SIMPLE.finditer(word):
                tag, cls, ident, attr, op, *values, fn, arg = m.groups()
                if tag and tag != "*":
                    tests.append(("tag", tag.lower()))
                elif cls:
                    tests.append(("class", cls))
                elif ident:
                    tests.append(("id", ident))
                elif attr:
                    tests.append(("attr", attr.lower(), op, next((v for v in values if v is not None), "")))
                elif fn:
                    tests.append((fn, _compile(arg)))
            chain.append((how, tests))
            how = " "
        if chain:
            out.append(chain)
    return out


def _passes(n: Node, tests: list) -> bool:
    for t in tests:
        kind = t[0]
        if kind == "tag":
            ok = n.tag == t[1]
        elif kind == "class":
            ok = t[1] in n.classes
        elif kind == "id":
            ok = n.attrs.get("id") == t[1]
        elif kind == "attr":
            v, op, want = n.attrs.get(t[1]), t[2], t[3]
            ok = v is not None and (op is None or (op == "=" and v == want) or (op == "^=" and v.startswith(want)) or (op == "$=" and v.endswith(want)) or (op == "*=" and want in v) or (op == "~=" and want in v.split()))
        elif kind == "not":
            ok = not any(_matches(n, c) for c in t[1])
        else:
            ok = any(_matches(d, c) for d in n.walk() for c in t[1])
        if not ok:
            return False
    return True


def _matches(n: Node, chain: list) -> bool:
    if not _passes(n, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    how, rest = chain[-1][0], chain[:-1]
    if how == ">":
        return n.parent is not None and n.parent.tag != "#root" and _matches(n.parent, rest)
    return any(a.tag != "#root" and _matches(a, rest) for a in n.ancestors())


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match, in order of the document."""
    chains = _compile(selector)
    return [n for n in root.walk() if any(_matches(n, c) for c in chains)]
