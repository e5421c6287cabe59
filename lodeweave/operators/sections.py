"""The section of a page that tells a product's strengths.

A page is flattened into an outline: one block per line of text, headings with their level.
A section is a heading with the blocks up to the next heading of its level or above, so
that nesting of elements doesn't matter. Candidates from several signals are scored and
the best one is taken, the first of equals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodeweave.functions import dom
from lodeweave.functions.plain import normalise_text
from lodeweave.operators.pages import NOISE, _per_page

# Words of headings that announce strengths, and of headings of other sections, folded.
POSITIVE = ("uu diem", "dac diem", "noi bat", "loi ich", "tai sao", "vi sao", "tinh nang", "uu viet")
NEGATIVE = (
    "thong so", "ung dung", "dia chi", "mua", "lap dat", "huong dan", "luu y", "cau hoi", "tuong tu", "khu vuc", "chinh sach", "cam ket", "so sanh", "danh gia", "bao hanh", "van chuyen", "thanh toan", "lien he",
)
# Limits of heading-like lines, of a section's content, and the points of the signals.
LABEL_LENGTH, BARE_LENGTH, LEAST_LINES, LEAST_LENGTH = 60, 40, 2, 80
POINTS_TITLE, POINTS_ANCHOR, POINTS_BULLET, MOST_BULLETS, MOST_LENGTH = 100, 60, 10, 8, 3000
CONTENT_LIMIT, SUMMARY_LIMIT = 8000, 2000
PSEUDO = frozenset("div p strong b span a label dt".split())
_MARK = re.compile(r"^[-•–—+*▪‣»☑✅✔✓❖◆●○]️?\s+")
_NUMBER = re.compile(r"^(?:\d+(?:\.\d+)+|\d+[.)])\s+")
_MORE = re.compile(r"(?i)^\s*>>>|xem\s+thêm\s*:")
_BLOCK_TAGS = frozenset("p li div td th dt dd tr section article blockquote h1 h2 h3 h4 h5 h6 ul ol table br".split())


def like_heading(text: str) -> bool:
    """A line that reads as a heading: short with a closing colon, or shorter still without comma and full stop."""
    t = text.strip()
    return len(t) <= LABEL_LENGTH if t.endswith(":") else len(t) <= BARE_LENGTH and "," not in t and not t.endswith(".")


def is_prose(text: str, most_pairs: float = 0.6) -> bool:
    """True for text with a real sentence that isn't mainly label-and-value lines."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    pairs = sum(bool(re.match(r"^[^:]{1,40}:\s*\S.{0,60}$", x)) for x in lines)
    return bool(lines) and pairs / len(lines) <= most_pairs and any(len(x) >= 40 and ("." in x or "," in x) for x in lines)


def _has(title: str, words: tuple[str, ...]) -> bool:
    text = f" {normalise_text(title)} "
    return any(f" {w}" in text for w in words)


@dataclass
class Block:
    level: int  # 0 for text, 1 to 4 for headings, 4 for lines that only look like one
    text: str
    item: bool = False
    label: str = ""


def outline(root: dom.Node) -> list[Block]:
    """The page as blocks, in order."""
    out: list[Block] = []

    def visit(node: dom.Node, item: bool) -> None:
        line: list[str] = []
        bold: list[str] = []

        def flush() -> None:
            text = " ".join(" ".join(line).split())
            if text:
                label = " ".join(" ".join(bold).split()) if bold and text.startswith(" ".join(" ".join(bold).split())) else ""
                level = 4 if node.tag in PSEUDO and not item and like_heading(text) and _has(text, POSITIVE) else 0
                out.append(Block(level, text, item, label))
            line.clear()
            bold.clear()

        def inline(n: dom.Node, strong: bool) -> None:
            for c in n.children:
                if isinstance(c, str):
                    if c.strip():
                        line.append(c)
                        if strong and len(line) == len(bold) + 1:
                            bold.append(c)
                elif c.tag in NOISE:
                    continue
                elif c.tag[:1] == "h" and c.tag[1:].isdigit():
                    flush()
                    title = c.text()
                    if title:
                        out.append(Block(min(int(c.tag[1:]), 4), title))
                elif c.tag in _BLOCK_TAGS:
                    flush()
                    if c.tag != "br":
                        visit(c, item or c.tag == "li")
                else:
                    inline(c, strong or c.tag in ("strong", "b"))

        inline(node, False)
        flush()

    visit(root, False)
    return out


def bullets(blocks: list[Block], level: int) -> list[str]:
    """The points of a section: deeper headings, else items by their bold label, else marked lines, else bold beginnings."""
    heads = [b.text for b in blocks if b.level > level]
    items = [b.label or b.text for b in blocks if b.item]
    marked = [_MARK.sub("", b.text) for b in blocks if _MARK.match(b.text)]
    bold = [b.label for b in blocks if b.label and not b.level]
    chosen = next((x for x in (heads, items, marked, bold) if len(x) >= 2), heads or items or marked or bold)
    clean = (re.sub(r"[\s:–—-]+$", "", _NUMBER.sub("", x).strip()) for x in chosen)
    return list(dict.fromkeys(x for x in clean if x))


def _score(title: str, blocks: list[Block], level: int, anchored: bool) -> tuple[float, list[str], str] | None:
    lines = [b.text for b in blocks if not _MORE.search(b.text)]
    content = "\n".join(lines)
    if len(lines) < 1 or _has(title, NEGATIVE):
        return None
    points = bullets(blocks, level)
    return (
        POINTS_TITLE * _has(title, POSITIVE) + POINTS_ANCHOR * anchored + POINTS_BULLET * min(len(points), MOST_BULLETS) + min(len(title) + 1 + len(content), MOST_LENGTH) / 100,
        points,
        content,
    )


def find_section(html: str | None, anchor: str | None = None, description: str | None = None) -> dict:
    """The section: source (keyword, anchor, cluster, description or none), title, bullets, summary and content."""
    root = dom.parse(html or "")
    try:
        blocks = outline(root)
    except RecursionError:  # elements nested deeper than any real page's: text alone, without headings
        blocks = [Block(0, line) for line in root.text("\n", NOISE).split("\n") if line]
    heads = [i for i, b in enumerate(blocks) if b.level]

    def section(i: int) -> list[Block]:
        end = next((j for j in heads if j > i and blocks[j].level <= blocks[i].level), len(blocks))
        return blocks[i + 1 : end]

    found: list[tuple[float, int, str, str, list[str], str]] = []

    def offer(source: str, i: int, body: list[Block], anchored: bool = False) -> None:
        got = _score(blocks[i].text, body, blocks[i].level or 4, anchored)
        if got:
            found.append((got[0], -len(found), source, blocks[i].text, got[1], got[2]))

    for i in heads:
        if _has(blocks[i].text, POSITIVE):
            body = section(i)
            if blocks[i].level < 4 or (len(body) >= LEAST_LINES and sum(len(b.text) for b in body) >= LEAST_LENGTH):
                offer("keyword", i, body)
    key = normalise_text(anchor)
    if len(key) >= 6 and not _has(key, NEGATIVE):
        for i, b in enumerate(blocks):
            text = normalise_text(b.text)
            if (b.level and key in text) or (not b.level and text.startswith(key)):
                at = i if b.level else max((j for j in heads if j < i), default=None)
                if at is not None:
                    offer("anchor", at, section(at), True)
                break
    for n, i in enumerate(heads):
        level = blocks[i].level
        peers = [j for j in heads[n:] if blocks[j].level == level]
        stop = next((j for j in heads[n:] if blocks[j].level < level), len(blocks))
        peers = [j for j in peers if j < stop]
        parent = next((blocks[j].text for j in reversed(heads[:n]) if blocks[j].level < level), "")
        first = not any(blocks[j].level == level for j in heads[:n][-1:])
        if first and level < 4 and len(peers) >= 3 and not _has(parent, NEGATIVE) and not any(_has(blocks[j].text, NEGATIVE) for j in peers):
            offer("cluster", i, [Block(level + 1, blocks[i].text), *(Block(level + 1, b.text) if b.level == level else b for b in blocks[i + 1 : stop])])
    if found:
        _, _, source, title, points, content = max(found)
        return {"source": source, "title": title, "bullets": points, "summary": "\n".join(points)[:SUMMARY_LIMIT], "content": content[:CONTENT_LIMIT]}
    for n in dom.select(root, description) if description else []:
        inner = outline(n)
        text = "\n".join(b.text for b in inner)
        if is_prose(text):
            points = [p for p in bullets(inner, 0) if not p.endswith(":")]
            return {"source": "description", "title": None, "bullets": points, "summary": "\n".join(points)[:SUMMARY_LIMIT], "content": text[:CONTENT_LIMIT]}
    return {"source": "none", "title": None, "bullets": [], "summary": None, "content": None}


def find_sections(pages: DataFrame, keys: tuple[str, ...] = ("id",), description: str | dict[str, str] | None = None, anchor: str | None = None) -> DataFrame:
    """The section of every page; a page without one has source none.

    ``anchor`` names a column with a text that stands in the page's section; ``description``
    is the selector of descriptions, one for all pages or one per host."""
    schema = "source string, title string, bullets array<string>, summary string, content string"

    def read(html: str | None, url: str | None, text: str | None = None) -> dict:
        host = re.sub(r"^[A-Za-z]+://", "", url or "").split("/")[0]
        return find_section(html, text, description.get(host) if isinstance(description, dict) else description)

    return _per_page(pages, schema, read, list(keys), [anchor] if anchor else [])
