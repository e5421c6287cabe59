"""Captured pages: links, text, structured data and specifications. Every operator parses a
page once, in Arrow batches; what follows is done on columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.functions import dom
from lodeweave.functions import urls as U
from lodeweave.session import cut, spread

NAVIGATION = "nav, header, .menu, .nav, #menu, #nav"
NOISE = frozenset("script style template noscript nav header footer aside iframe svg".split())

LINKS = "ord int, href string, text string, in_nav boolean, has_img boolean"
PAGE = "title string, heading string, text string, name string, sku string, image string, price_text string, brand string, breadcrumb array<string>, source string, spec_lines array<string>, n_links int, n_cards int, has_pagination boolean, n_spec_fields int, n_products int"

# Names of specification fields, folded patterns of which a page is counted by.
_SPEC_FIELDS = [re.compile(p, re.I) for p in (r"công suất|power", r"điện áp|voltage", r"quang thông|lumen", r"nhiệt độ màu|\bcct\b", r"\bcri\b|hoàn màu", r"kích thước|dimension", r"chất liệu|material", r"tuổi thọ|lifetime", r"bảo hành|warranty", r"\bip\s?\d{2}\b|cấp bảo vệ", r"góc chiếu|beam")]
_PAGER = re.compile(r"[?&]page=\d|/page/\d+|\brel=[\"']?next", re.I)


def page_links(root: dom.Node, base: str) -> list[tuple]:
    """Absolute links without fragment; scripts, mail, telephone and same-page links are left out."""
    inside = {id(d) for n in dom.select(root, NAVIGATION) for d in (n, *n.walk())}
    out = []
    for n in root.walk():
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if not href or href.startswith("#") or re.match(r"(?i)(javascript|mailto|tel|data):", href):
            continue
        try:
            full = urldefrag(urljoin(base or "", href))[0]
        except ValueError:
            continue
        out.append((len(out), full, n.text(), id(n) in inside, any(d.tag == "img" for d in n.walk())))
    return out


def _json_ld(root: dom.Node) -> Iterator[list[dict]]:
    """Groups of nodes, one per block of linked data; broken blocks are skipped."""
    for n in root.walk():
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            try:
                data = json.loads("".join(c for c in n.children if isinstance(c, str)).strip().rstrip(";"))
            except ValueError:
                continue
            nodes, todo = [], [data]
            while todo:
                d = todo.pop(0)
                if isinstance(d, list):
                    todo = d + todo
                elif isinstance(d, dict):
                    nodes.append(d)
                    todo = (d["@graph"] if isinstance(d.get("@graph"), list) else []) + todo
            yield nodes


def _is(node: dict, kind: str) -> bool:
    t = node.get("@type")
    return kind in (t if isinstance(t, list) else [t])


def _first(v):
    while isinstance(v, list):
        v = v[0] if v else None
    return v


def _word(v) -> str | None:
    v = _first(v)
    if isinstance(v, dict):
        v = _first(v.get("name") or v.get("url") or v.get("@id"))
    return str(v).strip() or None if v is not None and not isinstance(v, dict) else None


def _offer(offers) -> str | None:
    """The price of an offer, or of its first price specification."""
    o = _first(offers)
    if not isinstance(o, dict):
        return None
    p = _first(o.get("price"))
    if p in (None, ""):
        spec = _first(o.get("priceSpecification"))
        p = spec.get("price") if isinstance(spec, dict) else None
    return None if p in (None, "") else str(p)


def _crumbs(node: dict) -> list[str]:
    items = node.get("itemListElement")
    named = []
    for i, it in enumerate(items if isinstance(items, list) else []):
        if isinstance(it, dict):
            label = _word(it.get("name")) or _word(it.get("item"))
            if label:
                named.append((it.get("position") if isinstance(it.get("position"), (int, float)) else i, label))
    return [label for _, label in sorted(named, key=lambda x: x[0])]


def _microdata(root: dom.Node, kind: str) -> list[dict]:
    """Items of a type as nodes of the same form as linked data."""
    out = []
    for n in root.walk():
        if n.attrs.get("itemtype", "").rstrip("/").endswith("/" + kind):
            node: dict = {"@type": kind}
            for d in n.walk():
                for prop in d.attrs.get("itemprop", "").split():
                    value = d.attrs.get("content") or d.attrs.get("src") or (d.attrs.get("href") if d.tag == "link" else None) or d.text()
                    if prop == "price":
                        node.setdefault("offers", {"price": value})
                    elif prop not in ("offers", "itemListElement"):
                        node.setdefault(prop, value)
            if kind == "BreadcrumbList":
                node["itemListElement"] = [{"name": d.text()} for d in n.walk() if "name" in d.attrs.get("itemprop", "").split()]
            out.append(node)
    return out


def _rdfa(root: dom.Node) -> list[dict]:
    """Typed items in RDFa attributes as nodes of the same form as linked data, in order. A property
    belongs to the nearest typed element around it; terms lose their vocabulary."""
    local = lambda terms: [re.split(r"[/#:]", t.rstrip("/#"))[-1] for t in terms.split()]
    out: list[dict] = []
    stack: list[tuple[dom.Node, dict | None, list[str]]] = [(root, None, [])]
    while stack:
        n, owner, waiting = stack.pop()
        a = n.attrs
        names = local(a.get("property", ""))
        if a.get("typeof"):
            item: dict = {"@type": local(a["typeof"])}
            out.append(item)
            for name in dict.fromkeys([*names, *local(a.get("rel", "")), *waiting]) if owner is not None else ():
                owner.setdefault(name, []).append(item)
            owner, waiting = item, []
        elif owner is not None:
            value = a.get("content") or a.get("src") or a.get("href") or a.get("resource") or (n.text() if names else "")
            for name in names:
                owner.setdefault(name, []).append(int(value) if name == "position" and value.isdecimal() else value)
            # A relation without a target of its own waits for the typed elements below.
            waiting = local(a["rel"]) if a.get("rel") and not (a.get("href") or a.get("src") or a.get("resource")) else waiting
        stack += [(c, owner, waiting) for c in reversed(n.children) if isinstance(c, dom.Node)]
    for item in out:
        if "position" in item:
            item["position"] = item["position"][0]
    return out


def structured(root: dom.Node) -> dict:
    """Product and breadcrumb: linked data before microdata before RDFa before social tags; the
    breadcrumb of the product's own block before the longest one."""
    groups = list(_json_ld(root))
    product = home = None
    source = "json-ld"
    for g in groups:
        product = next((n for n in g if _is(n, "Product")), None)
        if product:
            home = g
            break
    if product is None:
        items = _microdata(root, "Product")
        product, source = (items[0], "microdata") if items else (None, "")
    rdfa = _rdfa(root) if product is None else []
    if product is None:
        product = next((n for n in rdfa if _is(n, "Product")), None)
        source = "rdfa" if product else ""
    lists = [_crumbs(n) for n in home or [] if _is(n, "BreadcrumbList")] or sorted((_crumbs(n) for g in groups for n in g if _is(n, "BreadcrumbList")), key=len, reverse=True) or [_crumbs(n) for n in _microdata(root, "BreadcrumbList")] or [_crumbs(n) for n in rdfa if _is(n, "BreadcrumbList")]
    out = {"breadcrumb": lists[0] if lists else [], "n_products": sum(_is(n, "Product") for g in groups for n in g) + len(_microdata(root, "Product"))}
    if product is not None:
        out |= {"name": _word(product.get("name")), "sku": _word(product.get("sku")) or _word(product.get("mpn")), "image": _word(product.get("image")), "price_text": _offer(product.get("offers")), "brand": _word(product.get("brand")), "source": source}
    else:
        og = {n.attrs.get("property", n.attrs.get("name", "")): n.attrs.get("content", "") for n in root.walk() if n.tag == "meta"}
        if og.get("og:title"):
            out |= {"name": og["og:title"], "image": og.get("og:image") or None, "price_text": og.get("product:price:amount") or None, "source": "opengraph"}
    return out


def _own_lines(node: dom.Node) -> list[str]:
    """An item's or paragraph's lines: inline elements joined, broken at br, without nested items."""
    lines = [""]
    stack: list[dom.Node | str] = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            lines[-1] += c
        elif c.tag == "br":
            lines.append("")
        elif c.tag not in ("ul", "ol", "li", "p", "table", "dl") and c.tag not in dom.UNSHOWN:
            stack += reversed(c.children)
    return [" ".join(x.split()) for x in lines if x.strip()]


def spec_lines(root: dom.Node, scope: str | None = None) -> list[str]:
    """label: value lines of tables of two cells, definition lists and items with a colon, each once."""
    roots = dom.select(root, scope) if scope else [root]
    lines: dict[str, None] = {}
    for r in roots:
        for n in r.walk():
            if any(a.tag in NOISE for a in n.ancestors()):
                continue
            if n.tag == "tr":
                cells = [c.text() for c in n.children if isinstance(c, dom.Node) and c.tag in ("td", "th")]
                if len(cells) == 2 and all(cells):
                    lines[f"{cells[0].rstrip(':').strip()}: {cells[1]}"] = None
            elif n.tag == "dt":
                kids = [c for c in n.parent.children if isinstance(c, dom.Node)]
                after = kids[kids.index(n) + 1 :][:1]
                if after and after[0].tag == "dd":
                    lines[f"{n.text().rstrip(':').strip()}: {after[0].text()}"] = None
            elif n.tag in ("li", "p"):
                for t in _own_lines(n):
                    head, sep, rest = t.partition(":")
                    if sep and 0 < len(head.strip()) <= 40 and rest.strip() and "//" not in rest[:3] and not head.startswith(">"):
                        lines[f"{head.strip()}: {rest.strip()}"] = None
    return list(lines)


def read_page(html: str | None, url: str | None) -> dict:
    """All features of a page in one parse."""
    root = dom.parse(html or "")
    first = lambda tag: next((n.text() for n in root.walk() if n.tag == tag and n.text()), None)
    links = page_links(root, url or "")
    text = root.text("\n", NOISE)
    out = {"title": first("title"), "heading": first("h1"), "text": text, "name": None, "sku": None, "image": None, "price_text": None, "brand": None, "source": None}
    out |= structured(root)
    out |= {
        "spec_lines": spec_lines(root), "n_links": len(links), "n_cards": len({x[1] for x in links if x[4]}), "has_pagination": bool(_PAGER.search(html or "")), "n_spec_fields": sum(bool(p.search(text)) for p in _SPEC_FIELDS),
    }
    return out


def _per_page(pages: DataFrame, schema: str, read: Callable[..., list[dict] | dict], keys: list[str], more: list[str] | None = None) -> DataFrame:
    """(keys, schema): what ``read`` makes of the html and the url of every page, and of the columns ``more``."""
    more = more or []
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in zip(*(b[k] for k in keys), b["html"], b["url"], *(b[m] for m in more)):
                got = read(*r[len(keys) :])
                for g in got if isinstance(got, list) else [got]:
                    rows.append((*r[: len(keys)], *(g[n] for n in names)))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    chosen = pages.select(*dict.fromkeys((*keys, "url", "html", *more)))
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return spread(chosen).mapInPandas(run, f"{head}, {schema}")


def html_links(pages: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Every link of every page, in order; null pages have none."""
    names = ("ord", "href", "text", "in_nav", "has_img")
    return _per_page(pages.where("html is not null"), LINKS, lambda h, u: [dict(zip(names, x)) for x in page_links(dom.parse(h), u or "")], list(keys))


def read_pages(pages: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The features of every page; a null page has empty ones."""
    return _per_page(pages, PAGE, read_page, list(keys))


def nav_links(links: DataFrame, require: bool = False) -> DataFrame:
    """Links within navigation; for a page without any, all of its links unless ``require``."""
    inside = links.where("in_nav")
    if require:
        return inside
    return inside.unionByName(links.join(inside.select("id").distinct(), "id", "left_anti"))


def card_links(links: DataFrame) -> DataFrame:
    """Links around an image to a page of the same host, the first of each target; links has url."""
    own = links.where(F.col("has_img") & (U.host(F.col("href")) == U.host(F.col("url"))))
    return own.groupBy("id", "href").agg(F.min("ord").alias("ord"))


def page_kinds(features: DataFrame) -> DataFrame:
    """product, listing or other, by structured data, cards and specification fields."""
    kind = F.when(F.col("n_products") >= 1, F.lit("product")).when(F.col("n_cards") >= 30, F.lit("listing")).when(F.col("n_spec_fields") >= 5, F.lit("product")).otherwise(F.lit("other"))
    return features.withColumn("kind", kind)


def category_levels(features: DataFrame, leaf_hosts: list[str], host: str = "domain") -> DataFrame:
    """Three category levels of a breadcrumb: without its first and last label, the last three for
    hosts whose lists end at the category, the first three for the others."""
    inner = F.when(F.size("breadcrumb") > 2, F.slice("breadcrumb", 2, F.size("breadcrumb") - 2)).otherwise(F.array().cast("array<string>"))
    leaf = F.when(F.size(inner) > 3, F.slice(inner, -3, 3)).otherwise(inner)
    three = F.when(F.col(host).isin(leaf_hosts) if leaf_hosts else F.lit(False), leaf).otherwise(F.slice(inner, 1, 3))
    return features.withColumns({f"category_{i + 1}": F.get(three, F.lit(i)) for i in range(3)})


#: Most rules of css_fields and dom_categories; they are sent with every task.
MAX_RULES = 100_000


def css_fields(pages: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, field, value): the first rule of each field, by ord, that finds something on the page.

    ``rules`` (domain, ord, field, selector, attr) is configuration, read on the driver and
    sent with the task; each page is parsed once for all its rules."""
    by_domain: dict[str, list] = {}
    listed = rules.orderBy("domain", "ord").limit(MAX_RULES + 1).collect()
    if len(listed) > MAX_RULES:
        raise ValueError(f"there are at most {MAX_RULES} rules")
    for r in listed:
        by_domain.setdefault(r.domain, []).append((r.field, r.selector, r.attr))

    def read(html: str | None, url: str | None) -> list[dict]:
        host = re.sub(r"^[a-z]+://", "", url or "").split("/")[0]
        chosen = by_domain.get(host, [])
        if not chosen or not html:
            return []
        root, out = dom.parse(html), {}
        for field, selector, attr in chosen:
            if field not in out:
                value = next((v for v in ((n.attrs.get(attr, "").strip() if attr else n.text()) for n in dom.select(root, selector)) if v), None)
                if value:
                    out[field] = value
        return [{"field": f, "value": v} for f, v in out.items()]

    return _per_page(pages, "field string, value string", read, list(keys))


def dom_categories(pages: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, labels): the texts of the links that the domain's selector finds, in order, each once,
    without the link to the page itself; null for domains without a selector and for null pages.

    ``rules`` has (domain, selector), at most MAX_RULES of them, else ValueError."""
    listed = rules.select("domain", "selector").limit(MAX_RULES + 1).collect()
    if len(listed) > MAX_RULES:
        raise ValueError(f"there are at most {MAX_RULES} rules")
    chosen = {r.domain: r.selector for r in listed}

    def read(html: str | None, url: str | None) -> dict:
        selector = chosen.get(re.sub(r"^[a-z]+://", "", url or "").split("/")[0])
        if selector is None or html is None:
            return {"labels": None}
        own = (url or "").rstrip("/")
        found = ((n.text(), urldefrag(urljoin(url or "", n.attrs.get("href", "")))[0].rstrip("/") if n.attrs.get("href") else "") for n in dom.select(dom.parse(html), selector))
        return {"labels": list(dict.fromkeys(text for text, target in found if text and target != own))}

    return _per_page(pages, "labels array<string>", read, list(keys))


def anchored_levels(labels: Column, anchors: Column) -> list[Column]:
    """Three category levels of a list of labels: from the first label on that is one of the
    ``anchors``; from the first label where none is."""
    at = F.array_position(F.transform(labels, lambda x: F.array_contains(anchors, x)), True)
    rest = F.slice(labels, F.greatest(at, F.lit(1)).cast("int"), 3)
    return [F.get(rest, F.lit(i)) for i in range(3)]


def chosen_levels(from_page: list[Column], from_data: list[Column]) -> list[Column]:
    """The levels that the page's own list gives, if it gives the first; else those of the structured
    data. All levels come from the same place."""
    return [F.when(from_page[0].isNotNull(), a).otherwise(b) for a, b in zip(from_page, from_data)]


def rebuild(pages: DataFrame, version: str) -> DataFrame:
    """Extraction rows of captured pages by structured data, headings and specification lines."""
    got = read_pages(pages, keys=("id", "url", "domain"))
    levels = category_levels(got, [])
    return levels.select(
        F.col("id").alias("snapshot_id"), "url", "domain", F.lit(version).alias("extractor_version"), F.coalesce("name", "heading", "title").alias("ten_san_pham"), F.col("sku").alias("ma_san_pham"),
        "category_1", "category_2", "category_3", F.col("image").alias("link_anh_san_pham"), F.nullif(F.array_join("spec_lines", "\n"), F.lit("")).alias("thong_so_ky_thuat"),
    )


def context_text(html: str | None, limit: int = 12_000) -> str:
    """What a model is shown of a page: its specification lines, then its other text, each line once."""
    root = dom.parse(html or "")
    lines = dict.fromkeys([*spec_lines(root), *root.text("\n", NOISE).split("\n")])
    return "\n".join(x for x in lines if x)[:limit]


def contexts(pages: DataFrame, keys: tuple[str, ...] = ("id",), limit: int = 12_000) -> DataFrame:
    """(keys, context) of every page."""
    return _per_page(pages, "context string", lambda h, u: {"context": context_text(h, limit)}, list(keys))


def known_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links to known urls, closing slashes aside, each with the url as it is known."""
    keyed = known.select(F.col("url").alias("product_url"), U.slash_key(F.col("url")).alias("_k")).groupBy("_k").agg(F.min("product_url").alias("product_url"))
    return links.withColumn("_k", U.slash_key(F.col("href"))).join(keyed, "_k").drop("_k")


# Fixed value: how a url names a further page of a listing.
PAGE_MARKER = r"(?i)[/?&](?:page|paged|trang)[=/-]?\d+"


def pager_links(links: DataFrame) -> DataFrame:
    """Links from a listing to its further pages: a page marker, and the listing's own path or
    one below it; a path that only begins with the same letters is another listing's."""
    marked = F.rlike("href", F.lit(PAGE_MARKER))
    own = F.regexp_replace(U.path(F.col("url")), "/+$", "")
    rest = F.substring(U.path(F.col("href")), F.length(own) + 1, F.length("href"))
    below = F.startswith(U.path(F.col("href")), own) & ((rest == "") | F.startswith(rest, F.lit("/")))
    return links.where(marked & below & (U.host(F.col("href")) == U.host(F.col("url"))))


def walk_categories(categories: DataFrame, links: DataFrame, known: DataFrame, max_pages: int = 20) -> tuple[DataFrame, DataFrame]:
    """The products of every category, on its page and its further pages, and how the walk went.

    ``categories`` has url; ``links`` (url, href) are those of the captured pages, so a page
    without links there can't be read; ``known`` has the url of products. Returns (category,
    product_url) and (category, pages_fetched, ok): a category whose first page can't be read
    isn't ok and has no products, which says nothing about it; one that can and has none is
    empty. At most ``max_pages`` pages of a category are read, nearer ones and then lesser
    urls first. Every round reads the pages that the round before has found, in one join."""
    captured = cut(links.where("url is not null and href is not null").select("url", "href").distinct())
    pages = captured.select("url").distinct()
    roots = categories.where("url is not null").select(F.col("url").alias("category")).distinct()
    frontier = cut(roots.select("category", F.col("category").alias("url"), F.lit(0).alias("hop")))
    read = frontier.limit(0)
    while True:
        # Ranks run within one category and hop; what exceeds the budget of pages is cut off.
        taken = read.groupBy("category").agg(F.count("*").alias("_taken"))
        ranked = frontier.join(pages, "url", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("url")))
        now = cut(ranked.join(taken, "category", "left").where(F.col("_n") + F.coalesce("_taken", F.lit(0)) <= max_pages).select("category", "url", "hop"))
        if now.isEmpty():
            break
        read = cut(read.unionByName(now))
        onward = now.join(captured, "url").select("category", F.col("category").alias("url"), "href", "hop")
        new = pager_links(onward).select("category", F.col("href").alias("url"), F.col("hop") + 1).toDF("category", "url", "hop").distinct()
        frontier = cut(new.join(read, ["category", "url"], "left_anti"))
    found = known_links(read.join(captured, "url").select("category", "href"), known).select("category", "product_url").distinct()
    fetched = read.groupBy("category").agg(F.count("*").alias("pages_fetched"))
    report = roots.join(fetched, "category", "left").select("category", F.coalesce("pages_fetched", F.lit(0)).alias("pages_fetched"), F.col("pages_fetched").isNotNull().alias("ok"))
    return found, report


def sku_code(sku: str):
    """(code, raw id): a sku with a letter is a model code, one of digits alone only an id."""
    c = F.trim(F.col(sku))
    return F.when(F.rlike(c, F.lit(r"\p{L}")), c), F.nullif(c, F.lit(""))


def parse_tags(answers: DataFrame, column: str = "answer", most: int = 60, longest: int = 200) -> DataFrame:
    """Model answers with ``tags``, entries of (key, value), and ``error`` for answers that hold none.

    Code fences are stripped; keys are trimmed; blank and overlong values are left out."""
    body = F.regexp_replace(F.regexp_replace(F.col(column), r"(?s)^\s*```\w*\s*", ""), r"(?s)\s*```\s*$", "")
    parsed = F.from_json(body, "tags map<string,string>")
    entries = F.transform(F.map_entries(parsed["tags"]), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    kept = F.slice(F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != "") & (F.length(e["value"]) <= longest)), 1, most)
    return answers.withColumns({"tags": kept, "error": F.when(parsed["tags"].isNull(), F.lit("no tags object"))})


def grounded_tags(tags: DataFrame, source: str) -> DataFrame:
    """Tags all of whose parts stand in the source text; with an empty source all stay."""
    from lodeweave.functions.text import squeeze

    text = squeeze(F.col(source))
    parts = F.filter(F.transform(F.split("value", r"[/,;()]+"), squeeze), lambda p: p != "")
    return tags.where((F.coalesce(text, F.lit("")) == "") | F.forall(parts, lambda p: F.contains(text, p)))
