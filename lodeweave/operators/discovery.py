"""Finding product pages: sitemaps, URL shapes, bounded walks, and ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.functions import urls as U
from lodeweave.session import cut, small


def robots_sitemaps(robots: DataFrame, body: str = "body") -> DataFrame:
    """(domain, ord, url) of the Sitemap lines of robots files."""
    found = F.regexp_extract_all(F.col(body), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)\s*$"), F.lit(1))
    return robots.select("domain", F.posexplode(found).alias("ord", "url"))


def sitemap_candidates(listed: DataFrame, sites: DataFrame) -> DataFrame:
    """(domain, ord, url): listed sitemaps first, then the usual places; each url once."""
    # The places where sitemaps usually lie.
    usual = F.array(*[F.lit(p) for p in ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")])
    places = sites.where("base_url is not null").select("domain", F.posexplode(F.transform(usual, lambda p: F.concat(U.slash_key(F.col("base_url")), p))).alias("k", "url"))
    both = listed.select("domain", F.col("ord").alias("k"), "url").unionByName(places.withColumn("k", F.col("k") + 1_000_000))
    return both.groupBy("domain", "url").agg(F.min("k").alias("k")).select("domain", F.row_number().over(Window.partitionBy("domain").orderBy("k", "url")).alias("ord"), "url")


_LOC = r"(?is)<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(url, kind, loc) of sitemap files, kind index or urlset.

    Read tolerantly by pattern, so that a broken file gives what it holds; files whose root
    is something else, such as a page served in their place, give nothing."""
    root = F.lower(F.regexp_extract("body", r"(?is)^\s*(?:\xef\xbb\xbf|﻿)?(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:\w+:)?(\w+)", 1))
    kind = F.when(root == "sitemapindex", F.lit("index")).when(root == "urlset", F.lit("urlset"))
    locs = F.transform(F.regexp_extract_all("body", F.lit(_LOC), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return files.select("url", kind.alias("kind"), "body").where("kind is not null").select("url", "kind", F.explode(locs).alias("loc")).where("loc != ''")


# What names sitemaps of products and of their groupings.
_PRODUCT, _TAXONOMY = r"(?i)product|san-?pham", r"(?i)categor|danh-?muc|taxonom|_cat|-cat|tag|brand|collection"


def resolve_sitemaps(files: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, loc, kind): pages below each root sitemap, kind product or listing.

    Sub-sitemaps named after products are followed, those named after groupings give
    listings; where an index names neither, all are followed and no listing is given. At
    most ``depth`` levels are walked, each one join."""
    entries = cut(sitemap_entries(files))
    level = roots.select(F.col("url").alias("root"), F.col("url").alias("url"), F.lit("product").alias("as"))
    out = None
    for step in range(depth):
        here = level.join(entries, "url")
        pages = here.where("kind = 'urlset'").select("root", "loc", F.col("as").alias("kind"))
        out = pages if out is None else out.unionByName(pages)
        if step + 1 == depth:
            break
        kids = here.where("kind = 'index'").select("root", "url", "as", "loc", F.rlike("loc", F.lit(_TAXONOMY)).alias("_t"), F.rlike("loc", F.lit(_PRODUCT)).alias("_p"))
        named = kids.groupBy("root", "url").agg(F.bool_or(F.col("_p") & ~F.col("_t")).alias("_named"))
        kids = kids.join(named, ["root", "url"])
        kind = F.when(~F.col("_named"), F.col("as")).when(F.col("_t"), F.lit("listing")).when(F.col("_p"), F.col("as"))
        level = kids.select("root", F.col("loc").alias("url"), kind.alias("as")).where("`as` is not null").distinct()
    return out.groupBy("root", "loc").agg(F.max("kind").alias("kind"))


def select_urls(urls: DataFrame, base: Column, pattern: Column) -> DataFrame:
    """Product urls: trimmed, neither blank nor the home page, holding the pattern if there is one; of
    urls that differ in closing slashes alone the first by ``ord`` stays, as it is written."""
    rows = urls.withColumn("url", F.trim("url")).withColumn("_key", U.slash_key(F.col("url")))
    rows = rows.where((F.col("url") != "") & (F.col("_key") != F.coalesce(U.slash_key(base), F.lit(""))) & U.admits(F.col("url"), pattern))
    first = rows.groupBy("domain", "_key").agg(F.min(F.struct("ord", "url")).alias("f"))
    return first.select("domain", F.col("f.url").alias("url"))


def shape_groups(urls: DataFrame) -> DataFrame:
    """(domain, shape, n) of the shapes of urls."""
    return urls.groupBy("domain", U.shape(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))


def sample_by_shape(urls: DataFrame, least: int = 5, share: float = 0.1, most: int = 20) -> DataFrame:
    """A repeatable sample of each shape: the urls of least hash, ``share`` of the group, between
    ``least`` and ``most`` of them. Only the kept hashes travel: ranks are cut before the window."""
    rows = urls.select("domain", "url", U.shape(F.col("url")).alias("shape")).withColumn("_h", F.xxhash64("url"))
    sizes = rows.groupBy("domain", "shape").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("domain", "shape").orderBy("_h", "url"))
    head = rows.withColumn("_r", rank).where(F.col("_r") <= most)
    want = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("n") * share)))
    return head.join(sizes, ["domain", "shape"]).where(F.col("_r") <= want).select("domain", "shape", "url", "n")


def shape_verdicts(sampled: DataFrame, hits: DataFrame, accept: float = 0.8, reject: float = 0.2) -> DataFrame:
    """(domain, shape, n, sampled, hits, verdict): accept or reject a whole shape, or verify its urls singly."""
    marked = sampled.join(hits.select("url").distinct().withColumn("_hit", F.lit(1)), "url", "left")
    per = marked.groupBy("domain", "shape").agg(F.max("n").alias("n"), F.count("*").alias("sampled"), F.count("_hit").alias("hits"))
    ratio = F.col("hits") / F.col("sampled")
    return per.withColumn("verdict", F.when(ratio >= accept, F.lit("accept")).when(ratio <= reject, F.lit("reject")).otherwise(F.lit("verify")))


def dominant_shape(links: DataFrame) -> DataFrame:
    """Links of each page that aren't of its most frequent shape; the shape of the first link wins a tie."""
    rows = links.withColumn("_shape", U.shape(F.col("href")))
    counts = rows.groupBy("url", "_shape").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    top = counts.groupBy("url").agg(F.max(F.struct("n", -F.col("first"), "_shape")).alias("t")).select("url", F.col("t._shape").alias("_top"))
    return rows.join(top, "url").where("_shape != _top").drop("_shape", "_top")


def repeated_shapes(links: DataFrame, least: int = 6) -> DataFrame:
    """Links of shapes that a page repeats at least ``least`` times."""
    rows = links.withColumn("shape", U.shape(F.col("href")))
    often = rows.groupBy("url", "shape").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(often.select("url", "shape"), ["url", "shape"], "left_semi")


def walk(seeds: DataFrame, links: DataFrame, hops: int = 2, budget: int = 1500, further: DataFrame | None = None) -> DataFrame:
    """(domain, url, hop) of pages reached from the seeds along links, breadth first.

    ``further`` holds links (url, href) that are no hop of their own, such as those from a
    listing to its next pages; they are followed to their end at each hop. Each domain visits
    at most ``budget`` pages, which is the feature: nearer ones first, then by url. One join
    and one checkpoint per hop, and per round of further links."""
    edges, level = (x.select(F.col("url").alias("_from"), F.col("href").alias("url")).distinct() if x is not None else None for x in (links, further))
    level = cut(level) if level is not None else None
    step = 0
    seen = cut(seeds.select("domain", "url").distinct().withColumns({"hop": F.lit(0), "_step": F.lit(0)}))

    def visit(front: DataFrame, along: DataFrame, hop: int) -> DataFrame:
        reached = front.select("domain", F.col("url").alias("_from")).join(along, "_from").select("domain", "url").distinct()
        new = reached.join(seen, ["domain", "url"], "left_anti").withColumns({"hop": F.lit(hop), "_step": F.lit(step)})
        rank = F.row_number().over(Window.partitionBy("domain").orderBy("hop", "_step", "url"))
        return cut(seen.unionByName(new).withColumn("_r", rank).where(F.col("_r") <= budget).drop("_r"))

    for hop in range(hops + 1):
        if hop:
            step += 1
            seen = visit(seen.where(F.col("hop") == hop - 1), edges, hop)
        while level is not None and not (front := seen.where(F.col("_step") == step)).isEmpty():
            step += 1
            seen = visit(front, level, hop)
    return seen.drop("_step")


def excluded(domains: DataFrame, blocked: DataFrame) -> DataFrame:
    """(domain, blocked) of domains that are, or lie below, a blocked one.

    Every ending of a domain is looked up, so the join is by equality."""
    labels = F.split("domain", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return domains.select("domain", F.explode(endings).alias("blocked")).join(small(blocked.select(F.col("domain").alias("blocked")).distinct()), "blocked").groupBy("domain").agg(F.max("blocked").alias("blocked"))


def hits_by_domain(hits: DataFrame) -> DataFrame:
    """(domain, rank, queries, title, url) of search hits: best rank, different queries, first title and url."""
    per_query = hits.groupBy("domain", "query").agg(F.min(F.struct("rank", "title", "url")).alias("b"))
    return per_query.groupBy("domain").agg(F.min("b.rank").alias("rank"), F.count("*").alias("queries"), F.min("b").getField("title").alias("title"), F.min("b").getField("url").alias("url"))


def two_phase(candidates: DataFrame, score: Column, top: int) -> DataFrame:
    """The ``top`` by score among the 3 ``top`` of best rank and most queries: the score, which may be
    costly, is taken of the short list alone."""
    short = candidates.orderBy("rank", F.desc("queries"), "domain").limit(3 * top)
    return short.withColumn("score", score).orderBy(F.desc("score"), "rank", "domain").limit(top)


def signal_score(signals: Column) -> Column:
    """The sum of the points of (name, points, reason) signals."""
    return F.aggregate(signals, F.lit(0), lambda acc, s: acc + s["points"])


def explain(signals: Column) -> Column:
    """The signals in words, as name +points: reason."""
    return F.array_join(F.transform(signals, lambda s: F.concat(s["name"], F.when(s["points"] >= 0, F.lit(" +")).otherwise(F.lit(" ")), s["points"].cast("string"), F.lit(": "), s["reason"])), "; ")


def sitemap_reliability(entries: DataFrame, products: DataFrame, sample: int = 10) -> DataFrame:
    """(domain, sampled, reliability): the share of products among the ``sample`` entries of least hash."""
    w = Window.partitionBy("domain").orderBy(F.xxhash64("url"), "url")
    head = entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
    marked = head.join(products.select("url").distinct().withColumn("_hit", F.lit(1)), "url", "left")
    return marked.groupBy("domain").agg(F.count("*").alias("sampled"), (F.count("_hit") / F.count("*")).alias("reliability"))


def decode_redirect(url: Column) -> Column:
    """The target that a search engine's redirect carries as base64 in u=a1..., else the url itself."""
    coded = F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_\-]+)", 1)
    text = F.decode(F.unbase64(F.translate(coded, "-_", "+/")), "utf-8")
    return F.when((coded != "") & F.rlike(text, F.lit("^https?://")), text).otherwise(url)


def fresh(probes: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Probe results that are younger than ``days``, the newest of each domain."""
    best = probes.where(F.col("probed_at") > now - F.expr(f"INTERVAL {int(days)} DAYS")).groupBy("domain").agg(F.max("probed_at").alias("probed_at"))
    return probes.join(best, ["domain", "probed_at"], "left_semi")


def candidate_links(links: DataFrame, least: int = 6) -> DataFrame:
    """(url, href, ord) of what may be products on each page: its cards; on pages with fewer than
    ``least`` of them also links of repeated shapes within the host."""
    from lodeweave.operators.pages import card_links

    cards = card_links(links.withColumn("id", F.col("url"))).select(F.col("id").alias("url"), "href", "ord")
    enough = cards.groupBy("url").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("url")
    own = links.where((U.host(F.col("href")) == U.host(F.col("url"))) & (U.slash_key(F.col("href")) != U.slash_key(F.col("url"))))
    more = repeated_shapes(own.join(enough, "url", "left_anti")).select("url", "href", "ord")
    return cards.unionByName(more).groupBy("url", "href").agg(F.min("ord").alias("ord"))


#: Cards from which on a page whose kind isn't known is a listing.
LISTING_CARDS = 30
# A listing's further page, by the end of its path.
_PAGE_END = r"(?i)/(?:page|trang)[/-]\d+/*(?=[?#]|$)"


def followed(links: DataFrame, candidates: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (url, href) that a walk follows, and those that lead on within one listing.

    A listing leads to its other pages and to candidates that aren't of its most frequent
    shape, which is that of its products; a product leads nowhere; any other page to its
    navigation and cards. Links to files, dated paths and other hosts aren't followed."""
    from lodeweave.operators.pages import card_links, nav_links, pager_links

    said = pages.groupBy("url").agg(F.when(F.bool_or(F.col("kind") == "listing"), "listing").when(F.bool_or(F.col("kind") == "product"), "product").when(F.bool_or(F.col("kind").isNotNull()), "other").alias("_said"))
    guess = links.groupBy("url").agg(F.when(F.count_distinct(F.when(F.col("has_img"), F.col("href"))) >= LISTING_CARDS, "listing").otherwise("other").alias("_guess"))
    kinds = cut(guess.join(said, "url", "left").select("url", F.coalesce("_said", "_guess").alias("_kind")))
    of = lambda df, kind: df.join(kinds.where(F.col("_kind") == kind).select("url"), "url", "left_semi")
    # The root of a listing's further page is the listing itself.
    rooted = of(links, "listing").withColumn("id", F.col("url")).withColumn("url", F.regexp_replace("url", _PAGE_END, ""))
    within = pager_links(rooted).select(F.col("id").alias("url"), "href")
    other = of(links, "other").withColumn("id", F.col("url"))
    nav = nav_links(other).select("url", "href")
    deeper = dominant_shape(of(candidates, "listing")).select("url", "href").unionByName(nav).unionByName(card_links(other).select(F.col("id").alias("url"), "href"))
    good = (U.host(F.col("href")) == U.host(F.col("url"))) & ~U.is_file(F.col("href")) & ~U.is_dated(F.col("href"))
    return deeper.where(good), within.where(good)


def discover(seeds: DataFrame, links: DataFrame, pages: DataFrame, hops: int = 2, budget: int = 1500) -> DataFrame:
    """(domain, url): product pages found without a sitemap.

    Pages within ``hops`` are walked, see :func:`followed`; the pages of a listing count as one
    hop. Their candidates, and products met on the way, are taken unless navigation names them;
    a sample of each shape decides for the whole shape, or its urls are verified singly.
    ``links`` has url, href, ord, in_nav, has_img; ``pages`` has url and kind."""
    from lodeweave.operators.pages import nav_links

    candidates = cut(candidate_links(links))
    deeper, within = followed(links, candidates, pages)
    reached = walk(seeds, deeper, hops, budget, within)
    products = pages.where("kind = 'product'").select("url").distinct()
    named = nav_links(links.join(reached, "url", "left_semi"), require=True).select(U.slash_key(F.col("href")).alias("_k")).distinct()
    met = reached.join(products, "url", "left_semi").select("domain", "url")
    new = candidates.join(reached.select("domain", "url"), "url").select("domain", F.col("href").alias("url")).unionByName(met).distinct()
    new = new.where(~U.is_file(F.col("url")) & ~U.is_dated(F.col("url"))).withColumn("_k", U.slash_key(F.col("url"))).join(named, "_k", "left_anti").drop("_k")
    new = cut(new)
    verdicts = shape_verdicts(sample_by_shape(new), products)
    judged = new.withColumn("shape", U.shape(F.col("url"))).join(verdicts.select("domain", "shape", "verdict"), ["domain", "shape"])
    single = judged.where("verdict = 'verify'").join(products.select("url"), "url", "left_semi")
    return judged.where("verdict = 'accept'").select("domain", "url").unionByName(single.select("domain", "url"))
