"""Queries of the page, discovery and stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import urls as U
from lodeweave.functions.text import contains_tokens, fold_key, tokens
from lodeweave.operators import discovery, pages, sections, store
from lodeweave.plans.records import _t
from lodeweave.streaming import ingest


def _links(c: DataFrame) -> DataFrame:
    """Category pages' links to products, in order of the product."""
    distinct = c.select("domain", "category_url", "product_url").distinct()
    return distinct.select("domain", F.col("category_url").alias("url"), F.col("product_url").alias("href"), F.xxhash64("product_url").alias("ord"))


def _sitemaps(c: DataFrame) -> DataFrame:
    """A sitemap per category, and one index per domain that names them."""
    locs = c.where("product_url is not null").groupBy("domain", "category_url").agg(F.array_sort(F.collect_set(F.concat(F.lit("<url><loc>"), F.col("product_url"), F.lit("</loc></url>")))).alias("l"))
    files = locs.select(F.concat("category_url", F.lit("#product.xml")).alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join("l", "\n"), F.lit("</urlset>")).alias("body"))
    index = c.where("product_url is not null").groupBy("domain").agg(F.array_sort(F.collect_set(F.concat(F.lit("<sitemap><loc>"), F.col("category_url"), F.lit("#product.xml</loc></sitemap>")))).alias("l"))
    return files.unionByName(index.select("domain", F.concat(F.lit("<sitemapindex>"), F.array_join("l", ""), F.lit("</sitemapindex>")).alias("body")).withColumnRenamed("domain", "url"))


def _resolved(c: DataFrame) -> DataFrame:
    return discovery.resolve_sitemaps(_sitemaps(c), c.select(F.col("domain").alias("url")).distinct()).withColumnRenamed("root", "domain")


def _verdicts(p: DataFrame, e: DataFrame) -> DataFrame:
    good = store.current_state(e).where("crawl_status = 'ok'")
    return discovery.shape_verdicts(discovery.sample_by_shape(p.select("domain", "url").distinct(), least=5, share=1.0, most=1_000_000_000), good)


def _walk(p: DataFrame, c: DataFrame) -> DataFrame:
    return discovery.walk(p.where("ok").select("domain", "url"), c.select(F.col("category_url").alias("url"), F.col("product_url").alias("href")), hops=2, budget=1_000_000_000)


def _candidates(e: DataFrame) -> DataFrame:
    return e.groupBy("domain").agg(F.min("id").alias("rank"), F.count_distinct("category_1").alias("queries"), F.count_if(F.col("gia.kind") == "amount").alias("priced"))


def _discovered(s: DataFrame, p: DataFrame, c: DataFrame, e: DataFrame) -> DataFrame:
    """Discovery over the category pages as listings that show their products as cards."""
    links = _links(c).select("url", "href", F.col("ord").alias("ord"), F.lit(False).alias("in_nav"), F.lit(True).alias("has_img"))
    kinds = store.current_state(e).where("crawl_status != 'not-a-product'").select("url", F.lit("product").alias("kind"))
    return discovery.discover(p.where("ok").select("domain", "url"), links, kinds, hops=2, budget=1_000_000_000)


QUERIES = {
    "page_features": _t("page_snapshots")(lambda p: pages.read_pages(p).select("id", "title", "heading", F.array_join("spec_lines", "\n").alias("spec"), "n_links", "n_cards")),
    "page_kinds": _t("page_snapshots")(lambda p: pages.page_kinds(pages.read_pages(p)).groupBy("kind").agg(F.count("*").alias("n"))),
    "page_links": _t("page_snapshots")(lambda p: pages.html_links(p)),
    "css_fields": _t("page_snapshots", "sites")(lambda p, s: pages.css_fields(p, s.select("domain", F.lit(1).alias("ord"), F.lit("price").alias("field"), F.lit("span.price").alias("selector"), F.lit(None).cast("string").alias("attr")))),
    "rebuilt": _t("page_snapshots")(lambda p: pages.rebuild(p.where("http_status = 200"), "v8").select("snapshot_id", "ten_san_pham", "thong_so_ky_thuat")),
    "shape_groups": _t("page_snapshots")(lambda p: discovery.shape_groups(p)),
    "shape_verdicts": _t("page_snapshots", "extractions")(_verdicts),
    "select_urls": _t("page_snapshots")(lambda p: discovery.select_urls(p.select("domain", "url", F.col("id").alias("ord")), F.lit(None).cast("string"), F.lit("-p1"))),
    "file_and_dated": _t("page_snapshots")(lambda p: p.select("id", U.is_file(F.col("final_url")).alias("is_file"), U.is_dated(F.col("final_url")).alias("is_dated"))),
    "sitemap_entries": _t("category_products")(lambda c: discovery.sitemap_entries(_sitemaps(c)).groupBy("url", "kind").agg(F.count("*").alias("n"))),
    "sitemap_products": _t("category_products")(_resolved),
    "sitemap_candidates": _t("sites")(lambda s: discovery.sitemap_candidates(discovery.robots_sitemaps(s.where("base_url is not null").select("domain", F.concat(F.lit("User-agent: *\nSitemap: "), F.col("base_url"), F.lit("/main.xml\nsitemap:"), F.col("base_url"), F.lit("/sitemap.xml\n")).alias("body"))), s)),
    "dominant_shape": _t("category_products")(lambda c: discovery.dominant_shape(_links(c)).select("url", "href")),
    "repeated_shapes": _t("category_products")(lambda c: discovery.repeated_shapes(_links(c)).select("url", "href", "shape")),
    "walk": _t("category_pages", "category_products")(_walk),
    "excluded": _t("documents", "sites")(lambda d, s: discovery.excluded(d.select(F.col("source").alias("domain")).where("source is not null").distinct(), s.select(F.regexp_replace("domain", "^www\\.", "").alias("domain")).where("domain like 'den%'"))),
    "hits_by_domain": _t("extractions")(lambda e: discovery.hits_by_domain(e.select("domain", F.col("category_1").alias("query"), F.col("id").cast("int").alias("rank"), F.col("ten_san_pham").alias("title"), "url"))),
    "two_phase": _t("extractions")(lambda e: discovery.two_phase(_candidates(e), F.col("priced") - 3 * F.col("queries"), 4)),
    "signal_score": _t("extractions")(lambda e: _candidates(e).select("domain", F.array(F.struct(F.lit("queries").alias("name"), F.when(F.col("queries") > 20, 1).otherwise(-2).alias("points"), F.lit("categories").alias("reason")), F.struct(F.lit("priced").alias("name"), F.lit(3).alias("points"), F.lit("prices").alias("reason"))).alias("s")).select("domain", discovery.signal_score(F.col("s")).alias("score"), discovery.explain(F.col("s")).alias("why"))),
    "changes_only": _t("events")(lambda e: ingest.changes_only(e.select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")),
    "windowed_counts": _t("events")(lambda e: ingest.windowed_counts(e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "1 hour", "10 minutes", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))),
    "silent": _t("events")(lambda e: ingest.silent(e, "user_id", "ts", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))),
    "backoff": _t("events")(lambda e: ingest.backoff(e, "user_id", "event_id", F.col("event_type") == "error")),
    "brand_in_name": _t("extractions")(lambda e: e.where("ten_san_pham is not null").select("id", contains_tokens(tokens(F.col("ten_san_pham")), F.array(F.lit("mirasol"), F.lit("vi"))).alias("hit"))),
    "sections": _t("page_snapshots")(lambda p: sections.find_sections(p).groupBy("source").agg(F.count("*").alias("n"))),
    "contexts": _t("page_snapshots")(lambda p: pages.contexts(p)),
    "known_links": _t("category_products", "page_snapshots")(lambda c, p: pages.known_links(_links(c).select("url", F.concat("href", F.lit("/")).alias("href")), p.where("url not like '%/'").select("url").distinct()).select("url", "href", "product_url")),
    "pager_links": _t("category_pages")(lambda c: pages.pager_links(c.select("url", F.explode(F.array(F.concat("url", F.lit("?page=2")), F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/paged/2")), F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/trang2")), F.concat(F.regexp_replace("url", "/+$", ""), F.lit("-x/page/3")), F.concat("url", F.lit("?p=12")), F.lit("https://other.example/?page=2"), F.col("url"))).alias("href")))),
    "sku_codes": _t("extractions")(lambda e: e.select("id", *(c.alias(n) for c, n in zip(pages.sku_code("ma_san_pham"), ("code", "raw"))))),
    "sap_codes": _t("extractions")(lambda e: e.select("id", *(c.alias(n) for c, n in zip(pages.sku_code("ma_sap"), ("code", "raw"))))),
    "grounded_tags": _t("product_tags", "extractions")(lambda t, e: pages.grounded_tags(t.where("value is not null").join(e.select(F.col("id").alias("extraction_id"), "thong_so_ky_thuat"), "extraction_id"), "thong_so_ky_thuat").select("extraction_id", "ord", "key", "value")),
    "sitemap_reliability": _t("page_snapshots", "extractions")(lambda p, e: discovery.sitemap_reliability(p.select("domain", "url").distinct(), store.current_state(e).where("crawl_status = 'ok'"), 1_000_000_000)),
    "discovered": _t("sites", "category_pages", "category_products", "extractions")(_discovered),
    "fold_keys": _t("product_tags")(lambda t: t.groupBy(fold_key(F.col("key")).alias("key")).agg(F.count("*").alias("n"))),
}

_SHAPE = "regexp_extract(regexp_replace(regexp_replace(split_part(split_part({0}, '#', 1), '?', 1), '^[a-z]+://[^/]*', ''), '/+$', ''), '^(.*/)?[^/]*$', 1) || '*' || regexp_extract(regexp_replace(split_part(split_part({0}, '#', 1), '?', 1), '/+$', ''), '([.][A-Za-z0-9]{{1,5}})$', 1)"
_FOLD = "regexp_replace(replace(lower(strip_accents(key)), 'đ', 'd'), '[^\\pL\\pN]+', '', 'g')"
_LINKS = "l as (select distinct domain, category_url as url, product_url as href, " + _SHAPE.format("product_url") + " as shape from category_products)"

# Texts of the captured pages, whose form is known: a title, a heading and a list of lines.
_CLEAN = "trim(regexp_replace({0}, '[\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_SHOWN = "nullif(trim(regexp_replace(regexp_extract(html, '<{0}>([^<]*)</{0}>', 1), '\\s+', ' ', 'g')), '')"
_HEADING, _TITLE = _SHOWN.format("h1"), _SHOWN.format("title")
_LINES = "list_filter(list_transform(regexp_extract_all(html, '<li>([^<]*)</li>', 1), lambda x: " + _CLEAN.format("x") + "), lambda x: regexp_matches(x, '^[^:>][^:]{0,40}:.*[^ ]') and length(trim(split_part(x, ':', 1))) between 1 and 40 and trim(regexp_extract(x, '^[^:]*:(.*)$', 1)) <> '' and not contains(left(regexp_extract(x, '^[^:]*:(.*)$', 1), 3), '//'))"
_PAIRS = f"list_transform({_LINES}, lambda x: trim(split_part(x, ':', 1)) || ': ' || trim(regexp_extract(x, '^[^:]*:(.*)$', 1)))"
_ITEMS = f"array_to_string(list_filter({_PAIRS}, lambda x, i: list_position({_PAIRS}, x) = i), chr(10))"

ORACLE = {
    "page_features": f"select id, {_TITLE} as title, {_HEADING} as heading, {_ITEMS} as spec, 0 as n_links, 0 as n_cards from page_snapshots",
    "rebuilt": f"select id as snapshot_id, coalesce({_HEADING}, {_TITLE}) as ten_san_pham, nullif({_ITEMS}, '') as thong_so_ky_thuat from page_snapshots where http_status = 200",
    "sections": "select 'none' as source, count(*) as n from page_snapshots",
    "css_fields": "select id, 'price' as field, trim(regexp_extract(html, '<span class=price>([^<]*)</span>', 1)) as value from page_snapshots p join sites s using (domain) where trim(regexp_extract(html, '<span class=price>([^<]*)</span>', 1)) <> ''",
    "shape_groups": f"select domain, {_SHAPE.format('url')} as shape, count(*) as n from page_snapshots group by all",
    "shape_verdicts": f"with cur as (select * from (select *, row_number() over (partition by url order by (snapshot_id is null), snapshot_id desc, id desc) rn from extractions) where rn = 1), u as (select distinct domain, url, {_SHAPE.format('url')} as shape from page_snapshots), k as (select domain, shape, count(*) as n, count(*) as sampled, count(*) filter (url in (select url from cur where crawl_status = 'ok')) as hits from u group by 1, 2) select *, case when hits / sampled >= 0.8 then 'accept' when hits / sampled <= 0.2 then 'reject' else 'verify' end as verdict from k",
    "select_urls": "select domain, arg_min(url, (id, url)) as url from page_snapshots where contains(regexp_replace(trim(url), '/+$', ''), '-p1') group by domain, regexp_replace(trim(url), '/+$', '')",
    "file_and_dated": "select id, coalesce(regexp_matches(lower(split_part(split_part(final_url, '#', 1), '?', 1)), '[.](jpg|jpeg|png|gif|webp|svg|ico|bmp|pdf|zip|rar|doc|docx|xls|xlsx|ppt|pptx|mp3|mp4|avi|css|js)$'), null) as is_file, regexp_matches(split_part(split_part(final_url, '#', 1), '?', 1), '/(19|20)[0-9]{2}[/-](0?[1-9]|1[0-2])([/-]|$)') as is_dated from page_snapshots",
    "sitemap_entries": "select category_url || '#product.xml' as url, 'urlset' as kind, count(distinct product_url) as n from category_products group by 1 union all select domain, 'index', count(distinct category_url) from category_products group by 1",
    "sitemap_products": "select distinct domain, product_url as loc, 'product' as kind from category_products",
    "sitemap_candidates": "with b as (select domain, regexp_replace(base_url, '/+$', '') k, base_url from sites where base_url is not null), u as (select domain, 0 o, base_url || '/main.xml' url from b union all select domain, 1, base_url || '/sitemap.xml' from b union all select domain, 10, k || '/sitemap.xml' from b union all select domain, 11, k || '/sitemap_index.xml' from b union all select domain, 12, k || '/sitemap-index.xml' from b), m as (select domain, url, min(o) o from u group by all) select domain, row_number() over (partition by domain order by o, url)::int as ord, url from m",
    "repeated_shapes": f"with {_LINKS}, n as (select url, shape from l group by all having count(*) >= 6) select l.url, href, l.shape from l join n on l.url = n.url and l.shape = n.shape",
    "walk": "with s as (select distinct domain, url from category_pages where ok), r as (select distinct s.domain, c.product_url url from s join category_products c on c.category_url = s.url) select domain, url, 0 as hop from s union all select * , 1 from (select * from r except select * from s)",
    "excluded": "with d as (select distinct source domain from documents where source is not null), b as (select distinct regexp_replace(domain, '^www[.]', '') domain from sites where regexp_replace(domain, '^www[.]', '') like 'den%') select d.domain, max(b.domain) as blocked from d join b on d.domain = b.domain or ends_with(d.domain, '.' || b.domain) group by 1",
    "hits_by_domain": "with q as (select domain, coalesce(category_1, chr(0)) c, id, ten_san_pham, url from extractions) select domain, min(id)::int as rank, count(distinct c) as queries, (select e.ten_san_pham from extractions e where e.id = min(q.id)) as title, (select e.url from extractions e where e.id = min(q.id)) as url from q group by domain",
    "two_phase": "with c as (select domain, min(id) as rank, count(distinct category_1) as queries, count(*) filter (gia.kind = 'amount') as priced from extractions group by 1), s as (select * from c order by rank, queries desc, domain limit 12) select *, priced - 3 * queries as score from s order by score desc, rank, domain limit 4",
    "signal_score": "with c as (select domain, count(distinct category_1) q from extractions group by 1) select domain, case when q > 20 then 4 else 1 end as score, case when q > 20 then 'queries +1: categories; priced +3: prices' else 'queries -2: categories; priced +3: prices' end as why from c",
    "changes_only": "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) p, row_number() over (partition by user_id order by event_id) n from events) where n = 1 or event_type is distinct from p",
    "windowed_counts": "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all",
    "silent": "select user_id, max(ts) as last from events group by 1 having max(ts) is null or max(ts) < timestamp '2024-06-01 00:00:00' - interval 5 minutes",
    "backoff": "select user_id, list_reduce(list_prepend(0.0::double, list(case when event_type = 'error' then 1.0::double else 0.0::double end order by event_id)), lambda d, f: case when f = 1 then least(15.0, greatest(1.0, d * 2)) when d / 2 <= 0.25 then 0.0 else d / 2 end) as delay from events group by 1",
    "known_links": "with k as (select regexp_replace(url, '/+$', '') k, min(url) u from page_snapshots where url not like '%/' group by 1), l as (select distinct domain, category_url as url, product_url || '/' as href from category_products) select l.url, href, u as product_url from l join k on k.k = regexp_replace(href, '/+$', '')",
    "pager_links": "select url, url || '?page=2' as href from category_pages union all select url, regexp_replace(url, '/+$', '') || unnest(['/paged/2', '/trang2']) from category_pages",
    "sku_codes": "select id, case when regexp_matches(trim(ma_san_pham, ' '), '\\pL') then trim(ma_san_pham, ' ') end as code, nullif(trim(ma_san_pham, ' '), '') as raw from extractions",
    "sap_codes": "select id, case when regexp_matches(trim(ma_sap, ' '), '\\pL') then trim(ma_sap, ' ') end as code, nullif(trim(ma_sap, ' '), '') as raw from extractions",
    "grounded_tags": "with s as (select id, regexp_replace(lower(coalesce(thong_so_ky_thuat, '')), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', '', 'g') s from extractions), v as (select t.*, s, list_filter(list_transform(regexp_split_to_array(value, '[/,;()]+'), lambda x: regexp_replace(lower(x), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', '', 'g')), lambda x: x <> '') p from product_tags t join s on id = extraction_id where value is not null) select extraction_id, ord, key, value from v where s = '' or len(list_filter(p, lambda x: not contains(s, x))) = 0",
    "sitemap_reliability": "with cur as (select * from (select *, row_number() over (partition by url order by (snapshot_id is null), snapshot_id desc, id desc) rn from extractions) where rn = 1), u as (select distinct domain, url from page_snapshots) select domain, count(*) as sampled, count(*) filter (url in (select url from cur where crawl_status = 'ok')) / count(*)::double as reliability from u group by 1",
    "fold_keys": f"select {_FOLD} as key, count(*) as n from product_tags group by 1",
    "brand_in_name": "select id, contains(' ' || trim(regexp_replace(replace(lower(strip_accents(regexp_replace(ten_san_pham, '[\\x{200b}\\x{feff}]', ' ', 'g'))), 'đ', 'd'), '[^\\pL\\pN]+', ' ', 'g')) || ' ', ' mirasol vi ') as hit from extractions where ten_san_pham is not null",
}
