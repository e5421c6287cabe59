"""Queries of the registry and report operators, and of page operators over planted pages.

Planted pages are made by column expressions from the given tables, so that SQL can say
what must be found on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import discovery, pages, registry, reports, sections, store, versions
from lodeweave.plans.records import _t
from lodeweave.sources import records

_LEVELS = ["category_1", "category_2", "category_3"]
_LEAF_HOSTS = ["denphong.example", "denvuon.example"]


def _registry(s: DataFrame) -> DataFrame:
    """Sites with a brand where their url is known: the first label of the domain."""
    return s.select("domain", "base_url", F.when(F.col("base_url").isNotNull(), F.split_part(F.regexp_replace("domain", r"^www\.", ""), F.lit("."), F.lit(1))).alias("brand"))


def _planted(p: DataFrame) -> DataFrame:
    """The captured urls with pages of a product in linked data, a menu, a card and links that don't count."""
    h = F.md5("url")
    data = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"N '), h, F.lit('","sku":"S'), h, F.lit('"}</script>'))
    body = F.concat(
        F.lit('<nav><a href="/n/'), h, F.lit('">N</a></nav><div><a href="/p/'), h, F.lit('"><img src="x.png"></a><a href="https://other.example/'), h, F.lit('">O</a><a href="#top">T</a><a href="mailto:x@y.example">M</a></div>')
    )
    return p.select("id", "domain", "url", F.concat(F.lit("<html><head>"), data, F.lit("</head><body><h1>H</h1>"), body, F.lit("</body></html>")).alias("html"))


def _sectioned(p: DataFrame) -> DataFrame:
    """The captured urls with pages that have a section of every source in turn, and none."""
    h = F.md5("url")
    page = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    html = F.element_at(
        F.array(
            page("<h1>T</h1><h2>Ưu điểm</h2><ul><li>A ", h, "</li><li>B ", h, "</li></ul><h2>Thông số</h2><p>x</p>"),
            page("<h2>S ", h, "</h2><p>a</p><h2>N ", h, "</h2><p>b</p><h2>M ", h, "</h2><p>c</p>"),
            page("<h2>Vì da bạn</h2><p>ánh sáng ", h, " dịu</p>"),
            page("<div class=d><p>Đèn ", h, " này sáng dịu và bền, dùng trong nhà được nhiều năm.</p></div>"),
            page("<p>x</p>"),
        ),
        (F.col("id") % 5 + 1).cast("int"),
    )
    return p.select("id", "url", html.alias("html"), page("Ánh sáng ", h).alias("anchor"))


def _sections(p: DataFrame) -> DataFrame:
    found = sections.find_sections(_sectioned(p), description="div.d", anchor="anchor")
    return found.select("id", "source", "title", F.array_join("bullets", "|").alias("bullets"))


def _crumbs(e: DataFrame) -> DataFrame:
    """Extractions' levels as a list of links on a page, with a home link, one to the page itself and a repetition."""
    crumb = lambda c: F.coalesce(F.concat(F.lit('<a href="/c/'), F.md5(c), F.lit('">'), F.md5(c), F.lit("</a>")), F.lit(""))
    html = F.concat(F.lit('<div class="crumb"><a href="/">home</a>'), crumb("category_1"), crumb("category_2"), crumb("category_3"), F.lit('<a href="'), "url", F.lit('">self</a><a href="/">home</a></div><a href="/x">x</a>'))
    return e.where("url is not null").select("id", "domain", "url", html.alias("html"))


def _page_levels(e: DataFrame, s: DataFrame) -> DataFrame:
    rules = s.where("domain like 'den%'").select("domain", F.lit("div.crumb > a").alias("selector"))
    found = pages.dom_categories(_crumbs(e), rules).join(e.select("id", *_LEVELS), "id")
    anchors = F.array(F.md5("category_1"))
    chosen = pages.chosen_levels(pages.anchored_levels(F.filter("labels", lambda x: x != "home"), anchors), [F.lit("data"), F.lit(None).cast("string"), F.lit(None).cast("string")])
    return found.select("id", *[c.alias(f"level_{i + 1}") for i, c in enumerate(chosen)])


def _listing(p: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The walk over categories whose products lie on their first, second and third page, with the
    pages of a category of a like name beside each."""
    ok = p.where("ok").select("url")
    page = F.element_at(F.array("url", F.concat("url", F.lit("?page=2")), F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/paged/3"))), F.length("product_url") % 3 + 1)
    shown = c.where("product_url is not null").select(F.col("category_url").alias("url"), "product_url").join(ok, "url").select(page.alias("url"), F.col("product_url").alias("href"))
    base = F.regexp_replace("url", "/+$", "")
    pager = ok.select(
        F.inline(
            F.array(
                F.struct(F.col("url").alias("url"), F.concat("url", F.lit("?page=2")).alias("href")),
                F.struct(F.concat("url", F.lit("?page=2")).alias("url"), F.concat(base, F.lit("/paged/3")).alias("href")),
                F.struct(F.concat(base, F.lit("/paged/3")).alias("url"), F.col("url").alias("href")),
                F.struct(F.col("url").alias("url"), F.concat(base, F.lit("-x/page/2")).alias("href")),
                F.struct(F.concat(base, F.lit("-x/page/2")).alias("url"), F.lit("https://nowhere.example/p").alias("href")),
            )
        )
    )
    known = c.where("product_url is not null").select(F.col("product_url").alias("url"))
    return pages.walk_categories(p.select("url"), shown.unionByName(pager), known)


QUERIES = {
    "brand_of": _t("extractions", "sites")(lambda e, s: registry.brand_of(e.select("id", "domain"), _registry(s))),
    "site_options": _t("sites")(lambda s: s.select("domain", F.array_join(F.transform(F.map_entries(registry.options_of(["domain", "base_url"])), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("options"))),
    "has_pages": _t("sites", "category_products")(lambda s, c: registry.has_any(s, c)),
    "domain_table": _t("sites", "extractions")(lambda s, e: registry.domain_table(s.where("base_url is not null"), e)),
    "category_counts": _t("extractions")(lambda e: reports.counts_by(e, ["domain", "category_1"])),
    "product_counts": _t("extractions")(lambda e: reports.counts_by(store.current_state(e), ["domain"])),
    "category_sizes": _t("extractions", "category_pages")(lambda e, p: reports.category_sizes(e.select("domain", F.col("category_1").alias("name")), p)),
    "numeric_profile": _t("extractions")(lambda e: reports.numeric_profile(e, ["gia.amount", "snapshot_id"])),
    "run_summary": _t("extractions", "page_snapshots")(lambda e, p: reports.run_summary(e.join(p.select(F.col("id").alias("snapshot_id"), "fetched_at"), "snapshot_id", "left"), "crawl_status", "extractor_version", "fetched_at", "extracted_at").drop("seconds_each")),
    "merge_brands": _t("extractions", "sites")(lambda e, s: reports.merge_brands(registry.brand_of(e.select("id", "domain"), _registry(s)).withColumn("brand", F.left("brand", F.lit(3))))),
    "names_ordered": _t("extractions")(lambda e: reports.first_rows(e.where("ten_san_pham is not null").select("domain", "ten_san_pham").distinct(), ["domain", "ten_san_pham"], 5000)),
    "category_names": _t("category_pages")(lambda p: reports.first_rows(p.select("domain", "url", "name"), ["domain", "url"], None)),
    "first_urls": _t("page_snapshots")(lambda p: reports.first_rows(p.select("url").distinct(), ["url"], 25, 10)),
    "product_page": _t("extractions")(lambda e: reports.page_of(store.current_state(e).select("id", "url", "crawl_status"), F.col("crawl_status") == "ok", ["url"], 50, 20)),
    "ordered_changes": _t("extractions")(lambda e: reports.ordered_changes(versions.cell_changes(e, "v6", "v7"), "thong_so_ky_thuat", "changed", 40).select("url", "snapshot_id", "after")),
    "sheet_category": _t("extractions")(lambda e: e.select("id", reports.sheet_category(_LEAF_HOSTS).alias("sheet"))),
    "excluded_branch": _t("extractions", "category_pages")(lambda e, p: reports.excluded_branch(e.select("id", "domain", *_LEVELS), p.where("not ok").select("domain", F.col("name").alias("branch")), _LEVELS).select("id", "branch")),
    "sizes_in_order": _t("extractions")(lambda e: reports.sizes_in_order(e, "category_1", "id")),
    "page_levels": _t("extractions", "sites")(_page_levels),
    "category_walk": _t("category_pages", "category_products")(lambda p, c: _listing(p, c)[0]),
    "category_walk_report": _t("category_pages", "category_products")(lambda p, c: _listing(p, c)[1]),
    "planted_links": _t("page_snapshots")(lambda p: pages.html_links(_planted(p))),
    "planted_nav": _t("page_snapshots")(lambda p: pages.nav_links(pages.html_links(_planted(p))).select("id", "href")),
    "planted_cards": _t("page_snapshots")(lambda p: pages.card_links(pages.html_links(_planted(p), ("id", "url"))).select("id", "href")),
    "planted_products": _t("page_snapshots")(lambda p: pages.page_kinds(pages.read_pages(_planted(p))).select("id", "name", "sku", "kind")),
    "planted_sections": _t("page_snapshots")(_sections),
    "other_shapes": _t("page_snapshots")(lambda p: discovery.dominant_shape(p.select("url").distinct().select("url", F.posexplode(F.array(*[F.concat(F.lit(f"https://s.example/{x}/"), F.md5("url")) for x in ("a", "b", "b", "c/d")])).alias("ord", "href"))).select("url", "href")),
    "redirects": _t("page_snapshots")(lambda p: p.select("id", discovery.decode_redirect(F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://find.example/r?x=1&u=a1"), F.translate(F.base64(F.encode("url", "utf-8")), "+/=\n\r", "-_"))).otherwise(F.col("url"))).alias("target"))),
    "fresh_probes": _t("category_pages")(lambda c: discovery.fresh(c.select("domain", F.col("indexed_at").alias("probed_at")).distinct(), F.lit("2025-06-01 00:00:00").cast("timestamp_ntz"), 400)),
    "breadcrumb_levels": _t("extractions")(lambda e: pages.category_levels(e.select("id", "domain", F.array_compact(F.array(F.lit("home"), "category_1", "category_2", "category_3", F.lit("more"), F.lit("self"))).alias("breadcrumb")), _LEAF_HOSTS).select("id", *_LEVELS)),
    "answers": _t("product_tags")(lambda t: pages.parse_tags(t.where("key is not null").select("extraction_id", "ord", F.concat(F.lit('```json\n{"tags": {" '), F.md5("key"), F.lit(' ": "'), F.when(F.col("value").isNotNull(), F.md5("value")).otherwise(F.lit(" ")), F.lit('"}}\n```')).alias("answer"))).select("extraction_id", "ord", F.array_join(F.transform("tags", lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("tags"), "error")),
    "tags_as_json": _t("product_tags")(lambda t: t.where("extraction_id is not null").groupBy("extraction_id").agg(F.collect_list(F.struct("ord", "key", "value")).alias("tags")).select("extraction_id", F.size(F.from_json(records.tags_json(F.col("tags")), "map<string,string>")).alias("keys"))),
}

_CURRENT = "(select * from (select *, row_number() over (partition by url order by (snapshot_id is null), snapshot_id desc, id desc) rn from extractions where url is not null) where rn = 1)"
_BRAND = "with r as (select regexp_replace(domain, '^www[.]', '') h, max(case when base_url is not null then split_part(regexp_replace(domain, '^www[.]', ''), '.', 1) end) b from sites group by 1), x as (select id, domain, coalesce(b, regexp_replace(domain, '^www[.]', '')) as brand from extractions left join r on h = regexp_replace(domain, '^www[.]', ''))"
_VERSION = "(select * from (select *, row_number() over (partition by snapshot_id, url order by id desc) rn from extractions where extractor_version = '{0}' and snapshot_id is not null) where rn = 1)"
_HOST = "regexp_extract(url, '^[a-z]+://[^/?#]+')"

ORACLE = {
    "brand_of": _BRAND + " select * from x",
    "site_options": "select domain, 'domain=' || domain || coalesce(';base_url=' || base_url, '') as options from sites",
    "has_pages": "select distinct domain, domain in (select domain from category_products where domain is not null) as has from sites",
    "domain_table": "with k as (select distinct domain, true k from sites where base_url is not null), c as (select domain, count(*) n from extractions where domain is not null group by 1), b as (select domain, coalesce(k, false) as registered, coalesce(n, 0) as products from k full join c using (domain)) select *, row_number() over (order by registered desc, domain) as place from b",
    "category_counts": "select domain, category_1, count(*) as products from extractions where domain <> '' and category_1 <> '' group by all",
    "product_counts": f"select domain, count(*) as products from {_CURRENT} where domain <> '' group by 1",
    "category_sizes": "select domain, category_1 as name, count(*) as products from extractions where domain <> '' and category_1 <> '' group by all union all select distinct domain, name, 0 from category_pages where name is not null",
    "numeric_profile": "select 'amount' as field, count(gia.amount) as n, count(*) filter (gia.amount is null) as n_null, min(gia.amount)::double as least, median(gia.amount)::double as median, avg(gia.amount) as mean, max(gia.amount)::double as greatest from extractions union all select 'snapshot_id', count(snapshot_id), count(*) filter (snapshot_id is null), min(snapshot_id), median(snapshot_id), avg(snapshot_id), max(snapshot_id) from extractions",
    "run_summary": "select extractor_version, count(*) as n, count(*) filter (crawl_status = 'ok') as ok, count(*) filter (crawl_status = 'failed') as failed, count(*) filter (coalesce(crawl_status, '') not in ('ok', 'failed', 'not-a-product')) as to_review from extractions group by 1",
    "merge_brands": _BRAND + " select left(brand, 3) as brand, array_to_string(list_sort(list(distinct domain)), ',') as domains, count(*) as products from x where brand is not null group by 1",
    "names_ordered": "select distinct domain, ten_san_pham from extractions where ten_san_pham is not null order by all limit 5000",
    "category_names": "select domain, url, name from category_pages",
    "first_urls": "select distinct url from page_snapshots order by 1 limit 25 offset 10",
    "product_page": f"with c as (select id, url, crawl_status from {_CURRENT}) select *, (select count(*) from c) as total, (select count(*) from c where crawl_status = 'ok') as matched from c where crawl_status = 'ok' order by url limit 50 offset 20",
    "ordered_changes": f"select b.url, b.snapshot_id, b.thong_so_ky_thuat as after from {_VERSION.format('v6')} a join {_VERSION.format('v7')} b using (snapshot_id, url) where a.thong_so_ky_thuat <> '' and b.thong_so_ky_thuat <> '' and a.thong_so_ky_thuat <> b.thong_so_ky_thuat order by 1, 2 limit 40",
    "sheet_category": "select id, case when domain in ('denphong.example', 'denvuon.example') then coalesce(nullif(category_3, ''), nullif(category_2, ''), nullif(category_1, '')) else nullif(category_1, '') end as sheet from extractions",
    "excluded_branch": "with b as (select domain, list(distinct name) l from category_pages where not ok and name is not null group by 1) select id, case when list_contains(l, category_1) then category_1 when list_contains(l, category_2) then category_2 when list_contains(l, category_3) then category_3 end as branch from extractions left join b using (domain)",
    "sizes_in_order": "select nullif(category_1, '') as category_1, count(*) as n, min(id) as first from extractions group by 1",
    "page_levels": f"with l as (select id, regexp_replace({_HOST}, '^[a-z]+://', '') in (select domain from sites where domain like 'den%') r, category_1 c, list_distinct(list_filter([md5(category_1), md5(category_2), md5(category_3)], lambda x: x is not null)) a from extractions where url is not null), o as (select *, list_filter([md5(category_1), md5(category_2), md5(category_3)], lambda x: x is not null) o from l join (select id, category_1, category_2, category_3 from extractions) using (id)), d as (select *, list_filter(o, lambda x, i: list_position(o, x) = i) d from o) select id, case when r and len(d) > 0 then d[1] else 'data' end as level_1, case when r and len(d) > 0 then d[2] end as level_2, case when r and len(d) > 0 then d[3] end as level_3 from d",
    "category_walk": "with k as (select regexp_replace(product_url, '/+$', '') k, min(product_url) u from category_products where product_url is not null group by 1) select distinct category_url as category, u as product_url from category_products join k on k = regexp_replace(product_url, '/+$', '') where category_url in (select url from category_pages where ok)",
    "category_walk_report": "select url as category, case when bool_or(ok) then 3 else 0 end as pages_fetched, bool_or(ok) as ok from category_pages where url is not null group by 1",
    "planted_links": f"select id, unnest([0, 1, 2]) as ord, unnest([{_HOST} || '/n/' || md5(url), {_HOST} || '/p/' || md5(url), 'https://other.example/' || md5(url)]) as href, unnest(['N', '', 'O']) as text, unnest([true, false, false]) as in_nav, unnest([false, true, false]) as has_img from page_snapshots",
    "planted_nav": f"select id, {_HOST} || '/n/' || md5(url) as href from page_snapshots",
    "planted_cards": f"select id, {_HOST} || '/p/' || md5(url) as href from page_snapshots",
    "planted_products": "select id, 'N ' || md5(url) as name, 'S' || md5(url) as sku, 'product' as kind from page_snapshots",
    "planted_sections": "select id, ['keyword', 'cluster', 'anchor', 'description', 'none'][id % 5 + 1] as source, case id % 5 when 0 then 'Ưu điểm' when 1 then 'S ' || md5(url) when 2 then 'Vì da bạn' end as title, case id % 5 when 0 then 'A ' || md5(url) || '|B ' || md5(url) when 1 then 'S ' || md5(url) || '|N ' || md5(url) || '|M ' || md5(url) else '' end as bullets from page_snapshots",
    "other_shapes": "select distinct url, 'https://s.example/' || unnest(['a', 'c/d']) || '/' || md5(url) as href from page_snapshots",
    "redirects": "select id, url as target from page_snapshots",
    "fresh_probes": "select domain, max(indexed_at) as probed_at from category_pages where indexed_at > timestamp '2025-06-01' - interval 400 days group by 1",
    "breadcrumb_levels": "with l as (select id, domain, list_filter([category_1, category_2, category_3, 'more'], lambda x: x is not null) l from extractions), s as (select id, case when domain in ('denphong.example', 'denvuon.example') and len(l) > 3 then l[-3:] else l[:3] end l from l) select id, l[1] as category_1, l[2] as category_2, l[3] as category_3 from s",
    "answers": "select extraction_id, ord, case when value is null then '' else md5(key) || '=' || md5(value) end as tags, null::varchar as error from product_tags where key is not null",
    "tags_as_json": "select extraction_id, count(distinct key) as keys from product_tags where extraction_id is not null group by 1",
}
