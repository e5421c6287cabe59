"""Queries of the store, versions, coverage and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as X
from lodeweave.functions import urls as U
from lodeweave.operators import coverage, export, quality, search, store, versions
from lodeweave.session import table

COLUMNS = ["ten_san_pham", "ma_san_pham", "ma_sap", "category_1", "category_2", "category_3", "link_anh_san_pham", "link_mua_hang_online", "link_file_hdsd", "tom_tat_tskt", "thong_so_ky_thuat", "vd_hdsd", "tom_tat_uu_diem_tinh_nang", "noi_dung_uu_diem_sp", "uu_diem_la_ban", "crawl_error"]
KEYWORD, NAME = "den pha", "chieu sang"


def _t(*names):
    """A query over the named tables."""

    def wrap(f):
        return lambda spark, sf: f(*(table(spark, sf, n) for n in names))

    return wrap


def _current(e):
    return store.current_state(e)


def _done(e):
    return store.current_state(e).where(F.col("crawl_status").isin("ok", "not-a-product")).select("url")


def _names(e):
    return store.current_state(e).where("ten_san_pham is not null").groupBy("domain", F.col("ten_san_pham").alias("name")).agg(F.count("*").alias("products"))


QUERIES = {
    "current_state": _t("extractions")(lambda e: _current(e).select("url", "id", "snapshot_id", "extractor_version", "crawl_status")),
    "current_state_of_domain": _t("extractions")(lambda e: store.current_state(e, "denphong.example").select("url", "id", "crawl_status")),
    "latest_snapshot": _t("page_snapshots")(lambda p: store.latest_snapshots(p).select("url", "id", "http_status", "html_len")),
    "tags_ordered": _t("extractions", "product_tags")(lambda e, t: store.with_tags(e.select("id"), t.select("extraction_id", "ord", "key", "value")).select("id", F.array_join(F.transform("tags", lambda x: F.concat(x["ord"].cast("string"), F.lit("="), F.coalesce(x["key"], F.lit("")), F.lit("="), F.coalesce(x["value"], F.lit("")))), "|").alias("tags"))),
    "need_work": _t("category_products", "extractions")(lambda c, e: store.needs_work(c.select(F.col("product_url").alias("url")).distinct(), _current(e))),
    "merge_sites": _t("sites", "page_snapshots")(lambda s, p: store.merge_sites(s, p.select("domain", F.lit(None).cast("string").alias("base_url")))),
    "replace_edges": _t("category_products")(lambda c: store.replace_edges(c, c.where("domain = 'denphong.example'").distinct(), ["domain", "category_url"])),
    "orphan_extractions": _t("extractions", "page_snapshots")(lambda e, p: store.orphans(e.select("id", "snapshot_id"), p, "snapshot_id", "id").select("id", "snapshot_id")),
    "orphan_tags": _t("product_tags", "extractions")(lambda t, e: store.orphans(t.select("extraction_id", "ord"), e, "extraction_id", "id").select("extraction_id", "ord")),
    "number_rows": _t("sites")(lambda s: store.number_rows(s.select("domain"), 500, ["domain"]).select("id", "domain")),
    "valid_at": _t("page_snapshots", "crawl_rounds")(lambda p, r: store.valid_at(p, p.select("url", "domain").distinct().join(F.broadcast(r.where("round_no = 2").select("domain", F.col("opened_at").alias("at"))), "domain").select("url", "at"))),
    "valid_at_rounds": _t("page_snapshots", "crawl_rounds")(lambda p, r: store.valid_at(p, p.select("url", "domain").distinct().join(F.broadcast(r.select("domain", F.col("opened_at").alias("at"))), "domain").select("url", "at"))),
    "version_counts": _t("extractions")(lambda e: versions.version_counts(e)),
    "cell_changes": _t("extractions")(lambda e: versions.cell_changes(e, "v6", "v7").select("url", "snapshot_id", "field", "before", "after", "change")),
    "change_tally": _t("extractions")(lambda e: versions.change_tally(versions.cell_changes(e, "v6", "v7"))),
    "shared_snapshots": _t("extractions")(lambda e: versions.shared_snapshots(e, "v6", "v7")),
    "rerun_plan": _t("page_snapshots", "extractions")(lambda p, e: versions.rerun_plan(store.latest_snapshots(p), _current(e))),
    "category_summary": _t("category_pages", "category_products", "extractions")(lambda p, c, e: coverage.category_summary(p, c, _done(e))),
    "domain_scope": _t("category_products", "extractions")(lambda c, e: coverage.domain_scope(c, _done(e))),
    "products_in": _t("category_products", "category_pages")(lambda c, p: coverage.products_in(c, p.where("ok").select("domain", F.col("url").alias("category_url")))),
    "uncategorised": _t("page_snapshots", "category_products")(lambda p, c: coverage.uncategorised(p.select("domain", "url").distinct(), c)),
    "coverage_gap": _t("page_snapshots", "category_products")(lambda p, c: coverage.coverage_gap(p, c)),
    "index_report": _t("category_pages", "category_products", "page_snapshots")(lambda p, c, s: coverage.index_report(p, c, s)),
    "category_counts": _t("extractions")(lambda e: _current(e).where("category_1 is not null and category_1 != ''").groupBy("domain", "category_1").agg(F.count("*").alias("products"))),
    "product_counts": _t("extractions")(lambda e: _current(e).groupBy("domain").agg(F.count("*").alias("products"))),
    "category_union": _t("extractions", "category_pages")(lambda e, p: _current(e).where("category_1 is not null").groupBy("domain", F.col("category_1").alias("name")).agg(F.count("*").alias("products")).unionByName(p.where("name is not null").select("domain", "name", F.lit(0).cast("long").alias("products")))),
    "domain_outer": _t("sites", "extractions")(lambda s, e: s.select("domain", F.lit(True).alias("registered")).join(e.groupBy("domain").agg(F.count("*").alias("n")), "domain", "full").select("domain", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("n", F.lit(0)).alias("n"))),
    "fill_rates": _t("extractions")(lambda e: quality.fill_rates(e, COLUMNS)),
    "missing_reasons": _t("extractions")(lambda e: quality.missing_reasons(_current(e))),
    "tag_stats": _t("extractions", "product_tags")(lambda e, t: quality.tag_stats(e, t)),
    "top_keys": _t("product_tags")(lambda t: quality.top_keys(t)),
    "grounding": _t("extractions", "product_tags")(lambda e, t: quality.grounding(e, t, ["ten_san_pham", "thong_so_ky_thuat", "tom_tat_tskt"])),
    "run_tuning": _t("events")(lambda e: quality.run_tuning(e.select((F.col("user_id") % 8).alias("workers"), F.col("value").alias("seconds"), (F.col("event_type") == "error").alias("failed"), F.length("props").alias("tags")), 1.0, 0.9)),
    "audit": _t("extractions")(lambda e: quality.audit(_current(e), e.groupBy("url").agg(*[F.max(c).alias(c) for c in ("ma_san_pham", "category_2", "tom_tat_tskt")]), ["ma_san_pham", "category_2", "tom_tat_tskt"])),
    "popular_names": _t("category_pages")(lambda p: quality.popular_names(p, ["led", "den"])),
    "match_names": _t("extractions")(lambda e: search.match_names(KEYWORD, _current(e), F.col("ten_san_pham")).select("url", "ten_san_pham")),
    "match_categories": _t("category_pages")(lambda p: search.match_categories(NAME, p).select("domain", "url")),
    "classify": _t("sites", "category_pages", "extractions")(lambda s, p, e: search.classify(KEYWORD, s.select(F.col("domain").alias("name")), p, _current(e))),
    "suggest": _t("extractions")(lambda e: search.suggest("đèn", _names(e))),
    "merge_suggestions": _t("extractions")(lambda e: search.merge_suggestions(_names(e))),
    "resolve": _t("category_pages", "category_products", "extractions")(lambda p, c, e: search.resolve(NAME, p, c, _done(e))),
    "export_plan": _t("extractions")(lambda e: export.export_plan(_current(e).where("crawl_status != 'not-a-product' or crawl_status is null").select("id", "domain", "category_2"), "category_2", ["id"]).select("id", "sheet_no", "row_no")),
    "sheet_order": _t("extractions", "category_list")(lambda e, c: export.sheet_order(_current(e), "category_2", c.where("level = 2 and category_id < 205").select(F.col("name").alias("category_2"), F.col("category_id").alias("rank")))),
    "sheet_order_ranked": _t("extractions", "category_list")(lambda e, c: export.sheet_order(_current(e), "category_2", c.where("level = 2").select(F.col("name").alias("category_2"), F.col("category_id").alias("rank")))),
    "review_rows": _t("extractions")(lambda e: export.review_rows(_current(e), ["tom_tat_uu_diem_tinh_nang", "noi_dung_uu_diem_sp"], "uu_diem_nguon").select("id", "reason")),
    "paging": _t("documents")(lambda d: d.orderBy("doc_id").offset(50).limit(25).select("doc_id", "n_chars")),
    "normalise": _t("documents")(lambda d: d.select("doc_id", X.normalise(F.col("text")).alias("norm"))),
    "token_counts": _t("documents")(lambda d: d.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))),
    "url_parts": _t("page_snapshots")(lambda p: p.select("id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"), U.slash_key(F.col("url")).alias("slash_key"), X.slug(U.path(F.col("url"))).alias("slug"))),
    "sheet_names": _t("extractions")(lambda e: e.where("ten_san_pham is not null").select("id", export.short_sheet(F.col("ten_san_pham")).alias("sheet"))),
}

_CUR = "cur as (select * from (select *, row_number() over (partition by url order by (snapshot_id is null), snapshot_id desc, id desc) rn from extractions where url is not null) where rn = 1)"
_DONE = _CUR + ", done as (select distinct url from cur where crawl_status in ('ok', 'not-a-product'))"
_NORM = "trim(regexp_replace(strip_accents(replace(lower({}), 'đ', 'd')), '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200b}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"
_LINKS = "links as (select distinct domain, category_url, product_url from category_products)"
_VER = """v as (select * from (select *, row_number() over (partition by snapshot_id, url, extractor_version order by id desc) r from extractions where snapshot_id is not null) where r = 1),
p as (select b.url, b.snapshot_id, {cols} from v a join v b on a.snapshot_id = b.snapshot_id and a.url = b.url where a.extractor_version = 'v6' and b.extractor_version = 'v7'),
c as ({union}),
d as (select *, case when coalesce(before, '') = '' then 'fixed' when coalesce(after, '') = '' then 'broken' else 'changed' end as change from c where before is distinct from after)"""
_VER = _VER.format(
    cols=", ".join(f"a.{f} as b_{f}, b.{f} as a_{f}" for f in versions.FIELDS), union=" union all ".join(f"select url, snapshot_id, '{f}' as field, b_{f} as before, a_{f} as after from p" for f in versions.FIELDS)
)
_LABELS = _CUR + f""", n as (select domain, ten_san_pham as name, count(*) n, {_NORM.format('ten_san_pham')} as key from cur where ten_san_pham is not null group by all),
b as (select key, name, sum(n) n from n group by all),
m as (select key, max_by(name, (n, name)) as label, sum(n) as products from b group by key),
s as (select key, string_agg(distinct domain, ',' order by domain) as domains from n group by key)"""
_FILLED = "({0} is not null and {0} <> '')"

ORACLE = {
    "current_state": f"with {_CUR} select url, id, snapshot_id, extractor_version, crawl_status from cur",
    "current_state_of_domain": f"with {_CUR} select url, id, crawl_status from cur where domain = 'denphong.example'",
    "latest_snapshot": "select url, id, http_status, html_len from page_snapshots p where id = (select max(id) from page_snapshots q where q.url = p.url)",
    "tags_ordered": "select e.id, string_agg(ord || '=' || coalesce(key, '') || '=' || coalesce(value, ''), '|' order by ord, key nulls first, value nulls first) as tags from extractions e left join product_tags t on t.extraction_id = e.id group by e.id",
    "need_work": f"with {_DONE} select distinct product_url as url from category_products where product_url not in (select url from done)",
    "merge_sites": "select domain, base_url from sites union all select distinct domain, null from page_snapshots where domain not in (select domain from sites)",
    "replace_edges": "select * from category_products where (domain, category_url) not in (select domain, category_url from category_products where domain = 'denphong.example') union all select distinct * from category_products where domain = 'denphong.example'",
    "orphan_extractions": "select id, snapshot_id from extractions where snapshot_id is not null and snapshot_id not in (select id from page_snapshots)",
    "orphan_tags": "select extraction_id, ord from product_tags where extraction_id is not null and extraction_id not in (select id from extractions)",
    "number_rows": "select 500 + row_number() over (order by domain) as id, domain from sites",
    "valid_at": "with u as (select distinct url, domain from page_snapshots), m as (select u.url, opened_at as at from u join crawl_rounds r on u.domain = r.domain and r.round_no = 2) select m.url, m.at, (select max_by(id, (fetched_at, id)) from page_snapshots p where p.url = m.url and p.fetched_at <= m.at) as snapshot_id from m",
    "valid_at_rounds": "with u as (select distinct url, domain from page_snapshots), m as (select u.url, opened_at as at from u join crawl_rounds r on u.domain = r.domain) select m.url, m.at, (select max_by(id, (fetched_at, id)) from page_snapshots p where p.url = m.url and p.fetched_at <= m.at) as snapshot_id from m",
    "version_counts": "select domain, extractor_version, count(distinct snapshot_id) as snapshots from extractions where snapshot_id is not null group by all",
    "cell_changes": f"with {_VER} select url, snapshot_id, field, before, after, change from d",
    "change_tally": f"with {_VER} select field, count(*) filter (change = 'fixed') as fixed, count(*) filter (change = 'broken') as broken, count(*) filter (change = 'changed') as changed from d group by field",
    "shared_snapshots": "select (select count(*) from (select snapshot_id, url from extractions where snapshot_id is not null and extractor_version = 'v6' intersect select snapshot_id, url from extractions where extractor_version = 'v7')) as shared, (select count(*) from extractions where snapshot_id is null) as skipped",
    "rerun_plan": f"with {_CUR}, l as (select url, max(id) id from page_snapshots group by url) select l.url, l.id as snapshot_id, cur.id as prior_id from l left join cur using (url)",
    "category_summary": f"with {_DONE}, {_LINKS}, n as (select l.domain, category_url, count(*) t, count(d.url) h from links l left join done d on l.product_url = d.url group by all) select p.domain, p.url, p.name, coalesce(ok, false) as known, case when ok then coalesce(t, 0) end as total, case when ok then coalesce(h, 0) end as have, case when ok then coalesce(t - h, 0) end as missing from category_pages p left join n on p.domain = n.domain and p.url = n.category_url",
    "domain_scope": f"with {_DONE}, u as (select distinct domain, product_url from category_products) select domain, count(*) as total, count(d.url) as have, count(*) - count(d.url) as missing, count(*) = count(d.url) as complete from u left join done d on d.url = product_url group by domain",
    "products_in": "select distinct c.domain, product_url from category_products c join category_pages p on c.domain = p.domain and c.category_url = p.url where ok",
    "uncategorised": "select distinct domain, url from page_snapshots p where not exists (select 1 from category_products c where c.domain = p.domain and c.product_url = p.url)",
    "coverage_gap": "with u as (select distinct domain, url from page_snapshots) select domain, count(*) as total, count(*) filter (exists (select 1 from category_products c where c.domain = u.domain and c.product_url = u.url)) as indexed from u group by domain",
    "index_report": f"with {_LINKS}, n as (select domain, category_url, count(*) n from links group by all), c as (select p.domain, count(*) as categories, count(*) filter (not coalesce(ok, false)) as failed, count(*) filter (coalesce(ok, false) and n is null) as empty from category_pages p left join n on n.domain = p.domain and n.category_url = p.url group by 1), u as (select distinct domain, url from page_snapshots), g as (select domain, count(*) as total, count(*) filter (not exists (select 1 from category_products c where c.domain = u.domain and c.product_url = u.url)) as uncategorised from u group by 1) select c.*, coalesce(total, 0) as total, coalesce(uncategorised, 0) as uncategorised, concat_ws(',', case when failed > 0 then 'failed' end, case when empty > 0 then 'empty' end, case when coalesce(uncategorised, 0) * 5 > coalesce(total, 0) then 'many-uncategorised' when uncategorised > 0 then 'uncategorised' end) as warnings from c left join g using (domain)",
    "category_counts": f"with {_CUR} select domain, category_1, count(*) as products from cur where category_1 <> '' group by all",
    "product_counts": f"with {_CUR} select domain, count(*) as products from cur group by all",
    "category_union": f"with {_CUR} select domain, category_1 as name, count(*) as products from cur where category_1 is not null group by all union all select domain, name, 0 from category_pages where name is not null",
    "domain_outer": "with e as (select domain, count(*) n from extractions group by 1) select coalesce(s.domain, e.domain) as domain, s.domain is not null as registered, coalesce(n, 0) as n from sites s full join e on s.domain = e.domain",
    "fill_rates": " union all ".join(f"select '{c}' as field, count(*) as n_rows, count(*) filter ({_FILLED.format(c)}) as n_filled, count(*) filter ({_FILLED.format(c)}) / count(*)::double as rate from extractions" for c in COLUMNS),
    "missing_reasons": f"with {_CUR} select missing, count(*) as n from (select concat_ws(',', " + ", ".join(f"case when not coalesce({_FILLED.format(c)}, false) then '{c}' end" for c in quality.REQUIRED) + ") as missing from cur) where missing <> '' group by 1 order by 2 desc, 1 limit 10",
    "tag_stats": "with t as (select extraction_id, count(*) n from product_tags group by 1) select count(*) as extractions, count(n) as with_tags, avg(n) as mean_tags, min(n) as min_tags, max(n) as max_tags from extractions left join t on id = extraction_id",
    "top_keys": f"select {_NORM.format('key')} as key, count(*) as n from product_tags group by 1 order by 2 desc, 1 limit 8",
    "grounding": "with s as (select id, regexp_replace(lower(concat_ws(chr(10), ten_san_pham, thong_so_ky_thuat, tom_tat_tskt)), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', '', 'g') s from extractions), v as (select s, list_filter(list_transform(regexp_split_to_array(value, '[/,;()]+'), lambda x: regexp_replace(lower(x), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', '', 'g')), lambda x: x <> '') p from product_tags join s on id = extraction_id where value is not null and trim(value) <> '' and s <> '') select count(*) as values, count(*) filter (len(list_filter(p, lambda x: not contains(s, x))) = 0) as grounded, count(*) filter (len(list_filter(p, lambda x: not contains(s, x))) = 0) / count(*)::double as rate from v",
    "run_tuning": "with p as (select user_id % 8 as workers, avg(value) as seconds, avg((event_type = 'error')::int) as fail_rate, avg(length(props)) as tags from events group by 1), k as (select *, fail_rate <= 1.0 and tags >= 0.9 * (select max(tags) from p) ok from p) select workers, seconds, fail_rate, tags, workers = (select arg_min(workers, seconds) from k where ok) as recommended from k",
    "audit": f"with {_CUR}, o as (select url, max(ma_san_pham) a, max(category_2) b, max(tom_tat_tskt) c from extractions group by 1), x as (select 'ma_san_pham' as field, ma_san_pham v, a o from cur join o using (url) union all select 'category_2', category_2, b from cur join o using (url) union all select 'tom_tat_tskt', tom_tat_tskt, c from cur join o using (url)) select field, case when coalesce(o, '') <> '' then 'missed' else 'confirmed' end as verdict, count(*) as n from x where coalesce(v, '') = '' group by all",
    "popular_names": f"with n as (select trim(regexp_replace(replace(replace({_NORM.format('name')}, 'led', ''), 'den', ''), ' +', ' ', 'g')) as name from category_pages) select name, count(*) as n from n where length(name) >= 8 group by 1 order by 2 desc, 1 limit 6",
    "match_names": f"with {_CUR} select url, ten_san_pham from cur where contains({_NORM.format('ten_san_pham')}, 'den') and contains({_NORM.format('ten_san_pham')}, 'pha')",
    "match_categories": f"select domain, url from category_pages where contains({_NORM.format('coalesce(name, url)')}, 'chieu') and contains({_NORM.format('coalesce(name, url)')}, 'sang')",
    "classify": f"with {_CUR}, c as (select 1 as r, 'category' as kind, count(*) as n from category_pages where contains({_NORM.format('coalesce(name, url)')}, 'den') and contains({_NORM.format('coalesce(name, url)')}, 'pha') union all select 2, 'product_name', count(*) from cur where contains({_NORM.format('ten_san_pham')}, 'den') and contains({_NORM.format('ten_san_pham')}, 'pha')), k as (select * from c where n > 0), b as (select arg_min(kind, r) kind, arg_min(n, r) n from k) select coalesce(b.kind, 'none') as kind, coalesce(b.n, 0) as matches, coalesce((select string_agg(k.kind, ',' order by k.kind) from k, b b2 where k.kind <> b2.kind), '') as others from b",
    "suggest": f"with {_LABELS} select m.key, label, domains, products, starts_with(m.key, 'den') as prefix from m join s using (key) where contains(m.key, 'den') order by prefix desc, products desc, m.key limit 8",
    "merge_suggestions": f"with {_LABELS} select m.key, label, domains, products from m join s using (key)",
    "resolve": f"with {_DONE}, k as (select domain, url from category_pages where contains({_NORM.format('coalesce(name, url)')}, 'chieu') and contains({_NORM.format('coalesce(name, url)')}, 'sang')), u as (select distinct c.domain, product_url from category_products c join k on k.domain = c.domain and k.url = c.category_url) select domain, count(*) as total, count(d.url) as have, count(*) - count(d.url) as missing, count(*) = count(d.url) as complete from u left join done d on d.url = product_url group by domain",
    "export_plan": f"with {_CUR}, x as (select id, category_2 from cur where crawl_status is distinct from 'not-a-product'), s as (select category_2 g, row_number() over (order by category_2 is null, count(*) desc, category_2) no from x group by 1) select id, no as sheet_no, row_number() over (partition by no order by id) as row_no from x join s on x.category_2 is not distinct from s.g",
    "sheet_order": f"with {_CUR}, x as (select category_2 g, count(*) n from cur group by 1), r as (select name, category_id k from category_list where level = 2 and category_id < 205) select g as \"group\", n, row_number() over (order by g is null, k is null, k, n desc, g) as place from x left join r on name = g",
    "sheet_order_ranked": f"with {_CUR}, x as (select category_2 g, count(*) n from cur group by 1), r as (select name, category_id k from category_list where level = 2) select g as \"group\", n, row_number() over (order by g is null, k is null, k, n desc, g) as place from x left join r on name = g",
    "review_rows": f"with {_CUR} select id, case when coalesce(tom_tat_uu_diem_tinh_nang, '') = '' and coalesce(noi_dung_uu_diem_sp, '') = '' then 'no-content' else 'from-cluster' end as reason from cur where (coalesce(tom_tat_uu_diem_tinh_nang, '') = '' and coalesce(noi_dung_uu_diem_sp, '') = '') or uu_diem_nguon = 'cluster'",
    "paging": "select doc_id, n_chars from documents order by doc_id limit 25 offset 50",
    "normalise": f"select doc_id, coalesce({_NORM.format('text')}, '') as norm from documents",
    "token_counts": f"select doc_id, len(list_distinct(list_filter(regexp_split_to_array(coalesce({_NORM.format('text')}, ''), '[^\\pL\\pN]+'), lambda x: x <> ''))) as n_tokens from documents",
    "url_parts": "select id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_replace(url, '/+$', '') as slash_key, left(regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '-', 'g'), 100) as slug from page_snapshots",
    "sheet_names": "with c as (select id, trim(regexp_replace(ten_san_pham, '[\\[\\]:*?/\\\\]', '-', 'g'), ' ') s from extractions where ten_san_pham is not null) select id, case when length(s) > 31 then left(s, 15) || '…' || right(s, 15) else s end as sheet from c",
}
