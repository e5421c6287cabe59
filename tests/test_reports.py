import pytest
from pyspark.sql import functions as F

from lodeweave.functions import dom
from lodeweave.operators import export, pages, registry, reports
from lodeweave.sources import records


def test_registry(spark):
    sites = spark.createDataFrame([("www.A.example", "Acme"), ("b.example", None), ("c.example", "Zed"), ("c.example", "Yak"), (None, "x")], "domain string, brand string")
    rows = spark.createDataFrame([(1, "https://a.example/p"), (2, "b.example"), (3, "c.example"), (4, "d.example"), (5, None)], "id int, domain string")
    assert {r.id: r.brand for r in registry.brand_of(rows, sites).collect()} == {1: "Acme", 2: "b.example", 3: "Zed", 4: "d.example", 5: None}
    assert {r.domain: r.has for r in registry.has_any(rows, sites).collect()}["c.example"] is True
    table = registry.domain_table(sites.where("domain is not null").limit(2), rows).orderBy("place").collect()
    assert [r.registered for r in table] == sorted((r.registered for r in table), reverse=True) and registry.domain_table(sites.limit(0), rows.limit(0)).count() == 0


def test_pager_links_and_walk(spark):
    u = "https://s.example/den"
    links = [(u, f"{u}?page=2"), (u, f"{u}/paged/2"), (u, f"{u}/trang-3"), (u, f"{u}-x/page/2"), (u, f"{u}?p=12"), (u, "https://o.example/den?page=2"), (u, f"{u}/sub/page/2"), (u, None)]
    got = {r.href for r in pages.pager_links(spark.createDataFrame(links, "url string, href string")).collect()}
    assert got == {f"{u}?page=2", f"{u}/paged/2", f"{u}/trang-3", f"{u}/sub/page/2"}
    chain = [(u if i == 1 else f"{u}?page={i}", f"{u}?page={i + 1}") for i in range(1, 9)] + [(u if i == 1 else f"{u}?page={i}", f"https://s.example/p{i}/") for i in range(1, 10)] + [("https://s.example/empty", "https://s.example/x")]
    captured = spark.createDataFrame(chain, "url string, href string")
    categories = spark.createDataFrame([(u,), ("https://s.example/empty",), ("https://s.example/gone",), (None,)], "url string")
    known = spark.createDataFrame([(f"https://s.example/p{i}",) for i in range(1, 10)], "url string")
    for budget, want in ((4, 4), (20, 9)):
        found, report = pages.walk_categories(categories, captured, known, budget)
        assert sorted(r.product_url for r in found.collect()) == [f"https://s.example/p{i}" for i in range(1, want + 1)]
        assert {(r.category[18:], r.pages_fetched, r.ok) for r in report.collect()} == {("den", want, True), ("empty", 1, True), ("gone", 0, False)}


def test_a_page_of_several_products_is_a_product_page(spark):
    rows = spark.createDataFrame([(1, 8, 0, 0), (2, 0, 30, 0), (3, 0, 0, 5), (4, 0, 0, 4)], "id int, n_products int, n_cards int, n_spec_fields int")
    assert [r.kind for r in pages.page_kinds(rows).orderBy("id").collect()] == ["product", "listing", "product", "other"]


def test_dom_categories(spark):
    html = '<ol class="b"><li><a href="/">Home</a></li><li><a href="/a">A</a></li><li><a href="/a/p/">Self</a></li><li><a href="/b">B</a></li><li><a href="/a">A</a></li></ol>'
    rows = spark.createDataFrame([(1, "https://s.example/a/p", html), (2, "https://o.example/", html), (3, "https://s.example/", None), (4, "https://s.example/z", "")], "id int, url string, html string")
    rules = spark.createDataFrame([("s.example", "ol.b a")], "domain string, selector string")
    found = pages.dom_categories(rows, rules)
    assert {r.id: r.labels for r in found.collect()} == {1: ["Home", "A", "B"], 2: None, 3: None, 4: []}
    levels = pages.anchored_levels(F.col("labels"), F.array(F.lit("A"), F.lit("B")))
    assert list(found.where("id = 1").select(*levels).first()) == ["A", "B", None]


def test_unknown_selectors_raise():
    root = dom.parse("<ul><li class=x>1</li><li>2</li></ul>")
    assert [n.text() for n in dom.select(root, "ul > li.x, b:not(.y)")] == ["1"]
    for selector in ("li:nth-child(2)", "li + li", "li ~ li", "li::before"):
        with pytest.raises(ValueError):
            dom.select(root, selector)


def test_too_many_rules(spark, monkeypatch):
    monkeypatch.setattr(pages, "MAX_RULES", 2)
    rules = spark.range(3).select(F.concat(F.lit("d"), "id").alias("domain"), F.lit(1).alias("ord"), F.lit("f").alias("field"), F.lit("a").alias("selector"), F.lit(None).cast("string").alias("attr"))
    rows = spark.createDataFrame([(1, "https://d1/", "<a>x</a>")], "id int, url string, html string")
    for call in (lambda: pages.css_fields(rows, rules), lambda: pages.dom_categories(rows, rules)):
        with pytest.raises(ValueError):
            call()


def test_tags_json(spark):
    rows = spark.createDataFrame([(1, [(2, "k", "b"), (1, "k", "a"), (3, "m", "v"), (4, None, "z")]), (2, []), (3, None)], "id int, tags array<struct<ord:int,key:string,value:string>>")
    assert {r.id: r.j for r in rows.select("id", records.tags_json(F.col("tags")).alias("j")).collect()} == {1: '{"k":"b","m":"v"}', 2: None, 3: None}


def test_review_rows_are_no_records(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "A", "g"), ("u2", "B", "g")], "url string, name string, g string")
    review = spark.createDataFrame([("u1", "REVIEW", "no-content")], "url string, name string, reason string")
    path = str(tmp_path / "w.xlsx")
    records.write_plan(rows, "g", ["url"], ["url", "name"], path, review=review)
    assert {(r.url, r.name) for r in records.import_workbook(spark, path, ["url", "name"], "url").collect()} == {("u1", "A"), ("u2", "B")}


def test_reports(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", "", 5.0), (3, None, "x", None), (4, "b", "y", 9.0)], "id int, domain string, c string, v double")
    assert {(r.domain, r.products) for r in reports.counts_by(rows, ["domain", "c"]).collect()} == {("a", 1), ("b", 1)}
    p = reports.numeric_profile(rows, ["v"]).first()
    assert (p.n, p.n_null, p.least, p.median, p.mean, p.greatest) == (3, 1, 1.0, 5.0, 5.0, 9.0)
    assert reports.numeric_profile(rows.limit(0), ["v"]).first().median is None
    got = reports.page_of(rows, F.col("domain") == "a", ["id"], 1, 1).first()
    assert (got.id, got.total, got.matched) == (2, 4, 2)
    assert [r.c for r in reports.sizes_in_order(rows, "c", "id").collect()] == ["x", "y", None]
    assert reports.file_name("Đèn pha / LED") == "den-pha---led.xlsx" and reports.file_name("") == "ket-qua.xlsx"
    branches = spark.createDataFrame([("a", "x")], "domain string, branch string")
    assert {r.id: r.branch for r in reports.excluded_branch(rows, branches, ["c"]).collect()} == {1: "x", 2: None, 3: None, 4: None}
    assert export.export_plan(rows, "c", ["id"]).count() == 4
