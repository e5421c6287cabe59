import json

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import dom
from lodeweave.functions import text as X
from lodeweave.functions import urls as U
from lodeweave.operators import discovery as D
from lodeweave.operators import pages as P
from lodeweave.sources import xlsx

LD = json.dumps([{"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "Pha"}, {"position": 1, "item": {"name": "Nhà"}}, {"position": 3, "name": "Đèn X"}]}, {"@type": ["Product"], "name": "Đèn X", "sku": "AB-1", "image": ["/a.jpg"], "brand": {"name": "Lumo"}, "offers": [{"priceSpecification": [{"price": "166000"}]}]}])
PAGE = f"""<html><head><title>T</title><script type="application/ld+json">{{broken</script><script type='application/ld+json'>{LD}</script></head>
<body><nav class=menu><ul><li><a href="/c?x=1#f">C</a><li><a href='mailto:a@b'>M</a></ul></nav><h1>Đèn <b>X</b></h1>
<a href="p1"><img src=i></a><a href="//o.example/q"><img></a><p>Công suất: 12W<p>ghi chú<table><tr><td>CRI</td><td>90</td><tr><td>a</td><td>b</td><td>c</td></table><dl><dt>IP:<dd>65</dl>
<script>var a = "</p>: b";</script><!-- Ẩn: x --></body>"""


def test_dom():
    root = dom.parse(PAGE)
    assert [n.text() for n in dom.select(root, "nav li")] == ["C", "M"] and dom.select(root, "h1 > b")[0].text() == "X"
    assert [n.attrs["href"] for n in dom.select(root, "a:has(img), a[href^='/c']")] == ["/c?x=1#f", "p1", "//o.example/q"]
    assert len(dom.select(root, "a:not([href*=mailto])")) == 3 and not dom.select(root, ".Menu") and dom.select(root, "nav.menu")
    assert dom.parse("").text() == "" and dom.parse("</p></p>&amp;").text() == "&" and dom.parse("<p>a<p>b").text("|") == "a|b"
    assert dom.parse("<div>" * 3000 + "x").text() == "x"


def test_read_page():
    got = P.read_page(PAGE, "https://s.example/d/")
    assert (got["title"], got["heading"], got["name"], got["sku"], got["price_text"], got["brand"], got["image"], got["source"]) == ("T", "Đèn X", "Đèn X", "AB-1", "166000", "Lumo", "/a.jpg", "json-ld")
    assert got["breadcrumb"] == ["Nhà", "Pha", "Đèn X"] and got["n_products"] == 1
    assert got["spec_lines"] == ["Công suất: 12W", "CRI: 90", "IP: 65"] and "Ẩn" not in got["text"] and "var a" not in got["text"]
    assert P.read_page(None, None)["spec_lines"] == [] and P.read_page("", "")["title"] is None
    micro = P.read_page('<div itemscope itemtype="https://schema.org/Product"><span itemprop=name>M</span><meta itemprop="price" content="5"></div>', "u")
    assert (micro["name"], micro["price_text"], micro["source"]) == ("M", "5", "microdata")
    og = P.read_page('<meta property="og:title" content="O"><meta property="og:image" content="i">', "u")
    assert (og["name"], og["image"], og["source"]) == ("O", "i", "opengraph")


RDFA = """<body vocab="https://schema.org/"><ol typeof="BreadcrumbList"><li property="itemListElement" typeof="ListItem"><a property="item" typeof="WebPage" href="/p"><span property="name">Pha</span></a><meta property="position" content="2">
<li property="itemListElement" typeof="ListItem"><span property="name">Nhà</span><meta property="position" content="1"><li property="itemListElement" typeof="ListItem"><b property="name">Đèn X</b><meta property="position" content="3"></ol>
<div typeof="schema:Product"><h1 property="schema:name">Đèn X</h1><img property="image" src="/a.jpg"><span property="sku">AB-1</span><div property="brand" typeof="Brand"><b property="name">Lumo</b></div><div rel="offers"><p typeof="Offer"><i property="price" content="5">5 đ</i></div></div>
<meta property="og:title" content="O"></body>"""


def test_rdfa():
    got = P.read_page(RDFA, "u")
    assert (got["name"], got["sku"], got["image"], got["brand"], got["price_text"], got["source"]) == ("Đèn X", "AB-1", "/a.jpg", "Lumo", "5", "rdfa")
    assert got["breadcrumb"] == ["Nhà", "Pha", "Đèn X"]
    assert P.read_page("<div typeof=x property=y>" * 3000, "u")["name"] is None


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "https://s.example/d/", PAGE, "s.example", 200), (2, "https://s.example/e", None, "s.example", 200)], "id long, url string, html string, domain string, http_status int")
    links = P.html_links(df)
    assert [(r.href, r.in_nav, r.has_img) for r in links.orderBy("ord").collect()] == [("https://s.example/c?x=1", True, False), ("https://s.example/d/p1", False, True), ("https://o.example/q", False, True)]
    assert [r.href for r in P.nav_links(links).collect()] == ["https://s.example/c?x=1"]
    assert [r.href for r in P.card_links(links.join(df.select("id", "url"), "id")).collect()] == ["https://s.example/d/p1"]
    levels = P.category_levels(P.read_pages(df, ("id", "domain")), []).orderBy("id").collect()
    assert levels[0].category_1 == "Pha" and levels[0].category_2 is None and levels[1].category_1 is None
    rules = spark.createDataFrame([("s.example", 1, "h", "h2", None), ("s.example", 2, "h", "h1", None), ("s.example", 3, "i", "a img", "src")], "domain string, ord int, field string, selector string, attr string")
    assert {(r.id, r.field, r.value) for r in P.css_fields(df, rules).collect()} == {(1, "h", "Đèn X"), (1, "i", "i")}
    assert {r.kind for r in P.page_kinds(P.read_pages(df)).collect()} == {"product", "other"}
    rebuilt = P.rebuild(df, "v9").orderBy("snapshot_id").collect()
    assert rebuilt[0].ten_san_pham == "Đèn X" and rebuilt[0].thong_so_ky_thuat.startswith("Công suất: 12W") and rebuilt[1].thong_so_ky_thuat is None
    assert P.read_pages(df.limit(0)).count() == 0


URLS = [
    ("https://h.example/index.php/product/den-x/", "/index.php/product/*"), ("https://h.example/x.html", "/*.html"), ("https://h.example/plist.php?lay3=A&b=&a=1&a=2#f", "/*.php?a&lay3"), ("https://h.example", "*"),
    ("https://h.example:81/a/b", "/a/*"), ("/a/b?", "/a/*"), (None, None),
]


def test_urls(spark):
    df = spark.createDataFrame(URLS, "url string, want string").withColumns({"shape": U.shape(F.col("url")), "host": U.host(F.col("url"))})
    for r in df.collect():
        assert r.shape == r.want, r.url
    assert df.where("url like '%:81%'").first().host == "h.example:81"
    one = spark.createDataFrame([("1.2) Đèn :", "  Đèn  LED  ", "a/Đèn pha.html/", "x" * 12)], "a string, b string, c string, d string")
    got = one.select(X.clean_line(F.col("a")), X.normalise(F.col("b")), X.slug(F.col("c")), X.shorten(F.col("d"), 10, "…"), X.normalise(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("Đèn", "den led", "Den-pha.html", "x" * 10 + "…", "")


def test_select_urls(spark):
    df = spark.createDataFrame([("d", " https://d/p/a/ ", 1), ("d", "https://d/p/a", 2), ("d", "https://d/", 3), ("d", "", 4), ("d", "https://d/q", 5)], "domain string, url string, ord long")
    assert [tuple(r) for r in D.select_urls(df, F.lit("https://d"), F.lit("/p/")).collect()] == [("d", "https://d/p/a/")]


def test_sitemaps(spark):
    files = spark.createDataFrame(
        [("r", "\n<?xml version='1.0'?><sitemapindex><sitemap><loc>product-1.xml</loc></sitemap><sitemap><loc>product-cat.xml</loc></sitemap><sitemap><loc>post.xml</loc></sitemap></sitemapindex>"), ("product-1.xml", "<urlset><url><loc> <![CDATA[https://d/a?x=1&amp;y]]></loc></url><url><loc>https://d/b</loc>"), ("product-cat.xml", "<ns:urlset><ns:url><ns:loc>https://d/c</ns:loc></ns:url></ns:urlset>"), ("post.xml", "<urlset><loc>https://d/n</loc></urlset>"), ("x", "<html><loc>no</loc></html>")],
        "url string, body string",
    )
    got = {(r["loc"], r.kind) for r in D.resolve_sitemaps(files, spark.createDataFrame([("r",)], "url string")).collect()}
    assert got == {("https://d/a?x=1&y", "product"), ("https://d/b", "product"), ("https://d/c", "listing")}
    assert D.sitemap_entries(files).where("url = 'x'").count() == 0
    robots = spark.createDataFrame([("d", "a\nSITEMAP : https://d/s.xml\n # Sitemap: no\n sitemap:https://d/t.xml")], "domain string, body string")
    assert [r.url for r in D.robots_sitemaps(robots).orderBy("ord").collect()] == ["https://d/s.xml", "https://d/t.xml"]


def test_walk_and_shapes(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("b", "a")], "url string, href string")
    seeds = spark.createDataFrame([("x", "a"), ("x", "a")], "domain string, url string")
    assert {(r.url, r.hop) for r in D.walk(seeds, links, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.url for r in D.walk(seeds, links, 3, budget=2).collect()} == {"a", "b"}
    urls = spark.createDataFrame([("d", f"https://d/p/{i}") for i in range(100)] + [("d", f"https://d/n/{i}.html") for i in range(7)], "domain string, url string")
    sampled = D.sample_by_shape(urls)
    assert {r["shape"]: r["count"] for r in sampled.groupBy("shape").count().collect()} == {"/p/*": 10, "/n/*.html": 5}
    verdicts = {r["shape"]: r.verdict for r in D.shape_verdicts(sampled, urls.where("url like '%/p/%'")).collect()}
    assert verdicts == {"/p/*": "accept", "/n/*.html": "reject"}
    page = spark.createDataFrame([("u", f"https://d/p/{i}", i) for i in range(6)] + [("u", "https://d/x.html", 6)], "url string, href string, ord int")
    assert [r.href for r in D.dominant_shape(page).collect()] == ["https://d/x.html"] and D.repeated_shapes(page).count() == 6


def test_excluded(spark):
    d = spark.createDataFrame([("a.shop.example",), ("shop.example",), ("myshop.example",)], "domain string")
    assert {r.domain for r in D.excluded(d, spark.createDataFrame([("shop.example",)], "domain string")).collect()} == {"a.shop.example", "shop.example"}


def test_workbook_round_trip(spark, tmp_path):
    xlsx.register(spark)
    path = str(tmp_path / "a.xlsx")
    rows = [["Đèn <&> \"x\"", 1, 2.5, None], [" sp ", None, True, "\x01y"]]
    xlsx.write_workbook(path, [("Một & hai", [" A ", "B", "C", "D"], iter(rows)), ("Skip", ["A"], iter([["no"]])), ("Empty", ["A"], iter([]))])
    got = spark.read.format("xlsx").option("skip", "Skip").schema("sheet string, row_no int, A string, B string, C string, D string, E string").load(path).orderBy("row_no").collect()
    assert [tuple(r) for r in got] == [("Một & hai", 2, "Đèn <&> \"x\"", "1", "2.5", None, None), ("Một & hai", 3, " sp ", None, "True", "y", None)]
    raw = spark.read.format("xlsx").load(path).where("sheet = 'Empty'").collect()
    assert [r.cells for r in raw] == [["A"]]
    xlsx.write_workbook(str(tmp_path / "b.xlsx"), [])
    assert spark.read.format("xlsx").load(str(tmp_path / "b.xlsx")).count() == 0


@pytest.mark.parametrize("column,name", [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_column_names(column, name):
    assert xlsx._name(column) == name and xlsx._column(name + "7") == column
