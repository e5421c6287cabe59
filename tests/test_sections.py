import base64
import zlib

from pyspark.sql import functions as F

from lodeweave.operators import discovery as D
from lodeweave.operators import pages as P
from lodeweave.operators import sections as S
from lodeweave.sources import records as R
from lodeweave.sources import xlsx

STRONG = "<h1>Đèn X</h1><div>Đặc điểm:</div><h2>1. Ưu điểm của đèn</h2><ul><li><strong>Tiết kiệm:</strong> giảm điện năng</li><li><b>Bền</b> dùng lâu, chịu nước.</li></ul><p>>>> Xem thêm: khác</p><h2>Thông số</h2><p>Công suất: 12W</p>"
CLUSTER = "<h2>Sáng đều</h2><p>a</p><h2>Nhẹ</h2><p>b</p><h2>Mát</h2><p>c</p>"


def test_sources():
    got = S.find_section("<nav><h2>Ưu điểm</h2><p>menu</p></nav>" + STRONG)
    assert (got["source"], got["title"], got["bullets"]) == ("keyword", "1. Ưu điểm của đèn", ["Tiết kiệm", "Bền"])
    assert "Xem thêm" not in got["content"] and "12W" not in got["content"]
    got = S.find_section(CLUSTER)
    assert got["source"] == "cluster" and got["bullets"] == ["Sáng đều", "Nhẹ", "Mát"]
    assert S.find_section("<h1>Ứng dụng</h1>" + CLUSTER)["source"] == "none" and S.find_section("<h2>A</h2><p>a</p><h2>B</h2><p>b</p>")["source"] == "none"
    page = "<h2>Vì da bạn</h2><p>Ánh sáng dịu, không chói</p>"
    assert S.find_section(page, anchor="ÁNH sáng  dịu")["source"] == "anchor" and S.find_section(page, anchor="dịu")["source"] == "none"
    text = "<div class=d><p>Đèn này sáng dịu và bền, dùng trong nhà được nhiều năm.</p></div>"
    assert S.find_section(text, description=".d")["source"] == "description" and S.find_section(text)["source"] == "none"
    assert S.find_section("<h2>Ưu điểm</h2><h2>Thông số</h2><p>x</p>")["source"] == "none"
    assert S.find_section(None)["source"] == S.find_section("")["source"] == "none" and S.find_section("<div>" * 5000 + "x")["source"] == "none"
    assert len(S.find_section("<h2>Ưu điểm</h2>" + "<p>" + "đẹp " * 50_000)["content"]) <= S.CONTENT_LIMIT


def test_headings_and_prose():
    assert S.like_heading("Đặc điểm nổi bật:") and S.like_heading("Đặc điểm") and not S.like_heading("Rọi vào cây, làm nổi bật") and not S.like_heading("x" * 41)
    assert S.is_prose("Một câu khá dài về chiếc đèn, có dấu phẩy và chấm.\nA: 1") and not S.is_prose("A: 1\nB: 2\nMột câu khá dài về chiếc đèn, có dấu phẩy và chấm.") and not S.is_prose("")


def test_frames(spark):
    df = spark.createDataFrame([(1, "https://s/a", STRONG), (2, "https://s/b", None)], "id long, url string, html string")
    assert {r.id: r.source for r in S.find_sections(df).collect()} == {1: "keyword", 2: "none"}
    got = {r.id: r.context for r in P.contexts(df).collect()}
    assert got[1].startswith("Tiết kiệm: giảm điện năng\nCông suất: 12W\n") and got[2] == ""
    assert P.read_page("<li><b>IP</b>: 44<br>CRI: <i>90</i><ul><li>A: 1</li></ul></li>", "u")["spec_lines"] == ["IP: 44", "CRI: 90", "A: 1"]


def test_links(spark):
    links = spark.createDataFrame([("https://s/c", "https://s/c?page=2"), ("https://s/c", "https://s/d?page=2"), ("https://s/c", "https://s/p/"), ("https://s/c", "https://s/c/page/3")], "url string, href string")
    assert {r.href for r in P.pager_links(links).collect()} == {"https://s/c?page=2", "https://s/c/page/3"}
    known = spark.createDataFrame([("https://s/p",)], "url string")
    assert [(r.href, r.product_url) for r in P.known_links(links, known).collect()] == [("https://s/p/", "https://s/p")]


def test_answers(spark):
    rows = [("```json\n{\"tags\": {\" a \": \" 1 \", \"b\": \"\", \"c\": \"" + "x" * 201 + "\"}}\n```",), ("[1]",), ("{\"tags\": 3}",), (None,), ("no",)]
    got = P.parse_tags(spark.createDataFrame(rows, "answer string")).collect()
    assert [(t.key, t.value) for t in got[0].tags] == [("a", "1")] and got[0].error is None and all(r.error for r in got[1:])
    tags = spark.createDataFrame([("k", "IP44", "ip 44, đỏ"), ("k", "IP65", "ip 44"), ("k", "x", None)], "key string, value string, source string")
    assert [r.value for r in P.grounded_tags(tags, "source").collect()] == ["IP44", "x"]
    codes = spark.createDataFrame([("AB-1",), ("123",), (" ",), (None,)], "s string").select(*P.sku_code("s")).collect()
    assert [tuple(r) for r in codes] == [("AB-1", "AB-1"), (None, "123"), (None, None), (None, None)]


def test_redirects_and_probes(spark):
    coded = base64.urlsafe_b64encode("https://s.example/?a=ä~~~".encode()).decode().rstrip("=")
    df = spark.createDataFrame([(f"https://b.example/ck?x=1&u=a1{coded}&n=1",), ("https://b.example/?u=a1%%%",), ("https://z",)], "u string")
    assert [r[0] for r in df.select(D.decode_redirect(F.col("u"))).collect()] == ["https://s.example/?a=ä~~~", "https://b.example/?u=a1%%%", "https://z"]
    now = F.to_timestamp(F.lit("2025-03-01 00:00:00"))
    probes = spark.sql("select * from values ('a', timestamp'2025-02-20 00:00:00'), ('a', timestamp'2025-02-25 00:00:00'), ('b', timestamp'2025-01-01 00:00:00') t(domain, probed_at)")
    assert [(r.domain, r.probed_at.day) for r in D.fresh(probes, now).collect()] == [("a", 25)]


def test_discover_follows_listings(spark):
    u = "https://d/"
    # A listing whose pages each name the next one only, under a home page with a link to it.
    links = [(u, u + "c", 0, False, True)]
    for page in range(1, 6):
        at = u + "c" + (f"/page/{page}" if page > 1 else "")
        links += [(at, f"{u}p/{page}-{i}", i, False, True) for i in range(8)] + [(at, f"{u}sub/{page}", 8, False, True)] + [(at, f"{u}n/{i}.html", 20 + i, False, False) for i in range(7)]
        links += [(at, f"{u}c/page/{page + 1}", 9, False, False)] if page < 5 else []
    links += [(f"{u}sub/5", f"{u}q/{i}", i, False, True) for i in range(6)]
    df = spark.createDataFrame(links, "url string, href string, ord int, in_nav boolean, has_img boolean")
    kinds = [(x, "listing") for x in {r[0] for r in links} if "/c" in x] + [(r[1], "product") for r in links if "/p/" in r[1] or "/q/" in r[1]]
    pages = spark.createDataFrame(kinds, "url string, kind string")
    seeds = spark.createDataFrame([("d", u)], "domain string, url string")
    deeper, within = D.followed(df, D.candidate_links(df), pages)
    assert {r.href for r in deeper.where("url like '%/c%'").collect()} == {f"{u}sub/{k}" for k in range(1, 6)} and within.count() == 4
    got = {r.url for r in D.discover(seeds, df, pages).collect()}
    assert got == {f"{u}p/{k}-{i}" for k in range(1, 6) for i in range(8)} | {f"{u}q/{i}" for i in range(6)}
    # Repeated shapes count where cards are few.
    assert D.candidate_links(df).where("href like '%/n/%'").count() == 0
    few = df.where("has_img = false or href like '%-1'")
    assert D.candidate_links(few).where("href like '%/n/%'").count() == 35


def test_discover(spark):
    cards = [("https://d/c", f"https://d/p/{i}", i, False, True) for i in range(12)]
    links = spark.createDataFrame([("https://d/", "https://d/c", 0, True, False), ("https://d/", "https://d/news/2024/05/x", 1, False, True), *cards, ("https://d/c", "https://d/about.html", 99, False, True)], "url string, href string, ord int, in_nav boolean, has_img boolean")
    pages = spark.createDataFrame([(f"https://d/p/{i}", "product") for i in range(11)], "url string, kind string")
    got = {r.url for r in D.discover(spark.createDataFrame([("d", "https://d/")], "domain string, url string"), links, pages, hops=1).collect()}
    assert got == {f"https://d/p/{i}" for i in range(12)}


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "g", "Đèn", "u1"), (2, "g", None, "u2"), (3, None, "x", "u3")], "id int, g string, name string, url string")
    path = str(tmp_path / "o.xlsx")
    assert R.write_plan(rows, "g", ["id"], ["name", "url"], path, review=rows.where("id = 2").withColumn("reason", F.lit("r"))) == 3
    with open(path, "rb") as f:
        got = list(xlsx.read_workbook(f.read()))
    assert [(s, c) for s, _, c in got] == [("g", ["STT", "name", "url"]), ("g", ["1", "Đèn", "u1"]), ("g", ["2", None, "u2"]), ("Chưa phân loại", ["STT", "name", "url"]), ("Chưa phân loại", ["1", "x", "u3"]), ("Cần xem lại", ["name", "url", "reason"]), ("Cần xem lại", [None, "u2", "r"])]
    again = R.import_workbook(spark, path, ["name", "url", "absent"], "url", skip="Chưa phân loại")
    assert sorted((r.url, r.name, r.absent, r.snapshot_id) for r in again.collect()) == [("u1", "Đèn", None, None), ("u2", None, None, None)]
    blobs = spark.createDataFrame([(zlib.compress("đ".encode()),), (b"x",), (None,)], "b binary")
    assert [r[0] for r in blobs.select(R.inflate("b")).collect()] == ["đ", None, None]
    t = spark.sql("select array(struct(1 as ord, 'a' as key, 'đ' as value)) as t union all select null").select(R.tags_json(F.col("t"))).collect()
    assert {r[0] for r in t} == {'{"a":"đ"}', None}
    R.write_texts(spark.createDataFrame([("d", "x" * 40_000)], "domain string, t string"), str(tmp_path / "t"), F.col("t"))
    assert spark.read.text(str(tmp_path / "t")).where("length(value) = 30000").count() == 1
    assert R.select_records(rows.withColumn("domain", F.lit("d")), spark.createDataFrame([("d", "u1"), ("d", "u1")], "domain string, url string")).count() == 1
