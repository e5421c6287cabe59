from pyspark.sql import functions as F

from lodeweave.operators import coverage, export, quality, search, store, versions

EXT = "id long, url string, domain string, snapshot_id long, extractor_version string, crawl_status string, category_1 string, ten_san_pham string"


def ext(spark, rows):
    return spark.createDataFrame(rows, EXT)


def test_current_state_rules(spark):
    rows = [
        (1, "u1", "d", 10, "v1", "ok", None, "a"), (2, "u1", "d", 11, "v1", "ok", None, "b"), (3, "u1", "d", 10, "v2", "ok", None, "c"),  # a rerun on an older snapshot
        (4, "u2", "d", 20, "v1", "ok", None, "a"), (5, "u2", "d", 20, "v2", "error", None, "b"),  # a rerun on the same one
        (6, "u3", "d", None, "imported", "ok", None, "a"),
        (7, "u4", "d", 30, "v1", "ok", None, "a"), (8, "u4", "d", None, "imported", "ok", None, "b"),
        (9, "u5", "e", 40, "v1", "ok", None, "a"), (10, "u5/", "e", 41, "v1", "ok", None, "b"), (11, None, "e", 42, "v1", "ok", None, "b"),
    ]
    df = ext(spark, rows)
    assert {r.url: r.id for r in store.current_state(df).collect()} == {"u1": 2, "u2": 5, "u3": 6, "u4": 7, "u5": 9, "u5/": 10}
    assert {r.id for r in store.current_state(df, "e").collect()} == {9, 10}
    assert store.current_state(df.limit(0)).count() == 0
    assert {r.url for r in store.needs_work(df.where("url is not null").select("url").distinct(), store.current_state(df)).collect()} == {"u2"}


def test_tags_keep_their_order(spark):
    tags = spark.createDataFrame([(1, 2, "b", "x"), (1, 1, "a", None), (1, 1, "a", None), (None, 1, "z", "z")], "extraction_id long, ord int, key string, value string")
    got = {r.id: r.tags and [(t.ord, t.key) for t in r.tags] for r in store.with_tags(spark.createDataFrame([(1,), (2,)], "id long"), tags).collect()}
    assert got == {1: [(1, "a"), (1, "a"), (2, "b")], 2: None}


def test_sites_and_edges(spark):
    sites = spark.createDataFrame([("a", "x"), ("b", None)], "domain string, base_url string")
    new = spark.createDataFrame([("a", None), ("b", "y"), ("c", None)], "domain string, base_url string")
    assert {tuple(r) for r in store.merge_sites(sites, new).collect()} == {("a", "x"), ("b", "y"), ("c", None)}
    edges = spark.createDataFrame([("a", "c1", "p1"), ("a", "c2", "p2")], "domain string, category_url string, product_url string")
    fresh = spark.createDataFrame([("a", "c1", "p9")], "domain string, category_url string, product_url string")
    assert sorted(tuple(r) for r in store.replace_edges(edges, fresh, ["domain", "category_url"]).collect()) == [("a", "c1", "p9"), ("a", "c2", "p2")]


def test_numbering_follows_the_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7)
    assert [(r.id, r.k) for r in store.number_rows(df, 50, ["k"]).orderBy("id").collect()] == [(51 + i, i) for i in range(1000)]


def test_versions(spark):
    rows = [(1, "u", "d", 1, "v1", "ok", None, None), (2, "u", "d", 1, "v2", "ok", "c", None), (3, "w", "d", 2, "v1", "ok", "c", "n"), (4, "w", "d", 2, "v2", "ok", "", "m"), (5, "x", "d", 3, "v1", "ok", "c", "n"), (6, "y", "d", None, "imported", "ok", "c", "n")]
    df = ext(spark, rows)
    changes = versions.cell_changes(df, "v1", "v2", ("category_1", "ten_san_pham"))
    assert {(r.url, r.field, r.change) for r in changes.collect()} == {("u", "category_1", "fixed"), ("w", "category_1", "broken"), ("w", "ten_san_pham", "changed")}
    assert {tuple(r) for r in versions.change_tally(changes).collect()} == {("category_1", 1, 1, 0), ("ten_san_pham", 0, 0, 1)}
    assert tuple(versions.shared_snapshots(df, "v1", "v2").first()) == (2, 1)


def test_unknown_isnt_empty(spark):
    pages = spark.createDataFrame([("d", "c1", "n", True), ("d", "c2", "n", True), ("d", "c3", None, False), ("d", "c4", None, None)], "domain string, url string, name string, ok boolean")
    edges = spark.createDataFrame([("d", "c1", "p1"), ("d", "c1", "p1"), ("d", "c1", "p2"), ("d", "c3", "p3")], "domain string, category_url string, product_url string")
    done = spark.createDataFrame([("p1",), ("p1",)], "url string")
    got = {r.url: (r.known, r.total, r.have, r.missing) for r in coverage.category_summary(pages, edges, done).collect()}
    assert got == {"c1": (True, 2, 1, 1), "c2": (True, 0, 0, 0), "c3": (False, None, None, None), "c4": (False, None, None, None)}
    products = spark.createDataFrame([("d", f"p{i}") for i in range(1, 6)], "domain string, url string")
    r = coverage.index_report(pages, edges, products).first()
    assert (r.categories, r.failed, r.empty, r.uncategorised, r.warnings) == (4, 2, 1, 2, "failed,empty,many-uncategorised")


def test_search(spark):
    categories = spark.createDataFrame([("a", "/den-pha", None), ("a", "/x", "Đèn  PHA ngoài trời"), ("b", "/y", "Bộ nguồn")], "domain string, url string, name string")
    brands = spark.createDataFrame([("Hoa Lumen",), ("Đèn LED",)], "name string")
    products = spark.createDataFrame([("den pha 30w",)], "ten_san_pham string")
    kind = lambda k, prefer=None: search.classify(k, brands, categories, products, prefer).first()
    assert tuple(kind("đèn pha")) == ("category", 2, "product_name") and kind("đèn pha", "product_name").kind == "product_name"
    assert kind("hoa lumen 30w").kind == "brand" and kind("led").kind == "none" and kind("").kind == "none"
    names = spark.createDataFrame([("a", "Đèn Pha", 3), ("b", "đèn pha", 2), ("a", "Pha đèn", 9), ("a", None, 1)], "domain string, name string, products long")
    got = [(r.label, r.domains, r.products) for r in search.suggest("đèn", names).collect()]
    assert got == [("Đèn Pha", "a,b", 5), ("Pha đèn", "a", 9)]


def test_export(spark):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(["b", "a", None, "b", "x" * 40, "X" * 40, "a/b", "A:B"])], "id int, g string")
    plan = {r.id: (r.sheet_no, r.row_no) for r in export.export_plan(rows, "g", ["id"]).collect()}
    assert plan[0] == (1, 1) and plan[3] == (1, 2) and plan[2][0] == 7
    names = [r.sheet for r in export.distinct_names(export.sheet_order(rows, "g")).orderBy("place").collect()]
    assert len({n.lower() for n in names}) == 7 and max(map(len, names)) <= 31 and names[-1] == "Chưa phân loại" and names[0] == "b" and any(n.endswith(" (2)") for n in names)
    long = spark.createDataFrame([("y" * 40_000,), ("z",)], "t string").select(export.fit_cell(F.col("t")).alias("t"))
    assert sorted(len(r.t) for r in long.collect()) == [1, 32_004]


def test_quality(spark):
    e = spark.createDataFrame([(1, "IP 44 Đèn", None), (2, None, None)], "id long, a string, b string")
    t = spark.createDataFrame([(1, "k", "ip44"), (1, "k", "12VDC"), (1, "k", "IP44/đèn"), (2, "k", "x"), (1, "k", " ")], "extraction_id long, key string, value string")
    assert tuple(quality.grounding(e, t, ["a", "b"]).first()) == (3, 2, 2 / 3)
    assert {r.field: (r.n_filled, r.rate) for r in quality.fill_rates(e, ["a", "b"]).collect()} == {"a": (1, 0.5), "b": (0, 0.0)}
    assert tuple(quality.tag_stats(e, t).first()) == (2, 2, 2.5, 1, 4)


def test_registered_whole_jobs(spark, tmp_path):
    from lodeweave.plans import all_queries

    save = lambda name, sql: spark.sql(f"select * from values {sql}").write.parquet(f"{tmp_path}/{name}.parquet")
    day = lambda d: f"timestamp_ntz'2025-01-0{d} 00:00:00'"
    save("page_snapshots", f"(1L, 'u', 'd', {day(2)}), (2L, 'u', 'd', {day(4)}) t(id, url, domain, fetched_at)")
    save("crawl_rounds", f"('d', 1, {day(1)}), ('d', 2, {day(3)}), ('d', 3, {day(5)}) t(domain, round_no, opened_at)")
    got = all_queries()["valid_at_rounds"](spark, str(tmp_path)).collect()
    assert {(r["at"].day, r.snapshot_id) for r in got} == {(1, None), (3, 1), (5, 2)}
    save("extractions", "(1L, 1L, 'u', 'a'), (2L, 2L, 'v', 'b'), (3L, 3L, 'w', 'b') t(id, snapshot_id, url, category_2)")
    save("category_list", "(900, 'a', 2), (901, 'b', 2), (1, 'b', 1) t(category_id, name, level)")
    got = all_queries()["sheet_order_ranked"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["group"] for r in got] == ["a", "b"]
