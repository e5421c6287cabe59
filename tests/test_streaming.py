import datetime as dt

from pyspark.sql import functions as F

from lodeweave.streaming import ingest as I


def test_ingest_is_repeatable(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    rows = [(1, "https://s/a", "s", 200, "<h1>A</h1>"), (2, "https://s/b", "s", 404, "<h1>B</h1>"), (3, "https://s/c", "s", 200, "")]
    schema = "id long, url string, domain string, http_status int, html string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    for _ in range(2):
        q = I.ingest(spark.readStream.schema(schema).parquet(src), out, cp, "v1").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.snapshot_id, r.ten_san_pham) for r in spark.read.parquet(out).collect()] == [(1, "A")]
    spark.createDataFrame([(4, "https://s/d", "s", 200, "<h1>D</h1>")], schema).write.mode("append").parquet(src)
    I.ingest(spark.readStream.schema(schema).parquet(src), out, cp, "v1").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.snapshot_id for r in spark.read.parquet(out).collect()) == [1, 4]


def test_changes_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None), ("b", 2, None), ("a", 4, "x")]
    src = str(tmp_path / "s")
    schema = "k string, o long, v string"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = I.changes_stream(spark.readStream.schema(schema).parquet(src), "k", "o", "v").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.key, r.ord, r.value) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    want = sorted((r.k, r.o, r.v) for r in I.changes_only(spark.createDataFrame(rows, schema), "k", ["o"], "v").collect())
    assert got == want == [("a", 1, "x"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, None)]


def test_backoff_and_silence(spark):
    e = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, True, True, True, True, False, False])] + [("b", 0, False), ("c", 0, True), ("c", 1, False), ("c", 2, False)], "k string, o int, f boolean")
    assert {r.k: r.delay for r in I.backoff(e, "k", "o", F.col("f")).collect()} == {"a": 3.75, "b": 0.0, "c": 0.0}
    t = dt.datetime(2025, 1, 1, 12)
    h = spark.createDataFrame([("a", t), ("b", t - dt.timedelta(minutes=6)), ("c", None)], "k string, t timestamp")
    assert {r.k for r in I.silent(h, "k", "t", F.lit(t)).collect()} == {"b", "c"}


def test_windowed_counts(spark):
    t = dt.datetime(2025, 1, 1, 12)
    e = spark.createDataFrame([(t, "a"), (t + dt.timedelta(minutes=59), "a"), (t + dt.timedelta(hours=1), "b")], "t timestamp, k string")
    assert {(r.k, r.n) for r in I.windowed_counts(e, "t", "1 hour", "5 minutes", "k").collect()} == {("a", 2), ("b", 1)}
