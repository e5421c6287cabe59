"""What a category index holds and what of it is extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_summary(pages: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """(domain, url, name, known, total, have, missing) of every category page.

    known is false for a page that failed: its number of products isn't 0 but unknown, and
    its counts are null. ``done`` has the column url. Repeated edges count once."""
    links = edges.select("domain", F.col("category_url").alias("url"), "product_url").distinct()
    marked = links.join(done.select(F.col("url").alias("product_url")).distinct().withColumn("_have", F.lit(1)), "product_url", "left")
    counts = marked.groupBy("domain", "url").agg(F.count("product_url").alias("_total"), F.count("_have").alias("_have"))
    known = F.coalesce(F.col("ok"), F.lit(False))
    total, have = F.coalesce("_total", F.lit(0)), F.coalesce("_have", F.lit(0))
    joined = pages.join(counts, ["domain", "url"], "left")
    return joined.select("domain", "url", "name", known.alias("known"), F.when(known, total).alias("total"), F.when(known, have).alias("have"), F.when(known, total - have).alias("missing"))


def domain_scope(edges: DataFrame, done: DataFrame) -> DataFrame:
    """(domain, total, have, missing, complete) over the different products of a domain's categories."""
    products = edges.where("product_url is not null").select("domain", F.col("product_url").alias("url")).distinct()
    marked = products.join(done.select("url").distinct().withColumn("_have", F.lit(1)), "url", "left")
    return marked.groupBy("domain").agg(F.count("*").alias("total"), F.count("_have").alias("have")).withColumns({"missing": F.col("total") - F.col("have"), "complete": F.col("total") == F.col("have")})


def products_in(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """Different product urls of the given (domain, category_url)."""
    return edges.join(categories.select("domain", "category_url").distinct(), ["domain", "category_url"], "left_semi").select("domain", "product_url").distinct()


def uncategorised(products: DataFrame, edges: DataFrame) -> DataFrame:
    """Products without any category, repetitions kept."""
    return products.join(edges.select("domain", F.col("product_url").alias("url")), ["domain", "url"], "left_anti")


def coverage_gap(products: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, total, indexed) of the different products of each domain."""
    marked = products.select("domain", "url").distinct().join(edges.select("domain", F.col("product_url").alias("url")).distinct().withColumn("_in", F.lit(1)), ["domain", "url"], "left")
    return marked.groupBy("domain").agg(F.count("*").alias("total"), F.count("_in").alias("indexed"))


def index_report(pages: DataFrame, edges: DataFrame, products: DataFrame) -> DataFrame:
    """Per domain: categories, failed and empty ones, uncategorised products, and the warnings they give."""
    counts = edges.select("domain", F.col("category_url").alias("url"), "product_url").distinct().groupBy("domain", "url").agg(F.count("*").alias("n"))
    per = (
        pages.join(counts, ["domain", "url"], "left")
        .groupBy("domain")
        .agg(F.count("*").alias("categories"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("failed"), F.count_if(F.coalesce(F.col("ok"), F.lit(False)) & F.col("n").isNull()).alias("empty"))
    )
    gap = coverage_gap(products, edges).select("domain", "total", (F.col("total") - F.col("indexed")).alias("uncategorised"))
    out = per.join(gap, "domain", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "uncategorised": F.coalesce("uncategorised", F.lit(0))})
    warnings = F.array_compact(
        F.array(
            F.when(F.col("failed") > 0, F.lit("failed")),
            F.when(F.col("empty") > 0, F.lit("empty")),
            F.when(F.col("uncategorised") * 5 > F.col("total"), F.lit("many-uncategorised")).when(F.col("uncategorised") > 0, F.lit("uncategorised")),
        )
    )
    return out.withColumn("warnings", F.array_join(warnings, ","))
