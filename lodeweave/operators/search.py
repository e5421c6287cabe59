"""Keyword search without regard to accents: what a keyword means, and suggestions for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.plain import normalise_text, tokens_of
from lodeweave.functions.text import all_tokens, contains_tokens, matches_all, normalise

# Words that alone never name a brand.
GENERIC = ("den", "led", "bong", "anh", "sang", "chieu", "viet", "nam", "shop", "nha", "dien")


def match_brands(keyword: str, brands: DataFrame, name: str = "name") -> DataFrame:
    """Brands whose tokens stand side by side in the keyword, or hold the keyword's so. A keyword
    of generic words alone matches none."""
    words = tokens_of(keyword)
    if not words or all(w in GENERIC for w in words):
        return brands.limit(0)
    mine, theirs = F.array(*[F.lit(w) for w in words]), all_tokens(F.col(name))
    return brands.where(contains_tokens(theirs, mine) | contains_tokens(mine, theirs))


def match_names(keyword: str, rows: DataFrame, name: Column) -> DataFrame:
    """Rows whose normalised name holds every token of the keyword."""
    return rows.where(matches_all(keyword, name))


def match_categories(keyword: str, categories: DataFrame) -> DataFrame:
    """Category pages by name; by url where the name is missing."""
    return match_names(keyword, categories, F.coalesce("name", "url"))


def classify(keyword: str, brands: DataFrame, categories: DataFrame, products: DataFrame, prefer: str | None = None) -> DataFrame:
    """(kind, matches) of the keyword, one row, and its other meanings.

    brand goes before category, category before product_name, unless ``prefer`` names one
    that matches; none if nothing does. Only whether anything matches reaches the plan's end."""
    found = [("brand", match_brands(keyword, brands)), ("category", match_categories(keyword, categories)), ("product_name", match_names(keyword, products, F.col("ten_san_pham")))]
    counts = None
    for rank, (kind, rows) in enumerate(found):
        one = rows.agg(F.count("*").alias("matches")).select(F.lit(kind).alias("kind"), F.lit(-1 if kind == prefer else rank).alias("rank"), "matches")
        counts = one if counts is None else counts.unionByName(one)
    hit = counts.where("matches > 0").agg(F.min(F.struct("rank", "kind", "matches")).alias("best"), F.array_sort(F.collect_list("kind")).alias("kinds"))
    kind = F.coalesce("best.kind", F.lit("none"))
    return hit.select(kind.alias("kind"), F.coalesce("best.matches", F.lit(0)).alias("matches"), F.array_join(F.array_except("kinds", F.array(kind)), ",").alias("others"))


def merge_suggestions(names: DataFrame) -> DataFrame:
    """(key, label, domains, products): names of equal normalised form as one suggestion.

    ``names`` has domain, name and products. The label is the name with most products, the
    greatest of equals; domains is their sorted list, bounded by the number of domains."""
    per = names.where("name is not null").groupBy("name", "domain").agg(F.sum("products").alias("n")).withColumn("key", normalise(F.col("name")))
    by_name = per.groupBy("key", "name").agg(F.sum("n").alias("n"), F.collect_set("domain").alias("d"))
    return by_name.groupBy("key").agg(
        F.max(F.struct("n", "name")).getField("name").alias("label"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("d")))), ",").alias("domains"), F.sum("n").alias("products")
    )


def suggest(keyword: str, names: DataFrame, limit: int = 8) -> DataFrame:
    """The ``limit`` best suggestions: labels that begin with the keyword first, then by products, then by key."""
    hits = match_names(keyword, names, F.col("name"))
    start = F.lit(normalise_text(keyword))
    ranked = merge_suggestions(hits).withColumn("prefix", F.startswith("key", start))
    return ranked.orderBy(F.desc("prefix"), F.desc("products"), "key").limit(limit)


def resolve(keyword: str, categories: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """(domain, total, have, missing, complete) of the categories that a keyword means."""
    from lodeweave.operators.coverage import domain_scope

    chosen = match_categories(keyword, categories).select("domain", F.col("url").alias("category_url"))
    return domain_scope(edges.join(chosen, ["domain", "category_url"], "left_semi"), done)
