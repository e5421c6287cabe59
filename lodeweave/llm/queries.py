"""Queries of the llm operators and, where SQL can express them, their counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import categories, confusables, listings, packing, personal, tokenize
from lodeweave.session import table

#: Key of the surrogates in the registered query; in use it is a secret parameter.
SURROGATE_KEY = "registered query"
CATEGORY_FIELDS = ["category_1", "category_2", "category_3"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return categories.map_categories(table(spark, sf, "extractions"), table(spark, sf, "category_list"), fields=CATEGORY_FIELDS).withColumnRenamed("id", "extraction_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return listings.same_product_pairs(table(spark, sf, "extractions"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return listings.products(table(spark, sf, "extractions"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.inconsistent(table(spark, sf, "extractions"), "id", ["ten_san_pham", "category_1"]).withColumnRenamed("id", "extraction_id")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.lookalike_groups(table(spark, sf, "extractions"), ["ten_san_pham", "category_1"])


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_column(table(spark, sf, "documents"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal.find_personal(table(spark, sf, "documents"), key=SURROGATE_KEY)


def p9_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return personal.personal_pairs(table(spark, sf, "documents"), key=SURROGATE_KEY)


def p9_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind how many entities have several surrogates, and surrogates several entities: none."""
    return personal.distinctness(p9_pairs(spark, sf)).where("entities > 0").select("kind", "split", "merged")


def p9_replaced(spark: SparkSession, sf: str) -> DataFrame:
    return personal.replace_personal(table(spark, sf, "documents"), key=SURROGATE_KEY)


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Listings in the groups, and those in several groups."""
    groups = p4_groups(spark, sf)
    return groups.groupBy("url", "domain").agg(F.count("*").alias("n")).agg(F.count("*").alias("listings"), F.count_if(F.col("n") > 1).alias("in_several"))


def p5_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the look-alike groups and originals among them, per field: every non-null text is in one group."""
    return p5_groups(spark, sf).groupBy("field").agg(F.sum("n_rows").alias("texts"), F.sum("forms").alias("originals"))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether their ids decode to the very text."""
    ids = p7_ids(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return tokenize.decoded(ids).groupBy((F.col("decoded") == F.coalesce("text", F.lit(""))).alias("equal")).agg(F.count("*").alias("documents"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed, containers over their capacity, and documents cut that fit into one."""
    packed = p8_packed(spark, sf)
    over = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("fill")).agg(F.count_if(F.col("fill") > 2048).alias("over"))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("size")).agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("size") <= 2048)).alias("cut"))
    return docs.crossJoin(over)


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_groups": p4_groups, "p4_checks": p4_checks, "p5_found": p5_found, "p5_groups": p5_groups, "p5_totals": p5_totals, "p7_ids": p7_ids, "p7_checks": p7_checks, "p8_packed": p8_packed, "p8_checks": p8_checks, "p9_found": p9_found, "p9_pairs": p9_pairs, "p9_distinct": p9_distinct, "p9_replaced": p9_replaced}
_NAMED = "ten_san_pham is not null and ten_san_pham <> '' and url is not null and domain is not null and crawl_status is distinct from 'not-a-product'"
#: What the operators themselves compute isn't to be said in SQL; these are laws that their results keep.
ORACLE: dict[str, str] = {
    "p4_checks": f"select count(*) as listings, 0 as in_several from (select distinct url, domain from extractions where {_NAMED})",
    "p5_totals": " union all ".join(f"select '{f}' as field, count({f}) as texts, count(distinct {f}) as originals from extractions" for f in ("ten_san_pham", "category_1")),
    "p7_checks": "select true as equal, count(*) as documents from documents",
    "p8_checks": "select count(*) as documents, 0 as cut, 0 as over from documents",
    "p9_distinct": "select unnest(['email', 'phone', 'id_number', 'address', 'name', 'bare name']) as kind, 0 as split, 0 as merged",
}
