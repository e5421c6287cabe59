"""Extractor versions compared on the same snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.store import latest_by

#: Fields that are compared by default.
FIELDS = ("product_id", "ten_san_pham", "ma_san_pham", "category_1", "category_2", "category_3", "thong_so_ky_thuat", "tom_tat_tskt")


def version_counts(extractions: DataFrame) -> DataFrame:
    """Snapshots per domain and version; rows without snapshot don't count."""
    return extractions.where("snapshot_id is not null").groupBy("domain", "extractor_version").agg(F.count_distinct("snapshot_id").alias("snapshots"))


def change_group(before: Column, after: Column) -> Column:
    """null for equal values, fixed (was missing), broken (is missing) or changed."""
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(before.eqNullSafe(after), F.lit(None).cast("string")).when(missing(before), F.lit("fixed")).when(missing(after), F.lit("broken")).otherwise(F.lit("changed"))


def _version(extractions: DataFrame, version: str) -> DataFrame:
    rows = extractions.where((F.col("extractor_version") == version) & F.col("snapshot_id").isNotNull())
    return latest_by(rows, ["snapshot_id", "url"], [F.col("id")])


def cell_changes(extractions: DataFrame, before: str, after: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(domain, url, snapshot_id, field, before, after, change) of every cell that differs between two
    versions on the same snapshot. Each version counts with its last run; both sides are read
    with the compared columns alone and meet in one join."""
    key = ["snapshot_id", "url"]
    a = _version(extractions, before).select(*key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    b = _version(extractions, after).select(*key, "domain", *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in fields]))
    out = a.join(b, key).select("domain", "url", "snapshot_id", cells)
    return out.withColumn("change", change_group(F.col("before"), F.col("after"))).where("change is not null")


def change_tally(changes: DataFrame) -> DataFrame:
    """Per field the number of fixed, broken and changed cells."""
    kinds = ["fixed", "broken", "changed"]
    return changes.groupBy("field").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def shared_snapshots(extractions: DataFrame, before: str, after: str) -> DataFrame:
    """(shared, skipped): snapshots that both versions have, and rows that have none to compare on."""
    versions = extractions.where("snapshot_id is not null").where(F.col("extractor_version").isin(before, after)).groupBy("snapshot_id", "url").agg(F.count_distinct("extractor_version").alias("n"))
    shared = versions.agg(F.count_if(F.col("n") == 2).alias("shared"))
    skipped = extractions.agg(F.count_if(F.col("snapshot_id").isNull()).alias("skipped"))
    return shared.crossJoin(F.broadcast(skipped))


def rerun_plan(latest: DataFrame, current: DataFrame) -> DataFrame:
    """(url, snapshot_id, prior_id): what a new extractor version has to read, with the current
    extraction whose tags and anchors it carries over."""
    return latest.select("url", F.col("id").alias("snapshot_id")).join(current.select("url", F.col("id").alias("prior_id")), "url", "left")
