"""The append-only store: snapshots, extractions and tags, and the views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by(rows: DataFrame, keys: list[str], order: list[Column], id: str = "id") -> DataFrame:
    """The rows that are last by ``order`` in each group of ``keys``.

    Only the ids of the winners are aggregated, with partial maxima before the shuffle, so
    a key that holds a large part of all rows makes no large group; the rows follow by a
    semi join on the id. Rows with a null id can't win; of equal ids all rows stay."""
    best = rows.where(F.col(id).isNotNull()).groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id).alias("_id"))).alias("w"))
    return rows.join(best.select(F.col("w._id").alias(id)), id, "left_semi")


def current_state(extractions: DataFrame, domain: str | None = None) -> DataFrame:
    """One row per url: that of the newest snapshot, then of the highest id; imported rows, which
    have no snapshot, lose to any other. The domain filter lies below the aggregation."""
    rows = extractions if domain is None else extractions.where(F.col("domain") == domain)
    return latest_by(rows.where("url is not null"), ["url"], [F.col("snapshot_id").isNotNull(), F.col("snapshot_id"), F.col("id")])


def latest_snapshots(pages: DataFrame) -> DataFrame:
    """The snapshot of the highest id of every url."""
    return latest_by(pages.where("url is not null"), ["url"], [F.col("id")])


def with_tags(extractions: DataFrame, tags: DataFrame) -> DataFrame:
    """Extractions with their tags as an array of (ord, key, value) in the order of writing.

    An extraction's tags are one record's attributes; an extraction without tags has null."""
    lists = tags.where("extraction_id is not null").groupBy("extraction_id").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "value"))).alias("tags"))
    return extractions.join(lists, F.col("id") == F.col("extraction_id"), "left").drop("extraction_id")


def needs_work(urls: DataFrame, current: DataFrame, done: tuple[str, ...] = ("ok", "not-a-product")) -> DataFrame:
    """The urls whose current row isn't done."""
    return urls.join(current.where(F.col("crawl_status").isin(*done)).select("url"), "url", "left_anti")


def merge_sites(sites: DataFrame, new: DataFrame) -> DataFrame:
    """Sites with new ones merged in; a null base_url never replaces a known one."""
    fresh = new.groupBy("domain").agg(F.max("base_url").alias("_new"))
    return sites.join(fresh, "domain", "full").select("domain", F.coalesce("_new", "base_url").alias("base_url"))


def number_rows(rows: DataFrame, after: int, order: list[str], id: str = "id") -> DataFrame:
    """Rows with ids that follow ``after`` in the given order.

    Positions come from the sorted ranges and their sizes: the ranges are numbered in
    parallel and only one count per range meets on the driver."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    from lodeweave.session import cut

    placed = cut(sorted_rows).withColumns({"_p": F.shiftright("_m", 33), "_k": F.expr("_m & 8589934591")})
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, total = [], after
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = rows.sparkSession.createDataFrame(starts or [(0, after)], "_p long, _s long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(id, F.col("_s") + F.col("_k") + 1).drop("_p", "_s", "_k", "_m")


def replace_edges(edges: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges in which the groups that ``new`` brings are replaced as a whole."""
    return edges.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent: empty if the reference holds."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def valid_at(pages: DataFrame, moments: DataFrame, time: str = "at") -> DataFrame:
    """For each (url, time) of ``moments`` the id of the last page fetched by then, null for none.

    Both sides are brought together by url and sorted by time; a running maximum carries the
    last page forward. No pair of page and moment is formed."""
    events = pages.select("url", F.col("fetched_at").alias("_t"), F.lit(0).alias("_k"), F.struct("fetched_at", "id").alias("_s")).unionByName(
        moments.select("url", F.col(time).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("struct<fetched_at:timestamp_ntz,id:bigint>").alias("_s"))
    )
    w = Window.partitionBy("url").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_s", F.max("_s").over(w)).where("_k = 1").select("url", F.col("_t").alias(time), F.col("_s.id").alias("snapshot_id"))
