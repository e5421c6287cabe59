"""Reports over records: counts, profiles, ordered and limited lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.plain import normalise_text


def counts_by(rows: DataFrame, keys: list[str], name: str = "products") -> DataFrame:
    """(keys, name): rows per group in which no key is null or empty."""
    filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys])
    return rows.where(filled).groupBy(*keys).agg(F.count("*").alias(name))


def category_sizes(rows: DataFrame, indexed: DataFrame, name: str = "name") -> DataFrame:
    """(domain, name, products) of the categories that records name, and of indexed categories that
    none names, with 0."""
    stored = counts_by(rows, ["domain", name])
    return stored.unionByName(indexed.where(F.col(name).isNotNull()).select("domain", name).distinct().withColumn("products", F.lit(0).cast("long")))


def numeric_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, n_null, least, median, mean, greatest) of every numeric column, in one pass. The
    median is exact; its buffer holds the counts of the different values."""
    stats = ("n", "n_null", "least", "median", "mean", "greatest")
    make = lambda c: [F.count(c), F.count_if(c.isNull()), F.min(c), F.median(c), F.avg(c), F.max(c)]
    cells = [a.alias(f"{s}_{i}") for i, c in enumerate(columns) for s, a in zip(stats, make(F.col(c).cast("double")))]
    lines = F.array(*[F.struct(F.lit(c.split(".")[-1] if "." in c else c).alias("field"), *[F.col(f"{s}_{i}").alias(s) for s in stats]) for i, c in enumerate(columns)])
    return rows.agg(*cells).select(F.inline(lines))


def run_summary(rows: DataFrame, status: str, group: str, started: str, ended: str) -> DataFrame:
    """(group, n, ok, failed, to_review, seconds_each) per group: rows by status, and the mean time
    between two columns of a row that has both."""
    state = F.coalesce(F.col(status), F.lit(""))
    seconds = F.timestamp_diff("MICROSECOND", F.col(started).cast("timestamp"), F.col(ended).cast("timestamp")) / 1e6
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(state == "ok").alias("ok"), F.count_if(state == "failed").alias("failed"), F.count_if(~state.isin("ok", "failed", "not-a-product")).alias("to_review"), F.round(F.avg(seconds), 3).alias("seconds_each")
    )


def merge_brands(rows: DataFrame, brand: str = "brand", domain: str = "domain") -> DataFrame:
    """(brand, domains, products): domains of one brand as one entry, its domains sorted."""
    per = rows.where(F.col(brand).isNotNull()).groupBy(brand, domain).agg(F.count("*").alias("n"))
    return per.groupBy(brand).agg(F.array_join(F.array_sort(F.collect_set(domain)), ",").alias("domains"), F.sum("n").alias("products"))


def first_rows(rows: DataFrame, order: list[str], limit: int | None, offset: int = 0) -> DataFrame:
    """The rows from ``offset`` on in the given order, at most ``limit`` of them; a top-k, so no more
    than offset and limit rows leave a task."""
    ordered = rows.orderBy(*order)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def page_of(rows: DataFrame, matches: Column, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of the matching rows, each with the number of all rows and of matching ones."""
    totals = rows.agg(F.count("*").alias("total"), F.count_if(matches).alias("matched"))
    return first_rows(rows.where(matches), order, limit, offset).crossJoin(F.broadcast(totals))


def ordered_changes(changes: DataFrame, field: str, group: str | None = None, limit: int | None = None) -> DataFrame:
    """The changed cells of a field, of one group of changes if named, in order of url."""
    rows = changes.where(F.col("field") == field)
    return first_rows(rows if group is None else rows.where(F.col("change") == group), ["url", "snapshot_id"], limit)


def sheet_category(leaf_hosts: list[str], levels: tuple[str, str, str] = ("category_1", "category_2", "category_3"), host: str = "domain") -> Column:
    """The category whose sheet a record goes to: the deepest that is filled for hosts whose lists end
    at the category, the first for the others; null if it is empty."""
    one, two, three = (F.nullif(F.col(c), F.lit("")) for c in levels)
    return F.when(F.col(host).isin(leaf_hosts) if leaf_hosts else F.lit(False), F.coalesce(three, two, one)).otherwise(one)


def excluded_branch(rows: DataFrame, branches: DataFrame, levels: list[str], domain: str = "domain") -> DataFrame:
    """``rows`` with ``branch``: the first of their levels that is in the list of branches of their own
    domain that hold no products, null if none is. Lists are gathered per domain."""
    lists = branches.where("branch is not null").groupBy(domain).agg(F.collect_set("branch").alias("_list"))
    hit = F.coalesce(*[F.when(F.array_contains("_list", F.col(c)), F.col(c)) for c in levels])
    return rows.join(lists, domain, "left").withColumn("branch", hit).drop("_list")


def sizes_in_order(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, n, first): groups and their sizes, in order of their first row; the rows without a group last."""
    sizes = rows.groupBy(F.nullif(F.col(group), F.lit("")).alias(group)).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return sizes.orderBy(F.col(group).isNull(), "first")


def file_name(keyword: str, suffix: str = ".xlsx") -> str:
    """The name of a keyword's output file: its normalised words joined by dashes."""
    return (normalise_text(keyword).replace(" ", "-").replace("/", "-") or "ket-qua") + suffix
