"""Registered sites as a dimension table: lookups with a default, projections, and who has data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import urls as U
from lodeweave.session import small


def bare_host(url_or_domain: Column) -> Column:
    """The domain of a URL or of a bare domain, in small letters, without www."""
    host = F.when(F.contains(url_or_domain, F.lit("://")), U.host(url_or_domain)).otherwise(F.regexp_extract(url_or_domain, "^[^/?#]*", 0))
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def with_setting(rows: DataFrame, registry: DataFrame, setting: str, *, domain: str = "domain", default: Column | None = None) -> DataFrame:
    """``rows`` with the registered ``setting`` of their domain or url; ``default`` where none is
    registered or it is null. Of several entries of a domain the greatest counts."""
    table = registry.where(F.col(domain).isNotNull()).groupBy(bare_host(F.col(domain)).alias("_host")).agg(F.max(setting).alias("_setting"))
    keyed = rows.withColumn("_host", bare_host(F.col(domain)))
    return keyed.join(small(table), "_host", "left").withColumn(setting, F.coalesce("_setting", F.lit(None) if default is None else default)).drop("_host", "_setting")


def brand_of(rows: DataFrame, registry: DataFrame, brand: str = "brand", domain: str = "domain") -> DataFrame:
    """``rows`` with the brand registered for their domain, or the domain itself."""
    return with_setting(rows, registry, brand, domain=domain, default=bare_host(F.col(domain)))


def options_of(settings: list[str]) -> Column:
    """The settings that aren't null, by name: what a reader of the site is given."""
    entries = F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).cast("string").alias("value")) for s in settings])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def has_any(domains: DataFrame, rows: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, has): whether ``rows`` has any row of each domain."""
    some = rows.where(F.col(domain).isNotNull()).select(F.col(domain).alias("_d")).distinct()
    return domains.select(domain).distinct().join(some, F.col(domain) == F.col("_d"), "left").select(domain, F.col("_d").isNotNull().alias("has"))


def domain_table(registered: DataFrame, rows: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, registered, products, place): registered domains in order of name, then those that
    only have data. There is one row per domain, so the numbering runs over few rows."""
    from pyspark.sql.window import Window

    counts = rows.where(F.col(domain).isNotNull()).groupBy(domain).agg(F.count("*").alias("products"))
    known = registered.select(domain).distinct().withColumn("_known", F.lit(True))
    both = known.join(counts, domain, "full").select(domain, F.coalesce("_known", F.lit(False)).alias("registered"), F.coalesce("products", F.lit(0)).alias("products"))
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc("registered"), domain)))
