"""Profiles of extracted records: how full, how grounded, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import normalise, squeeze

#: Fields a complete record has.
REQUIRED = ("product_id", "ten_san_pham", "category_1", "link_anh_san_pham", "link_mua_hang_online", "thong_so_ky_thuat", "tom_tat_tskt")


def filled(c: Column) -> Column:
    """True for a value that is neither null nor the empty text."""
    return c.isNotNull() & (c.cast("string") != "")


def fill_rates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_rows, n_filled, rate) of every field, in one pass over the rows."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(filled(F.col(f))).alias(f"f_{i}") for i, f in enumerate(fields)])
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f_{i}").alias("n_filled")) for i, f in enumerate(fields)]))
    return counts.select("n", cells).select("field", F.col("n").alias("n_rows"), "n_filled", F.when(F.col("n") > 0, F.col("n_filled") / F.col("n")).alias("rate"))


def missing_fields(fields: tuple[str, ...] = REQUIRED) -> Column:
    """The names of the fields a row lacks, in order."""
    return F.array_compact(F.array(*[F.when(~filled(F.col(f)), F.lit(f)) for f in fields]))


def missing_reasons(rows: DataFrame, fields: tuple[str, ...] = REQUIRED, top: int = 10) -> DataFrame:
    """The ``top`` most frequent sets of missing fields."""
    return rows.select(F.array_join(missing_fields(fields), ",").alias("missing")).where("missing != ''").groupBy("missing").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "missing").limit(top)


def tag_stats(extractions: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: extractions, those with tags, and mean, least and greatest number of tags of those."""
    per = tags.where("extraction_id is not null").groupBy("extraction_id").agg(F.count("*").alias("n"))
    joined = extractions.select("id").join(per, F.col("id") == F.col("extraction_id"), "left")
    return joined.agg(F.count("*").alias("extractions"), F.count("n").alias("with_tags"), F.avg("n").alias("mean_tags"), F.min("n").alias("min_tags"), F.max("n").alias("max_tags"))


def top_keys(tags: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` most frequent tag keys, letter case and accents aside."""
    return tags.groupBy(normalise(F.col("key")).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)


def grounding(extractions: DataFrame, tags: DataFrame, sources: list[str]) -> DataFrame:
    """(values, grounded, rate): tag values all of whose parts stand in the record's own texts.

    Parts are what commas, slashes, semicolons and brackets separate; white space and letter
    case don't count. Values of records without any text aren't judged."""
    text = squeeze(F.concat_ws("\n", *sources))
    source = extractions.select(F.col("id").alias("extraction_id"), text.alias("_s")).where("_s != ''")
    values = tags.where("value is not null and trim(value) != ''").select("extraction_id", "value")
    joined = values.join(source, "extraction_id")
    parts = F.filter(F.transform(F.split("value", r"[/,;()]+"), squeeze), lambda p: p != "")
    ok = F.forall(parts, lambda p: F.contains(F.col("_s"), p))
    return joined.agg(F.count("*").alias("values"), F.count_if(ok).alias("grounded")).withColumn("rate", F.when(F.col("values") > 0, F.col("grounded") / F.col("values")))


def run_tuning(runs: DataFrame, max_fail: float = 0.05, tag_share: float = 0.95) -> DataFrame:
    """Per number of workers: seconds per page, share of failures, mean tags, and the recommendation.

    Recommended is the fastest whose failures are at most ``max_fail`` and whose tags reach
    ``tag_share`` of the best. ``runs`` has workers, seconds, failed and tags per page."""
    per = runs.groupBy("workers").agg(F.avg("seconds").alias("seconds"), F.avg(F.col("failed").cast("int")).alias("fail_rate"), F.avg("tags").alias("tags"))
    best = per.agg(F.max("tags").alias("_best"))
    marked = per.crossJoin(F.broadcast(best)).withColumn("_ok", (F.col("fail_rate") <= max_fail) & (F.col("tags") >= tag_share * F.col("_best")))
    fastest = marked.where("_ok").agg(F.min(F.struct("seconds", "workers")).alias("_f"))
    return marked.crossJoin(F.broadcast(fastest)).select("workers", "seconds", "fail_rate", "tags", F.coalesce(F.col("workers") == F.col("_f.workers"), F.lit(False)).alias("recommended"))


def audit(records: DataFrame, independent: DataFrame, fields: list[str]) -> DataFrame:
    """(field, verdict, n) of blank cells, held against a second extraction of the same urls:
    confirmed blank, or missed."""
    other = independent.select("url", *[F.col(f).alias(f"o_{f}") for f in fields])
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), filled(F.col(f)).alias("has"), filled(F.col(f"o_{f}")).alias("other")) for f in fields]))
    blank = records.join(other, "url").select(cells).where("not has")
    return blank.groupBy("field", F.when(F.col("other"), F.lit("missed")).otherwise(F.lit("confirmed")).alias("verdict")).agg(F.count("*").alias("n"))


def popular_names(names: DataFrame, brands: list[str], least: int = 8, top: int = 6) -> DataFrame:
    """The ``top`` most frequent category names once brands are taken out; names of fewer than
    ``least`` characters are left aside."""
    c = normalise(F.col("name"))
    for b in sorted(brands, key=len, reverse=True):
        c = F.replace(c, F.lit(b), F.lit(""))
    c = F.trim(F.regexp_replace(c, " +", " "))
    return names.select(c.alias("name")).where(F.length("name") >= least).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
