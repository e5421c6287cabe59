"""Records in and out: workbooks merged into the store, plans written as workbooks, page texts as files."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.operators import export
from lodeweave.session import cut
from lodeweave.sources import xlsx

#: Version that marks rows from workbooks.
IMPORTED = "imported-xlsx"


#: Name of the sheet of rows to look at; it repeats rows of other sheets and is no source of records.
REVIEW_SHEET = "Cần xem lại"


def import_workbook(spark: SparkSession, path: str, columns: list[str], key: str, skip: str = REVIEW_SHEET) -> DataFrame:
    """Rows of all sheets by header name; of rows with an equal key the last one, by sheet and row, stays.

    The sheet ``skip`` is left out. Rows have no snapshot and the version IMPORTED. Rows without a key are left out."""
    xlsx.register(spark)
    schema = ", ".join(["sheet string", "row_no int", *[f"`{c}` string" for c in columns]])
    rows = spark.read.format("xlsx").option("skip", skip).schema(schema).load(path).withColumn("_at", F.monotonically_increasing_id()).where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "")
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_at").alias("_at"))
    return rows.join(last.select("_at"), "_at", "left_semi").select(*columns, F.lit(None).cast("long").alias("snapshot_id"), F.lit(IMPORTED).alias("extractor_version"))


def write_plan(rows: DataFrame, group: str, order: list[str], columns: list[str], path: str, ranks: DataFrame | None = None, review: DataFrame | None = None) -> int:
    """One workbook of the rows, a sheet per group, numbered within each; the sheet of rows to look
    at comes last. Rows stream through the driver sheet by sheet; returns the number of sheets."""
    names = export.distinct_names(export.sheet_order(rows, group, ranks)).orderBy("place").collect()
    # The plan is read once per sheet, so it is computed once.
    plan = cut(export.export_plan(rows, group, order, ranks))
    header = ["STT", *columns]

    def lines(place: int):
        mine = plan.where(F.col("sheet_no") == place).orderBy("row_no").select("row_no", *[export.fit_cell(F.col(c).cast("string")).alias(c) for c in columns])
        for r in mine.toLocalIterator():
            yield list(r)

    sheets = [(r.sheet, header, lines(r.place)) for r in names]
    if review is not None:
        sheets.append((REVIEW_SHEET, [*columns, "reason"], (list(r) for r in review.select(*[F.col(c).cast("string") for c in columns], "reason").toLocalIterator())))
    xlsx.write_workbook(path, sheets or [("Sheet1", header, iter(()))])
    return len(sheets)


def select_records(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Records of the chosen (domain, url)."""
    return rows.join(selection.select("domain", "url").distinct(), ["domain", "url"], "left_semi")


def write_texts(rows: DataFrame, path: str, text: Column, limit: int = 30_000) -> None:
    """Page texts under a folder per domain, cut at ``limit`` characters with a mark."""
    from lodeweave.functions.text import shorten

    rows.select("domain", shorten(text, limit, "\n[…]").alias("value")).write.mode("overwrite").partitionBy("domain").text(path)


@F.pandas_udf(T.StringType())
def inflate(blobs: pd.Series) -> pd.Series:
    """Text of zlib-compressed blobs from other stores; null for null and for broken ones."""

    def one(b):
        try:
            return None if b is None else zlib.decompress(b).decode("utf-8", "replace")
        except zlib.error:
            return None

    return blobs.map(one)


def tags_json(tags: Column) -> Column:
    """Ordered entries of (ord, key, value) as a JSON object, null if there are none. Of a key that is
    stated more than once the value of the highest ord counts; entries without a key are left out."""
    entries = F.filter(F.array_sort(tags), lambda t: t["key"].isNotNull())
    later = lambda t, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda u: u["key"] == t["key"])
    last = F.filter(entries, lambda t, i: ~later(t, i))
    return F.when(F.size(tags) > 0, F.to_json(F.map_from_entries(F.transform(last, lambda t: F.struct(t["key"], t["value"])))))
