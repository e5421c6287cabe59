"""Plans of workbooks: which row goes to which sheet, at which place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.functions.text import shorten
from lodeweave.session import small

#: Most sheets of a workbook; their names are settled on the driver.
MAX_SHEETS = 10_000
# Limits and signs of the workbook format.
CELL_LIMIT, CELL_KEPT, SHEET_LIMIT = 32_767, 32_000, 31
UNGROUPED = "Chưa phân loại"


def fit_cell(c: Column, notice: str = " […]") -> Column:
    """A text over the limit of a cell, cut, with a notice."""
    return F.when(F.length(c) > CELL_LIMIT, shorten(c, CELL_KEPT, notice)).otherwise(c)


def short_sheet(c: Column) -> Column:
    """A sheet name: forbidden signs become dashes, the middle of a long name an ellipsis."""
    clean = F.trim(F.regexp_replace(c, r"[\[\]:*?/\\]", "-"))
    return F.when(F.length(clean) > SHEET_LIMIT, F.concat(F.left(clean, F.lit(15)), F.lit("…"), F.right(clean, F.lit(15)))).otherwise(clean)


def sheet_order(rows: DataFrame, group: str, ranks: DataFrame | None = None) -> DataFrame:
    """(group, n, place) of the groups: ranked ones in their order, then by size, then by name; the
    rows without group last."""
    counts = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))
    if ranks is not None:
        counts = counts.join(small(ranks.select(F.col(group).alias("group"), "rank")), "group", "left")
    else:
        counts = counts.withColumn("rank", F.lit(None).cast("int"))
    w = Window.orderBy(F.col("group").isNull(), F.col("rank").isNull(), "rank", F.desc("n"), "group")
    # One row per sheet, at most MAX_SHEETS of them in a usable workbook.
    return counts.select("group", "n", F.row_number().over(w).alias("place"))


def distinct_names(sheets: DataFrame) -> DataFrame:
    """(group, place, sheet): short names made distinct, letter case aside, by (2), (3) and so on.

    Settled on the driver in the order of the sheets; raises ValueError beyond MAX_SHEETS."""
    rows = sheets.withColumn("_s", short_sheet(F.coalesce("group", F.lit(UNGROUPED)))).orderBy("place").limit(MAX_SHEETS + 1).collect()
    if len(rows) > MAX_SHEETS:
        raise ValueError(f"a workbook has at most {MAX_SHEETS} sheets")
    taken: set[str] = set()
    out = []
    for r in rows:
        name, n = r["_s"] or "-", 1
        while name.lower() in taken:
            n += 1
            tail = f" ({n})"
            name = (r["_s"] or "-")[: SHEET_LIMIT - len(tail)] + tail
        taken.add(name.lower())
        out.append((r["group"], r["place"], name))
    return sheets.sparkSession.createDataFrame(out, "group string, place int, sheet string")


def export_plan(rows: DataFrame, group: str, order: list[str], ranks: DataFrame | None = None) -> DataFrame:
    """Rows with ``sheet_no`` and ``row_no``, their running number within the sheet in the given order."""
    sheets = sheet_order(rows, group, ranks).select(F.col("group").alias("_g"), F.col("place").alias("sheet_no"))
    placed = rows.join(small(sheets), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return placed.withColumn("row_no", F.row_number().over(Window.partitionBy("sheet_no").orderBy(*order)))


def review_rows(rows: DataFrame, cells: list[str], source: str) -> DataFrame:
    """Rows to look at: all of ``cells`` empty, or their source is a cluster of headings."""
    empty = F.lit(True)
    for c in cells:
        empty = empty & (F.coalesce(F.col(c), F.lit("")) == "")
    reason = F.when(empty, F.lit("no-content")).when(F.col(source) == "cluster", F.lit("from-cluster"))
    return rows.withColumn("reason", reason).where("reason is not null")
