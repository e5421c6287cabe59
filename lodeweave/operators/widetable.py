"""Entity-attribute-value rows into one typed row per entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.plain import fold_key_text
from lodeweave.functions.text import NUMBER, collapse_spaces, fold_key, plain_number
from lodeweave.session import local_rows, spread

#: Most rows of a column specification; it decides the plan's columns, so it is read on the driver.
MAX_SPEC_ROWS = 10_000

# Folded texts that state nothing.
NOTHING = ("", "na", "null", "none", "nan", "khongro", "chuaro", "lienhe", "theoyeucau", "dangcapnhat", "chuacapnhat", "capnhat", "khongxacdinh", "unknown", "updating", "contact", "onrequest", "tbd")
# Texts that say yes and no, folded, and the signs for them.
YES = ("co", "yes", "true", "1", "x", "y", "on", "dung")
NO = ("khong", "no", "false", "0", "n", "off", "ko", "khongco", "sai")
YES_SIGNS = ("✓", "✔", "☑", "√")
NO_SIGNS = ("✗", "✘", "☒", "×")

# For a column's unit, patterns of other units in the value and the factor to the column's unit.
OTHER_UNITS = {
    "W": [(r"(?i)\d\s*(kw|kilowatt)", "1000"), (r"\d\s*mW", "0.001")],
    "kg": [(r"(?i)\d\s*(g|gr|gram|grams|gam)\b", "0.001"), (r"(?i)\d\s*(tấn)\b", "1000")],
    "month": [(r"(?i)\d\s*(năm|nam|years?|yrs?)\b", "12")],
    "lm": [(r"(?i)\d\s*(klm|kilolumen)", "1000")],
    "h": [(r"(?i)\d\s*(k|ngàn|nghìn|ngan|nghin)\b", "1000")],
    "K": [],
    "degree": [],
}


@dataclass(frozen=True)
class WideColumn:
    """A column of the wide table: its place, type and unit."""

    pos: int
    attr: str
    value_type: str
    unit: str | None


SQL_TYPES = {"decimal": "decimal(24,6)", "integer": "bigint", "integer_list": "array<bigint>", "boolean": "boolean", "date": "date", "text": "string"}


def read_spec(columns: DataFrame) -> tuple[list[WideColumn], dict[str, int]]:
    """The wide table's columns in order of name, and the place of each folded alias.

    Raises ValueError beyond MAX_SPEC_ROWS rows, for an unknown type and for an alias of two columns."""
    rows = columns.select("attr", "alias", "value_type", "unit").limit(MAX_SPEC_ROWS + 1).collect()
    if len(rows) > MAX_SPEC_ROWS:
        raise ValueError(f"a column specification has at most {MAX_SPEC_ROWS} rows")
    kinds = {r.attr: (r.value_type, r.unit) for r in rows if r.attr is not None}
    spec = [WideColumn(i, a, *kinds[a]) for i, a in enumerate(sorted(kinds))]
    for c in spec:
        if c.value_type not in SQL_TYPES:
            raise ValueError(f"unknown type {c.value_type} of {c.attr}")
    place = {c.attr: c.pos for c in spec}
    aliases: dict[str, int] = {}
    for r in rows:
        k = fold_key_text(r.alias)
        if k and r.attr and aliases.setdefault(k, place[r.attr]) != place[r.attr]:
            raise ValueError(f"two columns go by {k}")
    return spec, aliases


def _plain(number: Column) -> Column:
    """A decimal as text without closing zeros."""
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


#: Day, month and year in the order of the source, or year first.
_DMY = r"(\d{1,2})\s*(?:[-/.]|tháng|thang)\s*(\d{1,2})\s*(?:[-/.]|năm|nam)\s*(\d{4})"
_YMD = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_LIST_ITEM = r"(\d{1,3}(?:[.,]\d{3})+|\d+)"


def _with_readable(rows: DataFrame, spec: list[WideColumn]) -> DataFrame:
    """Add ``val``: the value as text that casts to its column's type, null where it can't be
    read or states nothing. Steps that are used more than once are columns of their own, so
    that each is computed once."""
    at = lambda *kinds: F.col("pos").isin([c.pos for c in spec if c.value_type in kinds] or [-1])
    numeric = at("decimal", "integer")
    factor = F.lit(None).cast("decimal(12,6)")
    for unit, others in OTHER_UNITS.items():
        places = [c.pos for c in spec if c.unit == unit and c.value_type in ("decimal", "integer")]
        for pattern, times in others if places else []:
            factor = F.when(F.col("pos").isin(places) & F.rlike("_v", F.lit(pattern)), F.lit(times).cast("decimal(12,6)")).otherwise(factor)
    # In kilograms, and where a larger unit is named, three digits after a separator are decimals.
    kilo = F.col("pos").isin([c.pos for c in spec if c.unit == "kg"] or [-1])
    rows = rows.withColumns(
        {
            "_raw": F.when(numeric, F.regexp_extract("_v", NUMBER, 1)),
            "_factor": factor,
            "_f": F.when(at("boolean", "text"), fold_key(F.col("_v"))),
            "_items": F.when(at("integer_list"), F.regexp_extract_all("_v", F.lit(_LIST_ITEM), F.lit(1))),
            "_date": F.when(at("date"), F.regexp_replace(F.regexp_replace("_v", f"^.*?{_DMY}.*$", "$3-$2-$1"), f"^.*?{_YMD}.*$", "$1-$2-$3")),
        }
    )
    thousands = F.when(F.col("_factor").isNotNull(), F.col("_factor") < 1).otherwise(~kilo)
    rows = rows.withColumn("_num", (plain_number(F.col("_raw"), thousands).try_cast("decimal(24,6)") * F.coalesce("_factor", F.lit(1).cast("decimal(12,6)"))).cast("decimal(24,6)"))
    whole = F.col("_num") == F.floor("_num")
    numbers = F.filter(F.transform("_items", lambda x: F.regexp_replace(x, "[.,]", "").try_cast("bigint")), lambda x: x.isNotNull())
    sign = F.trim("_v")
    val = (
        F.when(numeric & (at("decimal") | whole), _plain(F.col("_num")))
        .when(at("integer_list"), F.nullif(F.array_join(F.array_sort(F.array_distinct(numbers)).cast("array<string>"), "|"), F.lit("")))
        .when(at("boolean") & (sign.isin(*YES_SIGNS) | F.col("_f").isin(*YES)), F.lit("true"))
        .when(at("boolean") & (sign.isin(*NO_SIGNS) | F.col("_f").isin(*NO)), F.lit("false"))
        .when(at("date"), F.col("_date").try_cast("date").cast("string"))
        .when(at("text") & ~F.col("_f").isin(*NOTHING), collapse_spaces(F.col("_v")))
    )
    return rows.withColumn("val", val)


def _from_text(text: Column, kind: str) -> Column:
    if kind == "integer_list":
        return F.transform(F.split(text, r"\|"), lambda x: x.try_cast("bigint"))
    return text.try_cast(SQL_TYPES[kind])


def entity_cells(tags: DataFrame, columns: DataFrame, *, entity: str = "extraction_id", key: str = "key", value: str = "value", order: str = "ord") -> tuple[DataFrame, list[WideColumn]]:
    """(entity, pos, val): the readable value of highest order per entity and attribute, val as text;
    and once per entity that has rows without a readable value, pos -1 and val null.

    ``tags`` is a table scan, which is read once. Values meet by entity and attribute with
    partial maxima before the shuffle, so an entity of very many rows makes no large group."""
    spec, aliases = read_spec(columns)
    lookup = local_rows(tags.sparkSession, list(aliases.items()), "_k string,pos int")
    rows = spread(tags).select(F.col(entity).alias("entity"), F.col(order).alias("_ord"), F.col(value).alias("_v"), F.coalesce(fold_key(F.col(key)), F.lit("")).alias("_k")).where("entity is not null")
    # read_spec has bounded the lookup by MAX_SPEC_ROWS. A key is never null here, so that no
    # filter on it repeats the folding.
    keyed = rows.join(F.broadcast(lookup), "_k", "left")
    read = _with_readable(keyed, spec).select("entity", F.when(F.col("val").isNotNull(), F.col("pos")).otherwise(-1).alias("pos"), F.coalesce(F.col("_ord").cast("bigint"), F.lit(-(2**62))).alias("_ord"), "val")
    return read.groupBy("entity", "pos").agg(F.max_by("val", F.when(F.col("val").isNotNull(), F.struct("_ord", "val"))).alias("val")), spec


def widen(tags: DataFrame, columns: DataFrame, entities: DataFrame | None = None, *, entity: str = "extraction_id", key: str = "key", value: str = "value", order: str = "ord") -> DataFrame:
    """One row per entity with the typed columns of ``columns`` (attr, alias, value_type, unit).

    The values of an entity, at most one per attribute, are brought together; there its row of
    the entity-by-attribute grid is completed with every attribute's position, and the values
    are left joined to it by position. What results is an array with one cell per attribute,
    sorted by position, whose fixed places are projected through casts of the column's type.
    As the grid is joined entity by entity, neither it nor the join is shuffled.

    Keys are matched without regard to case, accents, signs and spaces; keys outside the
    specification are left aside. Of several values of an attribute the readable one of
    the highest order counts; with equal order the greatest text. Null entities and null
    values are left out; an entity without any readable value keeps a row of nulls. With
    ``entities`` (the column ``entity``) the rows are those entities, with or without tags,
    and no others. Other columns of ``tags`` are ignored. An empty table gives an empty table."""
    cells, spec = entity_cells(tags, columns, entity=entity, key=key, value=value, order=order)
    lists = cells.groupBy("entity").agg(F.collect_list(F.struct("pos", "val")).alias("values"))
    if entities is not None:
        who = entities.select(F.col(entity).alias("entity")).where("entity is not null").distinct()
        lists = who.join(lists, "entity", "left")
    grid = F.sequence(F.lit(0), F.lit(len(spec) - 1)) if spec else F.array().cast("array<int>")
    values = F.map_from_entries(F.filter(F.coalesce("values", F.array().cast("array<struct<pos:int,val:string>>")), lambda x: x["pos"] >= 0))
    joined = F.transform(grid, lambda p: F.struct(p.alias("pos"), F.element_at("values", p).alias("val")))
    rows = lists.withColumn("values", values).select("entity", F.sort_array(joined).alias("cells"))
    return rows.select(F.col("entity").alias(entity), *[_from_text(F.get(F.col("cells"), F.lit(c.pos))["val"], c.value_type).alias(c.attr) for c in spec])


def cell_text(c: Column, kind: str) -> Column:
    """The text form of a typed cell."""
    if kind == "integer_list":
        return F.array_join(c.cast("array<string>"), "|")
    return _plain(c) if kind == "decimal" else c.cast("string")


def narrow(wide: DataFrame, columns: DataFrame, entity: str = "extraction_id") -> DataFrame:
    """(entity, attr, val) of the filled cells of a wide table."""
    spec, _ = read_spec(columns)
    cells = F.array(*[F.struct(F.lit(c.attr).alias("attr"), cell_text(F.col(c.attr), c.value_type).alias("val")) for c in spec])
    return wide.select(F.col(entity), F.inline(cells)).where("val is not null")
