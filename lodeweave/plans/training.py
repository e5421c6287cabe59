"""Queries of the core's data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import quantities, snapshots, widetable
from lodeweave.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "tag_columns")
    return widetable.narrow(widetable.widen(table(spark, sf, "product_tags"), columns), columns)


def p1_wide(spark: SparkSession, sf: str) -> DataFrame:
    return widetable.widen(table(spark, sf, "product_tags"), table(spark, sf, "tag_columns"), table(spark, sf, "extractions").withColumnRenamed("id", "extraction_id"))


def _p3(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities of the pages' histories in order of fetch, for rows without page of extraction."""
    said = cut(quantities.stated(table(spark, sf, "extractions"), keep=("snapshot_id", "extracted_at")))
    # Ids are positive, so a row without page finds none, and such rows don't meet in one task.
    page = F.coalesce("snapshot_id", -1 - F.col("id"))
    fetched = table(spark, sf, "page_snapshots").select(F.col("id").alias("_page"), "fetched_at")
    timed = said.withColumn("_page", page).join(fetched, "_page", "left")
    return quantities.named(quantities.common_units(cut(timed), F.coalesce("fetched_at", "extracted_at")), "extraction_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p3(spark, sf).drop("how")


def p3_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """How many numbers had their unit settled in which way, per quantity."""
    return _p3(spark, sf).groupBy("quantity", "how").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.price_changes(table(spark, sf, "page_snapshots"), table(spark, sf, "extractions"), table(spark, sf, "crawl_rounds"))


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p3_found": p3_found, "p3_evidence": p3_evidence, "p6_found": p6_found}

_FOLD = "regexp_replace(replace(lower(strip_accents({})), 'đ', 'd'), '[^a-z0-9]+', '', 'g')"
_P1_CELLS = f"""
with a as (select {_FOLD.format("alias")} k, attr, value_type, unit from tag_columns),
t as (
  select p.extraction_id, p.ord, a.attr, a.value_type, p.value v, {_FOLD.format("p.value")} f,
         regexp_extract(p.value, '[0-9]+([.,][0-9]+)*') n
  from product_tags p join a on {_FOLD.format("p.key")} = a.k where p.value is not null and p.extraction_id is not null),
n as (
  select *,
    try_cast(case when regexp_matches(n, '^[1-9][0-9]{{0,2}}[.,][0-9]{{3}}$') and attr <> 'trong_luong' then regexp_replace(n, '[.,]', '', 'g')
                  else replace(n, ',', '.') end as decimal(24,6)) num,
    case when regexp_matches(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(regexp_extract(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as date)
         else try_cast(regexp_extract(v, '([0-9]{{1,2}})[^0-9]+([0-9]{{1,2}})[^0-9]+([0-9]{{4}})', 3) || '-' || lpad(regexp_extract(v, '([0-9]{{1,2}})[^0-9]+([0-9]{{1,2}})[^0-9]+([0-9]{{4}})', 2), 2, '0')
              || '-' || lpad(regexp_extract(v, '([0-9]{{1,2}})[^0-9]+([0-9]{{1,2}})[^0-9]+([0-9]{{4}})', 1), 2, '0') as date) end d
  from t),
r as (
  select extraction_id, attr, ord,
    case value_type
      when 'decimal' then regexp_replace(regexp_replace(num::varchar, '0+$', ''), '[.]$', '')
      when 'integer' then num::bigint::varchar
      when 'integer_list' then nullif(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(v, '([0-9]{{1,3}}([.,][0-9]{{3}})+|[0-9]+)'), lambda x: regexp_replace(x, '[.,]', '', 'g')::bigint))), '|'), '')
      when 'boolean' then case when trim(v) = '✓' or f in ('co', 'yes', 'true', '1', 'x') then 'true' when f in ('khong', 'no', 'false', '0') then 'false' end
      when 'date' then d::varchar
      else case when f not in ('', 'na', 'null', 'khongro', 'lienhe', 'theoyeucau', 'dangcapnhat') then trim(regexp_replace(v, '\\s+', ' ', 'g')) end
    end val
  from n),
c as (select extraction_id, attr, max_by(val, (ord, val)) val from r where val is not null group by all)
"""
ORACLE = {
    "p1_found": _P1_CELLS + "select extraction_id, attr, val from c",
    "p6_found": """
with f as (
  select s.domain, s.url, r.round_no, max_by(s.id, (s.fetched_at, s.id)) sid
  from page_snapshots s join crawl_rounds r on s.domain = r.domain and s.fetched_at >= r.opened_at and s.fetched_at < r.closed_at
  where s.http_status = 200 group by all),
e as (select snapshot_id sid, max_by(gia, id) gia from extractions where snapshot_id is not null group by 1),
g as (select f.domain, f.url, f.round_no, e.gia.kind k, e.gia.amount a from f left join e using (sid)),
n as (select domain, round_no, lag(round_no) over (partition by domain order by round_no) p from crawl_rounds),
now as (select g.*, n.p from g join n using (domain, round_no) where n.p is not null),
was as (select g.*, n.round_no nxt from g join n on g.domain = n.domain and g.round_no = n.p)
select coalesce(now.domain, was.domain) as domain, coalesce(now.round_no, was.nxt) as round_no, coalesce(now.url, was.url) as url,
  case when was.url is null then 'added' when now.url is null then 'removed' else 'changed' end as change
from now full outer join was on now.domain = was.domain and now.url = was.url and now.round_no = was.nxt
where was.url is null or now.url is null or now.k is distinct from was.k or now.a is distinct from was.a""",
}
