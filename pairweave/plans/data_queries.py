"""Registered queries over raw records and skewed keys, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.operators.skew import heavy_keys, key_profile
from pairweave.sources.raw_records import parse_records
from pairweave.sources.tables import table

#: The header of the pair files.
PAIR_COLUMNS = ("idx1", "idx2", "id1", "id2", "tani", "gani", "ani", "cov", "num_alns", "len_ratio")


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "toy_raw", "line_id", "file_name", "line_no", "raw_line").filter(~F.coalesce(F.col("line_no") == 1, F.lit(False)))
    delimiter = F.when(F.lower("file_name").endswith(".csv"), F.lit(",")).otherwise(F.lit("\t"))
    return parse_records(lines, ["line_id"], "raw_line", delimiter, PAIR_COLUMNS, ["ani", "cov"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that fail, with the first reason that applies."""
    return _parsed(spark, folder).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that load, as typed rows. Fields that aren't judged become null where their text has no such value."""
    good = _parsed(spark, folder).filter(F.col("reason").isNull())
    kinds = {"idx1": "bigint", "idx2": "bigint", "num_alns": "bigint", "id1": "string", "id2": "string"}
    return good.select("line_id", *[F.trim(c).try_cast(kinds.get(c, "double")).alias(c) for c in PAIR_COLUMNS])


def p5_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines fail for which reason, and how far into the line they break on average."""
    bad = _parsed(spark, folder).filter(F.col("reason").isNotNull())
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg(F.when(F.col("at") >= 0, F.col("at"))), 3).alias("mean_offset"))


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return key_profile(table(spark, folder, "toy_ani", "row_id", "id1", "id2", "ani"), "id1", "id2", "ani", "row_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Objects that stand in id1 of at least 2 percent of all rows."""
    return heavy_keys(_profile(spark, folder), 0.02)


def p7_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct partners and best partner of every object in id1."""
    return _profile(spark, folder).filter("object is not null")


QUERIES = {"p5_found": p5_found, "p5_rows": p5_rows, "p5_offsets": p5_offsets, "p7_found": p7_found, "p7_profile": p7_profile}

_LINES = r"""
with lines as (
  select line_id, case when lower(file_name) like '%.csv' then ',' else chr(9) end as sep,
         regexp_replace(coalesce(raw_line, ''), '\r?\n?$', '') as raw
  from toy_raw where line_no is distinct from 1
), shaped as (
  select line_id, raw, sep,
    case when sep = ',' then regexp_full_match(raw, '(?s)(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)(?:,(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*))*')
         else regexp_full_match(raw, '(?s)(?: *"(?:[^"]|"")*" *|[^"\t]*)(?:\t(?: *"(?:[^"]|"")*" *|[^"\t]*))*') end as well
  from lines
), cut as (
  select line_id, well,
    case when sep = ',' then regexp_extract_all(raw || ',', '(?s)((?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)),', 1)
         else regexp_extract_all(raw || chr(9), '(?s)((?: *"(?:[^"]|"")*" *|[^"\t]*))\t', 1) end as f
  from shaped
), valued as (
  select line_id, well, len(f) as n, list_transform(f, lambda x: case when regexp_full_match(trim(x, ' ' || chr(9)), '(?s)".*"')
    then replace(trim(x, ' ' || chr(9))[2:-2], '""', '"') else trim(x, ' ' || chr(9)) end) as v
  from cut
), judged as (
  select line_id, v, case when not well then 'quoting' when n <> 10 then 'columns'
    when not coalesce(regexp_full_match(trim(v[7], ' ' || chr(9)), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(trim(v[7], ' ' || chr(9)) as double) between 0 and 1
      and regexp_full_match(trim(v[8], ' ' || chr(9)), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(trim(v[8], ' ' || chr(9)) as double) between 0 and 1, false) then 'value' end as reason
  from valued
)
"""

ORACLE = {
    "p5_found": _LINES + "select line_id, reason from judged where reason is not null",
    "p5_rows": _LINES
    + """select line_id, try_cast(trim(v[1]) as bigint) as idx1, try_cast(trim(v[2]) as bigint) as idx2, trim(v[3]) as id1, trim(v[4]) as id2,
  try_cast(trim(v[5]) as double) as tani, try_cast(trim(v[6]) as double) as gani, try_cast(trim(v[7]) as double) as ani, try_cast(trim(v[8]) as double) as cov,
  try_cast(trim(v[9]) as bigint) as num_alns, try_cast(trim(v[10]) as double) as len_ratio from judged where reason is null""",
    # a line breaks where the longest beginning that could still go on ends
    "p5_offsets": _LINES
    + r""", ends as (select line_id, strlen(case when sep = ','
    then regexp_extract(raw, '^(?s)(?:(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*),)*(?:[ \t]*"(?:[^"]|"")*(?:"[ \t]*)?|[^",]*)')
    else regexp_extract(raw, '^(?s)(?:(?: *"(?:[^"]|"")*" *|[^"\t]*)\t)*(?: *"(?:[^"]|"")*(?:" *)?|[^"\t]*)') end) as broken from shaped
), fine as (select line_id, coalesce(regexp_full_match(trim(v[7], ' ' || chr(9)), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(trim(v[7], ' ' || chr(9)) as double) between 0 and 1, false) as ani from valued
), places as (select reason, case reason when 'quoting' then broken when 'value' then strlen(array_to_string(f[1:case when ani then 7 else 6 end], '.')) + 1 end as broke
  from judged join ends using (line_id) join fine using (line_id) join cut using (line_id) where reason is not null)
select reason, count(*) as n_lines, round(avg(broke), 3) as mean_offset from places group by 1""",
    "p7_found": "select id1 as object from toy_ani where id1 is not null group by 1 having count(*) >= 0.02 * (select count(*) from toy_ani)",
    "p7_profile": """
with good as (select id1, id2, max(ani) as ani from toy_ani where not isnan(ani) and ani between 0 and 1 and id1 <> id2 group by 1, 2),
     top as (select id1, max(ani) as best, arg_min(id2, (-ani, id2)) as best_partner from good group by 1)
select t.id1 as object, count(*) as n_rows, count(distinct t.id2) as n_partners, max(top.best) as best, max(top.best_partner) as best_partner
from toy_ani t left join top on top.id1 = t.id1 where t.id1 is not null group by 1""",
}
