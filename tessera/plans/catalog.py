"""Queries by name, with the SQL that gives the same rows.

A query returns the support table of a detector before its thresholds, with ``flagged``,
so that results say something on data without findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.digits import risk_rank
from tessera.operators import claims, columns, cross_sheet, pairs, profile, text
from tessera.params import ImageParams, PairParams
from tessera.sources.virtual import line_cells

PAIRS = PairParams(min_pairs=4, max_offset=8)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def _events(spark, sf_dir):
    """Event values as one column a user, in the order of time."""
    rows = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select(F.lit("events").alias("workbook"), F.col("user_id").alias("sheet"), n.alias("row"), F.lit(1).alias("col"), F.col("value").cast("decimal(18,2)").cast("string").alias("raw"), F.col("value").cast("decimal(18,2)").cast("double").alias("num"))


def _long(spark, sf_dir):
    """Lines of the orders that have two, a group a thousand order keys."""
    rows = _read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).alias("grp"), F.col("l_orderkey").alias("pair_id"), F.col("l_quantity").alias("num"), "l_linenumber", "l_extendedprice")
    rows = rows.join(rows.groupBy("pair_id").count().where("count = 2").select("pair_id"), "pair_id", "left_semi")
    n = F.row_number().over(Window.partitionBy("grp", "pair_id").orderBy("l_linenumber", "num", "l_extendedprice"))
    return pairs.long_pairs(rows.withColumn("row", n), ["grp"], LONG)


LONG = PairParams(min_pairs=2, min_support=0.5, ratio_places=1, max_offset=40)
BASE_CELLS = """
with base as (select l_suppkey as workbook, l_returnflag as sheet, l_quantity, l_extendedprice, l_discount, l_tax,
  row_number() over (partition by l_suppkey, l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate)::int as row from lineitem),
cells as (select workbook, sheet, row, 1 as col, l_quantity::decimal(18,2) as d from base union all select workbook, sheet, row, 2, l_extendedprice::decimal(18,2) from base
  union all select workbook, sheet, row, 3, l_discount::decimal(18,2) from base union all select workbook, sheet, row, 4, l_tax::decimal(18,2) from base),
c as (select workbook, sheet, row, col, d::varchar as raw, d::double as num from cells where d is not null)"""
DENSE = ", dense as (select * from (select *, count(num) over (partition by workbook, sheet, col) as n from c) where n >= 12)"
CP = ", cp as (select a.workbook, a.sheet, a.row, a.col as left_col, b.col as right_col, a.num as l, b.num as r from dense a join dense b on a.workbook = b.workbook and a.sheet = b.sheet and a.row = b.row and a.col < b.col)"
INFO = ", inf as (select workbook, sheet, col from c group by all having not (count(*) >= 4 and (count(distinct num) <= 3 or (count(*) >= 20 and count(distinct num) / count(*) <= 0.1)))), ic as (select c.* from c join inf using (workbook, sheet, col))"
EVENTS = """with ev as (select user_id as sheet, row_number() over (partition by user_id order by ts, event_id)::int as row, value::decimal(18,2) as d from events),
c as (select 'events' as workbook, sheet, row, 1 as col, d::varchar as raw, d::double as num from ev where d is not null)"""
LINES = r"with ln as (select doc_id, unnest(range(1, len(p) + 1))::int as line, unnest(p) as text from (select doc_id, string_split_regex(text, '\r?\n') as p from documents where text is not null))"
NUMS = LINES + r""", nums as (select doc_id, line, unnest(range(0, len(p)))::int as pos, unnest(p) as raw from
 (select doc_id, line, regexp_extract_all(replace(text, '%', '% '), '(?:^|[^A-Za-z0-9_.\-])([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?%?)', 1) as p from ln) where len(p) > 0)"""
LONGSQL = """with li as (select l_orderkey // 1000 as grp, l_orderkey as pair_id, l_quantity as num, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice) as row from lineitem qualify count(*) over (partition by l_orderkey) = 2),
bi as (select grp, pair_id, count(*) as n, arg_min(num, row) as first, arg_max(num, row) as second from li where num is not null group by all),
ga as (select *, count(*) over (partition by grp) as ids, count_if(n = 2) over (partition by grp) as twos from bi),
lp as (select grp, pair_id, first, second, round_even(first * 0 + second / nullif(first, 0) * 10, 0)::bigint as ratio from ga where n = 2 and ids >= 2 and twos >= 2 and twos * 4 >= ids * 3)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(BASE_CELLS + """, s as (select workbook, sheet, count(*) as n_cells, count(num) as n_numeric, count(distinct row) as n_rows from c group by all)
select workbook::varchar as workbook, sheet, sum(n_cells)::bigint as n_cells, sum(n_numeric)::bigint as n_numeric, sum(n_rows)::bigint as n_rows, grouping_id(workbook, sheet)::int as level from s group by rollup (workbook, sheet)""")
def sheet_profile_counts(spark, sf_dir):
    return profile.counts(line_cells(spark, sf_dir)).withColumn("workbook", F.col("workbook").cast("string"))


@query(BASE_CELLS + r""", t as (select sheet, col, nullif(regexp_extract(trim(raw), '(\d)(?:\.0+)?$', 1), '') as digit from c),
n as (select sheet, col, digit, count(*) as n from t where digit is not null group by all)
select *, round(sum(case when digit in ('0', '5') then n else 0 end) over (partition by sheet, col) / sum(n) over (partition by sheet, col), 6) as zero_five_rate from n""")
def terminal_digits(spark, sf_dir):
    return profile.terminal_digits(line_cells(spark, sf_dir), ["sheet", "col"])


@query(BASE_CELLS + r""", f as (select sheet, col, regexp_replace(regexp_extract(raw, '\.(\d*)', 1), '0+$', '') as x from c where contains(raw, '.')),
n as (select sheet, col, case when x = '' then '0' else x end as fraction, count(*) as n from f group by all having count(*) >= 2)
select * from (select *, row_number() over (partition by sheet, col order by n desc, fraction)::int as rank from n) where rank <= 30""")
def fractional_parts(spark, sf_dir):
    return profile.fractions(line_cells(spark, sf_dir), ["sheet", "col"])


@query(BASE_CELLS + """, n as (select workbook, sheet, col, num, count(*) as n from c group by all having count(*) >= 2)
select * from (select *, row_number() over (partition by workbook, sheet, col order by n desc, num)::int as rank from n) where rank <= 5""")
def repeated_values(spark, sf_dir):
    return profile.top_repeats(line_cells(spark, sf_dir), ["workbook", "sheet", "col"], "num", 2, 5)


@query("""with v as (select o_totalprice::decimal(18,2) as v from orders), d as (select regexp_extract(abs(v)::varchar, '[1-9]', 0) as d from v where v is not null)
select d::int as digit, count(*) as n from d where d <> '' group by 1""")
def first_digit_counts(spark, sf_dir):
    return profile.first_digits(_read(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("v")), "v")


@query("""with v as (select o_totalprice::decimal(18,2) as v from orders), u as (select v, regexp_extract(abs(v)::varchar, '[1-9]', 0)::int as d from v where abs(v) > 0 and abs(v) < 1e12),
t as (select count(*) as n, log10(max(abs(v))::double / min(abs(v))::double) as orders from u),
g as (select sum(abs(coalesce(k, 0) / n - log10(1 + 1 / i::double))) / 9 as mad from t, range(1, 10) r(i) left join (select d, count(*) as k from u group by d) on d = i)
select n, round(orders, 6) as orders, round(mad, 6) as mad, n >= 100 and round(orders, 6) >= 2 as applicable from t, g""")
def benford_orders(spark, sf_dir):
    return profile.benford(_read(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("v")), "v")


def _relation(kind: str, key: str, trivial: str) -> str:
    return f"""select *, {trivial} as trivial, 'fixed_{kind}' as category from (select workbook, sheet, left_col, right_col, k as relationship_value, support_rows from
      (select *, row_number() over (partition by workbook, sheet, left_col, right_col order by support_rows desc, first) as rn from
        (select workbook, sheet, left_col, right_col, {key} as k, count(*) as support_rows, min(row) as first from cp where {key} is not null group by all)) where rn = 1)"""


@query(BASE_CELLS + DENSE + CP + ", m as (" + _relation("difference", "round_even((l - r) * 1e6::double, 0)::bigint", "relationship_value = 0") + " union all " + _relation("ratio", "round_even(l / nullif(r, 0) * 1e6::double, 0)::bigint", "relationship_value in (0, 1000000)") + """),
o as (select workbook, sheet, left_col, right_col, count(*) as overlap_rows from cp group by all)
select workbook, sheet, left_col, right_col, category, relationship_value, support_rows, overlap_rows, round(support_rows / overlap_rows, 4) as support_rate, case when support_rows >= 100 then 'high' else 'medium' end as risk_level,
 not trivial and overlap_rows >= 12 and support_rows / overlap_rows >= 0.98 as flagged from m join o using (workbook, sheet, left_col, right_col)""")
def fixed_relationships(spark, sf_dir):
    return columns.fixed_relations(line_cells(spark, sf_dir))


FLAGSHIP = "fixed_relationships"


@query(BASE_CELLS + DENSE + CP + """, st as (select *, l = r as same, case when l = r then (trunc(l)::bigint - lag(trunc(l)::bigint) over (partition by workbook, sheet, left_col, right_col order by row) = 1)::int end as step from cp),
a as (select workbook, sheet, left_col, right_col, count(*) as overlap_rows, count_if(same)::bigint as equal_rows, avg(step) as steps from st group by all)
select workbook, sheet, left_col, right_col, overlap_rows, equal_rows, round(equal_rows / overlap_rows, 4) as support_rate,
 case when coalesce(steps, 0) >= 0.7 and equal_rows >= 8 then 'low' when equal_rows >= 100 then 'high' else 'medium' end as risk_level, overlap_rows >= 12 and equal_rows / overlap_rows >= 0.98 as flagged from a""")
def duplicate_columns(spark, sf_dir):
    return columns.duplicate_columns(line_cells(spark, sf_dir))


@query(BASE_CELLS + """, s as (select workbook, sheet, col, num, trunc(num)::bigint - lag(trunc(num)::bigint) over (partition by workbook, sheet, col order by row) as step from c),
a as (select workbook, sheet, col, count(*) as n, avg((num = floor(num))::int) as whole, coalesce(avg((step = 1)::int), 0) as ones, count(distinct num) / count(*) as u from s group by all)
select workbook, sheet, col, n >= 8 and whole >= 0.95 and (ones >= 0.7 or (u >= 0.9 and ones >= 0.85)) as index_like from a""")
def index_like_columns(spark, sf_dir):
    return columns.index_like(line_cells(spark, sf_dir))


def _rows_sql(item: str, least: int) -> str:
    return BASE_CELLS + f""", k as (select workbook, sheet, row, string_agg({item}, '|' order by col) as vector, count(*) as w from c where col <> 2 group by all)
select workbook, sheet, vector, count(*) as n_rows, min(row) as first_row, max(row) as last_row from k where w >= {least} group by all having count(*) > 1"""


KEY = r"regexp_replace(raw, '\.?0+$', '')"


@query(_rows_sql(f"col || '=' || {KEY}", 2))
def duplicate_row_vector(spark, sf_dir):
    return columns.duplicate_rows(line_cells(spark, sf_dir).where("col <> 2"), True)


@query(_rows_sql(KEY, 3))
def profile_duplicate_rows(spark, sf_dir):
    return columns.duplicate_rows(line_cells(spark, sf_dir).where("col <> 2"), False, 3)


@query(EVENTS + INFO + """, pr as (select a.sheet, a.row, o.k as offset, round_even(b.num / nullif(a.num, 0) * 1e4::double, 0)::bigint as ratio from ic a join range(1, 9) o(k) on true join ic b on a.sheet = b.sheet and b.row = a.row + o.k),
ov as (select sheet, "offset", count(*) as overlap_rows from pr group by all),
m as (select *, row_number() over (partition by sheet, "offset" order by support_rows desc, first) as rn from (select sheet, "offset", ratio, count(*) as support_rows, min(row) as first from pr where ratio is not null group by all))
select 'events' as workbook, sheet, 1 as col, "offset"::int as "offset", ratio, support_rows, overlap_rows, round(support_rows / overlap_rows, 4) as support_rate,
 case when ratio = 10000 then 'row_offset_exact_reuse' else 'row_offset_scalar_multiple' end as category, case when support_rows >= 10 and ratio <> 10000 then 'high' else 'medium' end as risk_level,
 support_rows >= 4 and support_rows / overlap_rows >= 0.95 as flagged from m join ov using (sheet, "offset") where rn = 1""")
def row_offset_scalar(spark, sf_dir):
    return pairs.row_offset_scalar(_events(spark, sf_dir), PAIRS)


@query(EVENTS + r""", q as (select *, length(regexp_extract(raw, '\.(\d+)', 1)) as places from c),
pr as (select a.sheet, o.k as offset, a.num as l, b.num as r, a.places as pl, b.places as p from q a join range(1, 9) o(k) on true join q b on a.sheet = b.sheet and b.row = a.row + o.k),
a as (select sheet, "offset", count(*) as overlap_rows, count_if(l = r) as exact, count_if(p <= 2 and pl >= 6) as rounded, count_if(r > l) as upward, count_if(l <> r) as other from pr group by all)
select 'events' as workbook, sheet, 1 as col, "offset"::int as "offset", overlap_rows, exact::bigint as exact, rounded::bigint as rounded, upward::bigint as upward, other::bigint as other,
 overlap_rows >= 4 and exact / overlap_rows >= 0.5 and rounded / overlap_rows >= 0.3 and upward / greatest(1, other) >= 0.75 as flagged from a""")
def row_offset_rounding_bias(spark, sf_dir):
    return pairs.rounding_bias(_events(spark, sf_dir), PAIRS)


@query(BASE_CELLS + INFO + """, rt as (select a.workbook, a.sheet, a.col as left_col, b.col as right_col, a.row, round_even(a.num / nullif(b.num, 0) * 1e4::double, 0)::bigint as ratio from ic a join ic b on a.workbook = b.workbook and a.sheet = b.sheet and a.row = b.row and a.col < b.col),
k as (select * from rt where ratio is not null),
a as (select x.workbook, x.sheet, x.left_col, x.right_col, o.k::int as offset, count(*) as overlap_pairs, count_if(x.ratio = y.ratio)::bigint as matched_pairs from k x join range(1, 9) o(k) on true join k y on x.workbook = y.workbook and x.sheet = y.sheet and x.left_col = y.left_col and x.right_col = y.right_col and y.row = x.row + o.k group by all)
select *, round(matched_pairs / overlap_pairs, 4) as support_rate, matched_pairs >= 4 and matched_pairs / overlap_pairs >= 0.95 as flagged from a""")
def paired_ratio_reuse(spark, sf_dir):
    return pairs.paired_ratio_reuse(line_cells(spark, sf_dir), PAIRS)


@query(LONGSQL + " select * from lp")
def long_format_pairs(spark, sf_dir):
    return _long(spark, sf_dir)


@query(LONGSQL + """, k as (select * from lp where ratio is not null), a as (select x.grp, o.k::int as offset, count(*) as overlap_groups, count_if(x.ratio = y.ratio)::bigint as matched_groups from k x join range(1, 41) o(k) on true join k y on x.grp = y.grp and y.pair_id = x.pair_id + o.k group by all)
select *, matched_groups >= 2 and matched_groups / overlap_groups >= 0.5 as flagged from a""")
def long_ratio_reuse(spark, sf_dir):
    return pairs.long_ratio_reuse(_long(spark, sf_dir), ["grp"], LONG)


#: The same detectors at all offsets up to the reference's.
FAR = PairParams(min_pairs=4, max_offset=80)
LONG_FAR = PairParams(min_pairs=2, min_support=0.5, ratio_places=1, max_offset=80)


def _far(name: str, last: int) -> str:
    return ORACLE_SQL[name].replace(f"range(1, {last + 1})", "range(1, 81)")


@query(_far("row_offset_scalar", 8))
def row_offset_scalar_80(spark, sf_dir):
    return pairs.row_offset_scalar(_events(spark, sf_dir), FAR)


@query(_far("row_offset_rounding_bias", 8))
def row_offset_rounding_bias_80(spark, sf_dir):
    return pairs.rounding_bias(_events(spark, sf_dir), FAR)


@query(_far("paired_ratio_reuse", 8))
def paired_ratio_reuse_80(spark, sf_dir):
    return pairs.paired_ratio_reuse(line_cells(spark, sf_dir), FAR)


@query(_far("long_ratio_reuse", 40))
def long_ratio_reuse_80(spark, sf_dir):
    return pairs.long_ratio_reuse(_long(spark, sf_dir), ["grp"], LONG_FAR)


@query(LONGSQL + """, k as (select * from lp where ratio is not null), t as (select grp, count(*) as n_pairs from k group by all), n as (select grp, ratio, count(*) as support_rows from k group by all)
select grp, ratio, support_rows, n_pairs, round(support_rows / n_pairs, 4) as support_rate, case when support_rows / n_pairs >= 0.5 then 'high' else 'medium' end as risk_level,
 ratio <> 10 and support_rows >= 2 and support_rows / n_pairs >= 0.2 as flagged from n join t using (grp)""")
def long_ratio_enrichment(spark, sf_dir):
    return pairs.long_ratio_enrichment(_long(spark, sf_dir), ["grp"], LONG)


@query(BASE_CELLS + DENSE + """, a as (select x.workbook, x.sheet as sheet_1, x.col as col_1, y.sheet as sheet_2, y.col as col_2, count(*) as overlap_rows, count_if(abs(x.num - y.num) < 1e-9)::bigint as equal_rows
 from (select * from c qualify count(num) over (partition by workbook, sheet, col) >= 10) x join (select * from c qualify count(num) over (partition by workbook, sheet, col) >= 10) y on x.workbook = y.workbook and x.row = y.row and x.sheet < y.sheet group by all having count(*) >= 10)
select *, round(equal_rows / overlap_rows, 4) as support_rate, equal_rows / overlap_rows >= 0.8 as flagged from a""")
def cross_sheet_duplicates(spark, sf_dir):
    return cross_sheet.cross_sheet_duplicates(line_cells(spark, sf_dir), ["workbook"])


@query(BASE_CELLS + """, g as (select workbook // 5 as case_id, * from c qualify count(num) over (partition by workbook, sheet, col) >= 10), p as (select x.case_id, x.workbook as workbook_1, x.sheet as sheet_1, x.col as col_1, y.workbook as workbook_2, y.sheet as sheet_2, y.col as col_2, count(*) as overlap_rows, count_if(abs(x.num - y.num) < 1e-9)::bigint as equal_rows
 from g x join g y on x.case_id = y.case_id and x.row = y.row and (x.workbook, x.sheet) < (y.workbook, y.sheet) group by all having count(*) >= 10)
select *, round(equal_rows / overlap_rows, 4) as support_rate, equal_rows / overlap_rows >= 0.8 as flagged from p""")
def cross_workbook_duplicates(spark, sf_dir):
    """Five workbooks are a case, in which equally named sheets meet, too."""
    cells = line_cells(spark, sf_dir).withColumn("case_id", F.floor(F.col("workbook") / 5))
    return cross_sheet.cross_sheet_duplicates(cells, ["case_id"])


@query(BASE_CELLS + f""", d as (select * from c where col <> 2),
inf as (select workbook, sheet, col from d group by all having not (count(*) >= 4 and (count(distinct num) <= 3 or (count(*) >= 20 and count(distinct num) / count(*) <= 0.1)))),
told as (select distinct workbook, sheet, row from d join inf using (workbook, sheet, col)),
v as (select workbook, sheet, row, string_agg(col || '=' || {KEY}, '|' order by col) as vector, count(*)::int as width from d semi join told using (workbook, sheet, row) group by all having count(*) >= 2)
select workbook, sheet, vector, count(*) as duplicate_row_count, any_value(width) as width, array_to_string(list(row order by row)[1:30], ',') as "rows", case when count(*) < 4 then 'medium' else 'high' end as risk_level from v group by all having count(*) > 1""")
def duplicate_row_findings(spark, sf_dir):
    return columns.duplicate_row_findings(line_cells(spark, sf_dir).where("col <> 2"), PAIRS)


@query(NUMS + r" select *, nullif(regexp_extract(raw, '(\d)[^\d]*$', 1), '') as terminal, nullif(regexp_extract(lower(raw), '\.([^e%]*)', 1), '') as fraction from nums")
def text_numbers(spark, sf_dir):
    return text.numbers(_docs(spark, sf_dir)).drop("value")


@query(NUMS + """, n as (select raw, count(*) as n from nums group by all having count(*) >= 3)
select * from (select *, row_number() over (order by n desc, raw)::int as rank from n) where rank <= 50""")
def text_duplicate_numbers(spark, sf_dir):
    n = text.numbers(_docs(spark, sf_dir)).groupBy("raw").agg(F.count("*").alias("n")).where("n >= 3")
    return n.orderBy(F.desc("n"), "raw").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "raw")))


@query(NUMS + r", t as (select nullif(regexp_extract(raw, '(\d)[^\d]*$', 1), '') as digit from nums) select digit, count(*) as n from t where digit is not null group by all")
def text_terminal_digits(spark, sf_dir):
    return text.numbers(_docs(spark, sf_dir)).where("terminal is not null").groupBy(F.col("terminal").alias("digit")).agg(F.count("*").alias("n"))


@query(LINES + r""", p as (select doc_id, line from ln where contains(text, '|') and not regexp_matches(text, '!\[[^\]]*\]\(')),
i as (select doc_id, line, line - row_number() over (partition by doc_id order by line) as g from p)
select doc_id, min(line)::int as start_line, max(line)::int as end_line, count(*) as n_lines from i group by doc_id, g having count(*) >= 2""")
def markdown_tables(spark, sf_dir):
    return text.tables(_docs(spark, sf_dir))


@query(LINES + r""", p as (select *, line - row_number() over (partition by doc_id order by line) as g from ln where trim(text) <> '')
select doc_id, min(line)::int as start_line, sha256(trim(regexp_replace(string_agg(text, ' ' order by line), '\s+', ' ', 'g'))) as sha256 from p group by doc_id, g""")
def text_blocks(spark, sf_dir):
    return text.blocks(_docs(spark, sf_dir)).select("doc_id", "start_line", F.sha2("text", 256).alias("sha256"))


@query(r"""with p as (select doc_id, unnest(range(0, len(p)))::int as pos, trim(unnest(p)) as s from (select doc_id, string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null)),
k as (select * from p where length(s) >= 30 and not contains(s, '![')), f as (select * from k qualify row_number() over (partition by doc_id, substring(lower(s), 1, 180) order by pos) = 1)
select * from (select doc_id, row_number() over (partition by doc_id order by pos)::int as rank, pos, s from f) where rank <= 5""")
def sentence_claims(spark, sf_dir):
    return text.sentences(_docs(spark, sf_dir))


@query(LINES + r""", k as (select case when trim(text) = '' then 'blank' when regexp_matches(text, '!\[[^\]]*\]\([^)]+\)') then 'image' when contains(text, '|') then 'table'
 when regexp_matches(trim(text), '^(?i:fig(ure)?\.?|table)\s*[sS]?\d+') or regexp_matches(trim(text), '^[图表]\s*\d+') then 'caption' when starts_with(trim(text), '#') then 'heading' else 'text' end as kind from ln)
select kind, count(*) as n from k group by all""")
def line_classes(spark, sf_dir):
    return text.classified(_docs(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(LINES + r""", k as (select *, case when trim(text) = '' then 'blank' when regexp_matches(text, '!\[[^\]]*\]\([^)]+\)') then 'image' when contains(text, '|') then 'table'
 when regexp_matches(trim(text), '^(?i:fig(ure)?\.?|table)\s*[sS]?\d+') or regexp_matches(trim(text), '^[图表]\s*\d+') then 'caption' when starts_with(trim(text), '#') then 'heading' else 'text' end as kind,
 coalesce(nullif(regexp_extract(text, '(?i)\b((?:extended data |supplementary )?(?:fig(?:ure)?s?\.?|tables?)\s*s?\d+[a-z]?)', 1), ''), nullif(regexp_extract(text, '([图表]\s*\d+)', 1), '')) as label from ln),
i as (select 'type' as index_name, kind as key from k union all select 'label', regexp_replace(lower(label), '[^a-z0-9一-龥]+', '', 'g') from k where label is not null union all select 'line', line::varchar from k)
select index_name, key, count(*) as n_items from i where key <> '' group by all""")
def inverted_line_index(spark, sf_dir):
    return text.inverted_index(text.classified(_docs(spark, sf_dir)))


@query("select sha256(text) as sha256, count(*) as n_items, min(doc_id) as first_item from documents where text is not null group by 1 having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return claims.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text")


BITS = " + ".join(f"(case when embedding[{i + 1}] > embedding[{i}] then {1 << (i - 1)}::bigint else 0 end)" for i in range(1, 63))


@query(f"with h as (select vec_id as k, {BITS} as h from embeddings) select a.k as item_1, b.k as item_2, bit_count(xor(a.h, b.h))::int as distance from h a join h b on a.k < b.k where bit_count(xor(a.h, b.h)) <= 14")
def near_duplicates(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    bits = F.expr("aggregate(sequence(1, 62), 0L, (s, i) -> s + if(embedding[i] > embedding[i - 1], shiftleft(1L, i - 1), 0L))")
    return claims.near_hashes(e.select("vec_id", bits.alias("bits")), "vec_id", "bits", ImageParams(max_distance=14))


@query("""with r as (select l_orderkey as k, round(sum(cast(l_extendedprice as decimal(18,2)))::double, 2) as v from lineitem group by 1)
select case when r.k is null then 'missing' when abs(o_totalprice - v) > 1000 then 'mismatched' else 'matched' end as status, count(*) as n from orders left join r on o_orderkey = k group by 1""")
def claim_compare(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("string").alias("expected"), F.lit(1000.0).alias("tolerance"))
    r = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).cast("string").alias("value"))
    return claims.compare_claims(o, r, ["k"]).groupBy("status").agg(F.count("*").alias("n"))


@query("select count(*) as n, min(o_orderkey) as first_key from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def missing_dependencies(spark, sf_dir):
    o, li = _read(spark, sf_dir, "orders").select("o_orderkey"), _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_anti").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def _findings(spark, sf_dir):
    """Union of the support tables: relations of columns and duplicate columns."""
    a = columns.fixed_relations(line_cells(spark, sf_dir)).select("workbook", "sheet", "left_col", "right_col", "category", "support_rows", "support_rate", "risk_level")
    b = columns.duplicate_columns(line_cells(spark, sf_dir)).select("workbook", "sheet", "left_col", "right_col", F.lit("duplicate_columns").alias("category"), F.col("equal_rows").alias("support_rows"), "support_rate", "risk_level")
    return a.unionByName(b).withColumn("artifact_likelihood", F.lit(None).cast("string"))


FINDINGS = f"with fr as ({ORACLE_SQL['fixed_relationships']}), dc as ({ORACLE_SQL['duplicate_columns']}), f as (select workbook, sheet, left_col, right_col, category, support_rows, support_rate, risk_level from fr union all select workbook, sheet, left_col, right_col, 'duplicate_columns', equal_rows, support_rate, risk_level from dc), k as (select *, case risk_level when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as rk from f)"


@query(FINDINGS + " select category, count(*) as n_findings, count(distinct (workbook, sheet)) as n_sheets, count(distinct workbook) as n_workbooks, sum(support_rows)::bigint as support_rows, max(rk) as max_risk from k group by category")
def pattern_groups(spark, sf_dir):
    return claims.pattern_groups(_findings(spark, sf_dir))


@query(FINDINGS + " select workbook, sheet, max(rk) as max_risk, count(*) as n_findings from k group by all order by max_risk desc, n_findings desc, workbook, sheet limit 6")
def evidence_clusters(spark, sf_dir):
    return claims.clusters(_findings(spark, sf_dir))


@query(FINDINGS + " select *, format('CF-{:04d}', rank) as finding_id from (select workbook, sheet, left_col, right_col, category, support_rows, risk_level, row_number() over (order by rk desc, support_rows desc, workbook, sheet, category, left_col, right_col) as rank from k where rk >= 2) where rank <= 100")
def top_findings(spark, sf_dir):
    found = claims.priority(_findings(spark, sf_dir)).withColumn("rk", risk_rank(F.col("risk_level")))
    order = [F.desc("rk"), F.desc("support_rows"), "workbook", "sheet", "category", "left_col", "right_col"]
    top = claims.numbered(found.orderBy(*order).limit(100), "CF", order)  # a top-k report
    return top.select("workbook", "sheet", "left_col", "right_col", "category", "support_rows", "risk_level", "finding_id", F.substring("finding_id", 4, 9).cast("bigint").alias("rank"))


@query(FINDINGS + " select case when max(rk) >= 4 then 'fail' when count(*) > 0 then 'review' else 'pass' end as verdict, count(*) as n from k")
def report_verdict(spark, sf_dir):
    return claims.verdict(_findings(spark, sf_dir))


# Planted cases: submissions, papers and reports, which the tables don't hold.
from tessera.plans import cases  # noqa: E402

QUERIES.update(cases.QUERIES)
ORACLE_SQL.update(cases.ORACLE_SQL)
