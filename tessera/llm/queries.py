"""One query an operator, over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lm, media, mixing, ngram_join, secrets, sharding, suffix, tokens
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", (langid.remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard_records(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_repeated", F.expr("array_join(transform(spans, x -> concat(x.start, ':', x.stop)), ',')").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_weighted_fair_mix, op3_decontamination, op4_language_id, op5_secret_scan, op6_lm_scores, op7_virtual_slots, op8_token_files, op9_ngram_jaccard_join, op10_suffix_repeats)}

# Sources by cap / weight: the level is the first that the next source's cap admits; finish times order the rest.
OP2_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
                  md5('mix:' || coalesce(cast(doc_id as varchar), '')) as u from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as rank from s),
w as (select *, [3, 1, 2][(rank % 3 + 1)::int] as w, source_size * 2 as cap from r),
l as (select *, row_number() over o as place, lead(cap / w::double) over o as next,
             (sum(source_size) over () * 1.5::double - sum(cap) over (o rows unbounded preceding)) / nullif(sum(w) over () - sum(w) over (o rows unbounded preceding), 0)::double as after,
             sum(source_size) over () * 1.5::double / sum(w) over () as even, min(cap / w::double) over () as lowest
      from w window o as (order by cap / w::double, rank)),
g as (select source, rank, source_size, coalesce(least(cap::double, w * case when (select any_value(even <= lowest) from l) then even
             else (select arg_min(after, place) from l where after <= next) end), cap::double) as target from l),
q as (select doc_id, size, rank, source_size, target, sum(size) over (partition by d.source order by u, doc_id, size rows unbounded preceding) as done
      from d join g on d.source is not distinct from g.source),
e as (select *, e, (done + e * source_size)::double / target as f from q, (values (0), (1)) as t(e) where size > 0),
t as (select *, sum(size) over (order by least(floor(f * 4096), 16384), f, rank, e, done rows unbounded preceding) as upto from e),
k as (select doc_id, rank, done, count(*) as times from t where upto <= (select sum(size) * 1.5::double from d) group by all)
select q.doc_id, q.size::bigint as size, q.source_size, q.target, (q.size * coalesce(k.times, 0))::bigint as taken
from q left join k on q.doc_id = k.doc_id and q.rank = k.rank and q.done = k.done and q.size > 0
"""

OP3_SQL = r"""
with dw as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bs as (select item_id, w, least(13, len(w)) as k from bw where len(w) > 0),
grams as (select distinct k, array_to_string(w[i:i + k - 1], ' ') as g, item_id from (select *, unnest(range(1, len(w) - k + 2)) as i from bs)),
sizes as (select distinct k from grams),
dg as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, sizes where len(w) >= k)),
hits as (select doc_id, k, i, item_id from dg join grams using (k, g)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select dw.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from dw left join n using (doc_id) left join items using (doc_id)
"""

WORDS_SQL = r"""with recursive d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),"""

# Pairs by shared shingles, counted; then all that links reach.
OP9_SQL = WORDS_SQL + r"""
s as (select distinct rid, array_to_string(case when len(w) >= 5 then w[i:i + 4] else w end, ' ') as g from (select rid, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
p as (select a.rid as x, b.rid as y, count(*) as k from s a join s b on a.g = b.g and a.rid <> b.rid group by all),
e as (select x, y from p join n a on a.rid = x join n b on b.rid = y where 100 * k >= 80 * (a.n + b.n - k)),
r as (select rid as x, rid as y from n union select r.x, e.y from r join e on r.y = e.x),
c as (select r.x as rid, min(d.doc_id) as component_id from r join d on d.rid = r.y group by all)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, case when n.n is null then d.doc_id else c.component_id end as component_id from d left join n using (rid) left join c using (rid)"""

# Windows of 51 words that two documents have; overlapping or touching ones are one span.
OP10_SQL = WORDS_SQL + r"""
g as (select rid, i, array_to_string(w[i:i + 50], ' ') as g from (select rid, w, unnest(range(1, len(w) - 49)) as i from d where len(w) >= 51)),
h as (select g from g group by g having min(rid) <> max(rid)),
p as (select rid, i from g semi join h using (g)),
b as (select *, sum(case when i - before <= 51 then 0 else 1 end) over (partition by rid order by i) as k from (select *, lag(i) over (partition by rid order by i) as before from p)),
t as (select rid, k, min(i) - 1 as start, max(i) + 50 as stop from b group by all),
u as (select rid, sum(stop - start)::bigint as n_repeated, string_agg(start || ':' || stop, ',' order by start) as spans from t group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_repeated, 0)::bigint as n_repeated, coalesce(spans, '') as spans from d left join u using (rid)"""

ORACLE_SQL: dict[str, str] = {"op2_weighted_fair_mix": OP2_SQL, "op3_decontamination": OP3_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op10_suffix_repeats": OP10_SQL}
