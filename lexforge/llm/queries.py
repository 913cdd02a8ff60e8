"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fingerprints, language_id, mixing, near_dedup, packing, quality_model, quality_rules, token_counts, url_filter
from .common import table

BOTH_SAY = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", BOTH_SAY), (-1, 1, "assistant", BOTH_SAY)], given.schema)
    return chat_format.conversation_digests(chat_format.format_turns(given.unionByName(planted)))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_slot and second_slot: -1 where a pass takes nothing of a document."""
    return mixing.mix(table(spark, sf_dir, "documents")).fillna(-1, ["first_slot", "second_slot"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_source_mix, op3_token_counts, op4_url_filter, op5_quality_rules, op6_quality_model, op7_language_id, op8_near_dedup, op9_packing, op10_fingerprints)}

_ESCAPED = r"replace(coalesce(text, ''), '<|', '<|\')"
_ROLE = r"replace(replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n'), '|', '\p')"

OP1_SQL = rf"""with t as (select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '{BOTH_SAY}' union all select -1, 1, 'assistant', '{BOTH_SAY}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' order by turn nulls first, coalesce(role, ''), coalesce(text, ''))) as turns_sha256,
  sum(case when role = 'assistant' then length(coalesce(text, '')) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then coalesce(text, '') else '' end, '' order by turn nulls first, coalesce(role, ''), coalesce(text, '')), '')) as loss_sha256,
  sum(length('{chat_format.START}') + length({_ROLE}) + 1 + length({_ESCAPED}) + length('{chat_format.END}') + 1)::bigint as formatted_chars
from t group by conv_id"""

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint"

_BEFORE = f"(order by source_size * {mixing.MOST} / w, sid rows between unbounded preceding and 1 preceding)"

OP2_SQL = f"""with d as (select doc_id, source, {_SIZE} as size, ('0x' || substr(md5('{mixing.SEED}' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as sid from d group by source),
w as (select *, ([{", ".join(f"{x}::double" for x in mixing.WEIGHTS)}])[(sid - 1) % {len(mixing.WEIGHTS)} + 1] as w from s),
k as (select *, (sum(source_size) over () * {mixing.SHARE}::double - coalesce(sum(source_size) over {_BEFORE}, 0) * {mixing.MOST}) / (sum(w) over () - coalesce(sum(w) over {_BEFORE}, 0)) as lv from w),
t as (select source, sid, source_size, least(source_size::double * {mixing.MOST}, (max(lv) over ()) * w) as target from k),
b as (select *, sum(target) over (order by sid) / sum(target) over () as upto, greatest(1, ceil(sum(target) over () / {mixing.SLOTS}::double))::bigint as block, sum(target) over () as total from t),
g as (select *, coalesce(lag(upto) over (order by sid), 0) as low, case when sid = max(sid) over () then 2 else upto end as high, ((source_size + block - 1) // block)::bigint as blocks from b),
u as (select i as slot, ((i + 0.5::double) * {mixing.GOLDEN}::double) % 1.0::double as u from range(0, (select ceil(max(total / block))::bigint from b)) r(i)),
a as (select sid, slot, row_number() over (partition by sid order by slot) - 1 as k from u join g on u >= low and u < high),
c as (select g.*, least((select count(*) from a where a.sid = g.sid), {mixing.MOST} * blocks)::bigint as got from g),
p as (select doc_id, size, sid, source_size, target, block, blocks, got, (sum(size) over (partition by d.source order by h, doc_id nulls first, size rows unbounded preceding) - size)::bigint as beg
  from d join c on d.source is not distinct from c.source)
select doc_id, size, source_size, target, (greatest(0, least(beg + size, block * got) - beg) + greatest(0, least(beg + size, block * greatest(got - blocks, 0)) - beg))::bigint as taken,
  coalesce(x.slot, -1) as first_slot, coalesce(y.slot, -1) as second_slot
  from p left join a x on size > 0 and x.sid = p.sid and x.k = beg // block and x.k < least(got, blocks)
  left join a y on size > 0 and y.sid = p.sid and y.k = blocks + beg // block and y.k < got"""

OP8_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end)) as g from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
l as materialized (select a, b from e union all select b, a from e),
r(id, reach) as (select doc_id, doc_id from w union select r.id, l.b from r join l on l.a = r.reach)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n using (doc_id) join (select id, min(reach) as component_id from r group by id) on id = w.doc_id"""

ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op2_source_mix": OP2_SQL, "op4_url_filter": url_filter.judge_sql(), "op8_near_dedup": OP8_SQL}
