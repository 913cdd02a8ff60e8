"""Queries over generated articles and records (see generated.py), with DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generated as G
from .functions import patterns as P
from .functions import text as X
from .functions.tables import running_index
from .operators import curation as C
from .operators import mining as M
from .operators import records as R
from .operators import tasks as T
from .plans import stages
from .queries import _FINDINGS, _PRED, _SPLIT, clean, group_split, key, plain, schema_rows, space, table, term


def _reviewed(spark, sf_dir):
    return G.reviewed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _articles(spark, sf_dir):
    return G.articles(table(spark, sf_dir, "documents"))


def _md5(name: str):
    return F.md5(F.col(name).cast("binary")).alias(f"{name}_md5")


def merge_gold(spark, sf_dir):
    r = _reviewed(spark, sf_dir)
    out = R.merge_sources([("v0.4_gold", r.where("quality = 1")), ("v0.5_review", r.where("quality is null or quality <> 1"))])
    return out.select("row_idx", "annotation_source", "route", "reason", F.coalesce("original.idx", F.lit(-1)).alias("original_idx"), "definition_id", "previous_definition_id", "term", _md5("definition"), "scope_label", "inferred_scope", "definition_type")


def gold_records(spark, sf_dir):
    out = R.gold_from_review(_reviewed(spark, sf_dir))
    return out.select("row_idx", "route", "definition_id", X.normalize_gold_term(F.col("term")).alias("short_term"), "scope_label", "inferred_scope", "definition_type")


def article_exclusion_index(spark, sf_dir):
    return R.article_index(_reviewed(spark, sf_dir), "file").select("key", F.array_join("files", ",").alias("files"), "rows")


def term_exclusion_index(spark, sf_dir):
    return R.term_index(_reviewed(spark, sf_dir), "file").select("source_code", "term", F.array_join("files", ",").alias("files"), "rows")


def exclusion_stats(spark, sf_dir):
    return R.index_stats(_reviewed(spark, sf_dir), "file")


def exclusion_routes(spark, sf_dir):
    """Documents without a label as candidates, labelled records as known."""
    r = _reviewed(spark, sf_dir)
    known = r.where("quality = 1").select("article_id", "source_file", F.lit(None).cast("string").alias("source_code"), "article_number", "date_debut", "date_fin", "term")
    out = stages.exclusion(r.where("quality is null"), known)
    return out.groupBy("route").agg(F.count("*").alias("n"))


def candidate_task(spark, sf_dir):
    return T.candidate_examples(_reviewed(spark, sf_dir), "file").select("example_id", "label", "binary_label", "manual_label", "candidate_term", _md5("input_text"), "article_key")


def extraction_task(spark, sf_dir):
    return T.extraction_examples(_reviewed(spark, sf_dir)).select("example_id", _md5("input_text"), "target_term", _md5("target_definition"), "article_key")


def gold_instances(spark, sf_dir):
    return T.gold_instances(_reviewed(spark, sf_dir)).select("instance_id", "article_key", "term", _md5("raw_body"), "pattern", "manual_label")


def article_task(spark, sf_dir):
    r = _reviewed(spark, sf_dir)
    return T.article_examples(r.where("quality = 1"), r.where("quality is null")).select("example_id", "label", "binary_label", "article_key", _md5("input_text"), "origin")


def certified_task(spark, sf_dir):
    r = _reviewed(spark, sf_dir)
    return T.certified_examples(r.withColumn("binary_label", F.col("quality")), r.where("toxic = 1")).select("example_id", "label", "binary_label", "article_key", _md5("input_text"))


def split_report(spark, sf_dir):
    out = T.split_summary(group_split(spark, sf_dir), "split", "conv_id", "label")
    return out.select("split", "field", "value", "n", F.round("ratio", 6).alias("ratio"))


def task_strata(spark, sf_dir):
    """Labels by which the splits of three tasks are balanced."""
    r = _reviewed(spark, sf_dir).withColumn("binary_label", F.col("quality"))
    tasks = ("article_classification", "term_definition_extraction", "other")
    return r.select(*(T.stratification_label(t, r).alias(f"s{i}") for i, t in enumerate(tasks))).groupBy("s0", "s1", "s2").agg(F.count("*").alias("n"))


def _predicted(spark, sf_dir):
    marks = F.contains("definition_candidate", F.lit("!!")) | F.contains("definition_candidate", F.lit(" | "))
    r = _reviewed(spark, sf_dir).where("quality is not null")
    return r.withColumns({"gold_label": F.col("quality"), "pred_label": F.when(marks, 0).otherwise(1), "candidate_term": F.col("term_candidate"), "candidate_definition": F.col("definition_candidate"), "input_text": F.col("definition_candidate")})


def error_review(spark, sf_dir):
    return T.review_errors(_predicted(spark, sf_dir)).select("row_idx", "error_type", "diagnostic_hint", _md5("input_text_short"))


def error_rates(spark, sf_dir):
    return T.error_rate(_predicted(spark, sf_dir)).select("rows", "errors", F.round("error_rate", 6).alias("error_rate"))


def annotation_batch(spark, sf_dir):
    r = _reviewed(spark, sf_dir)
    return R.annotation_batch(r.where(R.has_text(r)), "batch 1", "row_idx").select("row_idx", "v0_5_sample_index", "annotation_batch", "sampling_stratum", "manual_review_status", "has_definition")


def missing_fields(spark, sf_dir):
    """Records as JSON lines, of which every fourth leaves out what is null, and the required fields that lines lack."""
    r = _reviewed(spark, sf_dir)
    whole = F.struct(*P.REQUIRED)
    raw = F.when(F.col("row_idx") % 4 == 0, F.to_json(whole)).otherwise(F.to_json(whole, {"ignoreNullFields": "false"}))
    return C.missing_fields(r.select("row_idx", raw.alias("raw"))).where(F.size("missing") > 0).select("row_idx", F.array_join("missing", ",").alias("missing"))


def validation_gate(spark, sf_dir):
    return C.gate(C.validate(schema_rows(spark, sf_dir)))


def french_candidates(spark, sf_dir):
    return M.mine(_articles(spark, sf_dir)).select("id", F.array_join("matched_definition_patterns", "|").alias("labels"), F.array_join("matched_pattern_categories", "|").alias("categories"), "candidate_score", "noise_risk", _md5("text_preview"))


def french_scopes(spark, sf_dir):
    return _articles(spark, sf_dir).select("id", M.infer_scope(F.col("text")).alias("s")).select("id", "s.*")


def french_rules(spark, sf_dir):
    return _articles(spark, sf_dir).withColumn("r", M.rule_extract(F.col("text"))).select("id", "r.rule", "r.term", "r.definition")


def french_drafts(spark, sf_dir):
    d = R.with_draft_ids(M.extract_drafts(_articles(spark, sf_dir)))
    return d.select("id", "candidate_definition_id", "pattern", "item_number", "defined_subject", "term_candidate", "definition_candidate", "definition_type", "scope_label")


def article_numbers(spark, sf_dir):
    """Dense numbers of documents in order of id."""
    return running_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "n", 1000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (merge_gold, gold_records, article_exclusion_index, term_exclusion_index, exclusion_stats, candidate_task, extraction_task, gold_instances, article_task, certified_task, split_report, task_strata, error_review, error_rates, annotation_batch, missing_fields, validation_gate, french_candidates, french_scopes, french_rules, article_numbers)}
#: Tests hold these against an independent Python form.
WITHOUT_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (french_drafts, exclusion_routes)}

# --- twins ---

_R = G.REVIEWED_SQL
cleaned = lambda c: f"nullif({space(f'({c})')}, '')"
given = lambda *cs: cleaned("coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + ", null)")
code = lambda c: f"trim(replace(replace(lower({clean(c)}), 'code rural (nouveau)', '{P.RURAL}'), 'code rural et de la peche maritime', '{P.RURAL}'), ' .;:,')"
number = lambda c: f"(case when {key(c)} in ('article liminaire', 'art liminaire', 'art. liminaire') then 'liminaire' else {key(c)} end)"
flat = lambda c: f"trim(regexp_replace(lower({clean(c)}), '\\s*''\\s*', '''', 'g'))"
safe = lambda c, n: f"left(coalesce(nullif(trim(regexp_replace({plain(f'upper({c})')}, '[^A-Z0-9]+', '_', 'g'), '_'), ''), 'UNK'), {n})"
new_id = lambda prefix, digits: f"'{prefix}_' || {safe('coalesce(source_code, chr(85) || chr(78) || chr(75))', 35)} || '_' || {safe('article_number', 20)} || '_' || replace(coalesce(nullif(article_id, ''), 'NOID'), 'LEGIARTI', 'ARTI') || '_' || case when length(n::varchar) < {digits} then lpad(n::varchar, {digits}, '0') else n::varchar end"
_KEY = f"case when {key('article_id')} <> '' then 'article_id::' || {key('article_id')} when {key('source_file')} <> '' then 'source_file::' || {key('source_file')} else 'source_article::' || {key('source_code')} || '::' || {number('article_number')} end"
_KEYS = f"""[x for x in [case when {key('article_id')} <> '' then 'article_id::' || {key('article_id')} end, case when {key('source_file')} <> '' then 'source_file::' || {key('source_file')} end,
  case when {code('source_code')} <> '' and {number('article_number')} <> '' then 'source_article::' || {code('source_code')} || '::' || {number('article_number')} end,
  case when {code('source_code')} <> '' and {number('article_number')} <> '' then 'source_article_dates::' || {code('source_code')} || '::' || {number('article_number')} || '::' || date_debut || '::' || date_fin end] if x is not null]"""
_TERMS = f"list_distinct([x for x in [{term('term')}, {term('gold_term')}, {term('term_candidate')}] if x <> ''])"
md5 = lambda c: f"md5({c})"


def _re2(regex: str) -> str:
    """A mining pattern for an engine whose word boundary knows only ASCII: the boundaries at its ends are spelt out."""
    regex = re.sub(r"^\\b", r"(?:^|[^\\pL\\pN_])", regex)
    return re.sub(r"\\b$", r"(?:$|[^\\pL\\pN_])", regex).replace("'", "''")


_HITS = ", ".join(f"case when regexp_matches(text, '(?im){_re2(r)}') then {G._quoted(n)} end" for n, _, r in P.INVENTORY)
_OF = {c: "[" + ", ".join(G._quoted(n) for n, own, _ in P.INVENTORY if own == c) + "]" for c in P.CATEGORY_SCORE}
_COUNT = {c: f"len(list_intersect(labels, {_OF[c]}))" for c in P.CATEGORY_SCORE}
_SCOPE = lambda what: "case " + " ".join(f"when regexp_matches(text, '(?i){_re2(r)}') then {what(r, label)}" for r, label in P.SCOPES)
_SHORT = lambda c: f"case when length({clean(c)}) > 500 then substr({clean(c)}, 1, 497) || '...' else {clean(c)} end"
_H = {k: G._quoted(v) for k, v in P.HINTS.items()}


def _rule(name: str, regex: str, terms: tuple[int, ...], at: int) -> str:
    body, flags = regex.replace("'", "''"), "(?is)"
    pick = lambda i: f"nullif(regexp_extract(text, '{flags}{body}', {i}), '')"
    found = clean(f"coalesce({', '.join(pick(i) for i in terms)})")
    if name == "sentend_de":
        prefix = P.SCOPE_PREFIX.replace("'", "''")
        found = f"trim(regexp_replace({found}, '(?i){prefix}', ''))"
    out = f"select id, {name!r} as rule, trim({found}, ' \"“”') as term, {clean(pick(at))} as definition, {[r[0] for r in P.RULES].index(name)} as k from a where regexp_matches(text, '{flags}{body}')"
    for stop in P.STOPS:  # the first place of a marker beyond the thirtieth character
        stop = stop.replace("'", "''")
        cut = f"case when regexp_matches(substr(definition, 32), '{stop}') then substr(definition, 1, 31) || regexp_extract(substr(definition, 32), '(?s)^(.*?){stop}', 1) else definition end"
        out = f"select id, rule, term, trim({cut}) as definition, k from ({out})"
    return f"select id, rule, term, trim(definition, ' ;') as definition, k from ({out})"


_MERGE = f"""with recursive r as (select *, case when quality = 1 then 'v0.4_gold' else 'v0.5_review' end as src, {cleaned('manual_label')} as ml,
    {given('term', 'gold_term', 'term_candidate')} as t, {given('definition', 'gold_definition', 'definition_candidate')} as d from {_R}),
  s as (select *, case when src = 'v0.5_review' and ml is null then 'missing_manual_label' when src = 'v0.5_review' and ml not in ('valid_definition', 'partial') then 'rejected_manual_label:' || ml
    when t is null or d is null then 'missing_term_or_definition' end as skip from r),
  a as (select *, row_number() over (order by src, row_idx) as n, case when {flat('article_id')} <> '' then 'article_id' || chr(1) || {flat('article_id')} else 'source_article' || chr(1) || {code('source_code')} || '::' || {number('article_number')} end
    || chr(1) || {term('t')} || chr(1) || {plain(flat('d'))} as e, {code('source_code')} || chr(1) || {number('article_number')} || chr(1) || {term('t')} as c from s where skip is null),
  x as (select n, row_idx, md5(e) as e, md5(c) as c from a),
  g(n, es, cs, ids, why, orig) as (select 0::bigint, []::varchar[], []::varchar[], []::bigint[], null::varchar, null::bigint
    union all select x.n, case when list_contains(es, e) or list_contains(cs, c) then es else list_append(es, e) end, case when list_contains(es, e) or list_contains(cs, c) then cs else list_append(cs, c) end,
      case when list_contains(es, e) or list_contains(cs, c) then ids else list_append(ids, row_idx) end,
      case when list_contains(es, e) then 'exact_article_term_definition_duplicate' when list_contains(cs, c) then 'existing_source_code_article_number_term' end,
      case when list_contains(es, e) then ids[list_position(es, e)] when list_contains(cs, c) then ids[list_position(cs, c)] end from g join x on x.n = g.n + 1),
  m as (select s.*, case when s.skip is not null then 'skipped' when why is null then 'merged' else 'duplicate' end as route, coalesce(s.skip, why) as reason, orig from s left join x using (row_idx) left join g on g.n = x.n),
  o as (select *, row_number() over (partition by route order by src, row_idx) as n from m)
  select row_idx, src as annotation_source, route, reason, coalesce(orig, -1) as original_idx, case when route = 'merged' then {new_id('NORMDEF_FR_V0_5', 5)} else {cleaned('definition_id')} end as definition_id, {given('definition_id')} as previous_definition_id,
    t as term, md5(d) as definition_md5, coalesce({given('scope_label', 'gold_scope_label')}, 'unspecified') as scope_label, coalesce({given('inferred_scope')}, 'article') as inferred_scope, coalesce({given('definition_type')}, 'explicit') as definition_type from o"""

_SHORT_TERM = lambda t: "case " + " ".join(f"when starts_with({t}, {G._quoted(p)}) and length({t}) > {len(p) + 2} then trim(substr({t}, {len(p) + 1}))" for p in P.LEADING_ARTICLES) + f" else {t} end"
_FIRST = lambda rows: f"(select *, row_number() over (partition by k order by row_idx) as nth from (select *, {_KEY} as k from {rows}))"

ORACLE_SQL: dict[str, str] = {
    "merge_gold": _MERGE,
    "gold_records": f"""with r as (select *, {cleaned('manual_label')} as ml, {cleaned('gold_term')} as gt, {cleaned('gold_definition')} as gd from {_R}),
      o as (select *, case when ml in ('valid_definition', 'partial') then case when gt is not null and gd is not null then 'gold' else 'skipped' end when ml in ('invalid', 'unsure') then 'rejected' else 'skipped' end as route from r),
      i as (select *, row_number() over (partition by route order by row_idx) as n from o)
      select row_idx, route, case when route = 'gold' then {new_id('NORMDEF_FR_V0_2', 4)} else definition_id end as definition_id, {_SHORT_TERM("trim(case when route = 'gold' then gt else term end, ' ' || chr(9) || chr(10) || chr(13))")} as short_term,
        case when route = 'gold' then coalesce({cleaned('gold_scope_label')}, 'unspecified') else scope_label end as scope_label, case when route = 'gold' then 'article' else inferred_scope end as inferred_scope, case when route = 'gold' then 'explicit' else definition_type end as definition_type from i""",
    "article_exclusion_index": f"select key, string_agg(distinct file, ',' order by file) as files, count(*) as rows from (select file, unnest({_KEYS}) as key from {_R}) group by key",
    "term_exclusion_index": f"select source_code, term, string_agg(distinct file, ',' order by file) as files, count(*) as rows from (select file, {code('source_code')} as source_code, unnest({_TERMS}) as term from {_R}) where source_code <> '' group by all",
    "exclusion_stats": f"""select file, status, count(*) as n from (select file, unnest(['rows_read', case when len({_KEYS}) > 0 then 'rows_with_article_keys' else 'rows_without_article_keys' end,
      case when {code('source_code')} = '' then 'rows_without_source_code_for_terms' when len({_TERMS}) > 0 then 'rows_with_terms' else 'rows_without_terms' end]) as status from {_R}) group by all""",
    "candidate_task": f"""with r as (select *, lower({cleaned('manual_label')}) as ml, coalesce({cleaned('candidate_definition_id')}, {cleaned('definition_id')}, file || ':' || row_idx) as example_id,
        {cleaned(f"case when {cleaned('term_candidate')} is not null then term_candidate when {cleaned('term')} is not null then term else gold_term end")} as t, {cleaned('definition_candidate')} as d, {cleaned('raw_body')} as b from {_R}),
      f as (select *, row_number() over (partition by example_id order by row_idx) as nth, concat_ws(chr(10), 'TERM: ' || t, 'DEFINITION: ' || d, 'CONTEXT: ' || b) as x from r where ml in ('valid_definition', 'partial', 'invalid'))
      select example_id, case when ml = 'invalid' then 'invalid' else 'accepted' end as label, (ml <> 'invalid')::int as binary_label, ml as manual_label, t as candidate_term, md5(x) as input_text_md5, {_KEY} as article_key from f where nth = 1 and x <> ''""",
    "extraction_task": f"select definition_id as example_id, md5({cleaned('raw_body')}) as input_text_md5, {cleaned('term')} as target_term, md5({cleaned('definition')}) as target_definition_md5, {_KEY} as article_key from {_R} where {cleaned('raw_body')} is not null and {cleaned('term')} is not null and {cleaned('definition')} is not null",
    "gold_instances": f"select definition_id as instance_id, {_KEY} as article_key, {cleaned('term')} as term, md5({cleaned('raw_body')}) as raw_body_md5, {cleaned('pattern')} as pattern, {cleaned('manual_label')} as manual_label from {_R}",
    "article_task": f"""with p as (select *, {cleaned('raw_body')} as x, row_number() over (order by row_idx) as n from {_FIRST(f"(select * from {_R} where quality = 1 and {cleaned('raw_body')} is not null)")} where nth = 1),
      m as (select *, {cleaned('raw_body')} as x, row_number() over (order by row_idx) as n from (select *, {_KEY} as k from {_R}) where quality is null and {cleaned('raw_body')} is not null and k not in (select k from p))
      select 'article_pos_' || lpad(n::varchar, 5, '0') as example_id, 'definition_article' as label, 1 as binary_label, k as article_key, md5(x) as input_text_md5, 'gold_positive' as origin from p
      union all select 'article_neg_' || lpad(n::varchar, 5, '0'), 'non_definition_article', 0, k, md5(x), 'low_clean_candidate_not_in_gold' from m where n <= (select floor(count(*) * 1.2) from p)""",
    "certified_task": f"""with g as (select *, {given('raw_body')} as x, row_number() over (order by row_idx) as n from {_FIRST(f"(select * from {_R} where toxic = 1)")} where nth = 1 and {given('raw_body')} is not null),
      p as (select *, {given('raw_body')} as x, row_number() over (order by ('0x' || substr(md5(k || ':2026'), 1, 15))::bigint) as n from {_FIRST(f"(select * from {_R} where quality = 1)")} where nth = 1)
      select 'cert_neg_' || lpad(n::varchar, 5, '0') as example_id, 'certified_true_negative' as label, 0 as binary_label, k as article_key, md5(x) as input_text_md5 from g
      union all select 'cert_pos_' || lpad(n::varchar, 5, '0'), 'definition_article', 1, k, md5(x) from p where n <= (select count(*) from g)""",
    "split_report": f"""with s as (select * from {_SPLIT}), b as (select conv_id, label, split from s union all select conv_id, label, 'all' from s)
      select split, 'rows' as field, '' as value, count(*) as n, round(count(*)::double / (select count(*) from s), 6) as ratio from b group by split
      union all select split, 'label', label, count(*), null from b group by split, label
      union all select 'all', 'overlap', '', (select count(*) from (select conv_id from s group by conv_id having count(distinct split) > 1)), null""",
    "task_strata": f"""select coalesce(quality::varchar, 'unknown') as s0, case when pattern = 'terme_colon_definition' then 'colon_definition' when pattern like '%s''entend de%' then 'sentend_de' when pattern like '%on entend par%' then 'on_entend_par' else 'other' end as s1, 'all' as s2, count(*) as n from {_R} group by all""",
    "error_review": f"""with e as (select row_idx, lower({clean('pattern')}) as p, {clean('term_candidate')} as t, {clean('definition_candidate')} as d, {clean('raw_body')} as b, {clean('manual_label')} as ml, quality as gold, case when contains(definition_candidate, '!!') or contains(definition_candidate, ' | ') then 0 else 1 end as pred, {_SHORT('definition_candidate')} as short from {_R} where quality is not null),
      w as (select *, len([x for x in string_split(d, ' ') if x <> '']) as words from e where gold <> pred)
      select row_idx, case when gold = 0 then 'false_positive_invalid_predicted_accepted' else 'false_negative_accepted_predicted_invalid' end as error_type, md5(short) as input_text_short_md5,
        case when gold = 0 then concat_ws(' ', {_H['kept_invalid']}, case when p = 'terme_colon_definition' then {_H['colon']} end, case when words < 4 then {_H['short']} end, case when t <> '' and not contains(lower(b), lower(t)) then {_H['absent']} end)
        else concat_ws(' ', {_H['rejected_accepted']}, case when ml = 'partial' then {_H['partial']} end, case when p in ('s''entend de', 'on entend par') then {_H['canonical']} end, case when words > 40 then {_H['long']} end) end as diagnostic_hint from w""",
    "error_rates": f"select count(*) as rows, count(*) filter (gold <> pred) as errors, round(count(*) filter (gold <> pred) / nullif(count(*), 0), 6) as error_rate from {_PRED}",
    "annotation_batch": f"select row_idx, row_number() over (order by row_idx) as v0_5_sample_index, 'batch 1' as annotation_batch, 'low_clean_v0_5' as sampling_stratum, 'pending' as manual_review_status, null::varchar as has_definition from {_R} where trim(coalesce(raw_body, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''",
    "missing_fields": f"select row_idx, array_to_string([x for x in [{', '.join(f'case when {c} is null then {c!r} end' for c in P.REQUIRED)}] if x is not null], ',') as missing from {_R} where row_idx % 4 = 0 and ({' or '.join(f'{c} is null' for c in P.REQUIRED)})",
    "validation_gate": f"select errors, warnings, errors = 0 as passed from (select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings from ({_FINDINGS}))",
    "french_candidates": f"""with h as (select id, text, [x for x in [{_HITS}] if x is not null] as labels from {G.ARTICLES_SQL})
      select id, array_to_string(labels, '|') as labels, array_to_string([x for x in [{', '.join(f'case when {_COUNT[c]} > 0 then {c!r} end' for c in sorted(_COUNT))}] if x is not null], '|') as categories, ({' + '.join(f'{P.CATEGORY_SCORE[c]} * {n}' for c, n in _COUNT.items())})::int as candidate_score,
      case when {_COUNT['strong']} > 0 then 'low' when {_COUNT['medium']} > 0 then 'medium' else 'high' end as noise_risk, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text_preview_md5 from h where len(labels) > 0""",
    "french_scopes": f"""select id, {_SCOPE(lambda r, label: f"regexp_extract(text, '(?i)(?:^|[^\\pL\\pN_])({r[2:-2].replace(chr(39), chr(39) * 2)})(?:$|[^\\pL\\pN_])', 1)")} end as scope_text, {_SCOPE(lambda r, label: G._quoted(label))} else 'unspecified' end as scope_label, {_SCOPE(lambda r, label: G._quoted(label))} else 'article' end as inferred_scope from {G.ARTICLES_SQL}""",
    "french_rules": f"""with a as (select * from {G.ARTICLES_SQL}), f as ({' union all '.join(_rule(*r) for r in P.RULES)}), b as (select id, arg_min(struct_pack(rule := rule, term := term, definition := definition), k) as x from f where term <> '' and definition <> '' group by id)
      select a.id, x.rule as rule, x.term as term, x.definition as definition from a left join b using (id)""",
    "article_numbers": "select doc_id, row_number() over (order by doc_id) as n from documents",
}
