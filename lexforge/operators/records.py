"""Records of the curation chain: acceptance, standard form, keys, the merge of versions, gold records, indexes, drafts.

A record is a row; columns that a table lacks count as null. Rows carry ``row_idx``, a whole number in file order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.tables import running_index, written
from . import curation as C


def given(rows: DataFrame, name: str) -> Column:
    """The column of that name, null where the table has none."""
    return F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")


def article_key(rows: DataFrame, fallback: str | None = None) -> Column:
    """One key an article: an article_key it has, else its id, else its file, else code and number. With ``fallback`` (a
    column of row numbers) rows without an id get a key of their own."""
    own, article, file = X.clean_text(given(rows, "article_key")), X.normalize_key(given(rows, "article_id")), X.normalize_key(given(rows, "source_file"))
    last = F.concat_ws("::", F.lit("source_article"), X.normalize_key(given(rows, "source_code")), X.normalize_article_number(given(rows, "article_number")))
    if fallback:
        return F.coalesce(own, F.concat(F.lit("article_id::"), X.clean_text(given(rows, "article_id"))), F.concat(F.lit("row::"), F.col(fallback).cast("string")))
    return F.coalesce(own, F.when(article != "", F.concat(F.lit("article_id::"), article)), F.when(file != "", F.concat(F.lit("source_file::"), file)), last)


def skip_reason(label: Column, source: Column) -> Column:
    """Null if a row is accepted: from a gold source, or reviewed as valid or partial; else why not."""
    label = X.clean_text(label)
    return F.when(source.endswith("_gold") | F.coalesce(label.isin(*P.ACCEPTED_LABELS), F.lit(False)), F.lit(None)).when(label.isNull(), "missing_manual_label").otherwise(F.concat(F.lit("rejected_manual_label:"), label))


def standardize(rows: DataFrame, source: str) -> DataFrame:
    """The columns of FINAL_FIELDS, then row_idx, skip_reason (null if kept) and the optional columns that rows have.
    Term, definition and scope come from the final, the gold or the candidate column, whichever is given first."""
    clean = lambda *names: X.first_given(*(given(rows, n) for n in names))
    made = {name: clean(name) for name in P.FINAL_FIELDS}
    made |= {
        "definition_id": clean("definition_id", "gold_definition_id"), "term": clean("term", "gold_term", "term_candidate"),
        "definition": clean("definition", "gold_definition", "definition_candidate"), "scope_text": clean("scope_text", "gold_scope_text"),
        "scope_label": F.coalesce(clean("scope_label", "gold_scope_label"), F.lit("unspecified")),
        "inferred_scope": F.coalesce(clean("inferred_scope", "gold_inferred_scope"), F.lit("article")),
        "definition_type": F.coalesce(clean("definition_type", "gold_definition_type"), F.lit("explicit")),
        "annotation_source": F.col(source), "previous_definition_id": clean("previous_definition_id", "definition_id"),
    }
    extra = [c for c in ("correction_status", "issue_reasons", "extraction_confidence") if c in rows.columns]
    reviewed = skip_reason(given(rows, "manual_label"), F.col(source)).alias("__reviewed")
    whole = rows.select("row_idx", *extra, reviewed, F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))).alias("__made"))
    reason = F.coalesce("__reviewed", F.when(F.col("__made.term").isNull() | F.col("__made.definition").isNull(), "missing_term_or_definition"))
    return whole.select("__made.*", "row_idx", reason.alias("skip_reason"), *extra)


def ordered(rows: DataFrame) -> DataFrame:
    """The columns of FINAL_FIELDS in order (null where missing), then all others as they come."""
    return rows.select(*(given(rows, n).alias(n) for n in P.FINAL_FIELDS), *(F.col(f"`{c}`") for c in rows.columns if c not in P.FINAL_FIELDS))


def without_helpers(rows: DataFrame) -> DataFrame:
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def flat_lower(c: Column, accents: bool = True) -> Column:
    """Lower case, straight apostrophes without blanks around them, single spaces."""
    c = F.lower(X.clean_flat(c))
    return F.btrim(F.regexp_replace(c if accents else X.strip_accents(c), r"\s*'\s*", "'"))


def article_term_key() -> Column:
    """Of a standard record: code, number and term."""
    return F.struct(X.normalize_source_code(F.col("source_code")).alias("source_code"), X.normalize_article_number(F.col("article_number")).alias("article_number"), X.normalize_term(F.col("term")).alias("term"))


def exact_key() -> Column:
    """Of a standard record: article (its id, else code and number), term and definition."""
    article = flat_lower(F.col("article_id"))
    pair = F.concat_ws("::", X.normalize_source_code(F.col("source_code")), X.normalize_article_number(F.col("article_number")))
    return F.struct(F.when(article != "", "article_id").otherwise("source_article").alias("kind"), F.when(article != "", article).otherwise(pair).alias("article"), X.normalize_term(F.col("term")).alias("term"), flat_lower(F.col("definition"), accents=False).alias("definition"))


def record_id(prefix: str, index: Column, digits: int, code: int = 35, number: int = 20) -> Column:
    """prefix, code, number, article id and zero-padded index, joined by underscores."""
    article = F.replace(F.coalesce(F.nullif("article_id", F.lit("")), F.lit("NOID")), F.lit("LEGIARTI"), F.lit("ARTI"))
    text = index.cast("string")
    padded = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    return F.concat_ws("_", F.lit(prefix), F.left(X.safe_id_part(F.col("source_code")), F.lit(code)), F.left(X.safe_id_part(F.col("article_number")), F.lit(number)), article, padded)


def merge_sources(sources: list[tuple[str, DataFrame]], prefix: str = "NORMDEF_FR_V0_5") -> DataFrame:
    """Every row of the sources, earlier sources and rows first, as a standard record with route (merged, duplicate,
    skipped), reason and, for a duplicate, the row it duplicates (original_source, original_idx). Merged rows get ids in
    order; their former ids stay in previous_definition_id."""
    parts = [standardize(rows.withColumn("__source", F.lit(name)), "__source").withColumn("__rank", F.lit(k)) for k, (name, rows) in enumerate(sources)]
    rows = written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "merge-sources")
    kept = C.merge_versions(rows.where("skip_reason is null"), exact_key(), article_term_key(), [F.col("__rank"), F.col("row_idx")], originals=F.struct(F.col("annotation_source").alias("source"), F.col("row_idx").alias("idx")))
    why = {"exact_duplicate": "exact_article_term_definition_duplicate", "same_article_term": "existing_source_code_article_number_term"}
    kept = kept.withColumn("route", F.when(F.col("keep"), "merged").otherwise("duplicate")).withColumn("reason", F.coalesce(*(F.when(F.col("reason") == k, v) for k, v in why.items())))
    first = kept.where("keep").withColumn("__order", F.col("__rank") * F.lit(1 << 48) + F.col("row_idx"))
    first = running_index(first, "__order", "__index", 1 << 16).drop("__order")
    first = first.withColumn("previous_definition_id", F.coalesce("previous_definition_id", "definition_id")).withColumn("definition_id", record_id(prefix, F.col("__index"), 5))
    skipped = rows.where("skip_reason is not null").withColumn("route", F.lit("skipped")).withColumn("reason", F.col("skip_reason"))
    out = first.drop("__index").unionByName(kept.where("not keep")).drop("keep").unionByName(skipped, allowMissingColumns=True)
    return ordered(out.drop("skip_reason", "__rank"))


def gold_from_review(reviewed: DataFrame, prefix: str = "NORMDEF_FR_V0_2") -> DataFrame:
    """Every reviewed row with route: gold (valid or partial with term and definition; the gold columns count), rejected
    (invalid, unsure) or skipped. Gold rows are numbered in order of row_idx."""
    clean = lambda name: X.clean_text(given(reviewed, name))
    label = clean("manual_label")
    whole = clean("gold_term").isNotNull() & clean("gold_definition").isNotNull()
    route = F.when(label.isin(*P.ACCEPTED_LABELS), F.when(whole, "gold").otherwise("skipped")).when(label.isin("invalid", "unsure"), "rejected").otherwise("skipped")
    rows = reviewed.drop("__line_number").withColumn("route", route)
    made = {"term": clean("gold_term"), "definition": clean("gold_definition"), "scope_text": clean("gold_scope_text"), "scope_label": F.coalesce(clean("gold_scope_label"), F.lit("unspecified")), "inferred_scope": F.coalesce(clean("gold_inferred_scope"), F.lit("article")), "definition_type": F.coalesce(clean("gold_definition_type"), F.lit("explicit")), "manual_label": label, "correction_notes": clean("correction_notes")}
    gold = running_index(rows.where("route = 'gold'"), "row_idx", "__index").withColumns(made)
    gold = gold.withColumn("definition_id", record_id(prefix, F.col("__index"), 4)).drop("__index")
    return gold.unionByName(rows.where("route <> 'gold'"), allowMissingColumns=True)


def article_index(rows: DataFrame, file: str) -> DataFrame:
    """key to the files whose rows have it, how many rows and how many files."""
    keys = C.article_keys(*(given(rows, n) for n in ("article_id", "source_file", "source_code", "article_number", "date_debut", "date_fin")))
    found = rows.select(F.col(file).alias("__file"), F.explode(keys).alias("key")).groupBy("key", "__file").agg(F.count("*").alias("n"))
    return found.groupBy("key").agg(F.array_sort(F.collect_list("__file")).alias("files"), F.sum("n").alias("rows"))


def known_terms(rows: DataFrame) -> DataFrame:
    """source_code and term (both normalised) of every term, gold term and candidate of rows, with the row's columns."""
    fields = F.array(*(X.normalize_term(given(rows, n)) for n in ("term", "gold_term", "term_candidate")))
    named = rows.withColumn("__code", X.normalize_source_code(given(rows, "source_code"))).where("__code <> ''")
    return named.withColumn("__term", F.explode(F.array_distinct(F.filter(fields, lambda x: x != ""))))


def term_index(rows: DataFrame, file: str) -> DataFrame:
    """(source_code, term) to the files whose rows name the term."""
    found = known_terms(rows).groupBy("__code", "__term", F.col(file).alias("__file")).agg(F.count("*").alias("n"))
    return found.groupBy(F.col("__code").alias("source_code"), F.col("__term").alias("term")).agg(F.array_sort(F.collect_list("__file")).alias("files"), F.sum("n").alias("rows"))


def index_stats(rows: DataFrame, file: str) -> DataFrame:
    """file, status, n: rows read, with and without article keys, without a source code, with and without terms."""
    keys = F.size(C.article_keys(*(given(rows, n) for n in ("article_id", "source_file", "source_code", "article_number", "date_debut", "date_fin"))))
    code = X.normalize_source_code(given(rows, "source_code")) != ""
    some = X.any_of([X.normalize_term(given(rows, n)) != "" for n in ("term", "gold_term", "term_candidate")])
    status = F.array(F.lit("rows_read"), F.when(keys > 0, "rows_with_article_keys").otherwise("rows_without_article_keys"), F.when(~code, "rows_without_source_code_for_terms").when(some, "rows_with_terms").otherwise("rows_without_terms"))
    return rows.select(F.col(file).alias("file"), F.explode(status).alias("status")).groupBy("file", "status").agg(F.count("*").alias("n"))


def has_text(rows: DataFrame) -> Column:
    return ~X.is_blank(F.coalesce(F.nullif(given(rows, "text"), F.lit("")), given(rows, "raw_body")))


def annotation_batch(sample: DataFrame, batch: str, order: str, stratum: str = "low_clean_v0_5") -> DataFrame:
    """A sample with the columns that annotators fill, numbered from 1 in order."""
    rows = running_index(sample, order, "v0_5_sample_index")
    empty = F.lit(None).cast("string")
    return rows.withColumns({"annotation_batch": F.lit(batch), "sampling_stratum": F.lit(stratum), "manual_review_status": F.lit("pending"), "has_definition": empty, "annotation_notes": empty})


#: Where the numbers of a draft's ids begin, by extractor.
DRAFT_BASE = {"terme_colon_definition": 1000, "on entend par": 2000, "s'entend de": 3000, "défini comme": 4000}
QUALIFICATION_BASE = 5000


def with_draft_ids(drafts: DataFrame) -> DataFrame:
    """Drafts of extract_drafts() with their ids: kept spans count up from the base of their kind of pattern, spans that
    were dropped as repeated included."""
    base = F.coalesce(*(F.when(F.col("pattern") == p, n) for p, n in DRAFT_BASE.items()), F.lit(QUALIFICATION_BASE))
    return drafts.withColumn("candidate_definition_id", record_id("DRAFT", base + F.col("place") - 1, 3, 60, 30))
