"""The stages of the curation chain in order. Each returns its outputs by name, lazily but for what a stage writes itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import curation as C
from ..operators import mining as M
from ..operators import records as R
from ..operators import tasks as T
from ..sources import archive as A
from ..sources import sinks


def candidates(spark: SparkSession, archives: str) -> dict[str, DataFrame]:
    """Archives to articles, those in force, and the candidates among them with their distributions."""
    members = A.members(spark, archives)
    articles = A.articles(members.where("relevant"))
    current = A.in_force(articles)
    mined = M.mine(current)
    labels = mined.select(F.explode("matched_definition_patterns").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return {"articles": articles, "current": current, "candidates": mined, "labels": labels, "risks": mined.groupBy("noise_risk").agg(F.count("*").alias("n"))}


def exclusion(rows: DataFrame, known: DataFrame, row_id: str = "row_idx") -> DataFrame:
    """Rows with route: excluded_article (a key in common with known records), excluded_term (a known term of the same
    code in the text), without_text, or kept; the first that holds."""
    fields = ("article_id", "source_file", "source_code", "article_number", "date_debut", "date_fin")
    keys = lambda df: C.article_keys(*(R.given(df, n) for n in fields))
    _, articles = C.exclude_known(rows.select(row_id, keys(rows).alias("__keys")), F.col("__keys"), known.select(F.explode(keys(known)).alias("key")), row_id)
    terms = R.known_terms(known).select(F.col("__term").alias("term"), F.col("__code").alias("source_code"))
    text = rows.withColumn("__text", F.coalesce(F.nullif(R.given(rows, "text"), F.lit("")), R.given(rows, "raw_body")))
    _, named = C.exclude_terms(text.select(row_id, "__text", X.normalize_source_code(F.col("source_code")).alias("source_code")), row_id, "__text", terms, "source_code")
    out = text.join(articles.select(row_id, "matched_keys"), row_id, "left").join(named.select(row_id, "matched_terms"), row_id, "left")
    route = F.when(F.col("matched_keys").isNotNull(), "excluded_article").when(F.col("matched_terms").isNotNull(), "excluded_term").when(X.is_blank(F.col("__text")), "without_text").otherwise("kept")
    return out.withColumn("route", route).drop("__text")


def sample_batch(rows: DataFrame, known: DataFrame, n: int, most: int, seed: int, batch: str) -> dict[str, DataFrame]:
    """Exclusion, then the balanced sample of what is kept, ready to annotate."""
    parts = sinks.routes(exclusion(rows, known), ["kept", "excluded_article", "excluded_term"])
    kept = parts["kept"]
    priority = M.priority_score(F.col("matched_definition_patterns"), F.col("candidate_score"), F.col("noise_risk"), F.lit("low_clean"), P.PRIORITY)
    keys = C.article_keys(*(R.given(kept, c) for c in ("article_id", "source_file", "source_code", "article_number", "date_debut", "date_fin")))
    drawn = C.balanced_sample(kept.withColumn("priority", priority), "source_code", "row_idx", F.col("priority"), n, most, seed, keys)
    order = F.row_number().over(C.Window.orderBy("turn", C.seeded(F.col("source_code"), seed), "source_code"))  # at most n rows
    return parts | {"sample": R.annotation_batch(drawn.withColumn("__order", order), batch, "__order").drop("__order")}


def drafts(batch: DataFrame, key: str = "article_id") -> dict[str, DataFrame]:
    """Draft definitions of a batch of articles, with ids and empty review columns, and their counts a pattern."""
    empty = F.lit(None).cast("string")
    made = R.with_draft_ids(M.extract_drafts(batch, key=key))
    review = ("manual_label", "gold_definition_id", "gold_term", "gold_definition", "gold_scope_text", "gold_scope_label", "gold_inferred_scope", "gold_definition_type", "correction_notes")
    comment = F.when(F.col("extraction_confidence") == "medium", "to be checked")
    made = made.withColumn("extraction_comment", comment).withColumns({c: empty for c in review}).drop("k", "i", "place")
    return {"drafts": made, "patterns": made.groupBy("pattern").agg(F.count("*").alias("n"))}


def gold(reviewed: DataFrame) -> dict[str, DataFrame]:
    """Reviewed drafts to gold, rejected and skipped records, and the precision of the drafts."""
    rows = R.gold_from_review(reviewed)
    total = F.count("*").cast("double")
    safe = lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))
    precision = rows.agg(F.count("*").alias("reviewed"), safe(F.count_if(F.col("route") == "gold")).alias("precision_valid_plus_partial"), safe(F.count_if(F.col("manual_label") == "valid_definition")).alias("precision_valid_only"))
    return sinks.routes(rows, ["gold", "rejected", "skipped"]) | {"precision": precision}


def merge(sources: list[tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Sources to merged records, duplicates, skipped rows and counters by source, route and reason."""
    rows = R.merge_sources(sources)
    return sinks.routes(rows, ["merged", "duplicate", "skipped"]) | {"stats": rows.groupBy("annotation_source", "route", "reason").agg(F.count("*").alias("n"))}


def splits(task: str, rows: DataFrame, key: str = "article_key", order: str = "row_idx", seed: int = 2026) -> dict[str, DataFrame]:
    """Rows of a task with their split (whole articles, balanced by the task's label), and the report of the split."""
    tagged = rows.withColumn("__strat", T.stratification_label(task, rows))
    groups = C.group_split(tagged, key, "__strat", order, seed).select(F.col(key).alias("__key"), "split")
    out = tagged.join(groups, tagged[key].eqNullSafe(groups["__key"])).drop("__key")
    fields = [c for c in ("binary_label", "pattern", "source_code") if c in rows.columns]
    return {"rows": T.shuffled(out.drop("__strat"), key, seed), "summary": T.split_summary(out, "split", key, "__strat", *fields)}
