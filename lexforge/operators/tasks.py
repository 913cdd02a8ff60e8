"""Task datasets, split reports and error review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.tables import held, running_index, written
from . import curation as C
from .records import article_key, given

KEPT = ("source_code", "article_number", "article_id", "source_file")


def _cleaned(rows: DataFrame, *names: str) -> list[Column]:
    return [X.clean_text(given(rows, n)).alias(n) for n in names]


def gold_instances(gold: DataFrame) -> DataFrame:
    own = [F.col("definition_id").alias("instance_id"), F.col("definition_id"), article_key(gold).alias("article_key")]
    return gold.select(*own, *_cleaned(gold, *KEPT, "term", "definition", "defined_subject", "raw_body", "pattern", "definition_type", "scope_text", "scope_label", "inferred_scope", "annotation_source", "manual_label"))


def extraction_examples(gold: DataFrame) -> DataFrame:
    """Rows with body, term and definition, as input and targets."""
    body, term, definition = (X.clean_text(given(gold, n)) for n in ("raw_body", "term", "definition"))
    whole = gold.where(body.isNotNull() & term.isNotNull() & definition.isNotNull())
    return whole.select(F.col("definition_id").alias("example_id"), F.lit("term_definition_extraction").alias("task"), body.alias("input_text"), term.alias("target_term"), definition.alias("target_definition"), X.clean_text(given(gold, "defined_subject")).alias("target_defined_subject"), article_key(gold).alias("article_key"), *_cleaned(gold, "source_code", "article_number", "article_id", "pattern", "definition_type", "scope_label"))


def candidate_examples(reviewed: DataFrame, file: str, order: str = "row_idx") -> DataFrame:
    """Reviewed candidates with a verdict (unsure ones go), the first row of each id in order; the input lists term,
    definition and context, whichever there are. A row without id is one of its own, named by file and place."""
    label = X.normalize_label(given(reviewed, "manual_label"))
    own = F.coalesce(X.clean_text(given(reviewed, "candidate_definition_id")), X.clean_text(given(reviewed, "definition_id")), F.concat_ws(":", F.col(file), F.col(order).cast("string")))
    rows = reviewed.withColumn("manual_label", label).where(F.col("manual_label").isin(*P.ACCEPTED_LABELS, "invalid")).withColumn("example_id", own)
    rows = C.first_per_key(rows, ["example_id"], [F.col(order)])
    pick = lambda *names: F.coalesce(*(X.clean_text(given(reviewed, n)) for n in names))
    rows = held(rows, {"__term": pick("term_candidate", "term", "gold_term"), "__definition": pick("definition_candidate", "definition", "gold_definition"), "__body": pick("raw_body")})
    term, definition, body = F.col("__term"), F.col("__definition"), F.col("__body")
    text = F.concat_ws("\n", F.concat(F.lit("TERM: "), term), F.concat(F.lit("DEFINITION: "), definition), F.concat(F.lit("CONTEXT: "), body))
    accepted = F.col("manual_label").isin(*P.ACCEPTED_LABELS)
    made = rows.where(F.coalesce(term, definition, body).isNotNull())
    return made.select("example_id", F.lit("candidate_validation").alias("task"), text.alias("input_text"), term.alias("candidate_term"), definition.alias("candidate_definition"), body.alias("raw_body"), F.when(accepted, "accepted").otherwise("invalid").alias("label"), accepted.cast("int").alias("binary_label"), "manual_label", article_key(reviewed).alias("article_key"), *_cleaned(reviewed, "source_code", "article_number", "article_id", "pattern", "definition_type"), F.col(file).alias("source_review_file"))


def _numbered(rows: DataFrame, order: str, prefix: str, text: Column, label: str, binary: int, origin: str) -> DataFrame:
    slim = written(rows.select(F.col(order).alias("__order"), text.alias("input_text"), "__key", *_cleaned(rows, *KEPT)), "numbered")
    n = running_index(slim, "__order", "__index")
    return n.select(F.concat(F.lit(prefix), F.lpad(F.col("__index").cast("string"), 5, "0")).alias("example_id"), "input_text", F.lit(label).alias("label"), F.lit(binary).alias("binary_label"), F.col("__key").alias("article_key"), *KEPT, F.lit(origin).alias("origin"), "__index")


def article_examples(gold: DataFrame, candidates: DataFrame, order: str = "row_idx", share: float = 1.2) -> DataFrame:
    """The first body of each gold article (positive), and the first candidates, at most ``share`` times as many, that are
    no gold article and have a text (negative)."""
    rows = held(gold.withColumn("__key", article_key(gold)), {"__text": X.clean_text(given(gold, "raw_body"))}).where("__text is not null")
    positive = _numbered(C.first_per_key(rows, ["__key"], [F.col(order)]), order, "article_pos_", F.col("__text"), "definition_article", 1, "gold_positive")
    text = X.clean_text(F.coalesce(F.nullif(given(candidates, "text"), F.lit("")), given(candidates, "raw_body")))
    others = held(candidates.withColumn("__key", article_key(candidates)), {"__text": text}).where("__text is not null").join(positive.select(F.col("article_key").alias("__key")), "__key", "left_anti")
    most = positive.agg(F.floor(F.count("*") * share).alias("n")).scalar()
    negative = _numbered(others, order, "article_neg_", F.col("__text"), "non_definition_article", 0, "low_clean_candidate_not_in_gold").where(F.col("__index") <= most)
    return positive.unionByName(negative).drop("__index")


def certified_examples(positives: DataFrame, negatives: DataFrame, order: str = "row_idx", seed: int = 2026) -> DataFrame:
    """All certified negatives with a text (first row of an article) and as many positives, drawn in seeded order; fails if
    there are too few. ``shuffled`` orders the rows of the result."""
    text = lambda rows: X.first_given(given(rows, "input_text"), given(rows, "text"), given(rows, "raw_body"))
    rank = lambda rows: F.conv(F.substring(C.seeded(F.col("__key"), seed), 1, 15), 16, 10).cast("long")
    first = lambda rows: C.first_per_key(rows.withColumn("__key", article_key(rows)), ["__key"], [F.col(order)])
    negative = _numbered(first(negatives).where(text(negatives).isNotNull()), order, "cert_neg_", text(negatives), "certified_true_negative", 0, "certified_true_negative_pool")
    needed = negative.agg(F.count("*").alias("n")).scalar()
    pool = first(positives.where("binary_label = 1"))
    drawn = pool.withColumn("__rank", rank(pool))
    positive = _numbered(drawn, "__rank", "cert_pos_", text(positives), "definition_article", 1, "gold_positive").where(F.col("__index") <= needed)
    enough = F.when(pool.agg(F.count("*").alias("n")).scalar() < needed, F.raise_error(F.lit("not enough positive articles")).cast("int")).otherwise(F.col("binary_label"))
    return positive.unionByName(negative).withColumn("binary_label", enough).drop("__index")


def shuffled(rows: DataFrame, key: str, seed: int = 2026) -> DataFrame:
    return rows.orderBy(C.seeded(F.col(key), seed), key)


def stratification_label(task: str, rows: DataFrame) -> Column:
    """What a split of the task balances: its binary label, its coarse pattern, or nothing."""
    if task in ("article_classification", "candidate_validation"):
        return F.coalesce(given(rows, "binary_label").cast("string"), F.lit("unknown"))
    return X.coarse_pattern(X.unknown_if_blank(given(rows, "pattern"))) if task == "term_definition_extraction" else F.lit("all")


def split_summary(rows: DataFrame, split: str, key: str, *fields: str) -> DataFrame:
    """split, field, value, n, ratio: sizes (field rows, ratio to all rows, null of none) and distributions of fields, for
    each split and for all; and for all the number of keys that lie in several splits (field overlap)."""
    both = rows.withColumn("__split", F.explode(F.array(F.col(split), F.lit("all"))))
    pairs = F.array(F.struct(F.lit("rows").alias("field"), F.lit("").alias("value")), *(F.struct(F.lit(f).alias("field"), X.unknown_if_blank(F.col(f).cast("string")).alias("value")) for f in fields))
    n = both.select(F.col("__split").alias("split"), F.explode(pairs).alias("p")).groupBy("split", "p.field", "p.value").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").cast("double").alias("n")).scalar()
    counts = n.withColumn("ratio", F.when(F.col("field") == "rows", F.try_divide(F.col("n").cast("double"), total)))
    several = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.countDistinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("n"))
    return counts.unionByName(several.select(F.lit("all").alias("split"), F.lit("overlap").alias("field"), F.lit("").alias("value"), "n", F.lit(None).cast("double").alias("ratio")))


def select_predictions(rows: DataFrame, model: str, split: str) -> DataFrame:
    """The predictions of a model on a split; the job that reads them fails if there are none."""
    chosen = rows.where((F.col("model") == model) & (F.col("split") == split))
    if not chosen.head(1):
        raise ValueError(f"no predictions of {model} on {split}")
    return chosen


def error_type() -> Column:
    gold, pred = F.col("gold_label"), F.col("pred_label")
    return F.when((gold == 0) & (pred == 1), "false_positive_invalid_predicted_accepted").when((gold == 1) & (pred == 0), "false_negative_accepted_predicted_invalid").otherwise("correct")


def diagnostic_hint(rows: DataFrame) -> Column:
    """Hints to review an error by, joined by blanks; empty for a correct row."""
    flat = lambda n: X.clean_flat(given(rows, n))
    pattern, term, definition, body = F.lower(flat("pattern")), flat("candidate_term"), flat("candidate_definition"), flat("raw_body")
    words = X.word_total(definition)
    hint = lambda name, test=None: F.when(F.lit(True) if test is None else test, P.HINTS[name])
    kept = [hint("kept_invalid"), hint("colon", pattern == "terme_colon_definition"), hint("short", words < 4), hint("absent", (term != "") & ~F.contains(F.lower(body), F.lower(term)))]
    lost = [hint("rejected_accepted"), hint("partial", flat("manual_label") == "partial"), hint("canonical", pattern.isin("s'entend de", "on entend par")), hint("long", words > 40)]
    return F.when(F.col("error_type").startswith("false_positive"), F.concat_ws(" ", *kept)).when(F.col("error_type").startswith("false_negative"), F.concat_ws(" ", *lost)).otherwise("")


def short_text(c: Column, most: int = 500) -> Column:
    flat = X.clean_flat(c)
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def review_errors(rows: DataFrame) -> DataFrame:
    """Wrong predictions with their kind, hints and a short input."""
    made = rows.withColumn("error_type", error_type()).where("error_type <> 'correct'")
    return made.withColumn("input_text_short", short_text(given(rows, "input_text"))).withColumn("diagnostic_hint", diagnostic_hint(rows))


def error_rate(rows: DataFrame) -> DataFrame:
    """rows, errors, error_rate (null of no rows)."""
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("gold_label") != F.col("pred_label")).alias("errors")).withColumn("error_rate", F.try_divide(F.col("errors").cast("double"), F.col("rows")))
