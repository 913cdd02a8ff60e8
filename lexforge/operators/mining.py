"""Candidate mining: labels hit, score, risk, preview; scope inference; term and context filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def matched_labels(text: Column, inventory=P.INVENTORY) -> Column:
    """The labels whose pattern hits. One alternation of all patterns goes first: a text that it misses is read once."""
    single = F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(P.FLAGS + regex)), label) for label, _, regex in inventory)))
    some = "|".join(f"(?:{regex})" for _, _, regex in inventory)
    return F.when(F.rlike(text, F.lit(P.FLAGS + some)), single) if len(inventory) > 8 else single


def article_text(articles: DataFrame, text: str = "text", other: str = "raw_text") -> Column:
    """The text of an article, or its raw text where the first is missing or empty."""
    return F.coalesce(F.nullif(F.col(text), F.lit("")), F.col(other)) if other in articles.columns else F.col(text)


def mine(articles: DataFrame, text: str = "text", inventory=P.INVENTORY) -> DataFrame:
    """Adds matched_definition_patterns, matched_pattern_categories, candidate_score, noise_risk, text_preview to the
    rows with a text that any pattern hits. A generator makes the labels, so that the optimiser keeps one copy of the
    patterns: it would repeat them in a filter on the labels."""
    labels, own = F.col("matched_definition_patterns"), article_text(articles, text)
    by = {c: [label for label, own_c, _ in inventory if own_c == c] for c in P.CATEGORY_SCORE}
    hits = {c: F.size(F.array_intersect(labels, F.array(*map(F.lit, ls)))) if ls else F.lit(0) for c, ls in by.items()}
    score = sum((P.CATEGORY_SCORE[c] * n for c, n in hits.items()), F.lit(0))
    found = matched_labels(own, inventory)
    # An empty list gives no row: explode drops what no pattern hits.
    one = F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x))
    out = articles.withColumn("matched_definition_patterns", F.explode(F.array_compact(one)))
    categories = F.array_compact(F.array(*(F.when(hits[c] > 0, c) for c in sorted(hits))))
    risk = F.when(hits["strong"] > 0, "low").when(hits["medium"] > 0, "medium").otherwise("high")
    return out.withColumns({"matched_pattern_categories": categories, "candidate_score": score.cast("int"), "noise_risk": risk, "text_preview": X.preview(own)})


def priority_score(labels: Column, score: Column, risk: Column, stratum: Column, priority=P.PRIORITY) -> Column:
    own = F.aggregate(labels, F.lit(0), lambda a, x: a + F.when(x.isin(*priority), 3).otherwise(1))
    return own + F.coalesce(score, F.lit(0)) + F.when(risk == "low", 2).otherwise(0) + F.when(stratum == "low_clean", 1).otherwise(0)


def infer_scope(text: Column) -> Column:
    """struct (scope_text, scope_label, inferred_scope) of the first scope pattern that matches."""
    found = [F.when(F.rlike(text, F.lit(P.SPAN_FLAGS + r)), F.struct(F.regexp_extract(text, P.SPAN_FLAGS + r, 0).alias("scope_text"), F.lit(label).alias("scope_label"), F.lit(label).alias("inferred_scope"))) for r, label in P.SCOPES]
    return F.coalesce(*found, F.struct(F.lit(None).cast("string").alias("scope_text"), F.lit("unspecified").alias("scope_label"), F.lit("article").alias("inferred_scope")))


def is_bad_term(term: Column) -> Column:
    t = F.btrim(F.lower(term))
    return t.isin(*P.BAD_TERMS) | X.any_of([t.startswith(s) for s in P.BAD_TERM_STARTS] + [t.contains(s) for s in P.BAD_TERM_PARTS] + [F.rlike(t, F.lit("(?U)" + r)) for r in P.BAD_TERM_REGEXES]) | (X.word_total(term) > 10)


def is_bad_colon_context(term: Column, body: Column) -> Column:
    t, b = F.lower(term), F.lower(body)
    return X.any_of([t.contains(s) for s in P.BAD_COLON_TERM_PARTS] + [b.contains(s) for s in P.BAD_COLON_BODY_PARTS] + [t.startswith(s) for s in P.BAD_COLON_STARTS]) | (X.word_total(term) > 12)


SPANS = "array<struct<k:int,i:int,pattern:string,item_number:string,defined_subject:string,term_candidate:string,definition_candidate:string,raw_body:string>>"


def extract_drafts(articles: DataFrame, text: str = "text", key: str = "id", drafts=P.DRAFTS) -> DataFrame:
    """One row per kept span: article columns, pattern, item_number, defined_subject, term_candidate,
    definition_candidate, raw_body, definition_type, extraction_confidence, scope and place (1, 2, ... within the article
    and the kind of pattern). Of the kept spans of equal article key,
    pattern, term and definition (nulls equal) the first in order of regex and place stays."""
    body, marks = F.col("__body"), ("\ue000", "\ue001")

    def spans_of(k: int, pattern: str, flags: str, regex: str, groups: dict[str, int]) -> Column:
        whole = {"raw": 0} | groups
        each = lambda n: F.regexp_extract_all(body, F.lit(flags + regex), F.lit(n))
        zipped = F.arrays_zip(*(each(i).alias(n) for n, i in whole.items()))
        # One pass gives all groups between marks; a text that has the marks itself takes a pass a group.
        marked = F.regexp_replace(body, flags + regex, marks[0] + marks[1].join(f"${i}" for i in whole.values()) + marks[0])
        cut = F.split(marked, marks[0])
        at = F.filter(cut, lambda x, i: i % 2 == 1)
        once = F.transform(at, lambda x: F.struct(*(F.get(F.split(x, marks[1]), F.lit(j)).alias(n) for j, n in enumerate(whole))))
        found = F.when(F.rlike(body, F.lit(f"[{''.join(marks)}]")), zipped).otherwise(once)
        pick = lambda x, n: X.clean_span(x[n]) if n in groups else F.lit(None).cast("string")
        meaning = lambda x: X.truncate_at_boundary(x["definition"], 800) if pattern == "on entend par" else X.clean_span(x["definition"])
        made = F.transform(found, lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.lit(pattern).alias("pattern"), pick(x, "item").alias("item_number"), pick(x, "subject").alias("defined_subject"), pick(x, "term").alias("term_candidate"), meaning(x).alias("definition_candidate"), X.clean_span(x["raw"]).alias("raw_body")))
        needed = P.NEEDED.get(regex)
        return F.when(F.rlike(body, F.lit(P.SPAN_FLAGS + needed)), made) if needed else made

    found = [F.coalesce(s, F.array().cast(SPANS)) for s in (spans_of(k, *draft) for k, draft in enumerate(drafts))]
    spaced = articles.withColumn("__body", F.explode(F.array(X.normalize_space(F.col(text)))))  # explode: one copy of the text
    d = spaced.withColumn("d", F.explode(F.concat(*found))).select(*articles.columns, "d.*")
    term, words = F.col("term_candidate"), X.word_total(F.col("term_candidate"))
    most = F.coalesce(*(F.when(F.col("pattern") == p, n) for p, n in P.MOST_TERM_WORDS.items()), F.lit(10))
    good = term.isNotNull() & F.col("definition_candidate").isNotNull() & (F.col("definition_candidate") != "") & F.col("raw_body").isNotNull() & ~is_bad_term(term) & (words <= most)
    good &= ~((F.col("pattern") == "terme_colon_definition") & is_bad_colon_context(term, F.col("raw_body")))
    qualified = F.col("k").isin([k for k, draft in enumerate(drafts) if "subject" in draft[3]])
    good &= ~qualified | (F.col("defined_subject").isNotNull() & (X.word_total(F.col("defined_subject")) <= 15))
    cut = F.when((F.col("pattern") == "on entend par") & (F.length("raw_body") > 1100), F.concat(F.rtrim(F.left("raw_body", F.lit(1100))), F.lit("..."))).otherwise(F.col("raw_body"))
    kind = F.when(qualified, "explicit_qualification").otherwise("explicit")
    sure = F.when(qualified | (F.col("pattern") == "défini comme"), "medium").otherwise("high")
    place = F.row_number().over(Window.partitionBy(key, F.coalesce(*(F.when(F.col("pattern") == p, p) for p in P.MOST_TERM_WORDS), F.when(qualified, "qualification"), F.col("pattern"))).orderBy("k", "i"))
    first = F.row_number().over(Window.partitionBy(key, "pattern", "term_candidate", "definition_candidate").orderBy("k", "i", "raw_body"))
    d = d.where(good).withColumn("place", place).withColumn("__n", first).where("__n = 1").drop("__n")
    return d.withColumns({"raw_body": cut, "definition_type": kind, "extraction_confidence": sure}).withColumn("scope", infer_scope(F.col("raw_body"))).select("*", "scope.*").drop("scope")


def rule_extract(text: Column) -> Column:
    """struct (term, definition, rule) of the first rule that gives both, else null."""
    out = []
    for rule, regex, terms, definition in P.RULES:
        r = P.DOTALL_FLAGS + regex
        term = X.clean_flat(F.coalesce(*(F.nullif(F.regexp_extract(text, r, i), F.lit("")) for i in terms)))
        if rule == "sentend_de":
            term = F.btrim(F.regexp_replace(term, P.SPAN_FLAGS + P.SCOPE_PREFIX, ""))
        body = X.trim_definition(F.regexp_extract(text, r, definition))
        out.append(F.when((term != "") & (body != ""), F.struct(F.btrim(term, F.lit(' "“”')).alias("term"), body.alias("definition"), F.lit(rule).alias("rule"))))
    return F.coalesce(*out)
