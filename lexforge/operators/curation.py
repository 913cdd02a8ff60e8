"""Keys, exclusion joins, sampling, splits, review routing, merging, validation and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import patterns as P
from ..functions import text as X
from ..functions.tables import held, is_few, written
from . import tfidf as W


def seeded(key: Column, seed: int) -> Column:
    """A reproducible order: md5 of key and seed, the same in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def article_keys(article_id: Column, source_file: Column, code: Column, number: Column, begin: Column | None = None, end: Column | None = None) -> Column:
    """Up to four keys under which an article may be known already: its id, its file, its code and number, these with
    both dates."""
    article_id, source_file, code, number = X.normalize_key(article_id), X.normalize_key(source_file), X.normalize_source_code(code), X.normalize_article_number(number)
    has = lambda *cs: X.all_of([c != "" for c in cs])
    keys = [F.when(has(article_id), F.concat(F.lit("article_id::"), article_id)), F.when(has(source_file), F.concat(F.lit("source_file::"), source_file)), F.when(has(code, number), F.concat_ws("::", F.lit("source_article"), code, number))]
    if begin is not None and end is not None:
        begin, end = X.normalize_key(begin), X.normalize_key(end)
        keys.append(F.when(has(code, number, begin, end), F.concat_ws("::", F.lit("source_article_dates"), code, number, begin, end)))
    return F.array_compact(F.array(*keys))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exclude_known(rows: DataFrame, keys: Column, known: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with matched_keys): rows sharing any key with known (key); joined by key, either side as large."""
    hit = rows.select(row_id, F.explode(keys).alias("key")).join(known.select("key").distinct(), "key").groupBy(row_id).agg(F.array_sort(F.collect_set("key")).alias("matched_keys"))
    return rows.join(hit, row_id, "left_anti"), rows.join(hit, row_id)


def exclude_terms(rows: DataFrame, row_id: str, text: str, terms: DataFrame, code: str | None = None, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with matched_terms, longest first): rows whose text holds a known term (``term``) as whole words,
    of the same ``code`` where one is named (compared as keys; a blank one matches nothing). Any white space or mark
    stands between words; terms of under ``least`` characters are no terms.

    A term is an n-gram of bare words. Where a count shows the list to be short it is broadcast: each word of a text meets
    the terms that begin with it, and the words that follow are compared. A long list is shuffled, to be joined by
    equality with the n-grams of the lengths that occur in it.
    """
    same = X.normalize_key(F.col(code)) if code else F.lit("*")
    words = X.bare_words(F.col("term"))
    known = terms.select(same.alias("__c"), F.array_join(words, " ").alias("__t"), F.size(words).alias("__n")).where((F.length("__t") >= least) & (F.col("__c") != "")).distinct()
    known = written(known, "terms")
    few = is_few(known)
    d = rows.select(row_id, same.alias("__c"), X.bare_words(F.col(text)).alias("__w")).where(F.col("__c") != "")
    if few:
        first = known.withColumn("__f", F.split_part("__t", F.lit(" "), F.lit(1)))
        at = d.select(row_id, "__c", "__w", F.posexplode("__w").alias("__p", "__f"))
        hit = at.join(F.broadcast(first), ["__c", "__f"]).where(F.array_join(F.slice("__w", F.col("__p") + 1, F.col("__n")), " ") == F.col("__t"))
    else:
        lengths = sorted(r[0] for r in known.select("__n").distinct().collect())
        gram = lambda n: F.expr(f"CASE WHEN size(__w) >= {n} THEN array_distinct(transform(sequence(1, size(__w) - {n - 1}), i -> array_join(slice(__w, i, {n}), ' '))) ELSE array() END")
        d = d.select(row_id, "__c", F.explode(F.concat(*map(gram, lengths))).alias("__t"))
        hit = d.join(known.select("__c", "__t"), ["__c", "__t"])
    hit = hit.groupBy(row_id).agg(F.array_sort(F.collect_set(F.struct((-F.length("__t")).alias("n"), F.col("__t").alias("t")))).alias("x"))
    hit = hit.select(row_id, F.col("x.t").alias("matched_terms"))
    return rows.join(hit, row_id, "left_anti"), rows.join(hit, row_id)


def balanced_sample(rows: DataFrame, code: str, key: str, priority: Column, n: int, most: int, seed: int, keys: Column | None = None) -> DataFrame:
    """Round-robin over codes in seeded order, best priority first, at most ``most`` a code, n in all. With ``keys`` (the
    article keys of a row), a candidate that shares one with a selected row is passed over for the next of its code."""
    w = Window.partitionBy(code).orderBy(priority.desc(), seeded(F.col(key), seed), key)
    ranked = rows.withColumn("turn", F.row_number().over(w))
    if keys is not None:
        return _without_conflicts(ranked.withColumn("__keys", keys), code, key, n, most, seed)
    return ranked.where(F.col("turn") <= most).orderBy("turn", seeded(F.col(code), seed), code).limit(n)


def _without_conflicts(ranked: DataFrame, code: str, key: str, n: int, most: int, seed: int) -> DataFrame:
    """The sequential choice, on the first candidates of each code; with twice as many where a code runs out of them."""
    sizes = {r[0]: r[1] for r in ranked.groupBy(code).count().collect()}
    depth = most
    while True:
        groups: dict = {}
        found = ranked.where(F.col("turn") <= depth).select(F.col(code).alias("code"), F.col(key).alias("key"), F.col("turn").alias("at"), "__keys", seeded(F.col(code), seed).alias("h"))
        for r in sorted(found.collect(), key=lambda r: (r["h"] is not None, r["h"] or "", r["at"])):
            groups.setdefault(r["code"], []).append(r)
        taken, known, at, short = [], set(), dict.fromkeys(groups, 0), False
        for turn in range(1, most + 1):
            for c, group in groups.items():
                while len(taken) < n and at[c] < len(group):
                    r = group[at[c]]
                    at[c] += 1
                    if known.isdisjoint(r["__keys"] or ()):
                        known.update(r["__keys"] or ())
                        taken.append((r["key"], r["at"], turn, len(taken), r["code"]))
                        break
                else:
                    short |= len(taken) < n and len(group) < sizes[c]
        if not short:
            break
        depth *= 2
    types = ranked.schema
    chosen = ranked.sparkSession.createDataFrame(taken, StructType([StructField("__k", types[key].dataType), StructField("__at", LongType()), StructField("__turn", LongType()), StructField("__n", LongType()), StructField("__code", types[code].dataType)]))
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("turn") == F.col("__at")) & F.col(code).eqNullSafe(F.col("__code"))
    names = [c for c in ranked.columns if c not in ("turn", "__keys")]
    return ranked.join(F.broadcast(chosen), same).orderBy("__n").select(*names, F.col("__turn").cast("int").alias("turn"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def group_split(rows: DataFrame, key: str, label: str, order: str, seed: int = 2026) -> DataFrame:
    """key, label, split: groups by key, majority label (ties: first seen), 70/15/15 a label, half-even, never empty
    from three groups on."""
    n = rows.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    groups = n.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("label"))
    at = F.row_number().over(Window.partitionBy("label").orderBy(seeded(F.col(key), seed), key))
    g = groups.join(groups.groupBy("label").agg(F.count("*").alias("size")), "label").withColumn("at", at)
    train, dev, size = F.rint(F.col("size") * 0.7), F.rint(F.col("size") * 0.15), F.col("size")
    train = F.when(size >= 3, F.least(F.greatest(train, F.lit(1.0)), size - 2)).otherwise(train)
    dev = F.when(size >= 3, F.least(F.greatest(dev, F.lit(1.0)), size - train - 1)).otherwise(dev)
    return g.select(key, "label", F.when(F.col("at") <= train, "train").when(F.col("at") <= train + dev, "dev").otherwise("test").alias("split"))


def review_route(label: Column, term: Column, definition: Column) -> Column:
    label = F.lower(F.btrim(label))
    whole = (F.coalesce(term, F.lit("")) != "") & (F.coalesce(definition, F.lit("")) != "")
    return F.when(label.isin("valid_definition", "partial"), F.when(whole, "gold").otherwise("skipped")).when(label.isin("invalid", "unsure"), "rejected").otherwise("skipped")


def apply_review(drafts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drafts with a reviewer's label and gold fields: valid copies the candidate, partial keeps edits, invalid clears."""
    d = drafts.join(decisions, "candidate_definition_id", "left")
    term, body = F.col("gold_term"), F.col("gold_definition")
    valid, invalid = F.col("manual_label") == "valid_definition", F.col("manual_label") == "invalid"
    return d.withColumns({"gold_term": F.when(valid, F.col("term_candidate")).when(~invalid, F.coalesce(F.nullif(term, F.lit("")), "term_candidate")), "gold_definition": F.when(valid, F.col("definition_candidate")).when(~invalid, F.coalesce(F.nullif(body, F.lit("")), "definition_candidate"))})


def apply_corrections(gold: DataFrame, corrections: DataFrame) -> DataFrame:
    """Gold rows under an audit's overlay (one row a definition_id): corrected fields that are not null replace, rows of
    status remove go, and all other rows stay. A correction of an unknown id changes nothing."""
    new = corrections.select(*(F.col(c).alias(f"__{c}") for c in corrections.columns))
    d = gold.join(new, F.col("definition_id") == F.col("__definition_id"), "left").where(F.coalesce(F.col("__correction_status"), F.lit("")) != "remove")
    return d.select(*(F.coalesce(f"__{c}", c).alias(c) if c in corrections.columns and c != "definition_id" else F.col(c) for c in gold.columns))


def duplicate_report(rows: DataFrame, key: Column, row_id: str, order: list) -> DataFrame:
    """Rows after the first of a key, each with the id of that first row (original_id)."""
    w = Window.partitionBy("__k").orderBy(*order)
    tagged = rows.withColumn("__k", key).withColumn("original_id", F.first(row_id).over(w)).withColumn("__n", F.row_number().over(w))
    return tagged.where("__n > 1").drop("__k", "__n")


def merge_versions(rows: DataFrame, exact: Column, coarse: Column, order: list, originals: Column | None = None) -> DataFrame:
    """Adds keep and reason (first, exact_duplicate, same_article_term): a greedy pass in ``order`` keeps a row unless a
    kept one has its exact or its coarse key. Where equal exact keys have equal coarse keys, which is checked, that is the
    first row of each coarse key; elsewhere rounds settle it. ``originals`` adds that column of the kept row as original."""
    digest = lambda c: F.unhex(F.sha2(F.to_json(F.struct(c.alias("k"))), 256))
    by = {f"__by{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    more = {} if originals is None else {"__o": originals}
    tagged = held(rows, {"__c": digest(coarse), "__e": digest(exact)}).withColumns(by | more).withColumn("__id", F.monotonically_increasing_id())
    tagged = written(tagged, "merge")
    slim = tagged.select("__id", "__c", "__e", *by, *more)
    if slim.groupBy("__e").agg(F.min("__c").alias("a"), F.max("__c").alias("b")).where("a <> b").head(1):
        found = written(_merge_in_rounds(slim, list(by)), "merge-found")
        return tagged.join(found, "__id").drop("__c", "__e", "__id", *by, *more)
    w = Window.partitionBy("__c").orderBy(*by)
    tagged = tagged.withColumn("__n", F.row_number().over(w)).withColumn("__f", F.first("__e").over(w))
    reason = F.when(F.col("__n") == 1, "first").when(F.col("__e") == F.col("__f"), "exact_duplicate").otherwise("same_article_term")
    if originals is not None:
        tagged = tagged.withColumn("original", F.when(F.col("__n") > 1, F.first("__o").over(w)))
    return tagged.withColumn("reason", reason).withColumn("keep", F.col("__n") == 1).drop("__c", "__e", "__n", "__f", "__id", *by, *more)


def _merge_in_rounds(rows: DataFrame, order: list[str]) -> DataFrame:
    """__id, keep, reason and, where there is __o, original of ``rows`` (__id, digests of both keys, order). Each round
    keeps the open rows that are first of the open rows of both their keys and drops what shares a key with them; the
    first open row of all is always one, so the rounds end with the choice of the sequential pass. Tables of a round are
    written to the shared folder."""
    by = lambda k: Window.partitionBy(k).orderBy(*order, "__id")
    over = lambda c, k: F.max(c).over(Window.partitionBy(k))
    kept, left = rows.select("__id").limit(0), rows.select("__id", "__c", "__e", *order)
    while left.head(1):
        ranked = left.withColumn("__first", (F.row_number().over(by("__e")) == 1) & (F.row_number().over(by("__c")) == 1))
        ranked = written(ranked.withColumn("__gone", over("__first", "__e") | over("__first", "__c")), "merge-round")
        kept = kept.unionByName(ranked.where("__first").select("__id"))
        left = ranked.where(~F.col("__gone")).select("__id", "__c", "__e", *order)
    out = rows.join(kept.withColumn("keep", F.lit(True)), "__id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    known = F.max("keep").over(by("__e").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("reason", F.when(F.col("keep"), "first").when(known, "exact_duplicate").otherwise("same_article_term"))
    if "__o" not in out.columns:
        return out.select("__id", "keep", "reason")
    of = lambda k: over(F.when(F.col("keep"), F.col("__o")), k)
    out = out.withColumn("__x", of("__e")).withColumn("__y", of("__c"))
    return out.select("__id", "keep", "reason", F.when(F.col("reason") == "exact_duplicate", F.col("__x")).when(~F.col("keep"), F.col("__y")).alias("original"))


def missing_fields(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds missing: the required fields that the JSON object of a line has no key for (a null value is a value)."""
    keys = F.coalesce(F.json_object_keys(F.col(raw)), F.array().cast("array<string>"))
    return lines.withColumn("missing", F.array_except(F.array(*map(F.lit, P.REQUIRED)), keys))


def validate_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """As validate(), of JSON lines (row_idx, raw): a line that lacks required fields breaks that rule alone, and its id
    is not taken as seen."""
    schema = ", ".join(f"{c} string" for c in P.REQUIRED)
    rows = missing_fields(lines, raw).withColumn("r", F.from_json(raw, schema))
    lacking = rows.where(F.size("missing") > 0)
    named = F.concat(F.lit("missing fields: "), F.array_join("missing", ", "))
    broken = lacking.select(F.coalesce("r.definition_id", F.concat(F.lit("line_"), F.col("row_idx").cast("string"))).alias("definition_id"), F.lit("error").alias("severity"), named.alias("message"))
    return broken.unionByName(validate(rows.where(F.size("missing") == 0).select("row_idx", "r.*")))


def gate(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings and passed; ``require_passed`` turns it into a failure."""
    n = lambda kind: F.count_if(F.col("severity") == kind)
    return findings.agg(n("error").alias("errors"), n("warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)


def require_passed(findings: DataFrame) -> DataFrame:
    """The gate as a job: it fails if there is any error."""
    return gate(findings).withColumn("passed", F.when(F.col("passed"), True).otherwise(F.raise_error(F.concat(F.lit("validation errors: "), F.col("errors").cast("string"))).cast("boolean")))


def validate(rows: DataFrame) -> DataFrame:
    """definition_id, severity, message of every broken constraint of the declared schema."""
    blank = lambda c: F.coalesce(F.btrim(F.col(c)), F.lit("")) == ""
    error = lambda test, message: F.when(test, F.struct(F.lit("error").alias("severity"), F.lit(message).alias("message")))
    warn = lambda test, message: F.when(test, F.struct(F.lit("warning").alias("severity"), F.lit(message).alias("message")))
    again = F.row_number().over(Window.partitionBy("definition_id").orderBy("row_idx")) > 1
    body = F.col("raw_body")
    tests = [error(F.col("__again"), "duplicate definition_id")]
    tests += [error(blank(c), f"empty {c}") for c in ("definition_id", "source_code", "article_number", "term", "definition", "pattern", "definition_type", "raw_body")]
    tests += [error(~F.coalesce(F.col("scope_label").isin(*P.SCOPE_LABELS), F.lit(False)), "bad scope_label"), error(F.col("inferred_scope").isNotNull() & ~F.col("inferred_scope").isin(*P.SCOPE_LABELS), "bad inferred_scope"), error(~F.coalesce(F.col("definition_type").isin(*P.DEFINITION_TYPES), F.lit(False)), "bad definition_type")]
    tests += [warn(F.col("scope_text").isNull() & (F.col("scope_label") != "unspecified"), "scope_label without scope_text"), error((F.col("definition_type") == "explicit_qualification") & blank("defined_subject"), "qualification without defined_subject"), warn((F.col("definition_type") != "explicit_qualification") & ~blank("defined_subject"), "unexpected defined_subject"), warn(~body.contains(F.btrim(F.col("term"), F.lit(" \t\r\n"))), "term not in raw_body"), warn(~body.contains(F.left(F.btrim(F.col("definition")), F.lit(40))), "definition not in raw_body")]
    return rows.withColumn("__again", again).select("definition_id", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("definition_id", "x.*")


def binary_metrics(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: the confusion matrix, accuracy, per-class and macro F1, and Cohen's kappa; 0 where undefined."""
    cell = lambda g, p: F.count_if((F.col(gold) == g) & (F.col(pred) == p))
    m = rows.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    n = F.expr("tn + fp + fn + tp").cast("double")
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1, f0 = safe(F.expr("2.0D * tp"), F.expr("2.0D * tp + fp + fn")), safe(F.expr("2.0D * tn"), F.expr("2.0D * tn + fp + fn"))
    agree, chance = safe(F.expr("(tp + tn) * 1.0D"), n), safe(F.expr("((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) * 1.0D"), n * n)
    return m.select("tn", "fp", "fn", "tp", F.round(agree, 6).alias("accuracy"), F.round(f1, 6).alias("f1_positive"), F.round(f0, 6).alias("f1_negative"), F.round((f0 + f1) / 2, 6).alias("macro_f1"), F.round(safe(agree - chance, 1 - chance), 6).alias("kappa"))


def distribution(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Counts by value, null as unknown, most frequent first, ties as first seen."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def _word_lots(docs: DataFrame, key: str, text: str, least: int, most: float) -> tuple[DataFrame, DataFrame]:
    words = F.regexp_extract_all(F.lower(X.strip_accents(F.col(text))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    lots = W.in_lots(docs, key, text, F.array_join(words, " "), F.lit(True))
    return lots, W.idf_by_lot(lots, W.word_pairs, least, most)


def word_tfidf(docs: DataFrame, key: str, text: str, least: int = 2, most: float = 0.95) -> DataFrame:
    """key, term, weight: words of two or more letters, digits or underscores and their bigrams, sublinear tf, smooth
    idf, L2 norm."""
    return W.weights(*_word_lots(docs, key, text, least, most), W.word_pairs, key)


def word_tops(docs: DataFrame, key: str, text: str, least: int = 2, most: float = 0.95) -> DataFrame:
    """key, terms, top_weight: how many weights word_tfidf() gives a document, and the largest."""
    return W.tops(*_word_lots(docs, key, text, least, most), W.word_pairs, key)
