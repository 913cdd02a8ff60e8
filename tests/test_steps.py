"""Steps that must not grow beyond their input: what a plan repeats, and the same results on odd rows."""

import re

from pyspark.sql import functions as F

from lexforge import record_queries as RQ
from lexforge.functions import patterns as P
from lexforge.functions import text as X
from lexforge.operators import curation as C
from lexforge.operators import mining as M
from lexforge.operators import tasks as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drafts_normalise_a_text_once(spark):
    rows = [(1, "red fox : runs over the hill; blue cat: sleeps in the sun all day"), (2, "no colon"), (3, None), (4, "\ue000 red fox : runs \ue001 over the hill")]
    d = M.extract_drafts(spark.createDataFrame(rows, "id int, text string"), drafts=P.NEUTRAL_DRAFTS)
    got = sorted((r["id"], r["term_candidate"], r["definition_candidate"]) for r in d.collect())
    assert got == [(1, "blue cat", "sleeps in the sun all day"), (1, "red fox", "runs over the hill"), (4, "red fox", "runs \ue001 over the hill")]
    assert plan(d).count("(text#") == 1
    own = [("x", "", "(e)(d)?", {"term": 1, "definition": 2})]
    assert M.extract_drafts(spark.createDataFrame(rows, "id int, text string"), drafts=own).count() > 0


def test_short_list_of_terms_makes_no_ngrams(spark):
    rows = spark.createDataFrame([(1, "A", "Été bleu, été  bleu clair"), (2, "B", "été bleu"), (3, "A", "bleu"), (4, "", "été bleu"), (5, "A", None), (6, "A", "clair été")], "id int, code string, t string")
    terms = spark.createDataFrame([("été bleu", "a"), ("Été bleu clair", "A"), ("bleu clair", "A"), ("clair ete bleu", "A"), ("été", "B"), ("bl", "A"), (None, "A")], "term string, code string")
    kept, gone = C.exclude_terms(rows, "id", "t", terms, "code")
    assert {r["id"]: r["matched_terms"] for r in gone.collect()} == {1: ["ete bleu clair", "bleu clair", "ete bleu"], 2: ["ete"]}
    assert {r["id"] for r in kept.collect()} == {3, 4, 5, 6} and "sequence(" not in plan(gone)
    assert C.exclude_terms(rows, "id", "t", terms.limit(0), "code")[1].count() == 0


def test_long_list_of_terms(spark, monkeypatch):
    monkeypatch.setattr(C, "is_few", lambda df: False)
    rows = spark.createDataFrame([(1, "été bleu clair"), (2, "bleu")], "id int, t string")
    terms = spark.createDataFrame([("bleu clair",), ("été",)], "term string")
    assert [(r["id"], r["matched_terms"]) for r in C.exclude_terms(rows, "id", "t", terms)[1].collect()] == [(1, ["bleu clair", "ete"])]


def test_white_space_by_python(spark):
    space = lambda t: re.sub(r"[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", t.translate({0xA0: " ", 0x2028: "\n", 0x2029: "\n"}))).strip(" \n\t\r")
    wide = "[\t-\r \x85\xa0  -     　]+"
    flat = lambda t: re.sub(wide, " ", t.replace("’", "'")).strip(" ")
    hard = ["", " ", "a b", "a  b", "a\tb", "\xa0a\xa0\xa0b \xa0c", "a   b c", "a\n\n\n\nb \n c\r\nd", "l’eau   x\x85y", "\x0b\x0ca\x1cb　", " a​b "]
    rows = spark.createDataFrame([(t,) for t in hard], "t string").select("t", X.normalize_space(F.col("t")), X.clean_flat(F.col("t")), X.clean_text(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(t, space(t), flat(t), space(t) or None) for t in hard]


def test_rounds_of_a_merge_write_keys_alone(spark, monkeypatch):
    seen, write = {}, C.written
    monkeypatch.setattr(C, "written", lambda df, what: seen.setdefault(what, df.columns) and write(df, what))
    rows = spark.createDataFrame([(0, "A", "x", "t0"), (1, "A", "y", "t1"), (2, "B", "y", "t2"), (3, None, "y", "t3"), (4, None, None, "t4")], "id int, e string, c string, text string")
    got = {r["id"]: (r["reason"], r["original"], r["text"]) for r in C.merge_versions(rows, F.col("e"), F.col("c"), ["id"], F.col("id")).collect()}
    assert got == {0: ("first", None, "t0"), 1: ("exact_duplicate", 0, "t1"), 2: ("first", None, "t2"), 3: ("same_article_term", 2, "t3"), 4: ("first", None, "t4")}
    assert not {"text", "e", "c"} & set(seen["merge-round"])


def test_tasks_clean_a_text_once(spark):
    r = RQ._reviewed(spark, SF)
    assert "regexp_replace" not in plan(T.article_examples(r.where("quality = 1"), r.where("quality is null")))
    assert plan(T.candidate_examples(r, "file")).count("CONTEXT: ") == 1
