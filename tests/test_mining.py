"""Draft extraction and term exclusion where spans repeat and terms have any length."""

from lexforge import queries as Q
from lexforge.functions import patterns as P
from lexforge.operators import curation as C
from lexforge.operators import mining as M

SF = "/root/testdata/sf0.001"


def test_drafts_of_a_span_are_one(spark):
    twice = "La probité, qui s'entend de l'exigence générale d'honnêteté, est requise."
    rows = [(1, twice + " " + twice), (2, twice), (None, twice + " " + twice)]
    got = [tuple(r) for r in M.extract_drafts(spark.createDataFrame(rows, "id int, text string")).select("id", "pattern", "term_candidate", "definition_candidate").collect()]
    assert len(got) == len(set(got)) and sorted(str(r[0]) for r in got if r[2] == "probité") == ["1", "2", "None"]


def test_neutral_colon_rule(spark):
    rows = [(1, "A red stone : something that is hard; A red stone : something that is hard; tiny : no"), (2, "no colon here"), (3, "")]
    got = M.extract_drafts(spark.createDataFrame(rows, "id int, text string"), drafts=P.NEUTRAL_DRAFTS).select("id", "term_candidate", "definition_candidate").collect()
    assert [tuple(r) for r in got] == [(1, "A red stone", "something that is hard")]
    docs = Q.draft_extraction_documents(spark, SF).collect()
    assert len(docs) == len({tuple(r) for r in docs})


def test_terms_of_any_length_and_code(spark):
    docs = spark.createDataFrame([(1, "Code A", "Le déchet, ultime!"), (2, "code a", "l'eau potable de la ville"), (3, "b", "le déchet ultime"), (4, None, "dechet"), (5, "code a", "dechets"), (6, "code a", None)], "id int, code string, text string")
    terms = spark.createDataFrame([("Déchet", "code a"), ("eau potable de la", "CODE A."), ("la", "code a"), ("ultime dechet", "b"), ("dechet", None), ("déchet ultime", "code a")], "term string, code string")
    kept, out = C.exclude_terms(docs, "id", "text", terms, "code")
    assert {r["id"]: r["matched_terms"] for r in out.collect()} == {1: ["dechet ultime", "dechet"], 2: ["eau potable de la"]}
    assert {r["id"] for r in kept.collect()} == {3, 4, 5, 6}
    kept, out = C.exclude_terms(docs, "id", "text", terms.limit(0), "code")
    assert kept.count() == 6 and out.count() == 0
    assert {r["id"] for r in C.exclude_terms(docs, "id", "text", terms)[1].collect()} == {1, 3, 4}.union({2})
