"""Records, tasks, sinks and stages on small tables, against plain Python."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexforge import generated as G
from lexforge import record_queries as RQ
from lexforge.functions import patterns as P
from lexforge.functions import text as X
from lexforge.functions.tables import running_index
from lexforge.operators import curation as C
from lexforge.operators import mining as M
from lexforge.operators import records as R
from lexforge.operators import tasks as T
from lexforge.plans import stages
from lexforge.sources import sinks

SF = "/root/testdata/sf0.001"


def test_every_pattern_and_scope_occurs(spark):
    found = {x for r in M.mine(RQ._articles(spark, SF)).select("matched_definition_patterns").distinct().collect() for x in r[0]}
    assert found == {label for label, _, _ in P.INVENTORY}
    scopes = {r["scope_label"] for r in RQ.french_scopes(spark, SF).collect()}
    assert scopes == {label for _, label in P.SCOPES} | {"unspecified"}
    assert {r["rule"] for r in RQ.french_rules(spark, SF).collect()} >= {"colon_definition", "on_entend_par", "sentend_de", "defini_comme", "qualification"}
    for stop in P.STOPS:
        assert any(re.search(stop, a) for a in G.ARTICLES)


def python_drafts(text):
    """The span patterns by Python's own engine, with the length and word limits, without repeats."""
    space = lambda t: re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f\v]+", " ", t)).strip(" \n\t\r")
    span = lambda t: (space(t).strip(" \t\n\r;.").strip() or None) if t is not None else None
    out, seen = [], set()
    for label, flags, regex, groups in P.DRAFTS:
        for m in re.finditer(regex, space(text), re.I | (re.S if flags == P.DOTALL_FLAGS else 0)):
            got = {k: span(m[i]) for k, i in groups.items()}
            term, body = got["term"], got["definition"]
            if label == "on entend par" and body:
                body = span(re.split(r"\n[a-z]\)\s", re.split(r"\n\d+°\s", space(m[groups["definition"]]), maxsplit=1)[0], maxsplit=1)[0][:800])
            if not term or not body:
                continue
            low, whole = term.lower().strip(), span(m[0]).lower()
            bad = low in P.BAD_TERMS or any(low.startswith(s) for s in P.BAD_TERM_STARTS) or any(s in low for s in P.BAD_TERM_PARTS) or any(re.search(r, low) for r in P.BAD_TERM_REGEXES) or len(term.split()) > 10
            bad |= len(term.split()) > P.MOST_TERM_WORDS.get(label, 10)
            if label == "terme_colon_definition":
                bad |= any(s in low for s in P.BAD_COLON_TERM_PARTS) or any(s in whole for s in P.BAD_COLON_BODY_PARTS) or any(low.startswith(s) for s in P.BAD_COLON_STARTS) or len(term.split()) > 12
            if "subject" in groups:
                bad |= not got["subject"] or len(got["subject"].split()) > 15
            if bad or (label, term, body) in seen:
                continue
            seen.add((label, term, body))
            out.append((label, got.get("item"), got.get("subject"), term, body))
    return sorted(out, key=str)


def test_drafts_by_python(spark):
    docs = RQ._articles(spark, SF)
    texts = {r["id"]: r["text"] for r in docs.collect()}
    got: dict = {i: [] for i in texts}
    ids: dict = {}
    for r in RQ.french_drafts(spark, SF).collect():
        got[r["id"]].append((r["pattern"], r["item_number"], r["defined_subject"], r["term_candidate"], r["definition_candidate"]))
        ids.setdefault(r["id"], []).append(r["candidate_definition_id"])
    for i, t in texts.items():
        assert sorted(got[i], key=str) == python_drafts(t), t
    assert all(len(set(x)) == len(x) for x in ids.values())
    assert {p for x in got.values() for p, *_ in x} == {d[0] for d in P.DRAFTS}


def test_accents_by_unicode(spark):
    hard = ["ﬁ ŉ … é œ № ½ ǅ ﷺ 漢 ́é ㍿ Å ﬀ", "déjà vu", None, "", "𝐀b", "Ĳssel €5 “q” ’"]
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in hard], "t string").select(X.strip_accents(F.col("t"))).collect()]
    assert got == [plain(t) for t in hard]


def test_greedy_merge_where_keys_disagree(spark):
    """Two rows of one article id, term and definition under different codes: the second duplicates the first exactly."""
    base = {"article_id": "LEGIARTI1", "article_number": "1", "term": "Déchet", "definition": "Toute substance", "manual_label": "valid_definition", "definition_id": "x"}
    rows = [base | {"row_idx": 1, "source_code": "A"}, base | {"row_idx": 2, "source_code": "B"}, base | {"row_idx": 3, "source_code": "B", "definition": "Autre"}, base | {"row_idx": 4, "source_code": "B", "manual_label": None}, base | {"row_idx": 5, "source_code": "B", "term": " "}]
    names = ["row_idx", *base, "source_code"]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "row_idx long, " + ", ".join(f"{n} string" for n in names[1:]))
    got = {r["row_idx"]: (r["route"], r["reason"], r["original"]["idx"] if r["original"] else None) for r in R.merge_sources([("v0.5_review", frame)]).collect()}
    assert got == {1: ("merged", None, None), 2: ("duplicate", "exact_article_term_definition_duplicate", 1), 3: ("merged", None, None), 4: ("skipped", "missing_manual_label", None), 5: ("skipped", "missing_term_or_definition", None)}
    assert R.merge_sources([("v0.4_gold", frame.limit(0))]).count() == 0


def test_small_functions(spark):
    frame = spark.createDataFrame([("L'eau vive", "Code rural (nouveau)", "art liminaire", " Partial "), ("La vie", " ", None, None), ("l'a", None, "L. 1.", "")], "t string, c string, n string, l string")
    got = frame.select(X.normalize_gold_term(F.col("t")), X.normalize_source_code(F.col("c")), X.normalize_article_number(F.col("n")), X.normalize_label(F.col("l")), X.unknown_if_blank(F.col("c")), X.search_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("eau vive", P.RURAL, "liminaire", "partial", "Code rural (nouveau)", " l eau vive "), ("vie", "", "", None, "unknown", " la vie "), ("l'a", "", "l. 1", None, "unknown", " l a ")]


def test_validation_of_lines(spark):
    whole = {c: "x" for c in P.REQUIRED} | {"scope_label": "article", "scope_text": "s", "inferred_scope": None, "definition_type": "explicit", "defined_subject": None, "definition_id": "a"}
    short = {k: v for k, v in whole.items() if k not in ("term", "pattern")}
    lines = spark.createDataFrame([(1, json.dumps(short)), (2, json.dumps(whole)), (3, json.dumps(whole)), (4, "[]")], "row_idx long, raw string")
    got = sorted((r["definition_id"], r["message"]) for r in C.validate_lines(lines).collect())
    assert ("a", "missing fields: term, pattern") in got and got.count(("a", "duplicate definition_id")) == 1 and any(i == "line_4" for i, _ in got)
    with pytest.raises(Exception, match="validation errors"):
        C.require_passed(C.validate_lines(lines)).collect()
    assert C.gate(C.validate_lines(lines.limit(0))).collect()[0]["passed"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "i long, route string, t string")
    sinks.write_routes(rows, str(tmp_path / "r"))
    assert json.loads(next((tmp_path / "r" / "route=a").glob("*.json")).read_text()) == {"i": 1, "t": None}
    assert {k: v.count() for k, v in sinks.routes(rows, ["a", "b", "c"]).items()} == {"a": 1, "b": 1, "c": 0}
    sinks.write_summary(str(tmp_path / "s"), rows=rows, totals=rows.agg(F.count("*").alias("n")))
    assert json.loads(next((tmp_path / "s").glob("*.txt")).read_text()) == {"rows": [{"i": 1, "route": "a", "t": None}, {"i": 2, "route": "b", "t": "x"}], "totals": [{"n": 2}]}


def test_running_index(spark):
    got = running_index(spark.range(0, 1000, 7), "id", "n", 64).collect()
    assert {r["id"]: r["n"] for r in got} == {i: k + 1 for k, i in enumerate(range(0, 1000, 7))}


def test_predictions_and_rates(spark):
    rows = spark.createDataFrame([("m", "test", 0, 1), ("m", "test", 1, 1)], "model string, split string, gold_label int, pred_label int")
    assert T.select_predictions(rows, "m", "test").count() == 2 and T.error_rate(rows).first()["error_rate"] == 0.5 and T.error_rate(rows.limit(0)).first()["error_rate"] is None
    with pytest.raises(ValueError):
        T.select_predictions(rows, "m", "dev")


def test_stages(spark):
    rows = RQ._reviewed(spark, SF)
    out = stages.gold(rows)
    assert sum(out[k].count() for k in ("gold", "rejected", "skipped")) == rows.count()
    merged = stages.merge([("v0.4_gold", rows.where("quality = 1")), ("v0.5_review", rows.where("quality = 0"))])
    assert sum(r["n"] for r in merged["stats"].collect()) == rows.where("quality is not null").count()
    tasks = T.candidate_examples(rows, "file").withColumn("row_idx", F.monotonically_increasing_id())
    split = stages.splits("candidate_validation", tasks)
    assert split["rows"].count() == tasks.count() and split["summary"].where("field = 'overlap'").first()["n"] == 0
    batch = stages.sample_batch(M.mine(RQ._articles(spark, SF).withColumnRenamed("id", "row_idx")), rows.where("quality = 1"), 10, 2, 1, "b")
    got = batch["sample"].orderBy("v0_5_sample_index").collect()
    assert [r["v0_5_sample_index"] for r in got] == list(range(1, len(got) + 1)) and 0 < len(got) <= 10
    assert stages.drafts(batch["kept"].withColumn("article_id", F.col("row_idx").cast("string")))["drafts"].count() > 0
