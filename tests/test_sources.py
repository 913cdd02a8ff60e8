import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.operators import curation as C
from lexforge.sources import jsonl

SCHEMA = "id int, name string"


def put(path, text):
    path.write_text(text)
    return str(path)


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_tolerant_skips_bad_lines(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"id": 1, "name": "x"}\n\nnot json\n[1]\n{"id": 2}\n{"id": \n')
    assert sorted(tuple(r) for r in jsonl.read_tolerant(spark, p, schema(spark)).collect()) == [(1, "x"), (2, None)]


LINES = '{"id": 1, "name": "x"}\n\nnot json\n[1]\n{"id": 2}\n{"id": \n'


def test_lines_are_numbered(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", LINES)
    assert sorted(tuple(r) for r in jsonl.read_numbered(spark, p, schema(spark)).collect()) == [(1, 1, "x"), (5, 2, None)]
    assert sorted((r[1], r[2]) for r in jsonl.bad_lines(spark, p, schema(spark)).collect()) == [(3, "not json"), (4, "[1]"), (6, '{"id": ')]


def test_strict_names_the_line(spark, tmp_path):
    with pytest.raises(Exception, match="on line 3"):
        jsonl.read_numbered(spark, put(tmp_path / "a.jsonl", '{"id": 1}\n\n{"id": \n'), schema(spark), strict=True).collect()
    assert [tuple(r) for r in jsonl.read_numbered(spark, put(tmp_path / "b.jsonl", '\n{"id": 1}\n'), schema(spark), strict=True).collect()] == [(2, 1, None)]


def test_numbers_go_on_over_blocks(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", "".join(f'{{"id": {i}}}\n' for i in range(1, 3001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = jsonl.read_numbered(spark, p, schema(spark))
        assert spark.read.text(p).rdd.getNumPartitions() > 4
        assert got.count() == 3000 and got.where("__line_number <> id").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_progress(spark, tmp_path):
    p = str(tmp_path / "progress")
    assert jsonl.load_progress(spark, p) == 0
    for stored, at in ((7, 7), (-2, 0), (3, 3)):
        jsonl.save_progress(spark, p, stored)
        assert jsonl.load_progress(spark, p) == at
    for text in ("{", "", '{"current_index": "x"}', "{}"):
        assert jsonl.load_progress(spark, put(tmp_path / "one.json", text)) == 0


def test_optional_is_empty(spark, tmp_path):
    assert jsonl.read_optional(spark, str(tmp_path / "none.jsonl"), schema(spark)).count() == 0


def test_polymorphic(spark, tmp_path):
    for k, text in enumerate(('[{"id": 1, "name": "x"}]', '{"records": [{"id": 1, "name": "x"}]}', '{"id": 1, "name": "x"}', '{"id": 1, "name": "x"}\n{"oops\n')):
        assert [tuple(r) for r in jsonl.read_any(spark, put(tmp_path / f"{k}.json", text), schema(spark)).collect()] == [(1, "x")]


def test_write_keeps_nulls(spark, tmp_path):
    jsonl.write_jsonl(spark.createDataFrame([(1, None)], SCHEMA), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.json")) == '{"id":1,"name":null}\n'


def test_scalar_functions(spark):
    d = spark.createDataFrame([("  L’Été ;\t du droit. ",)], "t string")
    r = d.select(X.clean_flat(F.col("t")), X.normalize_key(F.col("t")), X.normalize_for_match(F.col("t")), X.safe_id_part(F.col("t"))).first()
    assert tuple(r) == ("L'Été ; du droit.", "l'été ; du droit", "l'ete ; du droit", "L_ETE_DU_DROIT")


def test_review_overlay(spark):
    drafts = spark.createDataFrame([("a", "t", "d"), ("b", "t", "d"), ("c", "t", "d")], "candidate_definition_id string, term_candidate string, definition_candidate string")
    made = spark.createDataFrame([("a", "valid_definition", "old", None), ("b", "partial", "own", None), ("c", "invalid", "x", "y")], "candidate_definition_id string, manual_label string, gold_term string, gold_definition string")
    got = {r["candidate_definition_id"]: (r["gold_term"], r["gold_definition"]) for r in C.apply_review(drafts, made).collect()}
    assert got == {"a": ("t", "d"), "b": ("own", "d"), "c": (None, None)}
