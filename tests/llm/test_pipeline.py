"""Stages of the pipeline."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from lexforge.llm import near_dedup
from tokenizers import Tokenizer

WIDE = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, size int, slot string, row string, taken int, v string, `a.b` int"


def test_dedup_stage_takes_five_words(spark):
    """One word of 40 changed: 33 of 41 shingles of four words are common, 31 of 41 of five."""
    words = [[f"w{p}x{i}" for i in range(40)] for p in range(3)]
    rows = [(2 * p + j, " ".join(w if i != 20 or not j else "other" for i, w in enumerate(words[p])), "en", "a", 1) for p in range(3) for j in (0, 1)]
    docs = spark.createDataFrame([*rows, (9, rows[0][1], "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()) == [0, 2, 4]


def test_language_stage_rejects_by_score(spark):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len((r["text"] or "").split()) >= 20]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if x.isalpha() else x for x in r["text"]) for r in held]
    rows = [(10**7 + r["doc_id"], t, None, r["source"], r["n_chars"]) for r, t in zip(held, noise, strict=True)]
    stay = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), "").collect()}
    assert len(held) > 200 and sum(r["doc_id"] in stay for r in held) >= 0.99 * len(held)
    assert sum(r[0] in stay for r in rows) <= 0.05 * len(rows)


def wide(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "p", 1, "t", "r", 2, "v", 3) for r in rows], WIDE)


PROSE = "the river and the stone of the harbour in winter are the garden of a letter to the market by the bridge and a window for the teacher"
EDGE = [(1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "one", "en", None), (None, PROSE + " again", None, "b"), (5, PROSE + " at last", "en", "b"), (6, "long words of the forest journey and morning " * 3000, "en", "b"), (7, "12345 !!", "en", "a")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    """Nulls, empty and long texts, repeated rows and clashing names; an empty table gives no rows."""
    docs = wide(spark, EDGE)
    assert stage(spark, docs.limit(0), "").count() == 0
    out = stage(spark, docs, "")
    if name == "packing":
        assert Counter(r["doc_id"] for r in out.where("piece = 0").collect()) == Counter(i for i, *_ in EDGE)
        return
    assert out.columns == docs.columns and out.schema["a.b"].dataType == docs.schema["a.b"].dataType
    ids = Counter(r["doc_id"] for r in out.collect())
    if name == "language_id":
        assert not {2, 3, 7} & ids.keys() and {1, None} <= ids.keys()
    if name == "quality_rules":
        assert not {2, 3, 4, 6, 7} & ids.keys() and ids[1] == 2
    if name == "near_dedup":
        assert ids[1] == 1 and ids[None] == 1 and {2, 3, 4, 6, 7} <= ids.keys()
    if name == "source_mix":
        assert not {2, 3} & ids.keys() and max(ids.values()) <= 4


def test_mix_stage_keeps_the_order_of_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from lexforge.llm import mixing

    rows = mixing.mix(docs).collect()
    want = []
    for r in rows:
        times = int(np.floor(r["taken"] / r["size"] + 0.5)) if r["size"] else 0
        slots = [r["first_slot"], r["second_slot"] if r["second_slot"] is not None else r["first_slot"]]
        want += [(s, r["doc_id"]) for s in slots[:times]]
    assert [r["doc_id"] for r in corpus_pipeline.mix_stage(spark, docs, "").collect()] == [i for _, i in sorted(want)]


def test_run_by_hand(spark):
    """run() against its stages' operators in plain Python: pieces are those of the mixed documents' ids, whole and once."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        for a in [0, *range(head, len(ids), 1024)]:
            part = ids[a : head if a == 0 else a + 1024]
            want[r["doc_id"], a, len(part), zlib.crc32(part.tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert sum(r["length"] for r in got) <= 1024 * len({r["sequence_id"] for r in got}) <= 1.05 * sum(r["length"] for r in got) + 1024
