"""TF-IDF counted lot by lot against the form by aggregates and joins."""

import math
import random

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexforge.operators import models as L
from lexforge.operators import tfidf as W


@pytest.mark.parametrize("terms", [L.word_terms, L.char_terms])
@pytest.mark.parametrize("lot", [40, W.LOT])
def test_lots(spark, monkeypatch, terms, lot):
    """Null and empty texts, a repeated key, a null key, terms that only the test rows hold, one lot and many."""
    monkeypatch.setattr(W, "LOT", lot)
    monkeypatch.setattr(W, "CHUNK", 50)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Été", "bleu", "a", "l'eau", "x_1", "漢字"]) for _ in range(rng.randrange(9))), i % 3 > 0) for i in range(30)]
    rows += [(3, "bleu bleu eau", True), (50, None, True), (51, "", False), (52, "seul seul", False), (53, "seul", False), (None, "bleu eau", True)]
    d = spark.createDataFrame(rows, "id int, t string, train boolean")
    made = terms(F.col("t"))
    idf = L.term_idf(d.where("train"), "id", made)
    table = lambda df: sorted(((r[0], tuple(int(i) for i in r[1].indices), [round(float(x), 9) for x in r[1].values]) for r in df.select("id", "features").collect()), key=repr)
    assert table(L.features(d, F.col("train"), "id", "t", terms, "train")) == table(L.vectors(d, idf, "id", made))
    whole = d.withColumn("train", F.lit(True))
    want = {r[0]: (r[1], r[2]) for r in L.tfidf(d, L.term_idf(whole, "id", made), "id", made).groupBy("id").agg(F.count("*"), F.max("weight")).collect()}
    got = {r["id"]: (r["terms"], r["top_weight"]) for r in L.top_weights(d, "id", "t", terms).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)


def test_workers_need_no_package():
    assert W.__name__ in cloudpickle.list_registry_pickle_by_value()
