"""Archives, features, models, folds and streams."""

import io
import math
import tarfile
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.operators import models as L
from lexforge.sources import archive
from lexforge.streaming import curation as S

ARTICLE = """<r><TITRE>Code  du sport (longue forme)</TITRE><TITRE>Code du sport</TITRE><TITRE>Loi</TITRE><ARTICLE num="9"><ID>LEGIARTI1</ID><NUM> </NUM><ETAT>VIGUEUR</ETAT>
<DATE_DEBUT>2020-01-01</DATE_DEBUT><FIN>2999-01-01</FIN><BLOC_TEXTUEL><CONTENU>Un<b>club</b> est</CONTENU></BLOC_TEXTUEL></ARTICLE><ARTICLE><X>no id</X></ARTICLE></r>"""
PLAIN = '<ARTICLE ID="A2"><p>Whole text</p></ARTICLE>'


def test_archive(spark, tmp_path):
    folder = "legi/code_et_TNC_en_vigueur/code_en_vigueur"
    held = {f"{folder}/article/a.xml": ARTICLE, f"{folder}/code_du_travail/article/b.xml": PLAIN, f"{folder}/article/bad.xml": "<r><ARTICLE>", f"{folder}/article/c.txt": "x", "legi/code_et_TNC_en_vigueur/TNC_en_vigueur/article/d.xml": PLAIN}
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name, text in held.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    m = archive.members(spark, str(tmp_path))
    assert (m.count(), m.where("relevant").count()) == (5, 3)
    rows = archive.articles(m.where("relevant")).orderBy("article_id").collect()
    assert [tuple(r)[:7] for r in rows] == [("A2", "Code du travail", None, None, None, None, "Whole text"), ("LEGIARTI1", "Code du sport", "9", "VIGUEUR", "2020-01-01", "2999-01-01", "Un club est")]
    assert archive.in_force(archive.articles(m.where("relevant"))).count() == 1


def test_marker(spark):
    d = spark.createDataFrame([("<a>ON ENTEND PAR x</a>",), ("<a/>",)], "t string")
    assert [r[0] for r in d.select(archive.has_marker(F.col("t").cast("binary"))).collect()] == [True, False]


def test_terms(spark):
    d = spark.createDataFrame([("a Été  bleu",)], "t string")
    word, char = d.select(L.word_terms(F.col("t")), L.char_terms(F.col("t"))).first()
    assert word == ["ete", "bleu", "ete bleu"]
    want = []
    for w in (" a ", " ete ", " bleu "):
        for n in range(3, min(5, len(w)) + 1):
            want += [w[i : i + n] for i in range(len(w) - n + 1)]
    assert char == want


def test_tfidf_learns_from_train_only(spark):
    d = spark.createDataFrame([(1, "red blue"), (2, "red green"), (3, "grey"), (4, "red blue other")], "id int, t string")
    train = d.where("id < 4")
    got = {(r["id"], r["term"]): r["weight"] for r in L.tfidf(d, L.term_idf(train, "id", L.word_terms(F.col("t"))), "id", L.word_terms(F.col("t"))).collect()}
    assert set(got) == {(1, "red"), (2, "red"), (4, "red")} and all(math.isclose(v, 1.0) for v in got.values())


def test_models_and_metrics(spark):
    rows = [(i, ("good clear text number " if i % 2 else "bad broken junk number ") + str(i % 7), i % 2, "test" if i % 5 == 0 else "train") for i in range(60)] + [(99, None, 1, "train")]
    p = L.evaluate_models(spark.createDataFrame(rows, "id int, t string, y int, split string"), "id", "t", "y", "split")
    m = L.grouped_metrics(p.where("split = 'test'"), "model")
    assert {r["model"]: r["macro_f1"] for r in m.collect()} == dict.fromkeys(L.make_models(), 1.0)
    assert L.best_model(m).count() == 1


def test_fold_sizes_are_greedy():
    rng = np.random.default_rng(3)
    for _ in range(200):
        totals, size, count = [int(x) for x in rng.integers(0, 50, 4)], int(rng.integers(1, 9)), int(rng.integers(0, 40))
        want = list(totals)
        for _ in range(count):
            want[min(range(4), key=lambda i: (want[i], i))] += size
        got = [t + size * n for t, n in zip(totals, L.fold_sizes(totals, size, count), strict=True)]
        assert sorted(got) == sorted(want)


def test_group_folds(spark):
    rows = [(k, k % 3 == 0, i) for k in range(40) for i in range(1 + k % 6)] + [(None, True, 0)]
    f = L.group_folds(spark.createDataFrame(rows, "k int, y boolean, i int"), "k", "y", "i", 5).collect()
    assert len(f) == 41 and Counter(r["k"] for r in f).most_common(1)[0][1] == 1
    total = Counter()
    for r in f:
        total[r["fold"]] += r["size"]
    assert sum(total.values()) == len(rows) and max(total.values()) - min(total.values()) <= 6


def test_summary_of_folds(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "m string, x double")
    assert sorted(tuple(r) for r in L.fold_summary(d, "x", "m").collect()) == [("a", 2.0, math.sqrt(2), 1.0, 3.0), ("b", 2.0, 0.0, 2.0, 2.0)]


def test_softmax(spark):
    p, k = spark.createDataFrame([([0.0, math.log(3)],)], "x array<double>").select(*L.softmax(F.col("x"))).first()
    assert k == 1 and np.allclose(p, [0.25, 0.75])


def test_transformer_interface(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float64")

    d = spark.createDataFrame([("ab",), ("",)], "t string")
    assert [r["logits"] for r in L.transformer_logits(d, "t", load).orderBy("t").collect()] == [[0.0, 1.0], [2.0, 1.0]]


def test_stream(spark, tmp_path):
    rows = [(1, "Est réputé acquis", "2024-01-01 00:00:00"), (1, "Est réputé acquis", "2024-01-01 00:05:00"), (2, "nothing", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "id int, text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("id int, text string, ts timestamp").parquet(str(tmp_path / "in"))
    q = S.mined(S.first_seen(read, ["id"], "ts"), inventory=P.INVENTORY).writeStream.format("memory").queryName("mined_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["id"] for r in spark.table("mined_stream").collect()] == [1]
