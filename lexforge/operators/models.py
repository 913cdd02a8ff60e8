"""TF-IDF features, linear classifiers, grouped folds and their evaluation.

The weights of words and of characters are counted lot by lot (tfidf.py); those of any other terms are aggregates and
joins. Columns are hashed, so no vocabulary is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.tables import written
from . import tfidf as W
from .curation import seeded

HASHED, LEAST_DOCS, MOST_SHARE = 1 << 18, 2, 0.95


def _plain(text: Column) -> Column:
    return F.lower(X.strip_accents(X.clean_flat(text)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_plain(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def word_terms(text: Column) -> Column:
    """Words of two or more characters and their bigrams."""
    w = _words(text)
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(w, F.array_compact(pairs))


def char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams within words that are padded with a space on both sides."""
    words = F.filter(F.split(_plain(text), " "), lambda w: w != "")

    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        of = lambda n: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, n))
        return F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(p))), of))

    return F.flatten(F.transform(words, grams))


#: Terms that are counted lot by lot: how a text becomes words between spaces, and how these become pairs.
BY_LOT = {word_terms: (lambda text: F.array_join(_words(text), " "), W.word_pairs), char_terms: (_plain, W.char_pairs)}


def term_counts(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    return rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_idf(train: DataFrame, key: str, terms: Column) -> DataFrame:
    """term, idf over the rows of ``train``: smooth, terms of at least two rows and at most 95 % of them."""
    n = train.agg(F.count("*").alias("n")).scalar()
    df = term_counts(train, key, terms).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= LEAST_DOCS) & (F.col("df") <= MOST_SHARE * n)).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(rows: DataFrame, idf: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, term, weight: sublinear tf, idf learnt elsewhere, L2 norm a row."""
    raw = term_counts(rows, key, terms).join(idf, "term").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("weight"))


@F.udf(VectorUDT())
def _sparse(pairs):
    return Vectors.sparse(HASHED, [(p["i"], p["x"]) for p in sorted(pairs or [])])


def vectors(rows: DataFrame, idf: DataFrame, key: str, terms: Column) -> DataFrame:
    """``rows`` with features; a row without known terms has the zero vector."""
    at = F.pmod(F.xxhash64("term"), F.lit(HASHED)).cast("int").alias("i")
    hashed = tfidf(rows, idf, key, terms).groupBy(key, at).agg(F.sum("weight").alias("x"))
    packed = hashed.groupBy(key).agg(F.collect_list(F.struct("i", "x")).alias("pairs"))
    return rows.join(packed, key, "left").withColumn("features", _sparse("pairs")).drop("pairs")


def features(rows: DataFrame, train: Column, key: str, text: str, terms: Callable[[Column], Column], *carry: str) -> DataFrame:
    """key, the carried columns and features of ``rows``, written: what vectors() gives with the idf of the rows ``train``."""
    if terms not in BY_LOT:
        made = terms(F.col(text))
        return written(vectors(rows, term_idf(rows.where(train), key, made), key, made).select(key, *carry, "features"), "features")
    words, pairs = BY_LOT[terms]
    lots = W.in_lots(rows, key, text, words(F.col(text)), F.coalesce(train, F.lit(False)), *carry)
    made = W.hashed(lots, W.idf_by_lot(lots, pairs, LEAST_DOCS, MOST_SHARE), pairs, key, HASHED, *carry)
    # The fields of a sparse vector are read back as one.
    return written(made, "features", T.StructType([*made.schema.fields[:-1], T.StructField("features", VectorUDT())]))


def top_weights(rows: DataFrame, key: str, text: str, terms: Callable[[Column], Column]) -> DataFrame:
    """key, terms, top_weight: how many weights tfidf() gives a row of ``rows``, with the idf of these, and the largest."""
    words, pairs = BY_LOT[terms]
    lots = W.in_lots(rows, key, text, words(F.col(text)), F.lit(True))
    return W.tops(lots, W.idf_by_lot(lots, pairs, LEAST_DOCS, MOST_SHARE), pairs, key).where(F.col(key).isNotNull())


def balanced_weight(train: DataFrame, label: str) -> DataFrame:
    """label and n / (2 n of the label): two rows."""
    n = train.agg(F.count("*").alias("n")).scalar()
    return train.groupBy(label).agg((n / (2.0 * F.count("*"))).alias("weight"))


def make_models() -> dict[str, tuple[Callable[[Column], Column], Callable[[int], object]]]:
    """Name to (terms, estimator for n training rows). L2 strength 1/n is C=1 of a loss that is summed."""
    shared = {"labelCol": "label", "weightCol": "weight", "featuresCol": "features", "standardization": False}
    logistic = lambda n: LogisticRegression(maxIter=200, regParam=1.0 / n, **shared)
    margin = lambda n: LinearSVC(maxIter=100, regParam=1.0 / n, **shared)
    return {"word_tfidf_logreg": (word_terms, logistic), "word_tfidf_svm": (word_terms, margin), "char_tfidf_svm": (char_terms, margin)}


def evaluate_models(rows: DataFrame, key: str, text: str, label: str, split: str, models: dict | None = None) -> DataFrame:
    """model, key, split, label, pred of every row: features and classifier learn from split = 'train' only."""
    d = rows.select(key, text, F.col(label).cast("double").alias("label"), F.col(split).alias("split"))
    tables, out = {}, []
    for name, (terms, estimator) in (models or make_models()).items():
        if terms not in tables:
            tables[terms] = features(d, F.col("split") == "train", key, text, terms, "label", "split")
        made = tables[terms]
        train = made.where("split = 'train'")
        fitted = estimator(train.count()).fit(train.join(F.broadcast(balanced_weight(train, "label")), "label"))
        out.append(fitted.transform(made).select(F.lit(name).alias("model"), key, "split", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred")))
    return reduce(DataFrame.unionByName, out)


def grouped_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """A row per group: accuracy, precision, recall, F1 and support of both labels, macro F1; 0 where undefined."""
    hit = lambda a, b: F.count_if((F.col("label") == a) & (F.col("pred") == b)).cast("double")
    m = predictions.groupBy(*by).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    f1, f0 = ratio("2 * tp", "2 * tp + fp + fn"), ratio("2 * tn", "2 * tn + fp + fn")
    sides = {"precision_1": ("tp", "tp + fp"), "recall_1": ("tp", "tp + fn"), "precision_0": ("tn", "tn + fn"), "recall_0": ("tn", "tn + fp")}
    return m.select(*by, *(F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")), ratio("tp + tn", "tp + tn + fp + fn").alias("accuracy"), *(ratio(*r).alias(c) for c, r in sides.items()), f1.alias("f1_1"), f0.alias("f1_0"), ((f0 + f1) / 2).alias("macro_f1"))


def best_model(metrics: DataFrame, score: str = "macro_f1") -> DataFrame:
    return metrics.orderBy(F.col(score).desc(), "model").limit(1)


def fold_sizes(totals: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each fold gets when each goes to the fold that is smallest then."""
    low, high = min(totals), max(totals) + size * count
    taken = lambda level: [max(0, -(-(level - t) // size)) for t in totals]
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if sum(taken(level)) <= count else (low, level)
    got = taken(low)
    for _ in range(count - sum(got)):
        k = min(range(len(totals)), key=lambda i: (totals[i] + got[i] * size, i))
        got[k] += 1
    return got


def group_folds(rows: DataFrame, key: str, label: str, order: str, folds: int = 5, seed: int = 2026) -> DataFrame:
    """key, label, size, fold: groups by key, majority label, largest first into the smallest fold.

    How many groups of each (label, size) a fold gets follows from their histogram alone, which has at most about
    sqrt(2 rows) sizes a label; only that is collected. Which groups they are follows from a seeded rank, found by
    buckets so that no size is ranked in one task. A null key is a group of its own.
    """
    counts = rows.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    groups = counts.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("label"), F.sum("n").alias("size"))
    groups = groups.withColumn("h", F.coalesce(seeded(F.col(key), seed), F.lit(""))).withColumn("bucket", F.left("h", F.lit(2)))
    cells = groups.groupBy("label", "size", "bucket").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("label", "size").orderBy("bucket")) - F.col("n")
    at = F.row_number().over(Window.partitionBy("label", "size", "bucket").orderBy("h", key))
    same = lambda a, b, *on: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in on))
    placed = cells.select("label", "size", "bucket", offset.alias("offset"))
    ranked = groups.withColumn("at", at)
    ranked = ranked.join(placed, same(ranked, placed, "label", "size", "bucket")).select(ranked[key], ranked["label"], ranked["size"], (F.col("at") + F.col("offset")).alias("rank"))
    totals, ranges = [0] * folds, []
    for r in cells.groupBy("label", "size").agg(F.sum("n").alias("n")).orderBy("label", F.desc("size")).collect():
        upto = 0
        for k, n in enumerate(fold_sizes(totals, r["size"], r["n"])):
            ranges.append((r["label"], r["size"], upto, upto + n, k))
            totals[k], upto = totals[k] + n * r["size"], upto + n
    kinds = T.StructType([T.StructField("label", groups.schema["label"].dataType), *(T.StructField(c, T.LongType()) for c in ("size", "above", "upto", "fold"))])
    where = rows.sparkSession.createDataFrame(ranges, kinds)
    return ranked.join(where, same(ranked, where, "label", "size") & (F.col("rank") > F.col("above")) & (F.col("rank") <= F.col("upto"))).select(ranked[key], ranked["label"], ranked["size"], F.col("fold").cast("int").alias("fold"))


def cross_validate(rows: DataFrame, key: str, text: str, label: str, fold: str, folds: int = 5, models: dict | None = None) -> DataFrame:
    """model, fold, key, label, pred: each fold predicted by models that learnt from the others."""
    parts = []
    for k in range(folds):
        d = rows.withColumn("__split", F.when(F.col(fold) == k, "test").otherwise("train"))
        parts.append(evaluate_models(d, key, text, label, "__split", models).where("split = 'test'").drop("split").withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def fold_summary(metrics: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, sample deviation (0 of one value, null of none), least and most over folds."""
    x = F.col(value)
    std = F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, F.lit(0.0))
    return metrics.groupBy(*by).agg(F.avg(x).alias("mean"), std.alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def transformer_logits(rows: DataFrame, text: str, load: Callable[[], Callable], batch: int = 16) -> DataFrame:
    """``rows`` with logits from a network that ``load`` makes once a worker: it maps an array of texts to (n, classes).
    Fine-tuning needs libraries and weights that are not here; any network behind ``load`` will do."""
    model = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
    return rows.withColumn("logits", model(F.col(text)))


def softmax(logits: Column) -> tuple[Column, Column]:
    """(probabilities, index of the first greatest) of an array of logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total), (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
