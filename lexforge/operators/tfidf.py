"""TF-IDF weights of whole documents, counted lot by lot in numpy.

A lot is a set of documents by hash of their key, of about LOT characters. Pairs of document and term never leave their
lot: only the distinct terms of a lot are shuffled to be counted over all lots, and those that have an idf come back to
the lots that hold them. Memory follows the size of a lot, the shuffle that of texts and of the terms distinct in a lot.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOT, LEAST_LOT = 16_000_000, 1_000_000
CHUNK = 4_000_000
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def _split(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between single spaces: the row of each, its number in the dictionary, and the dictionary."""
    lists = pc.split_pattern(texts.combine_chunks().cast(pa.large_string()).fill_null(""), " ")
    row, words = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()
    some = pc.not_equal(words, "")
    encoded = words.filter(some).dictionary_encode()
    return row[some.to_numpy(zero_copy_only=False)], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _runs(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of the distinct codes first * k + second."""
    codes, n = np.unique(codes, return_counts=True)
    return codes // k, codes % k, n


def word_pairs(texts: pa.ChunkedArray, doc: np.ndarray) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words and the bigrams of words that follow each other in a row: (terms, (document, term, tf) of each pair)."""
    row, ids, words = _split(texts)
    v, same = len(words), row[1:] == row[:-1]
    codes = np.concatenate([ids, v + ids[:-1][same] * v + ids[1:][same]])
    known, at = np.unique(codes, return_inverse=True)
    two = known[known >= v] - v
    terms = pa.concat_arrays([words.take(pa.array(known[known < v])), pc.binary_join_element_wise(words.take(pa.array(two // max(v, 1))), words.take(pa.array(two % max(v, 1))), pa.scalar(" ", words.type))])
    k = max(len(known), 1)
    return terms, _runs(np.concatenate([doc[row], doc[row[1:][same]]]) * k + at, k)


def char_pairs(texts: pa.ChunkedArray, doc: np.ndarray, least: int = 3, most: int = 5) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Character n-grams within padded words, as word_pairs(); those of a word are made once a lot."""
    row, ids, words = _split(texts)
    grams, size = [], np.zeros(len(words), np.int64)
    for i, w in enumerate(words.to_pylist()):
        p = f" {w} "
        own = [p[j : j + n] for n in range(least, min(most, len(p)) + 1) for j in range(len(p) - n + 1)]
        size[i] = len(own)
        grams += own
    encoded = pa.array(grams, pa.large_string()).dictionary_encode()
    gram, first, k = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size) - size, max(len(encoded.dictionary), 1)
    order = np.argsort(doc[row], kind="stable")
    of, ids = doc[row][order], ids[order]
    done, parts = np.cumsum(size[ids]), []
    start = 0
    while start < len(ids):  # whole documents, as many as make about CHUNK grams
        end = int(np.searchsorted(done, (done[start - 1] if start else 0) + CHUNK, "right"))
        end = int(np.searchsorted(of, of[min(max(end, start), len(of) - 1)], "left")) if end < len(ids) else end
        if end <= start:
            end = int(np.searchsorted(of, of[start], "right"))
        n = size[ids[start:end]]
        at = np.repeat(first[ids[start:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parts.append(_runs(np.repeat(of[start:end], n) * k + gram[at], k))
        start = end
    empty = np.zeros(0, np.int64)
    return encoded.dictionary, tuple(np.concatenate([p[i] for p in parts]) if parts else empty for i in range(3))


def _documents(keys: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys, a null one included, and the place of each row's key among them."""
    encoded = keys.combine_chunks().dictionary_encode("encode")
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def in_lots(rows: DataFrame, key: str, text: str, words: Column, train: Column, *carry: str) -> DataFrame:
    """__lot, __key, __words, __train and the columns to carry. Rows of one key share a lot."""
    chars = rows.agg(F.sum(F.length(text))).first()[0] or 0
    lots = max(1, -(-chars // LOT), min(-(-chars // LEAST_LOT), rows.sparkSession.sparkContext.defaultParallelism))
    return rows.select(F.pmod(F.xxhash64(F.col(key)), F.lit(lots)).cast("int").alias("__lot"), F.col(key).alias("__key"), words.alias("__words"), train.alias("__train"), *carry)


def idf_by_lot(lots: DataFrame, pairs: Callable, least: int, most: float) -> DataFrame:
    """__lot, term, idf of the terms of each lot: smooth, over the rows to train on, terms of at least ``least`` documents
    and at most a share ``most`` of them."""
    schema = pa.schema([("__lot", pa.int32()), ("term", pa.string()), ("n", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        train = table.filter(pc.equal(table["__train"], True))
        held, (_, every, _) = pairs(table["__words"], _documents(table["__key"])[1])
        _, doc = _documents(train["__key"]) if len(train) else (None, np.zeros(0, np.int64))
        known, (_, term, _) = (held, (None, every, None)) if len(train) == len(table) else pairs(train["__words"], doc)
        n = np.bincount(term, minlength=len(known)).astype(np.int64)
        if known is not held:  # terms of the lot that it does not train on are there with none
            at = pc.index_in(held, value_set=known).to_numpy(zero_copy_only=False)
            n = np.where(np.isnan(at), 0, n[np.nan_to_num(at).astype(np.int64)] if len(n) else 0).astype(np.int64)
        return pa.table({"__lot": pa.array(np.full(len(held), table["__lot"][0].as_py(), np.int32)), "term": held.cast(pa.string()), "n": n}, schema=schema)

    total = lots.where("__train").agg(F.count("*").alias("n")).scalar()
    own = lots.select("__lot", "__key", "__words", "__train").groupBy("__lot").applyInArrow(count, "__lot int, term string, n long")
    df = own.withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    return df.where((F.col("df") >= least) & (F.col("df") <= most * total)).select("__lot", "term", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))


def _weighed(table: pa.Table, idf: pa.Table, pairs: Callable) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, document of each row, terms, document, term, weight of each pair in order of document, place of the term in
    ``idf``)."""
    keys, of = _documents(table["__key"])
    terms, (doc, term, tf) = pairs(table["__words"], of)
    place = pc.index_in(terms, value_set=idf["term"].combine_chunks().cast(terms.type)).fill_null(-1).to_numpy(zero_copy_only=False)
    known = place[term] >= 0
    doc, term, tf = doc[known], term[known], tf[known]
    x = (1 + np.log(tf)) * idf["idf"].to_numpy()[place[term]] if len(term) else np.zeros(0)
    norm = np.sqrt(np.bincount(doc, x * x, minlength=len(keys)))
    return keys, of, terms, doc, term, x / norm[doc], place[term]


def _apply(lots: DataFrame, idf: DataFrame, make: Callable, schema: T.StructType) -> DataFrame:
    return lots.groupBy("__lot").cogroup(idf.groupBy("__lot")).applyInArrow(make, schema)


def weights(lots: DataFrame, idf: DataFrame, pairs: Callable, key: str) -> DataFrame:
    """key, term, weight: sublinear tf, L2 norm a document."""
    kind = lots.schema["__key"].dataType

    def make(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, _, terms, doc, term, weight, _ = _weighed(table, known, pairs)
        return pa.table({key: keys.take(pa.array(doc)).cast(table["__key"].type), "term": terms.take(pa.array(term)).cast(pa.string()), "weight": weight})

    return _apply(lots, idf, make, T.StructType([T.StructField(key, kind), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def tops(lots: DataFrame, idf: DataFrame, pairs: Callable, key: str) -> DataFrame:
    """key, terms (how many have a weight) and top_weight of each document that has any: weights() summed up in its lot."""
    kind = lots.schema["__key"].dataType

    def make(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, _, _, doc, _, weight, _ = _weighed(table, known, pairs)
        n, top = np.bincount(doc, minlength=len(keys)), np.zeros(len(keys))
        np.maximum.at(top, doc, weight)
        some = np.flatnonzero(n)
        return pa.table({key: keys.take(pa.array(some)).cast(table["__key"].type), "terms": n[some].astype(np.int64), "top_weight": top[some]})

    return _apply(lots, idf, make, T.StructType([T.StructField(key, kind), T.StructField("terms", T.LongType()), T.StructField("top_weight", T.DoubleType())]))


def hashed(lots: DataFrame, idf: DataFrame, pairs: Callable, key: str, size: int, *carry: str) -> DataFrame:
    """key, the carried columns and the fields of a sparse vector (type, size, indices, values) of every row: weights
    summed by hash of the term. A row without known terms or without a key has no entries."""
    idf = idf.withColumn("i", F.pmod(F.xxhash64("term"), F.lit(size)).cast("int"))
    sparse = T.StructType([T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def make(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, of, _, doc, _, weight, place = _weighed(table, known, pairs)
        at = known["i"].to_numpy().astype(np.int64)[place] if len(place) else np.zeros(0, np.int64)
        codes, inverse = np.unique(doc * size + at, return_inverse=True)
        x, n = np.bincount(inverse, weight, minlength=len(codes)).astype(np.float64), np.bincount(codes // size, minlength=len(keys))
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        rows = pa.array(of, mask=pc.is_null(table["__key"]).to_numpy())
        empty = lambda a: pc.fill_null(a, pa.scalar([], a.type))
        indices = empty(pa.ListArray.from_arrays(pa.array(ends), pa.array((codes % size).astype(np.int32))).take(rows))
        values = empty(pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.float64())).take(rows))
        vector = pa.StructArray.from_arrays([pa.array(np.zeros(len(of), np.int8)), pa.array(np.full(len(of), size, np.int32)), indices, values], ["type", "size", "indices", "values"])
        return pa.table({key: table["__key"]} | {c: table[c] for c in carry} | {"features": vector})

    fields = [T.StructField(key, lots.schema["__key"].dataType), *(lots.schema[c] for c in carry), T.StructField("features", sparse)]
    return _apply(lots, idf, make, T.StructType(fields))
