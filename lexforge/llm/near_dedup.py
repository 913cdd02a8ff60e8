"""Near duplicates: MinHash bands find candidates, odd sketches thin them out, full shingle sets confirm them.

A document's MinHash samples are folded into a parity bitmap (odd sketch): the population count of the XOR of two such
bitmaps estimates how many samples differ. Documents with equal shingle sets become one class first. Classes that share
a band are linked in rounds: in each round every band bucket compares its members with one centre, and members that are
already in the centre's component need no comparison. What is then still split is compared across components within the
bucket, first by parity bitmaps of the whole sets: the XOR of two has at most as many ones as the sets differ in shingles,
so what it rules out can never be linked, and families of short documents just under the threshold yield no pairs. So a bucket of m copies costs about m comparisons a round, not m squared, and no bucket, list of partners or
number of candidates is capped. Every link is confirmed on whole sets of 64-bit shingle hashes; components are found by
alternating large-star and small-star steps on tables, never on the driver. Only texts that share a band are read for
this, from a table bucketed by id; a round moves one text a pair, and the pairs of a frequent centre are dealt to lots.

BANDS bands of ROWS samples miss a pair at similarity 0.8 with a chance of (1 - 0.8 ** ROWS) ** BANDS, under 1e-5; the
sketch test (SAMPLES samples in 64 * SKETCH_WORDS bits, a deviation of 0.021) drops it only if its estimate is under
SKETCH_FLOOR. Sets whose sizes alone rule the similarity out are not compared.

Defined cases: a text that is null or has no word has the empty set, links with nothing and keeps itself; fewer than K
words form one shingle; rows of equal id are one document if their sets are equal and are linked by id otherwise, each
is returned; the smallest id names a component; a null id is returned with a null component and kept, and links nothing;
no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete, discard, release, shared_dir, small, small_batches

K, SIMILARITY = 4, 80
BANDS, ROWS = 30, 5
SAMPLES, SKETCH_WORDS, SKETCH_FLOOR, ROUNDS = 640, 32, 0.715, 3
WHOLE_WORDS = 16
WORD_CACHE = 500_000
#: Pairs of one document that a task of the last join takes, about.
LOT = 2000
#: Ids (8 bytes each) that a broadcast may hold.
MOST_IDS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, k: int = K) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text in lower case (A-Z only)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    x = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        x *= MIX
        x += h[i : len(h) - n + 1 + i]
        x ^= x >> np.uint64(29)
    return np.unique(mixed(x + np.uint64(n)))


class Sketcher:
    """MinHash samples of a set, their bands and their odd sketch."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        m = SAMPLES
        self.a = rng.integers(1, 1 << 63, (m, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (m, 1), np.uint64)
        self.salt = rng.integers(0, 1 << 63, m, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(shingles), 4096):
            h = shingles[at : at + 4096] * self.a
            h += self.b
            h >>= np.uint64(32)
            m = h.min(1)
            low = m if low is None else np.minimum(low, m)
        return low

    def bands(self, samples: np.ndarray) -> np.ndarray:
        s = mixed(samples + self.salt)[: BANDS * ROWS].reshape(BANDS, ROWS)
        out = s[:, 0].copy()
        for i in range(1, ROWS):
            out = out * MIX + s[:, i]
        return mixed(out).view(np.int64)

    def odd(self, samples: np.ndarray) -> np.ndarray:
        return parity(mixed(samples * MIX ^ self.salt), SKETCH_WORDS)


def parity(x: np.ndarray, words: int) -> np.ndarray:
    """The parity bitmap of hashes x in 64-bit words."""
    flips = np.bincount((x % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def sketch_documents(docs: DataFrame, size: int = K) -> DataFrame:
    """doc_id, n_shingles, key (128-bit digest of the set, null if empty), bands, odd (sketch of the samples), whole
    (parity bitmap of the set): one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketcher = WordHashes(), Sketcher()
        for b in batches:
            n, key, bands, odd, whole = [], [], [], [], []
            for text in b["text"].to_pylist():
                s = shingle_set(text, hashes, size)
                n.append(len(s))
                if not len(s):
                    key.append(None), bands.append(None), odd.append(None), whole.append(None)
                    continue
                low = sketcher.samples(s)
                key.append(xxhash.xxh3_128_digest(s.tobytes())), bands.append(sketcher.bands(low)), odd.append(sketcher.odd(low)), whole.append(parity(s, WHOLE_WORDS))
            columns = [b["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "bands", "odd", "whole"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, odd array<bigint>, whole array<bigint>")


def ones(a: Column, b: Column, words: int) -> Column:
    """How many bits of two bitmaps differ."""
    return reduce(lambda x, i: x + F.bit_count(a[i].bitwiseXOR(b[i])), range(words), F.lit(0))


def possible(na: Column, nb: Column, a: str, b: str) -> Column:
    """Whether two sets of na and nb shingles can reach the similarity: then they differ in at most (100 - SIMILARITY) /
    (100 + SIMILARITY) of na + nb shingles, and so do their bitmaps a and b."""
    return (100 + SIMILARITY) * ones(F.col(a), F.col(b), WHOLE_WORDS) <= (100 - SIMILARITY) * (na + nb)


def likely(a: str, b: str) -> Column:
    """Whether the sizes of two sets allow the similarity, and their odd sketches one of SKETCH_FLOOR or more; a and b
    are columns of struct (n, odd)."""
    sizes = 100 * F.least(F.col(a)["n"], F.col(b)["n"]) >= SIMILARITY * F.greatest(F.col(a)["n"], F.col(b)["n"])
    differ = ones(F.col(a)["odd"], F.col(b)["odd"], SKETCH_WORDS)
    bits = 64 * SKETCH_WORDS
    # d of the samples differ: the XOR has about bits / 2 * (1 - exp(-2 * 2d / bits)) ones.
    return sizes & (differ <= int(bits / 2 * (1 - np.exp(-4 * (1 - SKETCH_FLOOR) * SAMPLES / bits))))


class Pool:
    """The texts of candidates as a table bucketed by id: no join on the id moves them again."""

    def __init__(self, docs: DataFrame, ids: DataFrame):
        """docs (id, text), ids (id)."""
        spark = docs.sparkSession
        self.spark, self.name = spark, f"lexforge_pool_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/lexforge/{self.name}"
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ids = cut(ids, "dedup-wanted")
        few = small(ids, MOST_IDS)
        # Few ids are broadcast, so that only their texts are shuffled; many meet all texts in the shuffle that the buckets need.
        rows = docs.join(few, "id", "left_semi").repartition(n, "id") if few is not ids else docs.repartition(n, "id").join(ids.repartition(n, "id"), "id", "left_semi")
        rows.write.bucketBy(n, "id").sortBy("id").option("path", self.path).saveAsTable(self.name)
        discard(ids)

    def texts(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def confirm(pairs: DataFrame, pool: Pool, size: int = K) -> DataFrame:
    """(a, b) pairs of ids to those whose full sets reach the similarity. The text of b travels to that of a; the pairs
    of an a that has many are dealt to lots of about LOT, each with its own copy of a's text."""
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    first = pool.texts().join(lots.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("text").alias("ta"))
    dealt = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), F.col("b").alias("id"))
    second = pool.texts().join(dealt, "id").select("a", "lot", F.col("id").alias("b"), F.col("text").alias("tb"))
    both = second.join(first, ["a", "lot"]).select("a", "b", "ta", "tb")
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for b in batches:
            good = []
            for ta, tb in zip(b["ta"].to_pylist(), b["tb"].to_pylist(), strict=True):
                if ta != last[0]:
                    last = (ta, shingle_set(ta, hashes, size))
                y = shingle_set(tb, hashes, size)
                same = len(np.intersect1d(last[1], y, assume_unique=True))
                good.append(100 * same >= SIMILARITY * (len(last[1]) + len(y) - same) > 0)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (id, component): the least id of each connected component, by large-star and small-star steps."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct()
        nearest = large.groupBy("v").agg(F.min("m").alias("t"))
        small = large.join(nearest, "v")
        after = small.select(F.when(F.col("m") == F.col("t"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("t").alias("u")).where("u <> v")
        after = cut(after.select("u", "v").distinct(), "cc")
        discard(edges)
        release(edges.sparkSession)
        edges = after
        # Done when every edge leads to a root and none has two: then it is a forest of stars.
        inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        twice = edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
        if not inner.select("v").union(twice.select("v")).head(1):
            out = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
            out._lexforge_path = edges._lexforge_path
            return out


def named_by(members: DataFrame, names: DataFrame) -> DataFrame:
    """Members with label: the name that (id, component) rows give them, else their own id."""
    return members.join(names, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def class_components(classes: DataFrame, whole: DataFrame, docs: DataFrame, known: DataFrame, size: int = K) -> DataFrame:
    """(id, component) of the linked classes among classes (id, bands, odd), given whole (id, whole), docs (id, text) and
    links (a, b) that are known: a written table."""
    written: list[DataFrame] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        written.append(cut(df, what))
        release(df.sparkSession)
        return written[-1]

    rows = classes.select("id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = keep(rows.join(shared, "band"), "dedup-members")
    pool = Pool(docs, members.select("id").distinct())
    odd = classes.select("id", "odd")
    # The original of a family of copies shares more bands with them than they do with each other: such are the centres.
    busy = members.join(members.groupBy("band").agg(F.count("*").alias("n")), "band").groupBy("id").agg(F.sum("n").alias("busy"))
    first = Window.partitionBy("band").orderBy(F.col("busy").desc(), "id")
    centres = keep(members.join(busy, "id").withColumn("k", F.row_number().over(first)).where(F.col("k") <= ROUNDS).select("band", F.col("id").alias("c"), "k"), "dedup-centres")
    tried, found = None, components(known)
    written.append(found)

    def check(pairs: DataFrame) -> None:
        """Confirms pairs (a, b) that the sketches allow, without those tried before in either direction, and joins the
        components of the links."""
        nonlocal found, tried
        pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
        if tried is not None:
            pairs = pairs.join(tried, ["lo", "hi"], "left_anti")
        fresh = keep(pairs.select("lo", "hi", "a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "dedup-pairs")
        got = keep(confirm(fresh.select("a", "b"), pool, size), "dedup-links")
        tried = fresh.select("lo", "hi") if tried is None else tried.union(fresh.select("lo", "hi"))
        if got.head(1):
            found = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(got))
            written.append(found)

    for k in range(1, ROUNDS + 1):
        now = named_by(members, found)
        here = centres.where(F.col("k") == k)
        centre = here.join(found.withColumnRenamed("id", "c"), "c", "left").select("band", "c", F.coalesce("component", "c").alias("cl"))
        pairs = now.join(centre, "band").where((F.col("label") != F.col("cl")) & (F.col("id") != F.col("c"))).select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
        with_odd = pairs.join(odd.select(F.col("id").alias("a"), F.col("odd").alias("oa")), "a").join(odd.select(F.col("id").alias("b"), F.col("odd").alias("ob")), "b")
        check(with_odd.where(likely("oa", "ob")).select("a", "b"))
    now = named_by(members, found)
    split = now.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    rest = keep(now.join(split, "band").join(odd, "id").join(whole, "id").select("band", "id", "label", "odd", "whole"), "dedup-rest")
    mine = rest.select("band", F.col("id").alias("a"), F.col("label").alias("la"), F.col("odd").alias("oa"), F.col("whole").alias("wa"))
    other = rest.select("band", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("odd").alias("ob"), F.col("whole").alias("wb"))
    # The bitmaps are compared within the join: only pairs that may be similar come out of it.
    alike = possible(F.col("oa")["n"], F.col("ob")["n"], "wa", "wb") & likely("oa", "ob")
    across = mine.join(other, (mine["band"] == other["band"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & alike).select("a", "b").distinct()
    check(across)
    pool.drop()
    discard(*(df for df in written if df is not found))
    return found


def near_duplicates(docs: DataFrame, size: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs, as a written table; shingles have ``size`` words."""
    release(docs.sparkSession)
    sketches = cut(sketch_documents(docs, size), "dedup-sketches")
    named = sketches.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    same = cut(named.groupBy("key").agg(F.min("doc_id").alias("id")), "dedup-classes")
    # A class takes the bands of the row that carries its least id.
    heads = named.join(same, "key").where("doc_id = id")
    classes = cut(heads.groupBy("id", "key").agg(F.first("bands").alias("bands"), F.first(F.struct(F.col("n_shingles").alias("n"), "odd")).alias("odd"), F.first("whole").alias("whole")), "dedup-heads")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    # Copies hang on their class, one edge each; the classes' components then name them in one join.
    copies = named.select("doc_id", "key").join(same, "key").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    # Rows of one id with different sets link the classes of these.
    several = named.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select(F.col("doc_id").alias("b"))
    found = class_components(classes.select("id", "bands", "odd"), classes.select("id", "whole"), texts, copies.join(several, "b").select("a", "b"), size)
    roots = copies.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("id"))
    own = sketches.select("doc_id", "n_shingles").join(roots, "doc_id", "left").withColumn("id", F.coalesce("id", "doc_id"))
    out = own.join(found, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    out = cut(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "dedup-result")
    discard(sketches, same, classes, found)
    return out
