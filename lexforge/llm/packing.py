"""Best-fit packing by hierarchical residuals.

Every partition turns its documents into token pieces and packs them best-fit (largest first) into sequences. Nearly full
sequences are final. The others become items themselves: partitions are merged FAN_IN to one and packed best-fit again,
until one partition is left or merging no longer helps. A task never holds more than MOST_ITEMS items at once; the rest
of its partition follows in further lots. Lots and the early end lose no piece; they cost fill, at most what the bins
that stay underfull leave empty.

Token ids are found as the library gives them: texts of common characters go through a second implementation of byte
pairs over the same vocabulary, which merges by the rank of the merged token. The two agree if merges come in the order
of the tokens that they make, each token being made by one, and if every token of the vocabulary is what the library
makes of that token's own string (a piece of a longer text merges as it would alone, so two neighbours that make up a
token are its own merge). Both are checked before each run; for a vocabulary where that fails, for other texts and for
texts with a special string the library is asked. Ids never leave the task: a piece
carries its place, length and checksum.

Defined cases: null text is empty, and gives one piece of just the end token; ties pack in the order of (id, start);
repeated rows are each packed; a null id stays null; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, printed_bytes, small_batches

CAPACITY, END_ID, SLACK, FAN_IN, MOST_ITEMS = 1024, 2, 8, 8, 200_000
#: Characters whose class and white space are the same in the tokenizer and in Python.
COMMON = re.compile(r"[\t-\r -ɏ‐-‧€]*+")
#: The tokenizer's split.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = "bin bigint, size int, items array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def by_rank(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary for merging by rank; None where that may differ from the library."""
    own = tokenizer(path)
    vocab = own.get_vocab(with_added_tokens=False)
    to_byte = {c: b for b, c in enumerate(printed_bytes())}
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    plain = {token: i for token, i in vocab.items() if token not in special}
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    if any(a >= b for a, b in zip([-1, *made], made, strict=False)):
        return None
    if any(not to_byte.keys() >= set(token) or [x.id for x in own.model.tokenize(token)] != [i] for token, i in plain.items()):
        return None
    return tiktoken.Encoding("by_rank", pat_str=PRE_TOKEN, mergeable_ranks={bytes(map(to_byte.get, token)): i for token, i in plain.items()}, special_tokens={})


def encode(text: str, path: str) -> bytes:
    ids = tokenizer(path).encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes()


def token_bytes(text: str, path: str, fast: bool, special: tuple[str, ...]) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit bytes."""
    if not fast or COMMON.fullmatch(text) is None or any(s in text for s in special):
        return encode(text, path)
    try:
        return by_rank(path).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
    except ValueError:  # a run of white space longer than its regular expression can follow
        return encode(text, path)


def pieces(ids: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; the first piece takes what does not fill a sequence."""
    n = len(ids) // 4
    start, k = 0, 0
    while start < n:
        length = CAPACITY if start else (n % CAPACITY or CAPACITY)
        yield k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, k = start + length, k + 1


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit, largest first: lists of indices. Open bins are kept by free space, and a bitmap of those in use finds
    the tightest one."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fit = used >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
            bins[k].append(i)
        else:
            free, k = capacity, len(bins)
            bins.append([i])
        free -= size
        if free:
            by_free[free].append(k)
            used |= 1 << free
    return bins


def _packed(lots: Iterator[tuple[list[int], list[list[dict]]]], level: int) -> Iterator[pa.RecordBatch]:
    """Packs lots of (sizes, items of each) and names the bins by level, partition and number."""
    base, k = (level << 56) | (TaskContext.get().partitionId() << 32), 0
    for sizes, held in lots:
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], str(held[i][0]["doc_id"]), held[i][0]["start"]))
        sizes, held = [sizes[i] for i in order], [held[i] for i in order]
        bins = best_fit(sizes)
        for at in range(0, len(bins), 5000):
            lot = bins[at : at + 5000]
            columns = [pa.array(range(base + k, base + k + len(lot)), pa.int64()), pa.array([sum(sizes[i] for i in b) for b in lot], pa.int32()), pa.array([[x for i in b for x in held[i]] for b in lot], pa.list_(ITEM))]
            k += len(lot)
            yield pa.RecordBatch.from_arrays(columns, ["bin", "size", "items"])


def tokenised_bins(docs: DataFrame, path: str) -> DataFrame:
    special = tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    fast = by_rank(path) is not None
    small_batches(docs.sparkSession)

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[dict]]]]:
        end = END_ID.to_bytes(4, "little")
        sizes, held = [], []
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                for k, start, length, crc in pieces(token_bytes(text or "", path, fast, special) + end):
                    sizes.append(length)
                    held.append([{"doc_id": doc_id, "piece": k, "start": start, "length": length, "ids_crc32": crc}])
            if len(sizes) >= MOST_ITEMS:
                yield sizes, held
                sizes, held = [], []
        yield sizes, held

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _packed(lots(batches), 0), BIN)


def repacked(bins: DataFrame, partitions: int, level: int) -> DataFrame:
    """Underfull bins as items of fewer partitions (dealt by their names, so that a lost task repeats its work)."""

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[dict]]]]:
        sizes, held = [], []
        for b in batches:
            sizes += b["size"].to_pylist()
            held += b["items"].to_pylist()
            if len(sizes) >= MOST_ITEMS:
                yield sizes, held
                sizes, held = [], []
        yield sizes, held

    dealt = bins.repartition(partitions, "bin").select("size", "items")
    return dealt.mapInArrow(lambda batches: _packed(lots(batches), level), BIN)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    bins = cut(tokenised_bins(docs, path), "pack-0")
    full = bins.where(F.col("size") >= CAPACITY - SLACK)
    open_bins, level = bins.where(F.col("size") < CAPACITY - SLACK), 0
    count, parts = open_bins.count(), max(1, bins.rdd.getNumPartitions())
    while count > 1:
        level += 1
        parts = max(1, -(-parts // FAN_IN), -(-count // MOST_ITEMS))
        bins = cut(repacked(open_bins, parts, level), f"pack-{level}")
        full = full.unionByName(bins.where(F.col("size") >= CAPACITY - SLACK))
        open_bins = bins.where(F.col("size") < CAPACITY - SLACK)
        before, count = count, open_bins.count()
        if parts == 1 or (count > 0.98 * before and level > 3):
            break
    every = full.unionByName(open_bins)
    # The offset of each item: lengths so far within its bin (at most CAPACITY items).
    upto = "transform(items, (x, i) -> struct(x as x, aggregate(slice(items, 1, i), 0L, (a, y) -> a + y.length) as offset))"
    out = every.select(F.col("bin").alias("sequence_id"), F.explode(F.expr(upto)).alias("p"))
    return out.select("p.x.doc_id", "p.x.piece", "p.x.start", "p.x.length", "p.x.ids_crc32", "sequence_id", "p.offset")
