"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. At each level runs of one symbol become one, deterministic coin tossing over neighbouring
symbols (lowest differing bit, three times) gives labels of eight values, and a phrase starts at every local maximum of
the labels. A phrase's name is a hash of its symbols, so equal substrings get equal names inside, wherever they stand.
The names of all levels are sampled by one-permutation MinHash into BINS bins: that is the fingerprint, written in hex,
and the share of equal bins is the likeness of two.

Every text of a batch is parsed at once in numpy. To find each document's successor, rows are dealt into ranges of ids
(bounds from quantiles) and streamed in descending order; the greatest row of each range is also dealt to the range
above it, so that no row is ever looked up.

Defined cases: null text is empty; the fingerprint of an empty text is all BINS marks of an empty bin, and two such are
alike (1); equal ids go by text; null ids come last; a single row is its own successor; no documents give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BINS, LEVELS = 64, 32
EMPTY = np.uint32(0xFFFFFFFF)
LOT_CHARS = 400_000
NULL_KEY = -(1 << 63)
FINGERPRINT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which a symbol differs from the one before it, plus that bit's value. The
    first symbol of a text is compared with its complement."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    low = x ^ before
    low &= ~low + low.dtype.type(1)
    place = (low.astype(np.float32).view(np.int32) >> 23) - 127
    return (2 * place + ((x & low) != 0)).astype(np.uint8)


def _pairs(bits: int) -> np.ndarray:
    """toss() of every pair (before, symbol) of small symbols; equal ones get a label of their own."""
    before, x = np.divmod(np.arange(1 << 2 * bits), 1 << bits)
    low = (x ^ before) & -(x ^ before)
    place = np.where(low > 0, np.log2(np.maximum(low, 1)), 0).astype(int)
    return np.where(low == 0, 2 * bits, 2 * place + ((x & low) != 0)).astype(np.uint8)


_BYTES, _LABELS = _pairs(8), _pairs(5)
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B9))
_BASE = 0x2545F491


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 32, as many as were ever asked for."""

    up = down = np.ones(1, np.uint32)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            cls.up, cls.down = (np.cumprod(np.concatenate([[1], np.full(n, b)]).astype(np.uint32), dtype=np.uint32) for b in (_BASE, pow(_BASE, -1, 1 << 32)))
        return cls.up, cls.down


def phrase_names(values: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """A hash of each phrase's values and their order: differences of one running sum, brought to a common place."""
    up, down = Powers.upto(len(values) + 1)
    upto = np.cumsum(values * up[: len(values)], dtype=np.uint32)
    ends = upto[np.append(at[1:], len(values)) - 1]
    ends[1:] -= ends[:-1].copy()
    size = np.diff(at, append=len(values)).astype(np.uint32)
    return mix(ends * down[at] + size * np.uint32(0x27D4EB2F) + np.uint32(level))


def starts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start: at each text's first symbol and at each local maximum of the labels."""
    cut = first.copy()
    if len(label) > 2:
        rise = label[1:] > label[:-1]
        cut[1:-1] |= rise[:-1] & (label[1:-1] > label[2:]) & ~first[2:]
    return np.flatnonzero(cut)


def sketch(texts: list[str]) -> np.ndarray:
    """(texts, BINS) uint32: the least name hash of each bin over all levels of each text's parse.

    Level 0 are the UTF-8 bytes, whose tosses are looked up; a run of one byte stays in one phrase. Above, runs of a
    symbol become one symbol first."""
    out = np.full((len(texts), BINS), EMPTY, np.uint32)
    flat = out.reshape(-1)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    length = np.array([len(t) for t in raw])
    b = np.frombuffer(b"".join(raw), np.uint8)
    if not len(b):
        return out
    begin = (np.cumsum(length) - length)[length > 0]
    first = np.zeros(len(b), bool)
    first[begin] = True
    label, table, shift = b, _BYTES, 8
    for _ in range(3):
        pair = label.astype(np.uint16)
        pair[1:] |= label[:-1].astype(np.uint16) << np.uint16(shift)
        pair[begin] = label[begin] | ((~label[begin]).astype(np.uint16) & np.uint16((1 << shift) - 1)) << np.uint16(shift)
        label, table, shift = table[pair], _LABELS, 5
    at = starts(label, first)
    x, who = phrase_names(_BYTE_NAMES[b], at, 0), np.repeat(np.arange(len(texts), dtype=np.int32), length)[at]
    for level in range(1, LEVELS):
        h = mix(x + np.uint32(0x85EBCA6B * level & 0xFFFFFFFF))
        np.minimum.at(flat, who * BINS + (h & np.uint32(BINS - 1)).astype(np.int32), mix(h) & np.uint32(0xFFFFFFFE))
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (who[1:] != who[:-1])
        at = np.flatnonzero(new)
        if len(at) < len(x):
            run = np.diff(at, append=len(x)).astype(np.uint32)
            x, who = np.where(run > 1, mix(x[at] + run * np.uint32(0xC2B2AE35)), x[at]), who[at]
        # A text that has come down to one symbol is done.
        single = np.bincount(who, minlength=len(texts)) == 1
        if single.any():
            stay = ~single[who]
            x, who = x[stay], who[stay]
            if not len(x):
                break
        first = np.ones(len(x), bool)
        first[1:] = who[1:] != who[:-1]
        at = starts(toss(toss(toss(x, first), first), first), first)
        x, who = phrase_names(x, at, level), who[at]
    return out


def hexed(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the share of equal bins among those not empty in both; 1 if all are empty."""
    some = (a != EMPTY) | (b != EMPTY)
    n = some.sum(1)
    return np.where(n == 0, 1.0, ((a == b) & some).sum(1) / np.maximum(n, 1))


def edited(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _ranges(docs: DataFrame, n: int) -> list[int]:
    bounds = docs.select(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    return sorted(set(bounds or []))


def _range_of(bounds: list[int]):
    """The number of bounds at or below key, found in two steps of about sqrt(n) comparisons."""
    width = max(1, int(len(bounds) ** 0.5))
    lots = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    heads = f"array({', '.join(f'{lot[0]}L' for lot in lots if lot)})" if bounds else "array(9223372036854775807L)"
    every = f"array({', '.join(f'{b}L' for b in bounds)})" if bounds else heads
    lot = f"size(filter({heads}, x -> x <= key))"
    return F.expr(f"CASE WHEN {lot} = 0 THEN 0 ELSE ({lot} - 1) * {width} + size(filter(slice({every}, ({lot} - 1) * {width} + 1, {width}), x -> x <= key)) END")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _ranges(rows.select("key"), 4 * n)
    rows = rows.withColumn("r", _range_of(bounds))
    tops = sorted((r["r"], r["top"]) for r in rows.groupBy("r").agg(F.max("key").alias("top")).collect())  # a row a range
    # The greatest row of a range follows the least of the range above; that of the highest follows the least of all.
    above = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    if above:
        ghost = F.expr(f"element_at(map({', '.join(f'{top}L, {r}' for top, r in above.items())}), key)") if len(above) <= 64 else None
    if not above:
        dealt = rows.withColumn("ghost", F.lit(False))
    else:
        if ghost is None:
            small = spark.createDataFrame([(k, r) for k, r in above.items()], "key bigint, up int")
            dealt = rows.join(F.broadcast(small), "key", "left")  # at most 4 rows a shuffle partition
        else:
            dealt = rows.withColumn("up", ghost)
        copies = F.when(F.col("up").isNull(), F.array(F.struct("r", F.lit(False).alias("ghost")))).otherwise(F.array(F.struct("r", F.lit(False).alias("ghost")), F.struct(F.col("up").alias("r"), F.lit(True).alias("ghost"))))
        dealt = dealt.withColumn("c", F.explode(copies)).select("doc_id", "key", "text", F.col("c.r").alias("r"), F.col("c.ghost").alias("ghost"))
    order = (F.col("r"), F.col("ghost"), F.col("key").desc(), F.col("text"))
    ordered = dealt.repartition(n, "r").sortWithinPartitions(*order).select("doc_id", "text", "r", "ghost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(lot: list[tuple]) -> pa.RecordBatch:
            """Results for all rows of a lot but the last, which only follows."""
            texts = [t for _, t, _, _ in lot]
            use = [i for i in range(len(lot) - 1) if not lot[i][3] and lot[i + 1][2] == lot[i][2]]
            changed = [edited(texts[i], texts[i + 1]) for i in use]
            own, other = sketch(texts), sketch(changed)
            here, after = own[use], own[[i + 1 for i in use]]
            columns = [
                pa.array([lot[i][0] for i in use], pa.int64()), pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([hexed(a) for a in here], pa.string()), pa.array([hexed(a) for a in other], pa.string()),
                pa.array(likeness(here, other), pa.float64()), pa.array(likeness(here, after), pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        lot: list[tuple] = []
        chars = 0
        for b in batches:
            for row in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["r"].to_pylist(), b["ghost"].to_pylist(), strict=True):
                lot.append(row)
                chars += len(row[1])
                if chars >= LOT_CHARS and len(lot) > 1:
                    yield done(lot)
                    lot, chars = [row], len(row[1])
        if len(lot) > 1:
            yield done(lot)

    return ordered.mapInArrow(run, FINGERPRINT)
