"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Statistics of each whole text (shares of byte classes, lengths, repetition) are mapped through random cosine features,
whose inner products approximate a Gaussian kernel. Each partition of labelled rows sums its part of the normal
equations; the sums are added, solved for ridge weights, and the raw scores calibrated by pooling adjacent violators
over score bins. Labelled rows are a hash sample of about MOST_LABELLED at most; scoring covers every document.

Defined cases: null text is empty; an empty text gets the score of its statistics like any other; unlabelled and
held-out rows are never learnt from; with no labelled rows every score is 0.5; several labels of a document count each;
repeated rows are each scored; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder, small_batches

MOST_LABELLED = 200_000
FEATURES, WIDTH, RIDGE, BINS, SEED, TASKS = 128, 3.0, 1.0, 400, 11, 16

#: Statistics of a text: shares of byte classes, then shape and repetition.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\x0b\x0c\r", "hash": b"#$%&*", "bang": b"!?", "pipe": b"|<>{}[]\\/_=+~^`@", "stop": b".,;:", "quote": b"'\"()-"}
NAMES = (*CLASSES, "high", "length", "words", "word_length", "distinct", "line_length", "dup_lines", "stops_per_word")
_TABLE = np.zeros((256, len(CLASSES) + 1), np.float64)
for _k, _chars in enumerate(CLASSES.values()):
    _TABLE[list(_chars), _k] = 1
_TABLE[128:, len(CLASSES)] = 1


def statistics(text: str) -> np.ndarray:
    raw = text.encode()
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    rest = (np.log1p(len(raw)), np.log1p(len(words)), np.log(n / w), len(set(words)) / w, np.log1p(n / k), 1 - len(set(lines)) / k, shares[7] * n / w)
    return np.concatenate([np.sqrt(shares), rest])


def document_statistics(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t or "") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, x array<double>")


class Fourier:
    """cos(W (x - mean) / spread + phase), with a constant first feature."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.maximum(spread, 1e-3)
        self.w, self.phase = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.cos(z @ self.w + self.phase) * np.sqrt(2 / FEATURES)])


def stack(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pool_violators(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The isotonic fit of the means y / n (bins without rows take the value before them)."""
    blocks: list[list[float]] = []
    for a, b in zip(y, n, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a1, b1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a1, blocks[-1][1] + b1, blocks[-1][2] + k1]
    out, last = [], 0.0
    for a, b, k in blocks:
        last = a / b if b else last
        out += [last] * k
    return np.array(out)


def _summed(rows: DataFrame, size: int, part) -> np.ndarray:
    """Adds up the arrays that ``part`` makes of each batch: one row a task, of at most TASKS tasks, reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(stack(b["x"], len(NAMES)), b["y"].to_numpy(zero_copy_only=False)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["t"])

    return sum((np.array(r[0]) for r in rows.mapInArrow(run, "t array<double>").collect()), np.zeros(size))


class Model:
    def __init__(self, features: Fourier, weights: np.ndarray, levels: np.ndarray):
        self.features, self.weights, self.levels = features, weights, levels

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by linear interpolation between bin centres, plus a little of the raw score to part ties."""
        raw = np.clip(self.raw(x), -0.5, 1.5)
        level = np.interp(raw, (np.arange(BINS) + 0.5) / BINS * 2 - 0.5, self.levels)
        return np.clip(0.98 * level + 0.02 * (raw + 0.5) / 2, 0, 1)


def fit(labelled: DataFrame) -> Model | None:
    """Rows (x, y) to a model; None without rows of both labels."""
    d = len(NAMES)
    rows = cut(labelled.repartition(TASKS), "quality-train")
    moments = _summed(rows, 2 * d + 2, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    n = moments[0]
    if n == 0 or moments[1] in (0, n):
        return None
    mean = moments[2 : d + 2] / n
    features = Fourier(mean, np.sqrt(np.maximum(moments[d + 2 :] / n - mean**2, 0)))
    m = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = _summed(rows, m * (m + 1), normal).reshape(m, m + 1)
    penalty = np.full(m, RIDGE * np.sqrt(n) / FEATURES)
    penalty[0] = 0
    model = Model(features, np.linalg.solve(sums[:, :m] + np.diag(penalty), sums[:, m]), np.zeros(BINS))

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(k, y, BINS), np.bincount(k, minlength=BINS)])

    good, every = _summed(rows, 2 * BINS, bins).reshape(2, BINS)
    # Half a row of the prior in each bin keeps an empty stretch between its neighbours.
    centre = np.clip((np.arange(BINS) + 0.5) / BINS * 2 - 0.5, 0, 1)
    model.levels = pool_violators(good + 0.05 * centre, every + 0.05)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels has doc_id and quality."""
    spark = docs.sparkSession
    rows = cut(document_statistics(docs), "quality-x")
    marked = labels.where(F.col("quality").isNotNull() & (remainder("doc_id", folds) != held)).select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    share = min(1.0, MOST_LABELLED / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    model = spark.sparkContext.broadcast(fit(rows.join(marked, "doc_id").select("x", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = stack(b["x"], len(NAMES))
            score = np.full(len(x), 0.5) if model.value is None else model.value.score(x)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "x").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
