"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

One network reads a window of bytes forwards, one backwards; at every position a softmax over both states labels the
byte's language, and a document's probabilities are the mean over all its positions. Training is by backpropagation
through time with Adam on the driver, from about TRAIN_DOCS texts a language (a hash sample) and WINDOWS_EACH windows at
hashed places of each whole text; long texts are read in windows of CORE bytes with EDGE bytes of context on either side, all positions counted.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows of null language are never learnt
from; with no labelled rows every document is ``und``; ties between languages go to the first by code point; repeated
rows are each labelled; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, small_batches

HIDDEN, STEPS, BATCH, RATE, SEED = 6, 300, 64, 0.02, 5
TRAIN_DOCS, WINDOWS_EACH = 300, 3
TRAIN_BYTES, CORE, EDGE = 112, 184, 8
LANES = 1024
UND = "und"
LETTER = regex.compile(r"\p{L}")


class Direction:
    """One gated recurrent layer: the byte's row of a table, plus the former state through two matrices."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.table = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.gates = rng.normal(0, 0.3, (h, 2 * h)).astype(np.float32)
        self.turn = rng.normal(0, 0.3, (h, h)).astype(np.float32)

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: bytes (time, lanes); the states (time, lanes, hidden). keep: gets what learning needs."""
        h = HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        # sigmoid(a) = (1 + tanh(a / 2)) / 2: one kind of function, and the halves are folded into the weights.
        table, gates = self.table * np.repeat(np.float32([0.5, 0.5, 1]), h), self.gates * np.float32(0.5)
        for t in range(len(x)):
            a = table[x[t]]
            g = a[:, : 2 * h] + state @ gates
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            u, r = g[:, :h], g[:, h:]
            s = state @ self.turn
            c = a[:, 2 * h :] + r * s
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((state, u, r, s, c))
            state = c + u * (state - c)
            out[t] = state
        return out

    def states(self, x: np.ndarray) -> np.ndarray:
        """As run(), for reading only: (time, hidden, lanes), whose rows are contiguous, in buffers used again."""
        h, lanes = HIDDEN, x.shape[1]
        table = self.table * np.repeat(np.float32([0.5, 0.5, 1]), h)
        # r * s = (1 + tanh) * s / 2: the half goes into the matrix.
        gates, turn = np.ascontiguousarray(self.gates.T) * np.float32(0.5), np.ascontiguousarray(self.turn.T) * np.float32(0.5)
        out = np.empty((len(x) + 1, h, lanes), np.float32)
        out[0] = 0
        a, g, s = np.empty((lanes, 3 * h), np.float32), np.empty((2 * h, lanes), np.float32), np.empty((h, lanes), np.float32)
        u, r, into = g[:h], g[h:], a.T
        for t in range(len(x)):
            state, c = out[t], out[t + 1]
            np.take(table, x[t], axis=0, out=a, mode="clip")
            np.matmul(gates, state, out=g)
            g += into[: 2 * h]
            np.tanh(g, out=g)
            np.matmul(turn, state, out=s)
            np.multiply(r, s, out=r)
            s += r
            s += into[2 * h :]
            np.tanh(s, out=s)
            np.subtract(state, s, out=c)
            c *= np.float32(0.5)
            np.multiply(u, c, out=u)
            c += u
            c += s
        return out[1:]

    def learn(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, gates and turn, back through time."""
        h = HIDDEN
        d_table, d_gates, d_turn = np.zeros_like(self.table), np.zeros_like(self.gates), np.zeros_like(self.turn)
        d = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            before, u, r, s, c = keep[t]
            d = d + d_out[t]
            d_c = d * (1 - u) * (1 - c * c)
            d_u = d * (before - c) * u * (1 - u)
            d_s = d_c * r
            d_r = d_c * s * r * (1 - r)
            both = np.hstack([d_u, d_r])
            d_gates += before.T @ both
            d_turn += before.T @ d_s
            np.add.at(d_table, x[t], np.hstack([both, d_c]))
            d = d * u + both @ self.gates.T + d_s @ self.turn.T
        return [d_table, d_gates, d_turn]


class Network:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.forth, self.back = Direction(rng), Direction(rng)
        self.top = rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every position: (time, languages, lanes). States are within (-1, 1), so exp is safe."""
        top = np.ascontiguousarray(self.top.T)
        p = np.matmul(top[:, :HIDDEN], self.forth.states(x))
        p += np.matmul(top[:, HIDDEN:], self.back.states(x[::-1]))[::-1]
        p += self.bias[:, None]
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def step(self, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        kept: tuple[list, list] = ([], [])
        both = np.concatenate([self.forth.run(x, kept[0]), self.back.run(x[::-1], kept[1])[::-1]], axis=2)
        flat = both.reshape(-1, 2 * HIDDEN)
        logits = flat @ self.top + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), np.tile(y, len(x))] -= 1
        p /= len(p)
        d = (p @ self.top.T).reshape(both.shape)
        grads = [flat.T @ p, p.sum(0), *self.forth.learn(x, kept[0], d[:, :, :HIDDEN]), *self.back.learn(x[::-1], kept[1], d[::-1, :, HIDDEN:])]
        own = [self.top, self.bias, *(a for n in (self.forth, self.back) for a in (n.table, n.gates, n.turn))]
        return list(zip(own, grads, strict=True))

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """The mean probabilities of each text's positions, (texts, languages)."""
        total = np.zeros((len(texts), len(self.languages)))
        size = CORE + 2 * EDGE
        owner, lanes = [], []
        for k, raw in enumerate(texts):
            cut = np.frombuffer(b"\n" * EDGE + raw + b"\n" * (EDGE + -len(raw) % CORE), np.uint8)
            view = np.lib.stride_tricks.sliding_window_view(cut, size)[::CORE]
            lanes.append(view)
            owner.append(np.full(len(view), k))
        x, who = np.concatenate(lanes), np.concatenate(owner)
        last = np.bincount(who, minlength=len(texts))
        place = np.arange(len(who)) - np.repeat(np.cumsum(last) - last, last)
        length = np.array([len(t) for t in texts])
        real = np.minimum(CORE, length[who] - place * CORE)
        for a in range(0, len(x), LANES):
            w, n = who[a : a + LANES], real[a : a + LANES]
            p = self.positions(np.ascontiguousarray(x[a : a + LANES].T))[EDGE:-EDGE]
            if (n < CORE).any():
                p *= (np.arange(CORE)[:, None] < n)[:, None, :]
            np.add.at(total, w, p.sum(0).T)
        return total / np.maximum(length, 1)[:, None]


def train(examples: list[tuple[str, str]]) -> Network | None:
    """(window, language) pairs to a network; None without any."""
    examples = [(t.encode(), lang) for t, lang in examples if t and lang]
    if not examples:
        return None
    net = Network(sorted({lang for _, lang in examples}))
    rng = np.random.default_rng(SEED)
    by: list[list[np.ndarray]] = [[] for _ in net.languages]
    for raw, lang in sorted(examples):
        by[net.languages.index(lang)].append(np.frombuffer(raw[:TRAIN_BYTES].ljust(TRAIN_BYTES, b"\n"), np.uint8))
    pools = [np.stack(x) for x in by]
    moments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(1, STEPS + 1):
        y = rng.integers(0, len(pools), BATCH)
        x = np.stack([pools[c][rng.integers(0, len(pools[c]))] for c in y], axis=1)
        for i, (own, grad) in enumerate(net.step(x, y)):
            m, v = moments.setdefault(i, (np.zeros_like(own), np.zeros_like(own)))
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            own -= RATE * (1 - k / (STEPS + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
    return net


def sample(docs: DataFrame, fold_of: int, held: int) -> list[tuple[str, str]]:
    """WINDOWS_EACH windows, at hashed places, of about TRAIN_DOCS whole texts of each language, from rows that may be
    learnt from, by hash. Only windows reach the driver: at most so many a language."""
    rows = docs.where(F.col("lang").isNotNull() & (remainder("doc_id", fold_of) != held) & F.rlike("text", F.lit(r"\S")))
    counts = rows.groupBy("lang").count().collect()  # a row a language
    rank = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 40))
    chosen = None
    for r in counts:
        most = min(1 << 40, int((1 << 40) * 1.2 * TRAIN_DOCS / r["count"]) + 1)
        here = (F.col("lang") == r["lang"]) & (rank < most)
        chosen = here if chosen is None else chosen | here
    if chosen is None:
        return []
    at = [F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1 + j)), F.greatest(F.length("text") - TRAIN_BYTES + 1, F.lit(1))) + 1 for j in range(WINDOWS_EACH)]
    windows = F.array(*(F.substring("text", p.cast("int"), F.lit(TRAIN_BYTES)) for p in at))
    got = rows.where(chosen).select(windows.alias("w"), "lang", rank.alias("k")).orderBy("k", "w").limit(2 * TRAIN_DOCS * len(counts)).collect()
    return [(w, r["lang"]) for r in got for w in r["w"]]


def identify(docs: DataFrame, fold_of: int = 4, held: int = 2, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; with carry: all columns of docs, then lang_pred, score
    (where docs has columns of these names, identify_rows() keeps them apart)."""
    held_out = (remainder("doc_id", fold_of) == held).alias("held_out")
    columns = [F.col(f"`{c}`") for c in docs.columns] if carry else [F.col("doc_id").cast("long").alias("doc_id"), held_out]
    return identify_rows(docs, columns, fold_of, held).select("row.*", "lang_pred", "score")


def identify_rows(docs: DataFrame, columns: list[Column], fold_of: int = 4, held: int = 2) -> DataFrame:
    """The given columns as struct ``row``, lang_pred and score of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    net = spark.sparkContext.broadcast(train(sample(docs, fold_of, held)))
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for b in batches:
            texts = b["t"].to_pylist()
            lang, score = [UND] * len(texts), [0.0] * len(texts)
            real = [k for k, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
            held_bytes, group = 0, []
            for k in [*real, None]:
                if k is not None:
                    group.append(k)
                    held_bytes += len(texts[k])
                if group and (k is None or held_bytes > 2_000_000):
                    p = model.documents([texts[i].encode() for i in group])
                    for i, best, top in zip(group, p.argmax(1), p.max(1), strict=True):
                        lang[i], score[i] = model.languages[best], min(1.0, float(top))
                    held_bytes, group = 0, []
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(lang), pa.array(score)], ["row", "lang_pred", "score"])

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
