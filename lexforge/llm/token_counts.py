"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens: at most FREQUENT entries, counted by
one task over about SAMPLE_ROWS whole texts, a hash sample (only speed depends on it). Tier two is a cache in each
worker: what the table misses is encoded once by the tokenizer. No pre-token is shuffled.

Texts of common characters are split by a regular expression equal to the tokenizer's own; texts with any other character
by the tokenizer's own normaliser and split, which is slower. Both look up the same table and cache. Only texts with one
of the tokenizer's special strings are counted by the library whole.

Defined cases: null text is empty (0 bytes, 0 tokens); repeated rows are each counted; no rows give no rows; a null id
stays null; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import printed_bytes, small_batches

FREQUENT, SAMPLE_ROWS, SEED = 1 << 16, 2000, 3
CACHE = 400_000
LIMIT = 2048

#: Characters whose lower case, composition, class and white space are the same in the tokenizer and in Python.
COMMON = regex.compile(r"[\t-\r -ɏ‐-‧€]*+")
#: The tokenizer's split, for COMMON characters.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Lengths(dict):
    """Pre-token, in the printed bytes of the tokenizer's alphabet, to its number of tokens; misses are encoded and kept,
    up to CACHE of them. A pre-token of ASCII is printed as itself."""

    def __init__(self, frequent: dict[str, int], path: str):
        super().__init__(frequent)
        self.frequent, self.path = frequent, path

    def __missing__(self, printed: str) -> int:
        n = len(tokenizer(self.path).model.tokenize(printed))
        if len(self) >= len(self.frequent) + CACHE:
            self.clear()
            self.update(self.frequent)
        self[printed] = n
        return n


#: Bytes to the characters that print them; what is not ASCII in a pre-token goes through this table.
PRINTED = dict(zip(range(256), printed_bytes(), strict=True))


def pre_tokens(text: str, path: str) -> list[str]:
    """The printed pre-tokens of a text without special strings."""
    if COMMON.fullmatch(text) is not None:
        found = PRE_TOKEN.findall(text.lower())
        return found if text.isascii() else [w if w.isascii() else "".join(map(PRINTED.__getitem__, w.encode())) for w in found]
    own = tokenizer(path)
    return [w for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))]


def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def count(text: str, lengths: Lengths, special: tuple[str, ...]) -> int:
    if any(s in text for s in special):
        return len(tokenizer(lengths.path).encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, pre_tokens(text, lengths.path)))


def frequent_lengths(rows: DataFrame, path: str) -> dict[str, int]:
    """The FREQUENT most frequent pre-tokens of a hash sample of rows (doc_id, text), and their lengths: one task counts,
    at most FREQUENT rows reach the driver."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).where(F.col("text").isNotNull()).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b["text"].to_pylist():
                seen.update(pre_tokens(text, path))
        lengths = Lengths({}, path)
        words = [w for w, _ in seen.most_common(FREQUENT)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([lengths[w] for w in words], pa.int32())], ["word", "n"])

    return {r["word"]: r["n"] for r in chosen.repartition(1).mapInArrow(run, "word string, n int").collect()}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, for a tokenizers .json file."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    table = spark.sparkContext.broadcast(frequent_lengths(rows, path))
    special = special_strings(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(table.value, path)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            n = [count(t, lengths, special) for t in texts]
            columns = [b["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
