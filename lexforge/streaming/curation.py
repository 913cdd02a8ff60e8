"""The stateless operators on streams, and keyed deduplication and counts under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import mining as M


def mined(stream: DataFrame, text: str = "text", inventory=P.INVENTORY) -> DataFrame:
    """Candidates of a stream of articles: the batch operator, unchanged and without state."""
    return M.mine(stream, text, inventory)


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within ``delay``; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def label_counts(candidates: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Candidates a label and event-time window."""
    rows = candidates.withWatermark(time, delay).select(time, F.explode("matched_definition_patterns").alias("label"))
    return rows.groupBy(F.window(time, window), "label").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "label", "n")
