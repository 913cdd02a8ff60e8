"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The mix has about SLOTS slots of equally many words. Golden-ratio points are mapped through the cumulative target shares
of the sources, so that every stretch of the schedule holds the sources in their proportions. The slots of a source are
ranked; slot k takes block k of that source's documents, which are shuffled by a hash of their ids and cut into blocks of
a slot's words; after the last block a second pass begins, after which further slots stay empty. What a document gives
to the mix follows from the points alone: a source comes within a few slots of its target, a few millionths of the mix.

Ranks and running sums go by (source, bucket) first and then over bucket totals, so no source is ever in one task.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; equal hashes go by id;
each repeated row counts as a document; documents of size 0 are returned and take 0; no documents give no rows;
other columns are ignored. The number of sources must fit one task (they are aggregated first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, word_count

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SLOTS = 1 << 20
BUCKET_BITS = 10
SEED = "mix-1:"
GOLDEN = 0.6180339887498949


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the shuffle key h (60 bits of md5 over the seed and the id)."""
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row per source: number, size, target, cumulative target share, and the words and number of all slots.

    Water filling: sources sorted by how soon their bound of ``most`` times their size is reached; the level is the
    largest that any prefix of full sources leaves, and each target is the lesser of the bound and level times weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(every)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") * most / F.col("w"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("spare", F.sum("source_size").over(whole) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
    s = s.withColumn("left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.max(F.col("spare") / F.col("left")).over(whole))
    s = s.withColumn("target", F.least(F.col("source_size").cast("double") * most, F.col("level") * F.col("w")))
    total = F.sum("target").over(whole)
    share_of = F.sum("target").over(Window.orderBy("sid")) / F.greatest(total, F.lit(1e-9))
    s = s.withColumn("block", F.greatest(F.ceil(total / SLOTS), F.lit(1)).cast("long")).withColumn("n", F.ceil(total / F.col("block")).cast("long"))
    return s.select("source", "sid", "source_size", "target", share_of.alias("upto"), "block", "n")


def schedule(targets: DataFrame) -> DataFrame:
    """The mix in order: slot, sid, pass (0 or 1), at (number of the block that the slot takes)."""
    spark = targets.sparkSession
    n = targets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    bounds = targets.agg(F.sort_array(F.collect_list("upto")).alias("b")).scalar()
    points = spark.range(0, n).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("u"), bounds.alias("b"))
    drawn = points.select("slot", F.expr("cast(least(size(filter(b, x -> x <= u)) + 1, size(b)) as int)").alias("sid"), F.expr("slot div 65536").alias("chunk"))
    upto = F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")
    offset = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n")).select("sid", "chunk", upto.alias("offset"))
    local = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("local", local).join(offset, ["sid", "chunk"]).select("slot", "sid", (F.col("local") + F.col("offset")).alias("k"))
    blocks = targets.select("sid", F.expr("(source_size + block - 1) div block").alias("blocks"))
    return ranked.join(blocks, "sid").where(F.col("k") < MOST * F.col("blocks")).select("slot", "sid", F.expr("cast(k div blocks as int)").alias("pass"), F.expr("k % blocks").alias("at"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), first_slot and second_slot
    (where either pass first takes of the document, or null), a row per document."""
    sizes = cut(sized(docs), "mix-sizes")
    targets = cut(source_targets(sizes), "mix-targets")
    lookup = small(targets.select("source", "sid", "source_size", "target", "block"), 10_000)
    keyed = sizes.join(lookup, sizes["source"].eqNullSafe(lookup["source"])).select("doc_id", "size", "h", "sid", "source_size", "target", "block", F.shiftright("h", 60 - BUCKET_BITS).alias("bucket"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size")
    running = keyed.withColumn("rn", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")
    offset = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", base.alias("base"))
    placed = running.join(offset, ["sid", "bucket"]).withColumn("from", F.col("base") + F.col("upto") - F.col("size"))
    pieces = placed.withColumn("at", F.explode_outer(F.expr("CASE WHEN size > 0 THEN sequence(`from` div block, (`from` + size - 1) div block) END")))
    part = F.least(F.col("from") + F.col("size"), (F.col("at") + 1) * F.col("block")) - F.greatest(F.col("from"), F.col("at") * F.col("block"))
    used = pieces.withColumn("part", part).join(schedule(targets), ["sid", "at"], "left")
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("part"))), F.lit(0))
    slots = [F.min(F.when(F.col("pass") == p, F.col("slot"))).alias(name) for p, name in enumerate(("first_slot", "second_slot"))]
    return used.groupBy("sid", "bucket", "rn", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"), *slots).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "second_slot")
