"""A corpus pipeline of five stages over documents: language, quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet and reads back as the next
stage's documents. All but the last return the columns of documents, whatever further columns these have.

Defined cases: each stage's operator states its own. An empty table passes through every stage; a null language is
filled in by the first; documents without a letter go there, too short or repetitive ones and outliers in the second;
of the rows of one component the third keeps those of its least id, one row of them, and it keeps rows without an id; the
fourth repeats or drops whole documents, drops those without a word, and brings them into the order of the schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import language_id, mixing, near_dedup, packing, quality_rules
from lexforge.llm.common import cut, discard, small, table

#: No SQL twin: the stages train a network and estimate robust covariances.
ORACLE_SQL = None
#: Over held-out rows of 20 words or more on sf0.01, 241 of 241 texts reach it, and 5 of 241 whose letters are drawn at random.
LEAST_SCORE = 0.6
#: Words of a shingle in the stage of near duplicates; four are the contract of op8_near_dedup alone.
SHINGLE = 5
#: Ids (8 bytes each) that a broadcast may hold; more are joined by a shuffle.
MOST_IDS = 1_000_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no identifiable language; names the language of rows that had none."""
    found = language_id.identify_rows(docs, [F.col(f"`{c}`") for c in docs.columns])
    keep = (F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)
    named = F.coalesce("row.lang", "lang_pred").alias("lang")
    return found.where(keep).select(*(named if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.good_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: what else a component holds is dropped by an anti join; so are rows of one id after
    the first. The ids to drop are broadcast if a count shows that they are few."""
    judged = near_dedup.near_duplicates(docs, SHINGLE)
    lost = cut(judged.where(~F.col("kept")).select("doc_id").distinct(), "stage-lost")
    kept = docs.join(small(lost, MOST_IDS), "doc_id", "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))
    again = cut(judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "stage-again")
    discard(judged)
    if not again.head(1):
        return kept
    once = kept.join(small(again, MOST_IDS), "doc_id", "left_semi").select(*(kept[f"`{c}`"] for c in kept.columns)).dropDuplicates(["doc_id"])
    return kept.join(small(again, MOST_IDS), "doc_id", "left_anti").select(*(kept[f"`{c}`"] for c in kept.columns)).unionByName(once)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, to the nearest whole number, in the order of its slots: only the
    documents at the end of a source's last pass are taken in part. Rows of one id share their mean and their slots."""
    share = F.try_divide(F.sum("taken"), F.sum("size"))
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.round(F.coalesce(share, F.lit(0.0))).cast("int").alias("times"), F.min("first_slot").alias("a"), F.min("second_slot").alias("b"))
    copies = small(cut(taken.where("times > 0").select("doc_id", F.slice(F.array("a", F.coalesce("b", "a")), 1, F.col("times")).alias("slots")), "stage-mix"), MOST_IDS)
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    again = rows.join(copies, rows["id"].eqNullSafe(copies["doc_id"])).select("row", F.explode("slots").alias("slot"))
    return again.orderBy("slot", "row.doc_id").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("source_mix", mix_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # the given table is not one that cut() wrote, and stays
    return STAGES[-1][1](spark, docs, sf_dir)
