"""Tables in the folder that the cluster shares: lineage cuts that outlive any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder under a local master, else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, what: str, schema: StructType | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, by ``schema`` if one is given."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexforge/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def held(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds ``columns``, each made once a row: a generator holds them, where the optimiser would repeat those of a
    projection in each filter and each use."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select("*", made.alias("__held")).select(*(F.col(f"`{c}`") for c in rows.columns if c not in columns), *(F.col(f"__held.{n}").alias(n) for n in columns))


def is_few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether ``df``, a written table of short rows, has at most ``most`` rows and so can be broadcast."""
    return df.limit(most + 1).count() <= most


def running_index(rows: DataFrame, order: str, name: str, lot: int = 1 << 16) -> DataFrame:
    """Adds ``name``: 1, 2, ... in order of the whole number ``order``. Rows are numbered within lots of that number; only
    the sizes of lots are summed up in one task."""
    tagged = rows.withColumn("__lot", F.floor(F.col(order) / lot))
    before = F.sum("__n").over(Window.orderBy("__lot")) - F.col("__n")
    lots = tagged.groupBy("__lot").agg(F.count("*").alias("__n")).select(F.col("__lot").alias("__l"), before.alias("__before"))
    here = F.row_number().over(Window.partitionBy("__lot").orderBy(order))
    ranked = tagged.withColumn("__here", here)
    out = ranked.join(lots, ranked["__lot"].eqNullSafe(lots["__l"]))
    return out.select(*(ranked[f"`{c}`"] for c in rows.columns), (F.col("__here") + F.col("__before")).alias(name))
