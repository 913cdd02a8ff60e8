"""JSON Lines and polymorphic JSON sources and sinks, and XML archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parsed(line: Column, schema: T.StructType) -> Column:
    """A JSON object as a struct with the field _corrupt, which is null if the line is whole; null if it is no object."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return F.when(F.rlike(line, F.lit(r"^\s*\{")), F.from_json(line, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, __line_number (from 1, blank lines included), value. Lines are ranked within the block of a file that one
    task reads; the counts of the blocks, a row each, say how many lines come before it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    ranked = lines.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return ranked.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("k")).alias("__line_number"), "value")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """file, __line_number, value of the lines that read_tolerant() skips although they are not blank."""
    r = _parsed(F.col("value"), schema)
    return numbered_lines(spark, path).where(~F.rlike("value", F.lit(r"^\s*$")) & (r.isNull() | r["_corrupt"].isNotNull()))


def read_numbered(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """__line_number and the fields of each line that is a JSON object. Other lines but blank ones are skipped, or end a
    strict read with an error that names file and line."""
    lines = numbered_lines(spark, path).where(~F.rlike("value", F.lit(r"^\s*$"))).withColumn("r", _parsed(F.col("value"), schema))
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    if strict:
        where = F.format_string("no JSON object in %s on line %d", "file", "__line_number")
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(where).cast("boolean"))
    return lines.where(good).select("__line_number", *(f"r.`{f.name}`" for f in schema.fields))


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that are JSON objects; blank and malformed lines are skipped."""
    rows = spark.read.text(path).select(_parsed(F.col("value"), schema).alias("r"))
    return rows.where("r is not null and r._corrupt is null").select(*(f"r.`{f.name}`" for f in schema.fields))


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_strict(spark, path, schema) if _there(spark, path) else spark.createDataFrame([], schema)


def read_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array, an object holding a list under a usual name, one object, or JSON lines."""
    text = spark.read.text(path, wholetext=True).select(F.btrim("value", F.lit(" \t\r\n")).alias("v"))
    rows = f"array<{schema.simpleString()}>"
    lists = [F.from_json(F.get_json_object("v", f"$.{k}"), rows) for k in ("data", "records", "definitions", "items")]
    whole = F.try_parse_json("v").isNotNull()
    many = F.when(F.col("v").startswith("["), F.from_json("v", rows)).otherwise(F.coalesce(*lists, F.array(F.from_json("v", schema))))
    return text.where(whole).select(F.explode(many).alias("r")).select("r.*").unionByName(
        text.where(~whole).select(F.explode(F.split("v", "\n")).alias("line")).where(F.try_parse_json("line").isNotNull()).select(F.from_json("line", schema).alias("r")).select("r.*"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_progress(spark: SparkSession, path: str) -> int:
    """The row at which a review goes on: 0 where nothing valid is stored."""
    if not _there(spark, path):
        return 0
    stored = F.try_parse_json(F.concat_ws("\n", F.sort_array(F.collect_list("value"))))
    at = spark.read.text(path, wholetext=True).agg(F.try_variant_get(stored, "$.current_index", "long")).head()[0]
    return max(at or 0, 0)


def save_progress(spark: SparkSession, path: str, index: int) -> None:
    spark.range(1).select(F.to_json(F.struct(F.lit(index).alias("current_index")))).coalesce(1).write.mode("overwrite").text(path)
