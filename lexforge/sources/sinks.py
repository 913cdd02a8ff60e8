"""Sinks: routed outputs, one-object reports, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written


def write_routes(rows: DataFrame, path: str, route: str = "route") -> None:
    """One folder of JSON lines a route, in one pass over ``rows``; nulls are kept."""
    rows.write.mode("overwrite").partitionBy(route).option("ignoreNullFields", "false").json(path)


def routes(rows: DataFrame, names: list[str], route: str = "route") -> dict[str, DataFrame]:
    """Each route as a DataFrame of its own; ``rows`` is computed once."""
    table = written(rows, "routes")
    return {name: table.where(F.col(route) == name).drop(route) for name in names}


def summary(**parts: DataFrame) -> DataFrame:
    """One row with a column ``report``: a JSON object of a list of records a part. Parts are reports, of few rows."""
    listed = {name: df.agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(name)) for name, df in parts.items()}
    (name, first), *others = listed.items()
    out = first.select(name, *(df.scalar().alias(n) for n, df in others))
    return out.select(F.to_json(F.struct(*parts), {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def write_summary(path: str, **parts: DataFrame) -> None:
    summary(**parts).coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
