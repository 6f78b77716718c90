"""Parquet as read-only tables of the dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.bridge import spark_type
from quillon.plans.compile import Relation


def relation(df: DataFrame, key: list[str] | None = None) -> Relation:
    """Any DataFrame as a table; columns of types the dialect lacks pass through untouched."""
    cols = [(f.name, spark_type(f.dataType.simpleString())) for f in df.schema]
    df = df.select(*[df[f.name].cast("double") if f.dataType.simpleString() == "float" else df[f.name].cast("timestamp_ntz") if f.dataType.simpleString() == "timestamp" else df[f.name] for f in df.schema])
    return Relation(df, cols, key=list(key or []))


def attach(spark: SparkSession, path: str, key: list[str] | None = None) -> Relation:
    return relation(spark.read.parquet(path), key)
