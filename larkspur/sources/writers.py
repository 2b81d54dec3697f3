"""Writers: tables as Parquet or CSV with columns in a given order, parameters as JSON text with sorted keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators.relational import ordered_columns


def table(df: DataFrame, path: str, order: list[str] | None = None, partition: list[str] | None = None, kind: str = "parquet") -> None:
    writer = (ordered_columns(df, order) if order else df).write.mode("overwrite")
    writer = writer.partitionBy(*partition) if partition else writer
    writer.option("header", True).format(kind).save(path)


def parameters(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str) -> dict:
    """The parameters, or none where nothing was written."""
    from larkspur.sources.readers import exists

    return json.loads(spark.read.text(path).first()[0]) if exists(spark, path) else {}
