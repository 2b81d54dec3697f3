"""Readers with explicit schemas: CSV, JSON documents, and a directory routed by a column; missing inputs raise one typed error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class MissingInput(FileNotFoundError):
    """A table that an earlier step writes is not there."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by Spark's own file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, *paths: str) -> str:
    """The first of these paths that is there."""
    for path in paths:
        if exists(spark, path):
            return path
    raise MissingInput(f"none of {', '.join(paths)} is there; run the step that writes it first")


def csv(spark: SparkSession, path: str, schema: StructType | str, dates: dict[str, str] | None = None, order: str | None = None, rows: int | None = None) -> DataFrame:
    """CSV with a header; dates maps string columns to their formats; the first rows are those by an explicit order."""
    df = spark.read.schema(schema).csv(resolve(spark, path), header=True)
    df = df.withColumns({c: F.to_date(c, f) for c, f in (dates or {}).items()}) if dates else df
    return df if rows is None else df.orderBy(order).limit(rows)


def json_documents(spark: SparkSession, paths: str | list[str], schema: StructType | str, file_column: str | None = None) -> DataFrame:
    """One document (or array of documents) a file; the file's name, which often carries a key, as a column."""
    df = spark.read.schema(schema).option("multiLine", True).json(paths)
    return df.withColumn(file_column, F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)) if file_column else df


def catalogue(entries: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Every entry of a catalogue with what was found for it, or a note that nothing was."""
    return entries.join(found.withColumn("_found", F.lit(True)), key, "left").withColumn("note", F.when(F.col("_found").isNull(), "NO MATCHES FILE")).drop("_found")


def routed(spark: SparkSession, folder: str, schema: StructType | str, column: str, routes: dict[str, str]) -> DataFrame:
    """All CSV files of a folder, each row with the league that its division stands for; other divisions are left out."""
    df = spark.read.schema(schema).csv(f"{folder}/*.csv", header=True)
    table = spark.createDataFrame(list(routes.items()), f"{column} string, league string")
    return df.join(F.broadcast(table), column)
