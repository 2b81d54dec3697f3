"""From raw documents to encoded training text: five stages, each written as Parquet and read again by the next.

Results for odd rows: null, empty and wordless texts fail the quality rules and go; rows that repeat id and text
count as copies, of which one stays; null ids are documents like others and stay behind those with an id; a null
source is a source; very long texts are worked on whole; other columns are carried along, whatever their names, up
to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, jaccard_join, mixing, pii, quality_rules
from larkspur.llm.common import shared_folder
from larkspur.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that the rules reject go."""
    return quality_rules.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard_join.dedupe(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in angle brackets."""
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources come near their target weights."""
    return mixing.sample(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row for each document taken, with the number of its ids and digests of ids and decoded text."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The mix draws at random by hashes that DuckDB lacks.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later stage reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with a table in the shared folder between each two. Each table goes once the next one is
    written; the last one stays, as the result reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
