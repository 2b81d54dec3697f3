"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one that spark.checkpoint.dir names. Only a local master may do without (tests): it gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="larkspur-")


def checkpointing(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def saved(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: later uses read it back, also when executors are lost."""
    checkpointing(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """Shuffle files of an action go when it ends, not when the driver next collects garbage. For jobs of many actions that read one another's checkpoints only."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names close to bases that df does not have (Spark's names ignore case)."""
    taken, names = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def words_of(text: Column) -> Column:
    """The words of a text, in order; empty for null and for texts without one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that other columns of docs can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_parts(batches, rows: int = 256, size: int = 1 << 20):
    """Arrow batches cut into parts of at most so many rows and, unless one row has more, bytes: long texts that come together don't add up in a worker."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > size):
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def eights(flat: np.ndarray) -> np.ndarray:
    """At each place, and at the end, the eight bytes from there on as one number, the first byte highest; zeros stand behind the end."""
    return np.ndarray((len(flat) + 1,), ">u8", np.concatenate([flat, np.zeros(8, np.uint8)]), strides=(1,))
