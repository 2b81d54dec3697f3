"""Ranks over whole tables without a single task that sees all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local master may do without (tests): it gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="larkspur-")


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1, 2, ... over the whole table in this order, which must end in a unique key.

    Rows are dealt by ranges of the order (sampled splitters), numbered within each range, and moved up by the sizes of the
    ranges before; the only thing that meets in one place is one count for each range.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._range") < F.col("a._range"), "left").groupBy(F.col("a._range").alias("_range")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, within).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def running_within(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with a running sum of each column over the rows of its group up to this one, in an order that ends in a unique key.

    As in `global_rank`, rows are dealt by ranges, of group and order, so a group of any size is spread over tasks; only one
    sum for each range and group goes from range to range.
    """
    values = {f"_value{k}": c for k, c in enumerate(sums.values())}
    ranged = saved(df.withColumns(values).repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    heads = {f"_group{k}": F.col(g) for k, g in enumerate(group)}
    parts = ranged.groupBy(F.col("_range").alias("_part"), *[c.alias(n) for n, c in heads.items()]).agg(*[F.sum(v).alias(f"{v}_part") for v in values])
    earlier = Window.partitionBy(*heads).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the group has ranges
    before = parts.select("_part", *heads, *[F.coalesce(F.sum(f"{v}_part").over(earlier), F.lit(0)).alias(f"{v}_before") for v in values])
    within = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"{v}_within": F.sum(v).over(within) for v in values})
    same = F.col("_range") == F.col("_part")
    for n, c in heads.items():
        same = same & c.eqNullSafe(F.col(n))
    out = out.join(before, same)
    return out.select(*df.columns, *[(F.col(f"{v}_within") + F.col(f"{v}_before")).alias(name) for v, name in zip(values, sums)])


def percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, share, value: exact percentiles without nulls, between two neighbours in proportion; null for a column without values.

    Values are folded with their counts, summed up in order by ranges (`running_within`), and only the two neighbours of
    each wanted place leave the table.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    folded = df.select(pairs.alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    summed = saved(running_within(folded, ["column"], ["value"], {"upto": F.col("n")}))
    names = df.sparkSession.createDataFrame([(c, float(s)) for c in columns for s in shares], "column string, share double")
    wanted = names.join(summed.groupBy("column").agg(F.max("upto").alias("total")), "column", "left").withColumn("place", F.col("share") * (F.col("total") - 1))
    wanted = wanted.withColumn("low", F.floor("place")).withColumn("high", F.least(F.col("low") + 1, F.col("total") - 1))
    has = lambda place: (F.col(place) >= F.col("upto") - F.col("n")) & (F.col(place) < F.col("upto"))
    near = summed.join(F.broadcast(wanted.where("total IS NOT NULL")), "column").where(has("low") | has("high"))  # a row for each column and share
    found = near.groupBy("column", "share").agg(F.max(F.when(has("low"), F.col("value"))).alias("a"), F.max(F.when(has("high"), F.col("value"))).alias("b"), F.first(F.col("place") - F.col("low")).alias("part"))
    return names.join(found.select("column", "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value")), ["column", "share"], "left")


def percentile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a percentile (column, share) under each name."""
    found = percentiles(df, list(dict.fromkeys(c for c, _ in wanted.values())), sorted({s for _, s in wanted.values()}))
    return found.agg(*[F.max(F.when((F.col("column") == c) & (F.col("share") == float(s)), F.col("value"))).alias(name) for name, (c, s) in wanted.items()])
