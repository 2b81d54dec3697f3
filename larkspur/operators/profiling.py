"""Data profiles: missing values, outliers, constant columns, leakage, labels. Each is one or two aggregates over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import percentile_row


def unpivoted(row: DataFrame, columns: list[str], stats: list[str]) -> DataFrame:
    """A row of aggregates named column|stat as one row per column."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").cast("double").alias(s) for s in stats]) for c in columns])).alias("x")).select("x.*")


def missing(df: DataFrame, columns: list[str], numeric: list[str], bound: float = 0.3, most: float = 0.6) -> DataFrame:
    """column, n_missing, share, strongest correlation of being missing with a numeric column, and MAR, MNAR or MCAR."""

    def r(gone: Column, y: str) -> Column:
        x = F.when(F.col(y).isNotNull(), gone.cast("double"))
        return F.when(F.count(y) > 10, F.abs(F.coalesce(F.try_divide(F.covar_pop(x, F.col(y).cast("double")), F.stddev_pop(x) * F.stddev_pop(F.col(y).cast("double"))), F.lit(0.0)))).otherwise(0.0)

    aggs = []
    for c in columns:
        gone = F.col(c).isNull()
        others = [r(gone, y) for y in numeric if y != c] or [F.lit(0.0)]
        aggs += [F.count_if(gone).alias(f"{c}|n_missing"), F.avg(gone.cast("int")).alias(f"{c}|share"), reduce(lambda a, b: F.greatest(a, b), others).alias(f"{c}|corr")]
    out = unpivoted(df.agg(*aggs), columns, ["n_missing", "share", "corr"])
    return out.where("n_missing > 0").withColumn("kind", F.when(F.col("corr") > bound, "MAR").when(F.col("share") > most, "MNAR").otherwise("MCAR"))


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows with |z| > 3, rows outside 1.5 interquartile ranges (exact quartiles); what the last pass gets is one row."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    quartiles = percentile_row(df, {f"{c}__q{k}": (c, k / 4) for c in columns for k in (1, 3)})
    joined = df.select(*columns).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(quartiles))
    aggs = []
    for c in columns:
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        aggs += [
            F.count_if(F.abs(F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s"))) > 3).alias(f"{c}|n_z"),
            F.count_if((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))).alias(f"{c}|n_iqr"),
        ]
    return unpivoted(joined.agg(*aggs), columns, ["n_z", "n_iqr"])


def near_constant(df: DataFrame, columns: list[str], bound: float = 0.99) -> DataFrame:
    """column, distinct values, the most frequent one's share, and whether that is above the bound."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL")
    counted = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    g = counted.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), (F.max("n") / F.sum("n")).alias("top_share"))
    return g.withColumn("near_constant", (F.col("top_share") > bound) | (F.col("n_unique") <= 1))


def skewness(x: str) -> Column:
    """Bias-corrected; null for fewer than three rows or no variation."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), skewness(column).alias("skew"), F.min(column).alias("min"), F.max(column).alias("max"), F.count_distinct(column).alias("n_unique"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"), (F.max("n") / F.min("n")).alias("ratio"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.least(F.lit(bins), F.greatest(F.lit(1), F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rebuilt(df: DataFrame, target: str, features: list[str], tolerance: float = 0.005, bound: float = 0.99) -> DataFrame:
    """numerator, denominator, share, leaks: for each two features, the share of rows whose target is their ratio, and whether that gives the target away. One aggregate."""
    pairs = [(a, b) for a in features for b in features if a != b]
    same = lambda a, b: F.abs(F.try_divide(F.col(a), F.col(b)) - F.col(target)) <= tolerance
    row = df.agg(*[(F.count_if(same(a, b)) / F.greatest(F.count(target), F.lit(1))).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("numerator"), F.lit(b).alias("denominator"), F.col(f"`{a}|{b}`").alias("share")) for a, b in pairs]))
    return row.select(cells.alias("x")).select("x.*").withColumn("leaks", F.col("share") > bound)


def refused(columns: list[str], banned: list[str] = (), prefixes: list[str] = ("future_",)) -> list[str]:
    """Of feature columns, those that may not be used: banned ones, and those whose names say that they look ahead (any case)."""
    return [c for c in columns if c.lower() in {b.lower() for b in banned} or c.lower().startswith(tuple(p.lower() for p in prefixes))]


def guarded(df: DataFrame, features: list[str], banned: list[str] = (), prefixes: list[str] = ("future_",)) -> DataFrame:
    """df, unless a feature is refused."""
    if found := refused(features, banned, prefixes):
        raise ValueError(f"features that may not be used: {', '.join(found)}")
    return df


def binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, is_binary: whether every value that is there is 0 or 1."""
    row = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(False)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("is_binary")) for c in columns])).alias("x")).select("x.*")
