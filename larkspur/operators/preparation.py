"""Encoding, imputation, scaling, selection, splitting and resampling. What is fitted is fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators.concordance import kendall_value
from larkspur.operators.neighbors import nearest
from larkspur.operators.ordering import global_rank, percentile_row, running_within, saved

#: Levels of one column that become columns of their own, at most.
MOST_LEVELS = 1000


def levels(df: DataFrame, column: str) -> list:
    """The distinct values, sorted; more than MOST_LEVELS are refused."""
    got = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(MOST_LEVELS + 1).collect()]
    if len(got) > MOST_LEVELS:
        raise ValueError(f"{column} has over {MOST_LEVELS} levels")
    return got


def one_hot(df: DataFrame, column: str, fitted: list, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each fitted level; values that were not fitted get zeros."""
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in fitted[drop_first:]})


def ordinal_map(column: str, places: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col(column)]


def label_encode(df: DataFrame, column: str, fitted: list, name: str) -> DataFrame:
    """The place of the value among the fitted levels, -1 for others."""
    return df.withColumn(name, F.coalesce(F.array_position(F.array(*[F.lit(v) for v in fitted]), F.col(column)) - 1, F.lit(-1)).cast("int"))


def frequency_codes(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values with their ranks from 0 (ties by value)."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)
    return top.withColumn("code", (F.row_number().over(Window.orderBy(F.desc("n"), column)) - 1).cast("int"))  # n rows


def medians(train: DataFrame, columns: list[str]) -> DataFrame:
    return percentile_row(train, {f"{c}__median": (c, 0.5) for c in columns})


def impute_median(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(medians(train, columns)))
    return out.withColumns({c: F.coalesce(c, f"{c}__median") for c in columns}).drop(*[f"{c}__median" for c in columns])


def impute_mode(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(train.agg(*[F.mode(c, True).alias(f"{c}__mode") for c in columns])))
    return out.withColumns({c: F.coalesce(c, f"{c}__mode") for c in columns}).drop(*[f"{c}__mode" for c in columns])


def scale(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1 by the training rows; a deviation of 0 counts as 1."""
    stats = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")).otherwise(1.0) for c in columns}).drop(*[f"{c}__{k}" for c in columns for k in "ms"])


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, over rows that have both; 0 for a column that does not vary. One aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def r(a: str, b: str) -> Column:
        x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
        return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))

    row = df.agg(*[r(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns (see `concordance`), one row."""
    return df.sparkSession.createDataFrame([(kendall_value(df, x, y),)], "tau double")


def kendall_kept(df: DataFrame, columns: list[str], label: str, bound: float = 0.5) -> DataFrame:
    """column, tau_label, kept: which columns `prune_kendall` leaves, with each one's tau with the label. A few counts a pair of columns; rows stay where they are."""
    tau = {(a, b): kendall_value(df, a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    with_label = {c: kendall_value(df, c, label) for c in columns}
    kept = prune_kendall(tau, columns, with_label, bound)
    return df.sparkSession.createDataFrame([(c, with_label[c], c in kept) for c in columns], "column string, tau_label double, kept boolean")


def prune_kendall(tau: dict[tuple[str, str], float], columns: list[str], label: dict[str, float], bound: float = 0.5) -> list[str]:
    """Columns left when, of two that go together, the one closer to the label stays."""
    out = set()
    for i, a in enumerate(columns):
        if a in out:
            continue
        for b in columns[i + 1 :]:
            if b in out or abs(tau[a, b]) <= bound:
                continue
            if abs(label[a]) >= abs(label[b]):
                out.add(b)
            else:
                out.add(a)
                break
    return [c for c in columns if c not in out]


def prune_pearson(r: dict[tuple[str, str], float], label: dict[str, float], columns: list[str], bound: float = 0.85) -> list[str]:
    out = {(b if abs(label[a]) >= abs(label[b]) else a) for (a, b), v in r.items() if abs(v) > bound}
    return [c for c in columns if c not in out]


def ranked_within(df: DataFrame, group: list[str], key: str, seed: int, purpose: str, name: str) -> DataFrame:
    """1, 2, ... in random but repeatable order within each group, which may be of any size."""
    out = running_within(df.withColumn("_draw", S.draw(seed, purpose, F.col(key))), group, ["_draw", key], {name: F.lit(1)})
    return out.drop("_draw").withColumn(name, F.col(name).cast("int"))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Column is_test: per class, max(1, floor(n * share)) rows."""
    out = ranked_within(df, [label], key, seed, "split", "_r").join(F.broadcast(df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))), F.col(label).eqNullSafe(F.col("_label")))
    return out.withColumn("is_test", F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_r", "_n", "_label")


def kfold(df: DataFrame, key: str, k: int, label: str, seed: int = 42) -> DataFrame:
    return ranked_within(df, [label], key, seed, "fold", "_r").withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def group_kfold(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """All rows of a group in one fold."""
    return df.withColumn("fold", F.floor(S.unit(seed, "group", F.col(group)) * k).cast("int"))


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement; a smaller n gives a part of a larger one's rows."""
    return df.orderBy(S.draw(seed, "sample", F.col(key)), key).limit(n)


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest has."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    return ranked_within(df, [label], key, seed, "under", "_r").crossJoin(F.broadcast(least)).where("_r <= _least").drop("_r", "_least")


def balanced_bootstrap(df: DataFrame, label: str, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """Per replicate: the minority drawn with replacement, and as many rows of the majority without. Columns replicate and pick."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min("n").alias("_least"), F.min_by(label, F.struct("n", label)).alias("_minority"))
    ranked = df.crossJoin(F.broadcast(least)).withColumn("_is", F.col(label) == F.col("_minority"))
    minority = ranked_within(ranked.where("_is"), [label], key, seed, "order", "_k")
    reps = lambda x: x.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    picks = reps(minority.select(F.col("_k").alias("pick"), "_least")).withColumn("_k", (F.floor(S.unit(seed, "boot", F.col("replicate"), F.col("pick")) * F.col("_least")) + 1).cast("int"))
    drawn = picks.drop("_least").join(minority, "_k").drop("_k", "_least", "_minority", "_is")
    rest = ranked_within(reps(ranked.where("NOT _is")).withColumn("_key", F.concat_ws(":", "replicate", key)), ["replicate"], "_key", seed, "major", "pick").where("pick <= _least").drop("_key", "_least", "_minority", "_is")
    return drawn.unionByName(rest)


def smote(df: DataFrame, key: str, vector: str, label: str, minority, n_new: int, k: int = 5, seed: int = 42) -> DataFrame:
    """n_new synthetic rows of a class: a drawn row, moved towards a drawn neighbour. With no neighbour, a copy."""
    own = df.where(F.col(label) == minority).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    near = saved(nearest(own, own, "key", "v", k).select(F.col("query").alias("key"), F.col("key").alias("other"), "rank"))
    numbered = global_rank(own, ["key"], "_k")
    total = own.agg(F.count(F.lit(1)).alias("_n"))
    many = near.groupBy("key").agg(F.max("rank").alias("_near"))
    new = df.sparkSession.range(1, n_new + 1).withColumnRenamed("id", "new_id").crossJoin(F.broadcast(total))
    new = new.withColumn("_k", (F.floor(S.unit(seed, "base", F.col("new_id")) * F.col("_n")) + 1).cast("long")).join(numbered, "_k").join(many, "key", "left")
    new = new.withColumn("rank", (F.floor(S.unit(seed, "near", F.col("new_id")) * F.coalesce("_near", F.lit(1))) + 1).cast("int")).join(near, ["key", "rank"], "left")
    new = new.join(own.select(F.col("key").alias("other"), F.col("v").alias("w")), "other", "left")
    step = S.unit(seed, "step", F.col("new_id"))
    moved = F.zip_with("v", F.coalesce("w", "v"), lambda x, y: x + step * (y - x))
    return new.select("new_id", F.col("key").alias("base"), "other", moved.alias("vector"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, weight = n / (classes * n of the class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return c.crossJoin(F.broadcast(t)).select(label, (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def refuse_snapshots(df: DataFrame, column: str = "snapshot") -> DataFrame:
    """Snapshots of one entity may not be resampled: synthetic rows would mix entities' moments."""
    if column in df.columns:
        raise ValueError("snapshot tables are not resampled")
    return df
