"""Hierarchically shrunk trees: every node's value is pulled towards its parent's, s = s(parent) + (mu - mu(parent)) / (1 + lam / n(parent)),
with lam chosen by validation inside the training rows.

A tree comes from `trees.grow`, with the sums of its leaves; those of inner nodes are their children's. All penalties are worked out along each path at once,
so a leaf has one value for each of them, and one scan of the rows scores all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import trees as T

PENALTIES = (0.1, 1.0, 10.0, 25.0, 50.0, 100.0, 500.0)


def node_sums(tree: T.Tree) -> dict[int, np.ndarray]:
    """The sums of every node."""
    out = {k: np.array(s, float) for k, s in tree.leaves.items()}
    for k in sorted(tree.splits, reverse=True):
        out[k] = out[2 * k] + out[2 * k + 1]
    return out


def shrunk_leaves(tree: T.Tree, penalties) -> dict[int, np.ndarray]:
    """leaf -> its values by penalty: of each class's share, or of the mean of y alone."""
    sums = node_sums(tree)
    width = 1 if tree.classes is None else len(tree.classes)
    mean = {k: s[1 : 1 + width] / s[0] for k, s in sums.items() if len(s)}
    lam, out = np.array(penalties, float)[:, None], {}
    for leaf in mean.keys() & tree.leaves.keys():
        value = np.repeat(mean[1][None], len(lam), 0)
        for up in range(leaf.bit_length() - 1, 0, -1):
            parent, child = leaf >> up, leaf >> up - 1
            value = value + (mean[child] - mean[parent])[None] / (1 + lam / sums[parent][0])
        out[leaf] = value
    return out


def with_values(df: DataFrame, forest: list[T.Tree], penalties, name: str) -> DataFrame:
    """df with an array of arrays: for each penalty the mean over the trees of the leaf's values. Trees are broadcast tables."""
    out, names = df, []
    for i, tree in enumerate(forest):
        leaf, column = f"_leaf{i}", f"_values{i}"
        table = df.sparkSession.createDataFrame([(k, v.tolist()) for k, v in shrunk_leaves(tree, penalties).items()], f"{leaf} long, {column} array<array<double>>")
        out = T.leaf(out, tree, leaf).join(F.broadcast(table), leaf, "left").drop(leaf)
        names.append(column)
    total = names[0]
    for other in names[1:]:
        total = f"zip_with({total}, {other}, (a, b) -> zip_with(a, b, (x, y) -> x + y))"
    return out.withColumn(name, F.expr(f"transform({total}, a -> transform(a, x -> x / {len(names)}))")).drop(*names)


def grow_forest(df: DataFrame, key: str, features: list[str], y: str, kind: str, trees: int = 1, depth: int = 5, seed: int = 42, **more) -> list[T.Tree]:
    """Trees; with more than one, each on a bootstrap of its own: a row comes as often as a hash of its key says (0 to 6 times, one on average)."""
    if trees == 1:
        return [T.grow(df, features, y, kind, depth, **more)]
    out = []
    for i in range(trees):
        u = S.unit(seed, f"tree{i}", F.col(key))
        times = sum((F.when(u >= bound, 1).otherwise(0) for bound in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)), F.lit(0))  # Poisson with mean 1
        drawn = df.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        out.append(T.grow(drawn, features, y, kind, depth, **more))
    return out


def losses(df: DataFrame, key: str, features: list[str], y: str, kind: str, fold: str, folds: list[int], penalties=PENALTIES, trees: int = 1, depth: int = 5, **more) -> DataFrame:
    """fold, lam, n, loss: for each fold, trees of the other rows, and the loss of each penalty on the fold's (mean squared error, or log loss of the class's share)."""
    out = None
    for k in folds:
        forest = grow_forest(df.where(F.col(fold) != k), key, features, y, kind, trees, depth, **more)
        held = with_values(df.where(F.col(fold) == k).where(F.col(y).isNotNull()), forest, penalties, "_shrunk")
        if kind == "variance":
            loss = [(F.col("_shrunk")[i][0] - F.col(y)) * (F.col("_shrunk")[i][0] - F.col(y)) for i in range(len(penalties))]
        else:
            # (a class that the training rows lack has no share)
            place = F.array_position(F.array(*[F.lit(c) for c in forest[0].classes]), F.col(y)).cast("int")
            share = [F.coalesce(F.get(F.col("_shrunk")[i], place - 1), F.lit(0.0)) for i in range(len(penalties))]
            loss = [-F.ln(F.greatest(F.lit(1e-15), F.least(F.lit(1.0), s))) for s in share]
        one = held.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"_l{i}") for i, x in enumerate(loss)])
        rows = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("lam"), F.col(f"_l{i}").alias("loss")) for i, p in enumerate(penalties)]))
        one = one.select(F.lit(k).alias("fold"), "n", rows.alias("x")).select("fold", "x.lam", "n", "x.loss")
        out = one if out is None else out.unionByName(one)
    return out


def chosen(scores: DataFrame) -> DataFrame:
    """lam, loss: the penalty with the least mean loss over the folds (ties: the smaller)."""
    means = scores.groupBy("lam").agg(F.avg("loss").alias("loss"))
    return means.agg(F.min_by(F.struct("lam", "loss"), F.struct(F.round("loss", 9), "lam")).alias("x")).select("x.*")


def fit(df: DataFrame, key: str, features: list[str], y: str, kind: str, fold: str, folds: list[int], penalties=PENALTIES, trees: int = 1, depth: int = 5, **more) -> tuple[list[T.Tree], float]:
    """Trees of all rows, and the penalty that the folds chose."""
    lam = chosen(losses(df, key, features, y, kind, fold, folds, penalties, trees, depth, **more)).first()["lam"]
    return grow_forest(df, key, features, y, kind, trees, depth, **more), lam
