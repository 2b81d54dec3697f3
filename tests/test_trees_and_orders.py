"""Trees by level against plain growth; running sums and percentiles against NumPy."""

import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import trees as T
from larkspur.operators.ordering import percentiles, running_within


def impurity(kind, y):
    if kind == "variance":
        return float(np.var(y)) if len(y) else 0.0
    return 1 - sum((y == c).mean() ** 2 for c in set(y)) if len(y) else 0.0


def plain(x, y, kind, depth, node=1, least_split=5, least_leaf=2):
    """node -> rows' leaf, by looking at every threshold; nulls (nan) go to the right."""
    if depth == 0 or len(y) < least_split or len(set(y)) == 1:
        return {node: len(y)}
    best = None
    for f in range(x.shape[1]):
        v = x[:, f][~np.isnan(x[:, f])]
        values = np.unique(v)
        tried = np.percentile(v, np.linspace(5, 95, 15)) if len(values) > 20 else (values[:-1] + values[1:]) / 2
        for t in tried:
            left = x[:, f] <= t
            if left.sum() < least_leaf or (~left).sum() < least_leaf:
                continue
            if kind == "hellinger":
                a, b = y == 1, y == 0
                score = (np.sqrt(left[a].mean()) - np.sqrt(left[b].mean())) ** 2 + (np.sqrt((~left)[a].mean()) - np.sqrt((~left)[b].mean())) ** 2
            else:
                score = impurity(kind, y) - left.mean() * impurity(kind, y[left]) - (~left).mean() * impurity(kind, y[~left])
            key = (-round(score, 9), f, t)
            if best is None or key < best[0]:
                best = (key, left)
    if best is None or kind != "hellinger" and -best[0][0] <= 0:
        return {node: len(y)}
    left = best[1]
    return plain(x[left], y[left], kind, depth - 1, 2 * node) | plain(x[~left], y[~left], kind, depth - 1, 2 * node + 1)


def table(spark, n=160, classes=3):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        a, b, c = rnd.randint(0, 90), rnd.randint(0, 5), rnd.random()
        rows.append((i, None if rnd.random() < 0.1 else float(a), float(b), c, (a // 30 + b + (c > 0.5)) % classes))
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y int")
    x = np.array([[np.nan if r[1] is None else r[1], r[2], r[3]] for r in rows])
    return df, x, np.array([r[4] for r in rows], float)


def test_trees_are_those_of_plain_growth(spark):
    df, x, y = table(spark)
    for kind in ("gini", "variance"):
        tree = T.grow(df, ["a", "b", "c"], "y", kind, 3)
        want = plain(x, y, kind, 3)
        assert {k: s[0] for k, s in tree.leaves.items()} == want
        assert {r[0]: r[1] for r in T.leaf(df, tree).groupBy("leaf").count().collect()} == want
        means = {r[0]: r[1] for r in T.leaf(df, tree).groupBy("leaf").agg(F.avg("y")).collect()}
        if kind == "variance":
            assert all(abs(r["prediction"] - means[r["leaf"]]) < 1e-9 for r in T.predict(T.leaf(df, tree), tree).collect())
        else:
            assert all(abs(sum(r["s"]) - 1) < 1e-9 and r["prediction"] == tree.classes[int(np.argmax(r["s"]))] for r in T.predict(df, tree, shares="s").collect())


def test_hellinger_parts_two_classes_at_any_midpoint(spark):
    df, x, y = table(spark, 15, 2)  # under 20 values, so that midpoints are tried by both
    assert {k: s[0] for k, s in T.grow(df, ["a", "b", "c"], "y", "hellinger", 3).leaves.items()} == plain(x, y, "hellinger", 3)


def test_trees_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(float(i), "x") for i in range(9)], "a double, y string")
    tree = T.grow(df, ["a"], "y")
    assert tree.splits == {} and T.predict(df, tree).select("prediction").distinct().collect()[0][0] == "x"
    none = T.grow(df.limit(0), ["a"], "y")
    assert [r["prediction"] for r in T.predict(df, none).collect()] == [None] * 9
    nulls = df.withColumn("a", F.lit(None).cast("double")).withColumn("y", F.when(F.rand(1) > 0.5, "x").otherwise("z"))
    assert T.grow(nulls, ["a"], "y").splits == {}


def test_running_sums_within_groups_of_any_size(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["big"] * 20 + ["a", None]), i, rnd.randint(0, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(6)
    got = {r["i"]: (r["s"], r["k"]) for r in running_within(df, ["g"], ["v", "i"], {"s": F.col("v"), "k": F.lit(1)}).collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for k, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))):
            total += v
            assert got[i] == (total, k + 1)


def test_percentiles_are_exact_and_pass_nulls_by(spark):
    rnd = random.Random(10)
    rows = [(rnd.choice([None, *range(30)]), rnd.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b double").withColumn("none", F.lit(None).cast("double"))
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["share"]): r["value"] for r in percentiles(df, ["a", "b", "none"], shares).collect()}
    for c, values in (("a", [a for a, _ in rows if a is not None]), ("b", [b for _, b in rows])):
        for s in shares:
            assert abs(got[c, s] - np.quantile(values, s)) < 1e-9
    assert all(got["none", s] is None for s in shares)
