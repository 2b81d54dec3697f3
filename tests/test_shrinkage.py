"""Shrunk trees against the recursion from the root."""

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import shrinkage as H
from larkspur.operators import trees as T


def table(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(a > 3) + 0.3 * rnd.normal(), "pqr"[int(a + b) % 3], i % 3) for i, (a, b) in enumerate(rnd.integers(0, 8, (150, 2)))]
    return spark.createDataFrame(rows, "i int, a double, b double, y double, c string, fold int")


def plain(tree, lam):
    sums = H.node_sums(tree)
    width = 1 if tree.classes is None else len(tree.classes)
    out = {}

    def go(k, value):
        if k in tree.leaves:
            out[k] = value
            return
        for child in (2 * k, 2 * k + 1):
            go(child, value + (sums[child][1 : 1 + width] / sums[child][0] - sums[k][1 : 1 + width] / sums[k][0]) / (1 + lam / sums[k][0]))

    go(1, sums[1][1 : 1 + width] / sums[1][0])
    return out


def test_values_are_those_of_the_recursion(spark):
    df = table(spark)
    for y, kind in (("y", "variance"), ("c", "gini")):
        tree = T.grow(df, ["a", "b"], y, kind, 3)
        assert len(tree.splits) > 2
        got = H.shrunk_leaves(tree, [0.0, 5.0, 1e12])
        for i, lam in enumerate((0.0, 5.0, 1e12)):
            want = plain(tree, lam)
            assert got.keys() == want.keys() and all(np.allclose(got[k][i], want[k]) for k in want)
        top = H.node_sums(tree)[1]
        assert all(np.allclose(v[2], top[1 : 1 + len(v[2])] / top[0]) for v in got.values())  # all pulled to the root


def test_losses_and_the_chosen_penalty(spark):
    df = table(spark)
    for y, kind in (("y", "variance"), ("c", "gini")):
        scores = H.losses(df, "i", ["a", "b"], y, kind, "fold", [0, 1], (1.0, 50.0), depth=1)
        got = {(r["fold"], r["lam"]): r["loss"] for r in scores.collect()}
        for f in range(2):
            tree = T.grow(df.where(F.col("fold") != f), ["a", "b"], y, kind, 1)
            held = T.leaf(df.where(F.col("fold") == f), tree).select(y, "leaf").collect()
            for i, lam in enumerate((1.0, 50.0)):
                values = H.shrunk_leaves(tree, (1.0, 50.0))
                each = [(r[y] - values[r["leaf"]][i][0]) ** 2 if kind == "variance" else -np.log(max(1e-15, values[r["leaf"]][i][tree.classes.index(r[y])])) for r in held]
                assert abs(got[f, lam] - np.mean(each)) < 1e-9
        best = min((1.0, 50.0), key=lambda lam: sum(got[f, lam] for f in range(2)))
        assert H.chosen(scores).first()["lam"] == best
    forest, lam = H.fit(df, "i", ["a"], "y", "variance", "fold", [0], (1.0,), depth=1)
    assert lam == 1.0 and len(forest) == 1


def test_a_forest_is_the_mean_of_its_trees(spark):
    df = table(spark)
    forest = H.grow_forest(df, "i", ["a", "b"], "y", "variance", 2, 1)
    assert len({str(t.leaves) for t in forest}) == 2
    got = H.with_values(df, forest, [7.0], "s").select("i", "s").collect()
    one = [{r["i"]: H.shrunk_leaves(t, [7.0])[r["leaf"]][0][0] for r in T.leaf(df, t).collect()} for t in forest]
    assert all(abs(r["s"][0][0] - sum(o[r["i"]] for o in one) / 2) < 1e-9 for r in got)
