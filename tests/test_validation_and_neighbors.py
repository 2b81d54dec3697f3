"""Cross-validation, several classes, calibration and neighbours against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import neighbors as N
from larkspur.operators import validation as V
from larkspur.operators.models import rbf


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(240, 3)) * [1, 50, 0.01] + [5, -3, 0]
    y = x @ [1.0, 0.2, -30] + rnd.normal(size=240)
    label = np.digitize(y, np.quantile(y, [0.3, 0.8]))
    rows = [(i, *map(float, x[i]), float(y[i]), int(label[i]), i % 4) for i in range(240)]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, y double, label int, fold int"), x, y, label


def test_folds_are_scaled_by_their_own_training_rows(table):
    df, x, y, _ = table
    got = {(r["fold"], r["penalty"]): r for r in V.cross_validate(df, ["a", "b", "c"], "y", "fold", [0.0, 3.0, 500.0]).collect()}
    fold = np.arange(240) % 4
    for f in range(4):
        train, test = fold != f, fold == f
        mean, sd = x[train].mean(0), x[train].std(0)
        z, t = (x[train] - mean) / sd, (x[test] - mean) / sd
        for p in (0.0, 3.0, 500.0):
            w = np.linalg.solve(z.T @ z + p * np.eye(3), z.T @ (y[train] - y[train].mean()))
            r = got[f, p]
            assert abs(r["mse"] - ((y[test] - y[train].mean() - t @ w) ** 2).mean()) < 1e-6 and (r["n_train"], r["n_test"]) == (180, 60)
    best = V.chosen(V.cross_validate(df, ["a", "b", "c"], "y", "fold", [0.0, 500.0])).first()
    assert best["penalty"] == 0.0 and best["folds"] == 4


def test_a_fixed_feature_nulls_and_a_single_fold(table):
    df = table[0].withColumn("d", F.lit(2.0)).withColumn("a", F.when(F.col("i") > 5, F.col("a")))
    rows = V.cross_validate(df, ["a", "d"], "y", "fold", [1.0]).collect()
    assert len(rows) == 4 and all(np.isfinite(r["mse"]) for r in rows) and sum(r["n_test"] for r in rows) == 234
    assert V.cross_validate(df.withColumn("fold", F.lit(1)), ["a"], "y", "fold", [1.0]).count() == 0


@pytest.mark.parametrize("classes", [3, 2])
def test_logistic_steps_are_those_of_each_class_alone(table, classes):
    df, x, y, label = table
    df, label = df.withColumn("label", F.least("label", F.lit(classes - 1))), np.minimum(label, classes - 1)
    model = V.Logistic(df, ["a", "c"], "label", rate=0.05, steps=6, lam=0.1)
    xs = x[:, [0, 2]]
    want = []
    for c in range(classes) if classes > 2 else [1]:
        w, b = np.zeros(2), 0.0
        for _ in range(6):
            e = 1 / (1 + np.exp(-(xs @ w + b))) - (label == c)
            w, b = w - 0.05 * (xs.T @ e / 240 + 0.1 * w), b - 0.05 * e.mean()
        want.append([b, *w])
    assert np.allclose(model.w, want)
    p = 1 / (1 + np.exp(-(xs @ np.array(want)[:, 1:].T + np.array(want)[:, 0])))
    p = p / p.sum(1, keepdims=True) if classes > 2 else np.hstack([1 - p, p])
    got = sorted(model.predict(df).select("i", "shares", "prediction").collect())
    assert np.allclose([r["shares"] for r in got], p) and [r["prediction"] for r in got] == p.argmax(1).tolist()


def test_kernel_ridge_of_classes_is_that_of_each_alone(table):
    df, x, _, label = table
    df = df.withColumn("v", F.array("a", "c"))
    model, classes, used = V.kernel_ridge_classes(df, "i", "v", "label", rbf(0.5), 0.7)
    k = rbf(0.5)(x[:, [0, 2]], x[:, [0, 2]])
    want = k @ np.linalg.solve(k + 0.7 * np.eye(240), np.array([[label == c for c in range(3)]]).reshape(3, 240).T.astype(float))
    got = sorted(model.apply(df.select("i", "v"), "v", "s").select("i", "s", V.class_of_scores("s", classes).alias("p")).collect())
    assert used == 240 and np.allclose([r["s"] for r in got], want) and [r["p"] for r in got] == want.argmax(1).tolist()


def test_sigmoids_reach_the_least_loss_and_shares_stay_over_the_floor(table):
    df = table[0].withColumns({"p": 1 / (1 + F.exp(-F.col("y"))), "q": 1 / (1 + F.exp(F.col("y")))}).withColumn("two", (F.col("label") > 0).cast("int"))
    fit = V.Sigmoids(df, ["q", "p"], "two", [0, 1])
    rows = df.select("q", "p", "two").toPandas()
    for (a, b), s, c in zip(fit.fits, ("q", "p"), (0, 1)):
        own = (rows["two"] == c).sum()
        t = np.where(rows["two"] == c, (own + 1) / (own + 2), 1 / (240 - own + 2))
        loss = lambda a, b: -(t * np.log(1 / (1 + np.exp(-(a * rows[s] + b)))) + (1 - t) * np.log(1 - 1 / (1 + np.exp(-(a * rows[s] + b))))).sum()  # noqa: E731, B023
        assert all(loss(a, b) <= loss(a + da, b + db) for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
    for methods in (("isotonic", "sigmoid"), ("sigmoid",), ()):
        out, used = V.calibrated(df, df, ["q", "p"], "two", [0, 1], methods)
        assert used == (methods[0] if methods else "uncalibrated") and out.columns == df.columns
        assert all(abs(r["p"] + r["q"] - 1) < 1e-9 and min(r["p"], r["q"]) > 0.0049 for r in out.collect())
    assert V.calibrated(df.where("two = 1"), df, ["q", "p"], "two", [0, 1], ("sigmoid",))[1] == "uncalibrated"


def plain_nearest(rows, k):
    out = []
    for i, g, v in rows:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 9), j) for j, h, w in rows if j != i and h == g)
        out += [(i, j, d, r + 1) for r, (d, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("chunk,part,pivots", [(4096, 20_000, 64), (7, 5, 5)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, chunk, part, pivots):
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "PART", part)
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab") if i < 300 else None, [float(rnd.randint(0, 9)), rnd.choice([0.0, 5.0, 1000.0])]) for i in range(310)]
    rows += [(400 + i, "c", [1.0, 1.0]) for i in range(40)] + [(500, "alone", [1.0, 1.0]), (501, "two", [1.0, 2.0]), (502, "two", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "i long, g string, v array<double>").repartition(4)
    assert sorted(tuple(r) for r in N.nearest(df, df, "i", "v", 3, "g", pivots).collect()) == plain_nearest(rows, 3)
    one = [(i, "x", v) for i, _, v in rows]
    assert sorted(tuple(r) for r in N.nearest(df, df.where("i < 20"), "i", "v", 4, None, pivots).collect()) == [r for r in plain_nearest(one, 4) if r[0] < 20]


def test_no_join_of_neighbours_compares_by_inequality(spark, capsys):
    df = spark.range(50).select("id", F.array(F.col("id") * 1.0).alias("v"))
    near = N.nearest(df, df, "id", "v", 2)
    near.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and near.count() == 100


def test_classes_are_filled_up_and_a_single_row_is_repeated(spark):
    rnd = random.Random(5)
    rows = [(i, "big", [rnd.random(), rnd.random() * 1000]) for i in range(30)] + [(100 + i, "small", [float(i), 1000.0 * i]) for i in range(4)] + [(200, "one", [7.0, 7.0])]
    got = N.smote_scaled(spark.createDataFrame(rows, "i long, y string, v array<double>"), "i", "v", "y", k=2).collect()
    assert sorted(r["new_id"] for r in got if r["label"] == "small") == list(range(1, 27)) and sum(r["label"] == "one" for r in got) == 29
    for r in got:
        if r["label"] == "one":
            assert r["other"] is None and list(r["vector"]) == [7.0, 7.0]
        else:
            a, b = r["base"] - 100, r["other"] - 100
            assert 0 < abs(a - b) <= 2 and min(a, b) <= r["vector"][0] <= max(a, b) and abs(r["vector"][1] - 1000 * r["vector"][0]) < 1e-6
    assert N.smote_scaled(spark.createDataFrame([], "i long, y string, v array<double>"), "i", "v", "y").count() == 0


def test_a_study_fits_every_seed_and_arm_on_its_own_rows(table):
    df, x, y, _ = table
    df = df.withColumn("two", (F.col("y") > 12).cast("int"))
    two = (y > 12).astype(float)
    train = np.arange(240) % 3 > 0
    got = {(r["seed"], r["arm"], r["penalty"]): r for r in V.study(df, "i", ["a", "b"], "two", F.col("i") % 3 > 0, [1, 2], [0.0, 9.0]).collect()}
    assert len(got) == 2 * 4 * 2
    share = {c: (two[train] == c).sum() for c in (0, 1)}
    xs = x[:, :2]
    for arm in ("none", "weighted"):
        w = np.array([1.0 if arm == "none" else min(share.values()) / share[c] for c in two[train]])
        mean = (w[:, None] * xs[train]).sum(0) / w.sum()
        sd = np.sqrt((w[:, None] * (xs[train] - mean) ** 2).sum(0) / w.sum())
        z, centre = (xs - mean) / sd, (w * two[train]).sum() / w.sum()
        for p in (0.0, 9.0):
            beta = np.linalg.solve((z[train] * w[:, None]).T @ z[train] + p * np.eye(2), (z[train] * w[:, None]).T @ (two[train] - centre))
            said = (centre + z[~train] @ beta) >= 0.5
            r, t = got[1, arm, p], two[~train] == 1
            assert abs(r["accuracy"] - (said == t).mean()) < 1e-9 and abs(r["recall"] - said[t].mean()) < 1e-9 and abs(r["specificity"] - (~said[~t]).mean()) < 1e-9
            assert got[2, arm, p]["gmean"] == r["gmean"]  # no draws in these arms
    means = {(r["arm"], r["penalty"]): r for r in V.over_seeds(V.study(df, "i", ["a", "b"], "two", F.col("i") % 3 > 0, [1, 2], [0.0])).collect()}
    assert means["none", 0.0]["accuracy_std"] == 0 and means["none", 0.0]["seeds"] == 2 and len(means) == 4


def test_draws_of_arms_keep_their_shares(spark):
    df = spark.range(4000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    w = V.arm_weights(F.col("y"), F.when(F.col("y") == 0, 3.0).otherwise(1.0), F.lit(5), F.col("id"))
    r = df.select("y", *[c.alias(a) for a, c in w.items()]).groupBy("y").agg(*[F.avg(a).alias(a) for a in V.ARMS]).collect()
    got = {x["y"]: x for x in r}
    assert got[1]["undersampled"] == 1.0 and abs(got[0]["undersampled"] - 1 / 3) < 0.04 and all(abs(got[c]["bootstrapped"] - 1) < 0.1 for c in (0, 1))
