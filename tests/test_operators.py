"""Hand-computed cases for the operators' rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import metrics as M
from larkspur.operators import models as L
from larkspur.operators import preparation as P
from larkspur.operators import profiling as Q
from larkspur.operators import relational as R
from larkspur.operators import temporal as T
from larkspur.operators.ordering import global_rank


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_prior_mean_skips_nulls_and_the_row_itself(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 4.0, 5.0])], "k int, i int, x double")
    assert [r[0] for r in rows(T.prior_mean(df, "k", ["i"], ["x"]).orderBy("i").select("form_x"))] == [None, 1.0, 1.0, 2.5]


def test_clock_never_goes_back(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 46), (1, 2, 3, 45), (1, 2, 4, 47)], "m int, period int, i int, minute int")
    assert [r[0] for r in rows(T.effective_clock(df, "m", ["period", "i"], "minute").orderBy("i").select("eff"))] == [1, 46, 46, 47]


def test_prefix_windows_are_closed_at_both_ends(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 9), (1, 21)], "m int, eff int")
    one = {"n": F.lit(1)}
    for operator in (T.prefix_state, T.prefix_state_range):
        got = operator(df, "m", "eff", one, {"late": F.lit(1)}, grid=(20, 20, 5)).select("n", "late")
        assert rows(got) == [(3, 2)]


@pytest.mark.parametrize("days,sizes", [(3, (1, 1, 1)), (4, (2, 1, 1)), (10, (6, 2, 2))])
def test_split_sizes(spark, days, sizes):
    df = spark.createDataFrame([(f"2020-01-{d + 1:02d}",) for d in range(days)], "d string").withColumn("d", F.to_date("d"))
    got = dict(rows(T.date_split(df, "d").groupBy("split").count()))
    assert tuple(got[k] for k in ("train", "validation", "test")) == sizes


@pytest.mark.parametrize("n,want", [(2, [2, 2]), (4, [1, 2, 2, 3]), (5, [1, 1, 2, 3, 3]), (7, [1, 1, 2, 2, 3, 3, 3])])
def test_terciles(spark, n, want):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "k int, v double")
    got = [r[0] for r in rows(T.tercile(df, "v", "k", "t").orderBy("v").select("t"))]
    edges = [1 if 3 * i < n - 1 else 2 if 3 * i < 2 * (n - 1) else 3 for i in range(n)] if n > 2 else [2] * n
    assert got == edges


def test_global_rank_numbers_all_rows(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id")).repartition(7)
    got = rows(global_rank(df, ["x", "id"]).select("x", "rank"))
    assert [r for _, r in sorted(got)] == list(range(1, 1001))


def test_names_resolve_exactly_then_fuzzily(spark):
    a = spark.createDataFrame([("Atlético Madrid",), ("Man City",), ("St-Etienne",)], "name string")
    b = spark.createDataFrame([("Atletico Madrid",), ("Manchester City",), ("Saint Etienne",), ("Sevilla",)], "name string")
    got = {r[0]: r[1:] for r in rows(R.resolve_names(a, b))}
    assert got["Atlético Madrid"] == ("Atletico Madrid", "exact") and got["Man City"] == ("Manchester City", "fuzzy") and got["St-Etienne"][0] == "Saint Etienne"
    assert rows(R.resolve_names(a, b, overrides={"Man City": "Sevilla"}).where("method = 'override'"))[0][1] == "Sevilla"


def test_validated_join_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(R.ContractError):
        R.validated_join(a, b, ["k"])
    with pytest.raises(R.ContractError):
        R.require_columns(a, {"k", "missing"})


def test_auc_counts_ties_half_and_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert rows(M.auc(df, F.col("y") == 1, "s")) == [(0.875,)]
    assert rows(M.auc(df.where("y = 1"), F.col("y") == 1, "s")) == [(None,)]


def test_constant_columns_do_not_raise(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert rows(P.pearson(df, ["a", "b"])) == [("a", "b", 0.0)]
    assert rows(M.regression(df, "a", "b").select("r2", "corr")) == [(0.0, 0.0)]
    assert rows(Q.distribution(df, "a").select("skew")) == [(None,)]


def test_rps_and_calibration_edges(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (1.0,), (0.0,)], "c double")
    bins = {r[0]: r[1] for r in rows(M.reliability(df, "c", F.lit(True)).select("bin", "n"))}
    assert bins == {1: 2, 3: 1, 10: 1}
    p, hit = [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(False), F.lit(False), F.lit(True)]
    assert rows(df.limit(1).select(M.rps(p, hit)))[0][0] == 1.0


def test_scalars(spark):
    df = spark.createDataFrame([("Saint-Étienne", "01:02:03.5", "$1,234", "95%", "01/02/98")], "n string, c string, m string, p string, d string")
    got = df.select(S.normalised_name(F.col("n")), S.clock_seconds(F.col("c")), S.money(F.col("m")), S.percent(F.col("p")), F.year(S.short_date(F.col("d"))), S.clipped(F.lit(7.0), 0.0, 5.0), S.sane(F.lit(float("inf"))))
    assert rows(got) == [("saint etienne", 3723.5, 1234.0, 0.95, 1998, 5.0, 0.0)]


def test_smote_lies_between_neighbours_and_copies_a_lone_row(spark):
    df = spark.createDataFrame([(i, 1, [float(i), 0.0]) for i in range(4)] + [(9, 0, [5.0, 5.0])], "k long, y int, v array<double>")
    got = rows(P.smote(df, "k", "v", "y", 1, 20))
    assert len(got) == 20 and all(0 <= r[3][0] <= 3 and r[3][1] == 0 for r in got)
    assert all(r[3] == [5.0, 5.0] for r in rows(P.smote(df, "k", "v", "y", 0, 3)))


def test_splits_keep_shares_and_groups(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    assert dict(rows(P.stratified_split(df, "y", "id").where("is_test").groupBy("y").count())) == {0: 22, 1: 7}
    assert dict(rows(P.undersample(df, "y", "id").groupBy("y").count())) == {0: 25, 1: 25}
    boot = P.balanced_bootstrap(df, "y", "id", 2)
    assert {r for r in rows(boot.groupBy("replicate", "y").count())} == {(1, 0, 25), (1, 1, 25), (2, 0, 25), (2, 1, 25)}
    with pytest.raises(ValueError):
        P.refuse_snapshots(df.withColumn("snapshot", F.lit(1)))


def test_unseen_level_is_all_zeros(spark):
    df = spark.createDataFrame([("a",), ("z",)], "x string")
    assert rows(P.one_hot(df, "x", ["a", "b"]).select("x_a", "x_b")) == [(1, 0), (0, 0)]


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(i, i, [float(i)]) for i in range(3)], "id long, label int, v array<double>")
    near = L.top_k(df, df.where("id = 0"), "id", "v", 5, ["label"])
    assert near.count() == 2 and rows(L.knn_classify(near, "label")) == [(0, 1)]


def test_kernel_ridge_and_pca_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, v.tolist(), float(v.sum())) for i, v in enumerate(x)], "id long, v array<double>, y double")
    k = L.rbf(0.5)(x, x)
    got = np.array([r[0][0] for r in rows(L.kernel_ridge(df, "id", "v", "y", L.rbf(0.5)).apply(df, "v", "p").orderBy("id").select("p"))])
    assert np.allclose(got, k @ np.linalg.solve(k + np.eye(30), x.sum(1)))
    p = np.array([r[0] for r in rows(L.kernel_pca(df, "id", "v", L.rbf(0.5)).apply(df, "v", "p").orderBy("id").select("p"))])
    c = k - k.mean(0)[None] - k.mean(1)[:, None] + k.mean()
    assert np.allclose((p**2).sum(0), np.linalg.eigvalsh(c)[::-1][:2])
    z = np.array([r[0] for r in rows(L.nystroem(df, "id", "v", L.rbf(0.5), 30).apply(df, "v", "p").orderBy("id").select("p"))])
    assert np.allclose(z @ z.T, k, atol=1e-6)


def test_ridge_and_boosting(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 1.0 if i > 4 else -1.0) for i in range(10)], "x double, y double, s double")
    assert np.allclose(L.ridge(df, ["x"], "y", 0.0), [1, 2])
    s = L.adaboost(df, ["x"], "s", 3)
    assert s[0]["threshold"] == 4.5 and s[0]["alpha"] == 10


def test_shrinkage_without_penalty_keeps_the_forest(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(60)], "id int, a double, b double, y double")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, seed=1).fit(ready)
    want = [r[0][1] for r in rows(model.transform(ready).orderBy("id").select("probability"))]
    got = [r[0] for r in rows(L.forest_predict(df, L.shrunk_nodes(model, 0.0, f"{tmp_path}/a"), ["a", "b"]).orderBy("id").select("p"))]
    assert np.allclose(got, want)
    flat = [r[0] for r in rows(L.forest_predict(df, L.shrunk_nodes(model, 1e12, f"{tmp_path}/b"), ["a", "b"]).select("p"))]
    assert max(flat) - min(flat) < 1e-6


def test_support_vectors_solve_the_dual(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1.0, -1.0)
    df = spark.createDataFrame([(i, v.tolist(), float(s)) for i, (v, s) in enumerate(zip(x, y))], "id long, v array<double>, y double")
    model, offset, converged = L.kernel_svm(df, "id", "v", "y", L.rbf(0.5), c=10.0, tol=1e-6, epochs=5000)
    got = np.array([r[0][0] for r in rows(model.apply(df, "v", "p").orderBy("id").select("p"))]) + offset
    assert converged and (np.sign(got) == y).mean() >= 0.95
    ids = [r[0] for r in rows(L.sampled(df, "id", 60).select("id"))]
    a, margin = np.abs(model.m[:, 0]), (got * y)[ids]
    assert (margin[a < 1e-9] >= 1 - 1e-3).all() and (margin[a > 10 - 1e-9] <= 1 + 1e-3).all() and np.allclose(margin[(a > 1e-6) & (a < 10 - 1e-6)], 1, atol=1e-3)


def test_geometric_points_lie_in_the_ball_around_their_base(spark):
    df = spark.createDataFrame([(i, 1, [float(i % 5), float(i // 5)], "a" if i % 2 else "b") for i in range(20)], "k long, y int, v array<double>, c string")
    at = {r[0]: np.array(r[2]) for r in rows(df)}
    got = rows(L.geometric_smote(df, "k", "v", "y", 1, 30, "c"))
    assert len(got) == 30 and all(np.linalg.norm(np.array(v) - at[b]) <= 2.3 for _, b, v, _ in got)
    assert sorted(got) == sorted(rows(L.geometric_smote(df.repartition(3), "k", "v", "y", 1, 30, "c")))


def test_expected_rows_are_demanded(spark):
    with pytest.raises(R.ContractError):
        R.expect_rows(spark.range(3).where("id > 9"), "no rows")


def test_targets_that_features_rebuild_and_names_that_look_ahead(spark):
    df = spark.createDataFrame([(float(i), float(i % 4 + 1), 9.0 if i else None) for i in range(20)], "a double, b double, c double").withColumn("y", F.col("a") / F.col("b"))
    got = {(r["numerator"], r["denominator"]): (r["share"], r["leaks"]) for r in Q.rebuilt(df, "y", ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (1.0, True) and not any(leaks for k, (_, leaks) in got.items() if k != ("a", "b"))
    assert Q.refused(["a", "Future_goals", "id"], ["ID"]) == ["Future_goals", "id"] and Q.guarded(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="future_x"):
        Q.guarded(df, ["a", "future_x"])
