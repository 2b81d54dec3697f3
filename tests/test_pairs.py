"""Queries that pair rows: whole results on odd rows and one large group, spread over tasks."""

import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.operators import models as M

ORACLES, QUERIES = entry.oracle_sql(), entry.queries()


def agree(spark, folder, name, tables, sums):
    """Both sides' row count and sums, as all rows are too many to collect."""
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    got = df.selectExpr("count(*)", *sums).first()
    want = c.execute(f"SELECT count(*), {', '.join(sums)} FROM ({ORACLES[name]})").fetchone()
    assert tuple(got) == tuple(want)
    return df


def test_levenshtein_pairs_of_one_large_group_are_whole_and_spread(spark, tmp_path):
    names = ["red bolt", "cold plate", "old gear", "", None, "blue ring"]
    rows = [(k, names[k % 6], "a", 1) for k in range(2990)] + [(7, "red ring", "a", 1), (None, "red", "a", 1), (5000, "x", None, 1), (5001, "y", None, 1), (5002, "z", "b", None), (5003, "z", "b", None), (5004, "q", "b", 2), (5005, "qq", "b", 2)]
    folder = os.fspath(tmp_path)
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    sums = ["sum(distance)", "count(distance)", "sum(p_partkey * 3 + other * 7)", "sum(distance * (p_partkey * 5 + other) % 1009)", "min(other - p_partkey)"]
    df = agree(spark, folder, "levenshtein_pairs", ["part"], sums)
    dealt = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) > 1 and max(dealt) < 0.9 * sum(dealt)


def test_levenshtein_pairs_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["levenshtein_pairs"](spark, os.fspath(tmp_path)).count() == 0


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", ["kernel_linear", "kernel_rbf", "kernel_poly", "kernel_centered"])
def test_kernels_of_odd_rows_follow_the_sql_and_one_file_is_spread(spark, tmp_path, monkeypatch, name):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(64)], 1) for k in range(40)] + [(k * 100, [rng.gauss(0, 2) for _ in range(64)], 2) for k in range(1, 6)]
    short, holes = [1.0, -2.5, 0.25], [None if k % 3 else 0.5 * k for k in range(64)]
    rows += [(600, short, 1), (700, holes, 1), (800, None, 1), (900, [], 1), (51, short, 1), (52, holes, 1), (53, None, 1), (54, [], 1), (55, [None] * 64, 1), (None, [0.5] * 64, 1), (56, [2.0] * 70, 1)]
    if name != "kernel_centered":  # their means are no numbers
        rows += [(57, [math.nan] + [1.0] * 63, 1), (58, [math.inf] * 64, 1)]
    folder = os.fspath(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    for n, v in {"MOST_QUERIES": 3, "TILE": (2, 5), "TASK_PAIRS": 20}.items():
        monkeypatch.setattr(M, n, v, raising=False)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    got = sorted(tuple(map(shown, (r["i"], r["j"], r["k"]))) for r in df.collect())
    assert got == sorted(tuple(map(shown, r)) for r in c.execute(f"SELECT i, j, k FROM ({ORACLES[name]})").fetchall())
    assert df.groupBy(F.spark_partition_id()).count().count() > 4


def nearest(keys, x, ids, q, k):
    """Plainly, from all distances."""
    out = []
    for i, z in zip(ids, q):
        d = M.rounded_values(np.array([sum((a - b) * (a - b) for a, b in zip(row, z)) for row in x.tolist()]), 9)
        out += [(int(i), int(keys[j]), float(d[j])) for j in [j for j in np.lexsort((keys, d)) if keys[j] != i][:k]]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e5])
def test_nearest_rows_are_those_of_all_distances(scale):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 7)), rng.integers(-1, 2, size=(150, 7)).astype(float), np.zeros((60, 7)), np.full((40, 7), 1e-6)]) * scale
    keys = rng.permutation(len(x)) * 3
    keys[10:20] = keys[9]  # a key of many rows
    ask = np.r_[np.arange(0, len(x), 4), 9, 10, 11]
    near = M.Nearest(keys[ask], x[ask], None, 5, None, 16, 50)
    for b in range(0, len(x), 130):
        near.add(keys[b : b + 130], x[b : b + 130], None, pa.table({"label": keys[b : b + 130] % 7}))
    got = near.table(["label"]).to_pylist()
    assert all(r["label"] == r["key"] % 7 for r in got)
    want = []
    for i, z in zip(*(a[np.unique(np.r_[np.arange(0, len(x), 4), 9, 10, 11], return_index=True)[0]] for a in (keys, x))):
        want += nearest(keys, x, [i], [z], 5)
    assert sorted((r["query"], r["key"], r["d"]) for r in got) == sorted(want)


def test_neighbours_of_odd_rows_follow_the_sql(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(64)], k % 3) for k in range(45)] + [(k, [0.5] * 64, k % 4) for k in range(60, 80)]
    rows += [(101, None, 1), (102, [0.5] * 10, 1), (103, [None if k % 2 else 0.5 for k in range(64)], 2), (110, [0.25, -0.5], 2)]
    folder = os.fspath(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    monkeypatch.setattr(M, "MOST_QUERIES", 4)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    for name in ("knn_classify", "knn_regress"):
        assert sorted(map(tuple, QUERIES[name](spark, folder).select("query", "prediction").collect())) == sorted(c.execute(f"SELECT query, prediction FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("mode", ["borderline", "adasyn"])
def test_mates_are_sought_for_drawn_bases_only_and_rows_are_those_of_plain_rules(spark, monkeypatch, mode):
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(120, 4)), np.arange(120) % 3
    df = spark.createDataFrame([(int(i), [float(a) for a in v], int(b)) for i, (v, b) in enumerate(zip(x, label))], "id long, v array<double>, label int")
    asked, plain = [], M.top_k

    def counted(base, queries, *more, **named):
        asked.append(queries.count())
        return plain(base, queries, *more, **named)

    monkeypatch.setattr(M, "top_k", counted)
    got = M.adaptive_smote(df, "id", "v", "label", 0, 6, mode).collect()
    assert asked[0] == 40 and asked[1] <= 6
    own = np.flatnonzero(label == 0)
    near = nearest(np.arange(120), x, own, x[own], 5)
    share = {i: np.mean([label[j] != 0 for q, j, _ in near if q == i]) for i in own}
    weight = np.array([share[i] if mode == "adasyn" else float(0.5 <= share[i] < 1) for i in own])
    upto = np.cumsum(weight)
    bases = {n: int(own[np.flatnonzero(np.floor(upto / upto[-1] * 6) >= n)[0]]) for n in range(1, 7)}
    assert {r["new_id"]: r["base"] for r in got} == bases
    mates = nearest(own, x[own], own, x[own], 5)
    for r in got:
        assert (r["base"], r["other"]) in {(i, j) for i, j, _ in mates}
        step = np.array(r["vector"]) - x[r["base"]]
        way = x[r["other"]] - x[r["base"]]
        assert np.allclose(step, way * (step @ way) / (way @ way)) and 0 <= (step @ way) / (way @ way) < 1
