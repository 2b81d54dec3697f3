"""Kendall's tau against all pairs."""

import random

import numpy as np
import pytest

from larkspur.operators import concordance as C
from larkspur.operators import preparation as P


def plain(x, y, n):
    s = p = q = 0.0
    for i in range(len(x)):
        dx, dy, w = np.sign(x - x[i]), np.sign(y - y[i]), n * n[i]
        s, p, q = s + (dx * dy * w).sum(), p + (dx * dx * w).sum(), q + (dy * dy * w).sum()
    return s / 2, p / 2, q / 2


def test_merging_counts_what_all_pairs_count():
    rnd = np.random.default_rng(2)
    for size in (0, 1, 2, 3, 7, 50, 301):
        x, y, n = rnd.integers(0, 12, size), rnd.integers(0, 9, size) * 1.5, rnd.integers(1, 5, size)
        assert abs(C.agreement(x.astype(float), y, n.astype(float)) - plain(x, y, n)[0]) < 1e-6
    table = rnd.integers(0, 5, (5, 7)).astype(float)
    i, j = np.indices(table.shape)
    assert abs(C.across(table) - plain(i.ravel(), j.ravel(), table.ravel())[0]) < 1e-6


@pytest.mark.parametrize("rows", [200_000, 20])
def test_tau_is_that_of_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "ROWS", rows)
    rnd = random.Random(3)
    data = [(rnd.choice([None, 5.0, 5.0, 5.0, *map(float, range(20))]), 0.0) for _ in range(400)]
    data = [(a, (a or 0) * rnd.choice([1.0, -0.5]) + rnd.randint(0, 9) if rnd.random() < 0.9 else None) for a, _ in data]
    df = spark.createDataFrame(data, "x double, y double").repartition(3)
    both = np.array([r for r in data if None not in r])
    s, p, q = plain(both[:, 0], both[:, 1], np.ones(len(both)))
    assert abs(C.kendall_value(df, "x", "y") - s / np.sqrt(p * q)) < 1e-9


def test_a_column_that_does_not_vary_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert C.kendall_value(df, "x", "y") == 0.0 == C.kendall_value(df.limit(0), "x", "y")
    assert P.kendall(df, "y", "y").first()[0] == 1.0
