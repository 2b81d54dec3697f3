"""Kendall's tau-b without pairs of rows: inversions are counted by a range-partitioned merge sort.

Rows are folded to different pairs (x, y) with their counts. Both columns are cut in ranges at sampled values; a value that is such
a bound is a range of its own, so a value that many rows have never makes a range that must be looked into. Two rows then differ in one of three ways:
they lie in one range of x (counted by the task that has the range), in different ranges of x but one of y (counted
by the task that has that one, by ranges of x), or in different ranges of both (counted from the table of counts by ranges,
which is small). Each task counts by merging sorted halves, n log n.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import saved

#: Different pairs of one range, about, and bounds of one column, at most: the table of counts has the square of twice as many cells.
ROWS, MOST_BOUNDS = 200_000, 500


def agreement(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Over pairs with different x: the weight of those that y orders likewise, less that of those it orders the other way."""
    order = np.lexsort((y, x))
    x, y, n = x[order], np.unique(y[order], return_inverse=True)[1], n[order].astype(float)
    total, half, place = 0.0, 1, np.arange(len(x))
    while half < len(x):
        block, right = place // (2 * half), (place // half) % 2 == 1
        by = np.lexsort((y, block))
        key = block[by] * (len(y) + 1) + y[by]
        left = np.append(0.0, np.cumsum(np.where(right[by], 0.0, n[by])))
        first, last = np.searchsorted(key, key), np.searchsorted(key, key, side="right")
        begin, end = np.searchsorted(block[by], block[by]), np.searchsorted(block[by], block[by], side="right")
        less, more = left[first] - left[begin], left[end] - left[last]
        total += float((np.where(right[by], n[by], 0.0) * (less - more)).sum())
        half *= 2
    # rows of one x stand in the order of y, and were counted as agreeing where their y differ
    same_x = np.bincount(np.unique(x, return_inverse=True)[1], n) if len(x) else np.zeros(0)
    _, pair = np.unique(np.stack([np.unique(x, return_inverse=True)[1], y]), axis=1, return_inverse=True) if len(x) else (None, np.zeros(0, int))
    same_pair = np.bincount(pair.ravel(), n) if len(x) else np.zeros(0)
    return total - float((same_x**2).sum() - (same_pair**2).sum()) / 2


def across(table: np.ndarray) -> float:
    """The same over cells (ranges of x by ranges of y) that differ in both."""
    below = np.cumsum(np.cumsum(table, 0), 1)
    padded = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    padded[1:, 1:] = below
    less = padded[:-1, :-1]
    more = padded[:-1, -1:] - padded[:-1, 1:]
    return float((table * (less - more)).sum())


def range_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 k for values between bounds, 2 k + 1 for the k-th bound itself."""
    at = np.searchsorted(bounds, values)
    return 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == values if len(bounds) else 0)


def kendall_value(df: DataFrame, x: str, y: str) -> float:
    """Tau-b over rows that have both; 0 if a column does not vary."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    folded = saved(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    many = min(MOST_BOUNDS, folded.count() // ROWS + 1)
    shares = [(k + 1) / (many + 1) for k in range(many)]
    got = folded.agg(*[F.percentile_approx(c, shares, 10 * MOST_BOUNDS).alias(c) for c in ("x", "y")]).first()
    if got["x"] is None:
        return 0.0
    bounds = {c: np.unique(got[c]) for c in ("x", "y")}

    def dealt(parts):
        for pdf in parts:
            for c in ("x", "y"):
                pdf[f"{c}r"] = range_of(pdf[c].to_numpy(), bounds[c]).astype("int32")
            yield pdf

    ranged = saved(folded.mapInPandas(dealt, "x double, y double, n long, xr int, yr int"))
    table = np.zeros((2 * len(bounds["x"]) + 1, 2 * len(bounds["y"]) + 1))
    for r in ranged.groupBy("xr", "yr").agg(F.sum("n").alias("n")).collect():  # (2 * MOST_BOUNDS + 1) squared cells at most
        table[r["xr"], r["yr"]] = r["n"]

    def counted(pdf):
        import pandas as pd

        return pd.DataFrame({"s": [agreement(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float), pdf["n"].to_numpy(float))]})

    # odd ranges have one value, so no two of their rows differ in it
    own = ranged.where("xr % 2 = 0").select(F.lit("x").alias("side"), F.col("xr").alias("r"), F.col("x").alias("a"), F.col("y").alias("b"), "n")
    other = ranged.where("yr % 2 = 0").select(F.lit("y").alias("side"), F.col("yr").alias("r"), F.col("xr").cast("double").alias("a"), F.col("y").alias("b"), "n")
    inside = own.unionByName(other).groupBy("side", "r").applyInPandas(counted, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
    total = table.sum()
    ties = [folded.groupBy(c).agg(F.sum("n").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] for c in ("x", "y")]
    p, q = ((total * total - t) / 2 for t in ties)
    return float((inside + across(table)) / np.sqrt(p * q)) if p > 0 and q > 0 else 0.0
