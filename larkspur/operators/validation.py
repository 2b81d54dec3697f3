"""Cross-validation, several classes at once, and calibration. Each scan of the rows is one aggregate whose size the rows don't change."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.models import MOST_EXACT, KernelMap, matrix, sampled
from larkspur.operators.trees import labels

#: Folds, at most: what an aggregate by fold returns is collected.
MOST_FOLDS = 1000


def sql_number(x: float) -> str:
    return f"({float(x)!r}D)"


# cross-validation


def fold_moments(df: DataFrame, features: list[str], target: str, fold: str) -> dict:
    """fold -> matrix of sums of products of 1, the features and the target, in one aggregate over rows without nulls."""
    names = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    rows = df.na.drop(subset=[*features, target, fold]).groupBy(fold).agg(*[F.sum(names[i] * names[j]) for i, j in pairs]).limit(MOST_FOLDS + 1).collect()
    if len(rows) > MOST_FOLDS:
        raise ValueError(f"over {MOST_FOLDS} folds")
    out = {}
    for r in rows:
        m = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, r[1:]):
            m[i, j] = m[j, i] = v
        out[r[0]] = m
    return out


def ridge_from(m: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and weights, in the features' own units, of a ridge on features that these moments' rows scale to mean 0 and deviation 1."""
    n, d = m[0, 0], len(m) - 2
    mean = m[0, 1:] / n
    spread = m[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(0, np.diag(spread)[:d] / n))
    sd[sd < 1e-12] = 1.0
    gram = spread[:d, :d] / np.outer(sd, sd) + penalty * np.eye(d)
    side = spread[:d, d] / sd
    try:
        w = np.linalg.solve(gram, side)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(gram, side, rcond=None)[0]
    w = w / sd
    return float(mean[d] - w @ mean[:d]), w


def squared_error(m: np.ndarray, intercept: float, w: np.ndarray) -> float:
    """The sum of squared errors over the rows of these moments."""
    a = np.concatenate([[-intercept], -w, [1.0]])
    return float(max(0.0, a @ m @ a))


def cross_validate(df: DataFrame, features: list[str], target: str, fold: str, penalties: list[float]) -> DataFrame:
    """fold, penalty, n_train, n_test, mse: each penalty's ridge on the rows outside the fold, scaled by those alone, measured on the fold.

    One scan: a fold's training moments are those of all rows less its own, and scaling, fits and errors follow from moments. Every
    penalty gets the same folds and rows, which is checked. A fold without training rows is left out.
    """
    by_fold = fold_moments(df, features, target, fold)
    total = sum(by_fold.values())
    out = []
    for k in sorted(by_fold):
        train = total - by_fold[k]
        if train[0, 0] < 0.5:
            continue
        for p in penalties:
            out.append((int(k), float(p), int(round(train[0, 0])), int(round(by_fold[k][0, 0])), float(squared_error(by_fold[k], *ridge_from(train, p)) / by_fold[k][0, 0])))
    budgets = {p: sorted((r[0], r[2], r[3]) for r in out if r[1] == p) for p in map(float, penalties)}
    if len({tuple(b) for b in budgets.values()}) > 1:
        raise ValueError("penalties got unequal budgets")
    return df.sparkSession.createDataFrame(out, "fold int, penalty double, n_train long, n_test long, mse double")


def chosen(scores: DataFrame) -> DataFrame:
    """penalty, mean_mse, folds of the penalty with the least mean error over folds (ties: the larger penalty)."""
    means = scores.groupBy("penalty").agg(F.avg("mse").alias("mean_mse"), F.count(F.lit(1)).alias("folds"))
    return means.agg(F.min_by(F.struct("penalty", "mean_mse", "folds"), F.struct(F.round("mean_mse", 9), -F.col("penalty"))).alias("x")).select("x.*")


# one against the rest


class Logistic:
    """One logistic model a class (with two classes, one for the second), all moved by one aggregate a step; the intercepts are not penalised."""

    def __init__(self, df: DataFrame, features: list[str], label: str, rate: float = 0.01, steps: int = 100, lam: float = 0.01):
        self.features, self.classes = features, labels(df, label)
        rows = df.na.drop(subset=[*features, label]).select(*[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)], *[(F.col(label) == F.lit(c)).cast("double").alias(f"_y{k}") for k, c in enumerate(self.fitted)])
        d = len(features)
        self.w = np.zeros((len(self.fitted), d + 1))
        for _ in range(steps):
            errors = [f"({self.sigmoid(w, [f'_x{k}' for k in range(d)])} - _y{c})" for c, w in enumerate(self.w)]
            sums = ["count(1)"] + [f"sum({e}{'' if k == 0 else f' * _x{k - 1}'})" for e in errors for k in range(d + 1)]
            row = rows.agg(*[F.expr(s) for s in sums]).first()
            if not row[0]:
                break
            g = np.array(row[1:], float).reshape(self.w.shape) / row[0]
            g[:, 1:] += lam * self.w[:, 1:]
            self.w -= rate * g

    @property
    def fitted(self) -> list:
        return self.classes[1:] if len(self.classes) == 2 else self.classes

    @staticmethod
    def sigmoid(w, names: list[str]) -> str:
        line = " + ".join([sql_number(w[0]), *[f"{sql_number(a)} * {n}" for a, n in zip(w[1:], names)]])
        return f"(1 / (1 + exp(-greatest(-500D, least(500D, {line})))))"

    def shares(self) -> Column:
        """An array with each class's share: the sigmoids over their sum (0 for all if that is 0)."""
        one = [self.sigmoid(w, [f"cast(`{f}` AS double)" for f in self.features]) for w in self.w]
        if len(self.classes) == 2:
            return F.expr(f"array(1 - {one[0]}, {one[0]})")
        total = " + ".join(one)
        return F.expr(f"transform(array({', '.join(one)}), s -> s / if({total} = 0, 1D, {total}))")

    def predict(self, df: DataFrame, prediction: str = "prediction", shares: str = "shares") -> DataFrame:
        """df with the shares and the class of the largest (the first among equals)."""
        out = df.withColumn(shares, self.shares())
        return out.withColumn(prediction, F.array(*[F.lit(c) for c in self.classes])[F.array_position(shares, F.array_max(shares)).cast("int") - 1])


def one_per_class(got, label: str) -> tuple[list, np.ndarray]:
    """The classes, and for each (with two, for the second) a column of 0 and 1."""
    classes = sorted({r[label] for r in got})
    fitted = classes[1:] if len(classes) == 2 else classes
    return classes, np.array([[float(r[label] == c) for c in fitted] for r in got])


def kernel_ridge_classes(df: DataFrame, key: str, vector: str, label: str, kernel, lam: float = 1.0, rows: int = MOST_EXACT) -> tuple[KernelMap, list, int]:
    """A kernel ridge a class on a sample of at most `rows` rows, all from one factorisation: the map to the classes' scores, the classes, rows used."""
    got = sampled(df, key, min(rows, MOST_EXACT)).select(vector, label).collect()
    x = matrix(got, vector)
    classes, y = one_per_class(got, label)
    lower = np.linalg.cholesky(kernel(x, x) + lam * np.eye(len(x)))
    return KernelMap(x, kernel, np.linalg.solve(lower.T, np.linalg.solve(lower, y))), classes, len(x)


def class_of_scores(scores: str, classes: list) -> Column:
    """The class of the largest score; with two classes the only score speaks for the second, from 0.5 on."""
    names = F.array(*[F.lit(c) for c in classes])
    if len(classes) == 2:
        return F.when(F.col(scores)[0] >= 0.5, names[1]).otherwise(names[0])
    return names[F.array_position(scores, F.array_max(scores)).cast("int") - 1]


# calibration


class Sigmoids:
    """For each class, p = 1 / (1 + exp(-(a * share + b))), fitted by Newton steps from five sums; all classes move in one aggregate a step.

    Targets are (n + 1) / (n + 2) for the class's n rows and 1 / (m + 2) for the m others, so that no class is certain.
    """

    def __init__(self, df: DataFrame, shares: list[str], label: str, classes: list, steps: int = 12):
        self.columns = shares
        rows = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"_s{k}") for k, c in enumerate(shares)], *[(F.col(label) == F.lit(c)).cast("double").alias(f"_y{k}") for k, c in enumerate(classes)])
        counts = rows.agg(F.count(F.lit(1)), *[F.sum(f"_y{k}") for k in range(len(classes))]).first()
        n, own = counts[0], [x or 0.0 for x in counts[1:]]
        if not n or not all(0 < x < n for x in own):
            raise ValueError("a class without rows, or without others, can't be calibrated")
        self.fits = [(0.0, float(np.log((x + 1) / (n - x + 1)))) for x in own]
        for _ in range(steps):
            sums = []
            for k, (a, b) in enumerate(self.fits):
                p = f"(1 / (1 + exp(-({sql_number(a)} * _s{k} + {sql_number(b)}))))"
                e = f"({p} - if(_y{k} = 1, {sql_number((own[k] + 1) / (own[k] + 2))}, {sql_number(1 / (n - own[k] + 2))}))"
                w = f"({p} * (1 - {p}))"
                sums += [f"sum({e})", f"sum({e} * _s{k})", f"sum({w})", f"sum({w} * _s{k})", f"sum({w} * _s{k} * _s{k})"]
            row = rows.agg(*[F.expr(s) for s in sums]).first()
            self.fits = [self.moved(fit, *row[5 * k : 5 * k + 5]) for k, fit in enumerate(self.fits)]

    @staticmethod
    def moved(fit, e, es, w, ws, wss):
        """One Newton step, with a trace of damping."""
        w, wss = w + 1e-12, wss + 1e-12
        det = w * wss - ws * ws
        return (fit[0] - (w * es - ws * e) / det, fit[1] - (wss * e - ws * es) / det) if abs(det) > 1e-300 else fit

    def apply(self) -> list[Column]:
        return [F.expr(f"1 / (1 + exp(-({sql_number(a)} * cast(`{c}` AS double) + {sql_number(b)})))") for (a, b), c in zip(self.fits, self.columns)]


class Isotonics:
    """For each class, the rising step function of its share, by Spark ML's pool of adjacent violators over ordered partitions."""

    def __init__(self, df: DataFrame, shares: list[str], label: str, classes: list):
        from pyspark.ml.regression import IsotonicRegression

        self.columns = shares
        self.models = [IsotonicRegression(featuresCol=c, labelCol="_y").fit(df.where(F.col(label).isNotNull()).withColumn("_y", (F.col(label) == F.lit(k)).cast("double"))) for c, k in zip(shares, classes)]

    def transform(self, df: DataFrame) -> DataFrame:
        for k, m in enumerate(self.models):
            df = m.setPredictionCol(f"_p{k}").transform(df)
        return df


def floored(shares: list[Column], floor: float = 0.005) -> list[Column]:
    """Shares over their sum, none under the floor, over their sum again; if all are 0, they stay so before the floor."""
    total = sum(shares[1:], shares[0])
    one = [F.greatest(F.lit(floor), F.least(F.lit(1.0), s / F.when(total == 0, 1.0).otherwise(total))) for s in shares]
    total = sum(one[1:], one[0])
    return [s / total for s in one]


def calibrated(fit: DataFrame, df: DataFrame, shares: list[str], label: str, classes: list, methods: tuple[str, ...] = ("isotonic", "sigmoid")) -> tuple[DataFrame, str]:
    """df with its shares (columns in the order of classes) calibrated on `fit`, and the method: the first that can be fitted, or none of them (uncalibrated)."""
    for method in methods:
        try:
            model = (Isotonics if method == "isotonic" else Sigmoids)(fit, shares, label, classes)
        except ValueError:
            continue
        if method == "isotonic":
            out = model.transform(df)
            new = [F.col(f"_p{k}") for k in range(len(shares))]
        else:
            out, new = df, model.apply()
        return out.withColumns({f"_c{k}": c for k, c in enumerate(floored(new))}).select(*[F.col(f"_c{shares.index(c)}").alias(c) if c in shares else F.col(c) for c in df.columns]), method
    return df.withColumns(dict(zip(shares, floored([F.col(c) for c in shares])))), "uncalibrated"


# studies

ARMS = ("none", "weighted", "undersampled", "bootstrapped")


def arm_weights(label: Column, share: Column, seed: Column, key: Column) -> dict[str, Column]:
    """How much a training row counts in each arm. share: the label's share of the rows over the smallest label's, 1 or more.

    weighted: by the inverse of the label's size; undersampled: rows of larger labels stay with the chance 1 / share; bootstrapped: 0 to 6 times, one on average.
    Draws are hashes of seed and key.
    """
    from larkspur.functions import scalars as S

    u = S.unit(7, "boot", seed, key)
    times = sum((F.when(u >= bound, 1.0).otherwise(0.0) for bound in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)), F.lit(0.0))  # Poisson with mean 1
    return {"none": F.lit(1.0), "weighted": 1 / share, "undersampled": F.when(S.unit(7, "under", seed, key) < 1 / share, 1.0).otherwise(0.0), "bootstrapped": times}


def study(df: DataFrame, key: str, features: list[str], label: str, train: Column, seeds: list[int], penalties: list[float], arms: tuple[str, ...] = ARMS) -> DataFrame:
    """seed, arm, penalty, accuracy, recall, specificity, gmean on the other rows: linear scores of a 0/1 label (1 from 0.5 on), fitted on each arm's rows.

    Seeds and arms are an axis of one aggregate of weighted moments, and fitted scores one of an aggregate of counts: two scans in all, however many
    fits (a row for each is broadcast). A ratio over no rows is 0.
    """
    if len(seeds) * len(arms) * len(penalties) > 10_000:
        raise ValueError("over 10,000 fits")
    rows = df.na.drop(subset=[*features, label]).withColumn("_train", train)
    y = F.col(label).cast("double")
    sizes = rows.where("_train").groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.min("_n").alias("_least"))))
    seeded = rows.where("_train").join(F.broadcast(sizes), F.col(label) == F.col("_label")).withColumn("_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    weights = arm_weights(F.col(label), F.col("_n") / F.col("_least"), F.col("_seed"), F.col(key))
    each = seeded.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), weights[a].alias("w")) for a in arms]))).where("_x.w > 0")
    names = [F.lit(1.0), *[F.col(f).cast("double") for f in features], y]
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    fits = []
    for r in each.groupBy("_seed", "_x.arm").agg(*[F.sum(F.col("_x.w") * names[i] * names[j]) for i, j in pairs]).collect():  # a row for each seed and arm
        m = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, r[2:]):
            m[i, j] = m[j, i] = v
        for p in penalties:
            c, w = ridge_from(m, p)
            fits.append((r[0], r[1], float(p), c, [float(x) for x in w]))
    table = df.sparkSession.createDataFrame(fits, "seed int, arm string, penalty double, c double, w array<double>")
    test = rows.where("NOT _train").select(y.alias("y"), F.array(*names[1:-1]).alias("x")).crossJoin(F.broadcast(table))
    score = F.col("c") + F.aggregate(F.zip_with("w", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    test = test.select("seed", "arm", "penalty", (F.col("y") == 1).alias("y"), (F.round(score, 9) >= 0.5).alias("p"))
    counts = test.groupBy("seed", "arm", "penalty").agg(F.count_if(F.expr("y AND p")).alias("tp"), F.count_if(F.expr("NOT y AND p")).alias("fp"), F.count_if(F.expr("NOT y AND NOT p")).alias("tn"), F.count_if(F.expr("y AND NOT p")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.select("seed", "arm", "penalty", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"))
    return out.withColumn("gmean", F.sqrt(F.col("recall") * F.col("specificity")))


def over_seeds(results: DataFrame) -> DataFrame:
    """arm, penalty, seeds, and the mean and population deviation over seeds of each measure."""
    measures = [c for c in results.columns if c not in ("seed", "arm", "penalty")]
    return results.groupBy("arm", "penalty").agg(F.count(F.lit(1)).alias("seeds"), *[x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
