"""Evaluation metrics as single aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import global_rank


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def counts(df: DataFrame, y: str, pred: str, positive) -> DataFrame:
    """tp, fp, tn, fn: one row."""
    p, q = F.col(y) == positive, F.col(pred) == positive
    return df.agg(F.count_if(p & q).alias("tp"), F.count_if(~p & q).alias("fp"), F.count_if(~p & ~q).alias("tn"), F.count_if(p & ~q).alias("fn"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def seven_ratios(df: DataFrame, y: str, pred: str, positive) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts(df, y, pred, positive).select(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(tn, tn + fn).alias("npv"),
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fn).alias("tpr"),
    )


def binary_pack(df: DataFrame, y: str, pred: str, positive) -> DataFrame:
    """accuracy, precision, recall, f1, gmean (of the two classes' recalls)."""
    r = seven_ratios(df, y, pred, positive)
    p, q = F.col("precision"), F.col("recall")
    return r.select("accuracy", "precision", "recall", ratio(2 * p * q, p + q).alias("f1"), F.sqrt(q * F.col("specificity")).alias("gmean"))


def per_class(df: DataFrame, y: str, pred: str) -> DataFrame:
    """label, support, precision, recall, f1. One pass: each row counts for its label and for its prediction."""
    sides = F.explode(F.array(F.struct(F.col(y).alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"))))
    hit = (F.col(y) == F.col(pred)).cast("int")
    g = df.select(hit.alias("hit"), sides.alias("x")).groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("hit") * F.col("x.s")).alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return g.select("label", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def macro_weighted(df: DataFrame, y: str, pred: str) -> DataFrame:
    g = per_class(df, y, pred)
    return g.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def auc(df: DataFrame, y: Column, score: str) -> DataFrame:
    """Area under the curve by mid-ranks, one row; null with one class. Scores are folded first, so ranks are over distinct scores."""
    folded = df.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(y).alias("pos"))
    ranked = global_rank(folded, ["score"], "_k")
    upto = ranked.select("score", "n", "pos", "_k")
    summed = running_sum(upto, "n", "_k", "below")
    rank = F.col("below") - F.col("n") + (F.col("n") + 1) / 2
    stats = summed.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return stats.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def running_sum(df: DataFrame, value: str, rank: str, name: str, block: int = 100_000) -> DataFrame:
    """Sum of value up to each row by rank: within blocks of ranks, plus the sums of the blocks before."""
    from pyspark.sql import Window

    df = df.withColumn("_block", F.floor(F.col(rank) / block))
    sums = df.groupBy("_block").agg(F.sum(value).alias("_s"))
    before = sums.alias("a").join(F.broadcast(sums.alias("b")), F.col("b._block") < F.col("a._block"), "left").groupBy(F.col("a._block").alias("_block")).agg(F.coalesce(F.sum("b._s"), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, within).join(before, "_block").withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")


def regression(df: DataFrame, y: str, pred: str) -> DataFrame:
    """mse, rmse, mae, r2 (0 if y does not vary), correlation (0 if one of both does not)."""
    e = F.col(y) - F.col(pred)
    a = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"), F.covar_pop(y, pred).alias("c"), F.stddev_pop(y).alias("a"), F.stddev_pop(pred).alias("b"))
    steady = (F.col("a") < 1e-12) | (F.col("b") < 1e-12)
    return a.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).otherwise(0.0).alias("r2"), F.when(steady, 0.0).otherwise(F.try_divide(F.col("c"), F.col("a") * F.col("b"))).alias("corr"))


def rps(p: list[Column], hit: list[Column]) -> Column:
    """Ranked probability score of one row, classes in order."""
    out, cp, co = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for a, o in zip(p[:-1], hit[:-1]):
        cp, co = cp + a, co + o.cast("double")
        out = out + (cp - co) * (cp - co)
    return out / (len(p) - 1)


def brier(p: list[Column], hit: list[Column]) -> Column:
    parts = [(a - o.cast("double")) * (a - o.cast("double")) for a, o in zip(p, hit)]
    return sum(parts[1:], parts[0])


def log_loss(p: list[Column], hit: list[Column]) -> Column:
    parts = [F.when(o, -F.ln(F.greatest(F.lit(1e-15), F.least(F.lit(1.0), a)))).otherwise(0.0) for a, o in zip(p, hit)]
    return sum(parts[1:], parts[0])


def reliability(df: DataFrame, confidence: str, correct: Column, keys: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Per bin (low, high]: n, mean confidence, accuracy."""
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins))).cast("int")
    return df.groupBy(*(keys or []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def ece(bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return bins.groupBy(*(keys or [])).agg((F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")) / F.sum("n")).alias("ece"))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = scale * x ** exponent by least squares of the logarithms, over positive y."""
    return df.where(F.col(y) > 0).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("exponent"), F.exp(F.regr_intercept(F.ln(y), F.ln(x))).alias("scale"), F.count(F.lit(1)).alias("points"))
