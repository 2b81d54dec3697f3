"""Queries that evaluate predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import metrics as M
from larkspur.plans.registry import query, table

SCORED = "WITH s AS (SELECT doc_id, quality AS y, toxic, n_chars, 1 / (1 + exp(-(n_chars - 2000) / 2000.0)) AS score FROM labels JOIN documents USING (doc_id)), p AS (SELECT *, (score >= 0.5)::INT AS pred, greatest(score, 1 - score) AS conf FROM s)"
COUNTED = SCORED + ", c AS (SELECT count(CASE WHEN y = 1 AND pred = 1 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN y = 0 AND pred = 1 THEN 1 END)::DOUBLE AS fp, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END)::DOUBLE AS tn, count(CASE WHEN y = 1 AND pred = 0 THEN 1 END)::DOUBLE AS fn FROM p)"
TRIPLE = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_orderpriority, 1 + o_totalprice / 100000 AS a, 1 + o_custkey % 7 AS b, 1 + o_orderkey % 3 AS c FROM orders), t AS (SELECT *, a / (a + b + c) AS f, b / (a + b + c) AS o, c / (a + b + c) AS p FROM o)"""


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    df = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", S.sigmoid((F.col("n_chars") - 2000) / 2000.0))
    return df.select("doc_id", F.col("quality").alias("y"), "toxic", "n_chars", "score", (F.col("score") >= 0.5).cast("int").alias("pred"), F.greatest("score", 1 - F.col("score")).alias("conf"))


def triple(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"a": 1 + F.col("o_totalprice") / 100000, "b": 1 + F.col("o_custkey") % 7, "c": 1 + F.col("o_orderkey") % 3})
    total = F.col("a") + F.col("b") + F.col("c")
    return o.withColumns({"f": F.col("a") / total, "o": F.col("b") / total, "p": F.col("c") / total})


def rounded(df, places=6):
    return df.select([F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(SCORED + " SELECT y, pred, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), "y", "pred")


PER_CLASS = SCORED + """, k AS (SELECT label, count(CASE WHEN y = label THEN 1 END) AS support, count(CASE WHEN pred = label THEN 1 END) AS predicted, count(CASE WHEN y = label AND pred = label THEN 1 END) AS tp FROM p, (VALUES (0), (1)) v(label) GROUP BY label),
m AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM k), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


@query(PER_CLASS + " SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def prf_macro_weighted(spark, sf_dir):
    return rounded(M.macro_weighted(scored(spark, sf_dir), "y", "pred"))


@query(PER_CLASS + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def classification_report(spark, sf_dir):
    return rounded(M.per_class(scored(spark, sf_dir), "y", "pred"))


@query(COUNTED + " SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(sqrt(tp / (tp + fn) * tn / (tn + fp)), 6) AS gmean FROM c")
def binary_pack_gmean(spark, sf_dir):
    return rounded(M.binary_pack(scored(spark, sf_dir), "y", "pred", 1))


@query(COUNTED + " SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(tn / (tn + fn), 6) AS npv, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fn), 6) AS tpr FROM c")
def seven_ratios(spark, sf_dir):
    return rounded(M.seven_ratios(scored(spark, sf_dir), "y", "pred", 1))


@query(SCORED + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p) SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y = 0 THEN 1 END)), 6) AS auc FROM r")
def auc_midrank(spark, sf_dir):
    return rounded(M.auc(scored(spark, sf_dir), F.col("y") == 1, "score"))


@query("""WITH e AS (SELECT label, embedding[label + 1] AS score FROM embeddings), k AS (SELECT v.k, e.label = v.k AS y, embedding[v.k + 1] AS score FROM embeddings e, (SELECT unnest(range(0, 10)) AS k) v), r AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2.0 AS r FROM k),
a AS (SELECT k, (sum(CASE WHEN y THEN r END) - count(CASE WHEN y THEN 1 END) * (count(CASE WHEN y THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y THEN 1 END) * count(CASE WHEN NOT y THEN 1 END)) AS auc FROM r GROUP BY k) SELECT round(avg(auc), 6) AS macro_auc FROM a""")
def auc_ovr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    aucs = None
    for k in range(10):
        one = M.auc(e.select((F.col("label") == k).alias("y"), F.col("embedding")[k].cast("double").alias("score")), F.col("y"), "score")
        aucs = one if aucs is None else aucs.unionByName(one)
    return rounded(aucs.agg(F.avg("auc").alias("macro_auc")))


@query("""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS q FROM lineitem) SELECT round(avg((y - q) ** 2), 4) AS mse, round(sqrt(avg((y - q) ** 2)), 6) AS rmse, round(avg(abs(y - q)), 6) AS mae, round(1 - avg((y - q) ** 2) / var_pop(y), 6) AS r2, round(corr(y, q), 6) AS corr FROM p""")
def regression_metrics(spark, sf_dir):
    df = M.regression(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("q")), "y", "q")
    return df.select(F.round("mse", 4).alias("mse"), *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2", "corr")])


SCORES = """round(avg((f - (o_orderstatus = 'F')::INT) ** 2 + (f + o - (o_orderstatus IN ('F', 'O'))::INT) ** 2) / 2, 6) AS rps, round(avg((f - (o_orderstatus = 'F')::INT) ** 2 + (o - (o_orderstatus = 'O')::INT) ** 2 + (p - (o_orderstatus = 'P')::INT) ** 2), 6) AS brier, round(avg(-ln(CASE o_orderstatus WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END)), 6) AS log_loss"""


def _scores(keys=()):
    p, hit = [F.col(c) for c in "fop"], [F.col("o_orderstatus") == c for c in "FOP"]
    return [F.round(F.avg(f(p, hit)), 6).alias(n) for n, f in (("rps", M.rps), ("brier", M.brier), ("log_loss", M.log_loss))]


@query(TRIPLE + f" SELECT {SCORES} FROM t")
def rps_brier_logloss(spark, sf_dir):
    return triple(spark, sf_dir).agg(*_scores())


@query(TRIPLE + ", g AS (SELECT o_orderkey, greatest(0.15, f) AS f, greatest(0.15, o) AS o, greatest(0.15, p) AS p FROM t) SELECT o_orderkey, round(f / (f + o + p), 6) AS f, round(o / (f + o + p), 6) AS o, round(p / (f + o + p), 6) AS p FROM g")
def prob_floor(spark, sf_dir):
    df = triple(spark, sf_dir)
    return df.select("o_orderkey", *[F.round(x, 6).alias(n) for n, x in zip("fop", S.floored([F.col(c) for c in "fop"], 0.15))])


BINS = SCORED + ", b AS (SELECT least(10, greatest(1, ceil(conf * 10)))::INT AS bin, count(*) AS n, avg(conf) AS confidence, avg((y = pred)::INT) AS accuracy FROM p GROUP BY 1)"


@query(BINS + " SELECT round(sum(abs(accuracy - confidence) * n) / sum(n), 6) AS ece FROM b")
def ece(spark, sf_dir):
    return rounded(M.ece(M.reliability(scored(spark, sf_dir), "conf", F.col("y") == F.col("pred"))))


@query(BINS + " SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def reliability_table(spark, sf_dir):
    return rounded(M.reliability(scored(spark, sf_dir), "conf", F.col("y") == F.col("pred")))


@query(SCORED + " SELECT least(greatest(floor(score * 10), 0), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(y), 6) AS observed FROM p GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.least(F.greatest(F.floor(F.col("score") * 10), F.lit(0)), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"))


@query(TRIPLE + f" SELECT (o_custkey % 19 * 5)::BIGINT AS minute, count(*) AS n, {SCORES} FROM t GROUP BY 1")
def metric_by_bucket(spark, sf_dir):
    return triple(spark, sf_dir).groupBy((F.col("o_custkey") % 19 * 5).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("n"), *_scores())


@query(SCORED + ", b AS (SELECT (doc_id % 6)::BIGINT AS phase, least(10, greatest(1, ceil(conf * 10)))::INT AS bin, count(*) AS n, avg(conf) AS c, avg((y = pred)::INT) AS a FROM p GROUP BY 1, 2) SELECT phase, round(sum(abs(a - c) * n) / sum(n), 6) AS ece, round(sum(c * n) / sum(n), 6) AS confidence, round(sum(a * n) / sum(n), 6) AS accuracy, round(sum((c - a) * n) / sum(n), 6) AS over_confidence FROM b GROUP BY phase")
def phase_calibration(spark, sf_dir):
    b = M.reliability(scored(spark, sf_dir).withColumn("phase", (F.col("doc_id") % 6).cast("long")), "conf", F.col("y") == F.col("pred"), ["phase"])
    n, c, a = F.col("n"), F.col("confidence"), F.col("accuracy")
    return b.groupBy("phase").agg((F.sum(F.abs(a - c) * n) / F.sum("n")).alias("ece"), (F.sum(c * n) / F.sum("n")).alias("confidence"), (F.sum(a * n) / F.sum("n")).alias("accuracy"), (F.sum((c - a) * n) / F.sum("n")).alias("over_confidence")).transform(rounded)


@query(TRIPLE + """, m AS (SELECT o_orderpriority AS model, round(avg((f - (o_orderstatus = 'F')::INT) ** 2 + (f + o - (o_orderstatus IN ('F', 'O'))::INT) ** 2) / 2, 5) AS rps FROM t WHERE o_orderkey % 2 = 0 GROUP BY 1), k AS (SELECT round(avg((0.5 - (o_orderstatus = 'F')::INT) ** 2 + (0.97 - (o_orderstatus IN ('F', 'O'))::INT) ** 2) / 2, 5) AS rps FROM t WHERE o_orderkey % 2 = 0)
SELECT model, m.rps AS rps, round(m.rps - k.rps, 5) AS gap, m.rps < k.rps AS beats_market, m.rps = (SELECT min(rps) FROM m) AS best FROM m, k""")
def market_compare(spark, sf_dir):
    tagged = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select("o_orderkey")
    t = triple(spark, sf_dir).join(tagged, "o_orderkey", "left_semi")
    hit = [F.col("o_orderstatus") == c for c in "FOP"]
    m = t.groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.avg(M.rps([F.col(c) for c in "fop"], hit)), 5).alias("rps"))
    k = t.agg(F.round(F.avg(M.rps([F.lit(0.5), F.lit(0.47), F.lit(0.03)], hit)), 5).alias("market"))
    return m.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(m.agg(F.min("rps").alias("least")))).select("model", "rps", F.round(F.col("rps") - F.col("market"), 5).alias("gap"), (F.col("rps") < F.col("market")).alias("beats_market"), (F.col("rps") == F.col("least")).alias("best"))


@query("WITH p AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT round(regr_slope(ln(t), ln(n)), 6) AS exponent, round(exp(regr_intercept(ln(t), ln(n))), 4) AS scale, count(*) AS points FROM p WHERE t > 0")
def power_law_fit(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("t"))
    return M.power_law(p, "n", "t").select(F.round("exponent", 6).alias("exponent"), F.round("scale", 4).alias("scale"), "points")


@query(SCORED + " SELECT doc_id, round(abs(y - score), 6) AS error FROM p ORDER BY abs(y - score) DESC, doc_id LIMIT 10")
def worst_predictions(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("e", F.abs(F.col("y") - F.col("score")))
    return df.orderBy(F.desc("e"), "doc_id").limit(10).select("doc_id", F.round("e", 6).alias("error"))


@query(SCORED + " SELECT toxic, round(avg(y), 6) AS prior, round(avg(score), 6) AS mean_score, count(*) AS n FROM p GROUP BY toxic")
def dummy_prior(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("toxic").agg(F.round(F.avg("y"), 6).alias("prior"), F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))
