"""Queries that fit or apply learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import models as M
from larkspur.operators import profiling as Q
from larkspur.operators import trees as T
from larkspur.operators.ordering import shared_folder
from larkspur.plans.metrics import rounded
from larkspur.plans.registry import query, table

D = "list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) ** 2))"
NEAR = f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 10 = 0), n AS (SELECT q.vec_id AS query, b.vec_id AS key, b.label, round({D}, 9) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({D}, 9), b.vec_id) AS rank FROM q JOIN e b ON b.vec_id <> q.vec_id), k AS (SELECT * FROM n WHERE rank <= 5)"""
DOT = "list_sum(list_transform(list_zip(q.v, b.v), lambda z: z[1] * z[2]))"
PAIRS = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def near(spark, sf_dir, kernel=None):
    e = vectors(spark, sf_dir)
    return M.top_k(e, e.where("vec_id % 10 = 0"), "vec_id", "v", 5, ["label"], kernel)


@query(NEAR + ", v AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, label) AS r FROM k GROUP BY 1, 2) SELECT query, label AS prediction FROM v WHERE r = 1")
def knn_classify(spark, sf_dir):
    return M.knn_classify(near(spark, sf_dir), "label")


@query(NEAR + ", v AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY round(sum(1 / (sqrt(d) + 1e-10)), 9) DESC, label) AS r FROM k GROUP BY 1, 2) SELECT query, label AS prediction FROM v WHERE r = 1")
def knn_weighted(spark, sf_dir):
    return M.knn_classify(near(spark, sf_dir), "label", weighted=True)


@query(NEAR + " SELECT query, round(avg(label), 6) AS prediction FROM k GROUP BY query")
def knn_regress(spark, sf_dir):
    return rounded(M.knn_regress(near(spark, sf_dir), "label"))


@query(NEAR + ", v AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, label) AS r FROM k GROUP BY 1, 2) SELECT query, label AS prediction FROM v WHERE r = 1")
def kernel_knn(spark, sf_dir):
    """With the linear kernel the neighbours are those of plain distances."""
    return M.knn_classify(near(spark, sf_dir, lambda a, b: a @ b.T), "label")


def _values(spark, sf_dir, kind, **more):
    """A stated query set against all rows, in blocks of queries."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return M.kernel_pairs(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", kind, **more)


@query(PAIRS + f" SELECT q.vec_id AS i, b.vec_id AS j, round({DOT}, 6) AS k FROM q, e b")
def kernel_linear(spark, sf_dir):
    return _values(spark, sf_dir, "linear")


@query(PAIRS + f" SELECT q.vec_id AS i, b.vec_id AS j, round(({DOT} + 1) ** 3, 6) AS k FROM q, e b")
def kernel_poly(spark, sf_dir):
    return _values(spark, sf_dir, "poly")


@query(PAIRS + f" SELECT q.vec_id AS i, b.vec_id AS j, round(exp(-{D} / 128), 6) AS k FROM q, e b")
def kernel_rbf(spark, sf_dir):
    return _values(spark, sf_dir, "rbf", gamma=1 / 128)


@query(PAIRS + f", m AS (SELECT list(a ORDER BY i) AS v FROM (SELECT i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)), c AS (SELECT vec_id, list_transform(list_zip(e.v, m.v), lambda z: z[1] - z[2]) AS v FROM e, m) SELECT q.vec_id AS i, b.vec_id AS j, round({DOT}, 6) AS k FROM c q, c b WHERE q.vec_id % 100 = 0")
def kernel_centered(spark, sf_dir):
    """The doubly centred linear kernel is the kernel of centred vectors, so no matrix of all pairs is needed for its means."""
    v = F.col("embedding")
    means = table(spark, sf_dir, "embeddings").agg(*[F.avg(F.get(v, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(64)]).first()
    return _values(spark, sf_dir, "linear", center=list(means))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS argmax, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def array_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.argmax(F.col("embedding")).alias("argmax"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS halves FROM embeddings")
def array_dot_norm(spark, sf_dir):
    v = F.col("v")
    return vectors(spark, sf_dir).select("vec_id", F.round(S.dot(v, v), 6).alias("norm2"), F.round(S.dot(F.slice(v, 1, 32), F.slice(v, 33, 32)), 6).alias("halves"))


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.length("source").cast("double").alias("source_len"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumns({"y": F.col("quality").cast("double"), "sign": (2 * F.col("quality") - 1).cast("double"), "n_k": F.col("n_chars") / 1000})


PER = "WITH p AS (SELECT n_chars::DOUBLE AS v, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1), l AS (SELECT v, lead(v) OVER (ORDER BY v) AS w, sum(n) OVER (ORDER BY v) AS ln, sum(s) OVER (ORDER BY v) AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM p), c AS (SELECT *, (v + w) / 2 AS threshold, ts - ls AS rs, tn - ln AS rn FROM l WHERE w IS NOT NULL)"


def _best(score):
    return PER + f" SELECT 'n_chars' AS feature, threshold, round({score}, 9) AS score FROM c ORDER BY score DESC, threshold LIMIT 1"


@query(_best("(sqrt(ls / ts) - sqrt((ln - ls) / (tn - ts))) ** 2 + (sqrt(rs / ts) - sqrt((rn - rs) / (tn - ts))) ** 2"))
def best_split_hellinger(spark, sf_dir):
    return M.best_split(_labelled(spark, sf_dir), ["n_chars"], "y", "hellinger")


def _g(s, n):
    return f"(1 - ({s} / {n}) ** 2 - (1 - {s} / {n}) ** 2)"


@query(_best(f"{_g('ts', 'tn')} - ln / tn * {_g('ls', 'ln')} - rn / tn * {_g('rs', 'rn')}"))
def best_split_gini(spark, sf_dir):
    return M.best_split(_labelled(spark, sf_dir), ["n_chars"], "y", "gini")


def _v(s, n):
    return f"({s} / {n} - ({s} / {n}) ** 2)"


@query(_best(f"{_v('ts', 'tn')} - ln / tn * {_v('ls', 'ln')} - rn / tn * {_v('rs', 'rn')}"))
def best_split_variance(spark, sf_dir):
    return M.best_split(_labelled(spark, sf_dir), ["n_chars"], "y", "variance")


def _tree_sql(score, gain="AND score > 0"):
    """Two levels of best splits, at least five rows to split and two to a leaf, and each row's leaf mean."""

    def best(name, source):
        return f"""{name}_p AS (SELECT v, count(*)::DOUBLE AS n, sum(y) AS s FROM {source} GROUP BY 1), {name}_l AS (SELECT v, lead(v) OVER (ORDER BY v) AS w, sum(n) OVER (ORDER BY v) AS ln, sum(s) OVER (ORDER BY v) AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM {name}_p), {name}_c AS (SELECT *, (v + w) / 2 AS threshold, ts - ls AS rs, tn - ln AS rn FROM {name}_l WHERE w IS NOT NULL), {name} AS (SELECT threshold FROM (SELECT threshold, round({score}, 9) AS score FROM {name}_c WHERE ln >= 2 AND rn >= 2 AND tn >= 5 AND ts > 0 AND ts < tn) WHERE true {gain} ORDER BY score DESC, threshold LIMIT 1)"""

    return f"""WITH d AS (SELECT doc_id, n_chars::DOUBLE AS v, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)), {best("root", "d")}, s AS (SELECT d.*, coalesce(v <= (SELECT threshold FROM root), true) AS a FROM d), {best("l", "(SELECT * FROM s WHERE a)")}, {best("r", "(SELECT * FROM s WHERE NOT a)")}
SELECT doc_id, round(avg(y) OVER (PARTITION BY a, b), 6) AS p FROM (SELECT *, coalesce(v <= CASE WHEN a THEN (SELECT threshold FROM l) ELSE (SELECT threshold FROM r) END, true) AS b FROM s)"""


def _tree(spark, sf_dir, kind):
    """Midpoints of all values are tried, whatever their number."""
    df = _labelled(spark, sf_dir).select("doc_id", "n_chars", "y")
    tree = T.grow(df, ["n_chars"], "y", kind, 2, tried=0)
    p = T.predict(df, tree, "p", "shares")
    return p.select("doc_id", F.round(F.col("p") if tree.classes is None else F.col("shares")[tree.classes.index(1.0)], 6).alias("p"))


@query(_tree_sql(f"{_g('ts', 'tn')} - ln / tn * {_g('ls', 'ln')} - rn / tn * {_g('rs', 'rn')}"))
def tree_gini(spark, sf_dir):
    return _tree(spark, sf_dir, "gini")


@query(_tree_sql(f"{_v('ts', 'tn')} - ln / tn * {_v('ls', 'ln')} - rn / tn * {_v('rs', 'rn')}"))
def tree_variance(spark, sf_dir):
    return _tree(spark, sf_dir, "variance")


@query(_tree_sql("(sqrt(ls / ts) - sqrt((ln - ls) / (tn - ts))) ** 2 + (sqrt(rs / ts) - sqrt((rn - rs) / (tn - ts))) ** 2", ""))
def tree_hellinger(spark, sf_dir):
    return _tree(spark, sf_dir, "hellinger")


@query(PER + ", e AS (SELECT threshold, ls + (rn - rs) AS wrong, tn FROM c) SELECT 'n_chars' AS feature, threshold, round(least(wrong / tn, 1 - wrong / tn), 6) AS error, round(0.5 * ln((1 - least(wrong / tn, 1 - wrong / tn)) / least(wrong / tn, 1 - wrong / tn)), 6) AS alpha FROM e ORDER BY round(least(wrong / tn, 1 - wrong / tn), 9), threshold LIMIT 1")
def adaboost_round1(spark, sf_dir):
    s = M.adaboost(_labelled(spark, sf_dir), ["n_chars"], "sign", 1)
    return rounded(spark.createDataFrame([(x["feature"], float(x["threshold"]), float(x["error"]), float(x["alpha"])) for x in s], "feature string, threshold double, error double, alpha double"))


def _adaboost_sql(rounds=3, xs=("n_chars", "source_len")):
    """The stumps of each round: rows weigh exp(-sign * margin), every midpoint of both columns is tried, and the errors of the two ways to label the sides are compared."""
    parts = ["m0 AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, length(source)::DOUBLE AS source_len, (2 * quality - 1)::DOUBLE AS y, 0.0::DOUBLE AS margin FROM labels JOIN documents USING (doc_id))"]
    for r in range(rounds):
        parts.append(f"w{r} AS (SELECT *, exp(-y * margin) AS w FROM m{r})")
        for k, x in enumerate(xs):
            parts.append(f"p{r}_{k} AS (SELECT {k} AS place, v, lead(v) OVER (ORDER BY v) AS after, sum(n) OVER (ORDER BY v) AS ln, sum(s) OVER (ORDER BY v) AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM (SELECT {x} AS v, sum(w) AS n, sum(w * y) AS s FROM w{r} GROUP BY 1))")
        every = " UNION ALL ".join(f"SELECT * FROM p{r}_{k}" for k in range(len(xs)))
        wrong = "((ln + ls) / 2 + ((tn - ln) - (ts - ls)) / 2) / tn"
        parts.append(f"b{r} AS (SELECT place, (v + after) / 2 AS threshold FROM ({every}) WHERE after IS NOT NULL ORDER BY round(-least({wrong}, 1 - {wrong}), 9) DESC, place, threshold LIMIT 1)")
        side = "CASE WHEN CASE place " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END <= threshold THEN -1 ELSE 1 END"
        parts.append(f"e{r} AS (SELECT sum(w) FILTER (WHERE {side} <> y) / sum(w) AS e FROM w{r}, b{r})")
        parts.append(f"a{r} AS (SELECT place, threshold, CASE WHEN e > 0.5 THEN -1 ELSE 1 END AS side, 0.5 * ln((1 - least(e, 1 - e)) / least(e, 1 - e)) AS alpha FROM b{r}, e{r})")
        parts.append(f"m{r + 1} AS (SELECT doc_id, n_chars, source_len, y, margin + alpha * side * {side} AS margin FROM m{r}, a{r})")
    return f"WITH {', '.join(parts)} SELECT doc_id, round(margin, 6) AS margin, CASE WHEN margin >= 0 THEN 1 ELSE -1 END AS prediction, round(1 / (1 + exp(-margin)), 6) AS p FROM m{rounds}"


@query(_adaboost_sql())
def adaboost_scores(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    stumps = M.adaboost(df, ["n_chars", "source_len"], "sign", 3)
    margin = sum((F.lit(s["alpha"]) * M.stump(s) for s in stumps), F.lit(0.0))
    return df.select("doc_id", F.round(margin, 6).alias("margin"), F.when(margin >= 0, 1).otherwise(-1).alias("prediction"), F.round(S.sigmoid(margin), 6).alias("p"))


XS = ["l_quantity", "l_discount", "l_tax"]


def _moment(i, j):
    x = ["1.0", *XS, "l_extendedprice"]
    return f"SELECT {i} AS i, {j} AS j, sum({x[i]}::DOUBLE * {x[j]}::DOUBLE) AS value FROM lineitem"


@query("SELECT i, j, round(value, 2) AS value FROM (" + " UNION ALL ".join(_moment(i, j) for i in range(4) for j in range(i, 5)) + ")")
def ridge_moments(spark, sf_dir):
    return M.moments(table(spark, sf_dir, "lineitem"), XS, "l_extendedprice").withColumn("value", F.round("value", 2))


@query("WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem), w AS (SELECT *, (n * xy - x * y) / (n * (xx + 1) - x * x) AS w FROM s) SELECT l_orderkey, l_linenumber, round((y - w * x) / n + w * l_quantity, 4) AS prediction FROM lineitem, w")
def ridge_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    w = M.ridge(df, ["l_quantity"], "l_extendedprice", 1.0)
    return df.select("l_orderkey", "l_linenumber", F.round(M.linear(w, ["l_quantity"]), 4).alias("prediction"))


def _logistic_sql(steps=15, rate=0.3, lam=0.01):
    parts = ["d AS (SELECT doc_id, n_chars::DOUBLE / 1000 AS x, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id))", "s0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for t in range(steps):
        e = "(1 / (1 + exp(-(a + b * x))) - y)"
        parts.append(f"s{t + 1} AS (SELECT any_value(a) - {rate} * avg({e}) AS a, any_value(b) - {rate} * (avg({e} * x) + {lam} * any_value(b) / count(*)) AS b FROM d, s{t})")
    return f"WITH {', '.join(parts)} SELECT doc_id, round(1 / (1 + exp(-(a + b * x))), 6) AS p FROM d, s{steps}"


@query(_logistic_sql())
def logistic_fit(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    w = M.logistic(df, ["n_k"], "y", steps=15)
    return df.select("doc_id", F.round(S.sigmoid(M.linear(w, ["n_k"])), 6).alias("p"))


@query()
def krr_fit(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return M.kernel_ridge(e, "vec_id", "v", "label", M.rbf(1 / 128)).apply(e, "v", "p").select("vec_id", F.round(F.col("p")[0], 6).alias("prediction"))


@query()
def svm_fit(spark, sf_dir):
    e = vectors(spark, sf_dir).withColumn("sign", F.when(F.col("label") < 5, 1.0).otherwise(-1.0))
    model, offset, _ = M.kernel_svm(e, "vec_id", "v", "sign", M.rbf(1 / 128))
    return model.apply(e, "v", "p").select("vec_id", F.round(F.col("p")[0] + offset, 6).alias("decision"))


@query()
def kpca(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return M.kernel_pca(e, "vec_id", "v", M.rbf(1 / 128)).apply(e, "v", "p").select("vec_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[1], 6).alias("second"))


@query()
def nystroem(spark, sf_dir):
    e = vectors(spark, sf_dir)
    mapped = M.nystroem(e, "vec_id", "v", M.rbf(1 / 128), 20).apply(e, "v", "z")
    names = [f"z{i}" for i in range(20)]
    wide = mapped.select("vec_id", "label", *[F.col("z")[i].alias(n) for i, n in enumerate(names)])
    return wide.select("vec_id", F.round(M.linear(M.ridge(wide, names, "label", 1e-3), names), 6).alias("prediction"))


@query()
def isolation_scores(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "l_quantity", "l_extendedprice", "l_discount")
    out = M.Isolation(df, "key", ["l_quantity", "l_extendedprice", "l_discount"], trees=25).score(df)
    bound = out.agg(F.percentile_approx("score", 0.95, 10_000).alias("bound"))
    return out.crossJoin(F.broadcast(bound)).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), (F.col("score") >= F.col("bound")).alias("anomaly"))


@query()
def balanced_bagging(spark, sf_dir):
    df = _labelled(spark, sf_dir).withColumn("y", F.col("quality").cast("double"))
    trees = M.balanced_bagging(df, "doc_id", ["n_chars", "source_len"], "y", replicates=3)
    return M.vote(trees, df, ["n_chars", "source_len"]).select("doc_id", "quality", "prediction", F.round("mean_probability", 6).alias("p"))


@query()
def hs_forest(spark, sf_dir):
    """A shrunk random forest; the model's node table goes through the shared folder."""
    import uuid

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df = _labelled(spark, sf_dir).select("doc_id", "y", "n_chars", "source_len")
    ready = VectorAssembler(inputCols=["n_chars", "source_len"], outputCol="features").transform(df)
    model = RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=4, seed=3).fit(ready)
    nodes = M.shrunk_nodes(model, 10.0, f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}")
    return M.forest_predict(df, nodes, ["n_chars", "source_len"]).select("doc_id", F.round("p", 6).alias("p"))


#: Least squares under the order: at each point the largest, over beginnings before it, of the least mean up to an end behind it; linear between points.
_ISOTONIC = """WITH d AS (SELECT doc_id, 1 / (1 + exp(-(n_chars::DOUBLE / 1000 - 2))) AS raw, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)),
u AS (SELECT raw, sum(y) AS s, count(*) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY raw), k AS (SELECT raw, row_number() OVER o AS i, sum(s) OVER o AS s, sum(n) OVER o AS n FROM u WINDOW o AS (ORDER BY raw ROWS UNBOUNDED PRECEDING)),
z AS (SELECT i, s, n FROM k UNION ALL SELECT 0, 0, 0), m AS (SELECT a.i + 1 AS a, b.i AS b, (b.s - a.s) / (b.n - a.n) AS mean FROM z a JOIN z b ON b.i > a.i),
l AS (SELECT k.i, m.a, min(mean) AS low FROM k JOIN m ON m.a <= k.i AND m.b >= k.i GROUP BY 1, 2), f AS (SELECT i, max(low) AS fit FROM l GROUP BY i), g AS (SELECT raw AS place, fit FROM k JOIN f USING (i)),
e AS (SELECT d.doc_id, d.raw, max(place) FILTER (WHERE place <= d.raw) AS lo, min(place) FILTER (WHERE place >= d.raw) AS hi FROM d, g GROUP BY 1, 2)
SELECT doc_id, round(raw, 6) AS raw, round(greatest(0.005, least(0.995, CASE WHEN lo IS NULL THEN h.fit WHEN hi IS NULL OR hi = lo THEN l.fit ELSE l.fit + (h.fit - l.fit) * (raw - lo) / (hi - lo) END)), 6) AS p FROM e LEFT JOIN g l ON l.place = e.lo LEFT JOIN g h ON h.place = e.hi"""


@query(_ISOTONIC)
def calibrate_isotonic(spark, sf_dir):
    from pyspark.ml.regression import IsotonicRegression

    df = _labelled(spark, sf_dir).withColumns({"raw": S.sigmoid(F.col("n_k") - 2), "label": F.col("y")})
    model = IsotonicRegression(featuresCol="raw", labelCol="label").fit(df.where("doc_id % 2 = 0"))
    return model.transform(df).select("doc_id", F.round("raw", 6).alias("raw"), F.round(F.greatest(F.lit(0.005), F.least(F.lit(0.995), F.col("prediction"))), 6).alias("p"))


@query()
def tune_grid(spark, sf_dir):
    """A grid of penalties by three folds that keep a customer's orders together; one row per candidate."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from larkspur.operators.preparation import group_kfold

    df = VectorAssembler(inputCols=XS, outputCol="features").transform(group_kfold(table(spark, sf_dir, "lineitem"), "l_orderkey", 3)).withColumn("label", F.col("l_extendedprice"))
    lr = LinearRegression(solver="normal")
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1, 10.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mae"), foldCol="fold", numFolds=3).fit(df)
    return spark.createDataFrame([(float(g[lr.regParam]), round(float(s), 4)) for g, s in zip(grid, cv.avgMetrics)], "penalty double, mae double")


@query()
def sweep(spark, sf_dir):
    """Every model of the registry on one split: model, accuracy."""
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["n_k", "source_len"], outputCol="features").transform(_labelled(spark, sf_dir)).withColumn("label", F.col("y"))
    train, test = df.where("doc_id % 3 > 0"), df.where("doc_id % 3 = 0")
    zoo = {"tree": DecisionTreeClassifier(maxDepth=3), "forest": RandomForestClassifier(numTrees=5, seed=1), "boosted": GBTClassifier(maxIter=3, seed=1), "logistic": LogisticRegression(regParam=0.01)}
    out = test.agg(F.lit("majority").alias("model"), F.round(F.avg("label"), 4).alias("accuracy"))
    for name, model in zoo.items():
        out = out.unionByName(model.fit(train).transform(test).agg(F.lit(name).alias("model"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 4).alias("accuracy")))
    return out


@query()
def adasyn(spark, sf_dir):
    return _resampled(spark, sf_dir, "adasyn")


@query()
def borderline(spark, sf_dir):
    return _resampled(spark, sf_dir, "borderline")


def _resampled(spark, sf_dir, mode):
    df = M.adaptive_smote(vectors(spark, sf_dir), "vec_id", "v", "label", 3, 40, mode)
    return df.select("new_id", "base", "other", F.round(F.col("vector")[0], 6).alias("first"))


@query()
def gsmotenc(spark, sf_dir):
    e = vectors(spark, sf_dir).withColumn("category", F.when(F.col("v")[0] > 0, "a").otherwise("b"))
    return M.geometric_smote(e, "vec_id", "v", "label", 3, 40, "category").select("new_id", "base", "category", F.round(F.col("vector")[0], 6).alias("first"))


BOARD = "SELECT o_orderkey, list_transform(range(0, 9), lambda i: ((o_orderkey // (3 ** i)::BIGINT) % 3 - 1)::INT) AS b FROM orders"
#: The eight lines of the board: fixed values.
LINES = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6))


@query(f"WITH x AS ({BOARD}), s AS (SELECT o_orderkey, [" + ", ".join(f"b[{i + 1}] + b[{j + 1}] + b[{k + 1}]" for i, j, k in LINES) + "] AS sums FROM x) SELECT o_orderkey, len(list_filter(sums, lambda v: v = 3)) AS won, len(list_filter(sums, lambda v: v = -3)) AS lost, len(list_filter(sums, lambda v: v = 2)) AS near, (len(list_filter(sums, lambda v: v = 3)) * 100 - len(list_filter(sums, lambda v: v = -3)) * 100 + len(list_filter(sums, lambda v: v = 2)) * 5)::BIGINT AS value FROM s")
def ttt_line_features(spark, sf_dir):
    """Boards are read off the digits of the order's number; their lines' sums are features of a linear value."""
    b = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (F.floor(F.col("o_orderkey") / F.pow(F.lit(3.0), i)) % 3 - 1).cast("int"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", b.alias("b"))
    sums = F.array(*[F.col("b")[i] + F.col("b")[j] + F.col("b")[k] for i, j, k in LINES])
    df = df.select("o_orderkey", sums.alias("sums"))
    many = lambda v: F.size(F.filter("sums", lambda x: x == v)).cast("long")
    df = df.select("o_orderkey", many(3).alias("won"), many(-3).alias("lost"), many(2).alias("near"))
    return df.withColumn("value", F.col("won") * 100 - F.col("lost") * 100 + F.col("near") * 5)


@query("WITH a AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding[1:16], embedding[17:32]), lambda z: z[1]::DOUBLE * z[2])) AS x, list_sum(list_transform(list_zip(embedding[1:16], embedding[33:48]), lambda z: z[1]::DOUBLE * z[2])) AS y, list_sum(list_transform(list_zip(embedding[1:16], embedding[49:64]), lambda z: z[1]::DOUBLE * z[2])) AS z FROM embeddings) SELECT vec_id, CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS action, round(greatest(x, y, z), 6) AS value FROM a")
def value_argmax(spark, sf_dir):
    """The action with the highest value: features of each action by weights."""
    v = F.col("v")
    values = F.array(*[S.dot(F.slice(v, 1, 16), F.slice(v, 16 * k + 17, 16)) for k in range(3)])
    return vectors(spark, sf_dir).select("vec_id", S.argmax(values).alias("action"), F.round(F.array_max(values), 6).alias("value"))


@query("WITH v AS (SELECT 'l_returnflag' AS kept, l_returnflag AS x FROM lineitem UNION ALL SELECT 'fixed', 'x' FROM lineitem), c AS (SELECT kept, x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1, 2) SELECT kept FROM c GROUP BY kept HAVING max(n) / sum(n) <= 0.99 AND count(*) > 1")
def near_constant_drop(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.lit("x").alias("fixed"))
    return Q.near_constant(df, ["l_returnflag", "fixed"]).where("NOT near_constant").select(F.col("column").alias("kept"))
