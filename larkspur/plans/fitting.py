"""Queries that grow trees, validate, calibrate and fit several classes at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import models as M
from larkspur.operators import neighbors as N
from larkspur.operators import preparation as P
from larkspur.operators import shrinkage as H
from larkspur.operators import trees as T
from larkspur.operators import validation as V
from larkspur.plans.learning import vectors
from larkspur.plans.metrics import TRIPLE, rounded, triple
from larkspur.plans.preparation import UNIT
from larkspur.plans.registry import query, table


def tree_parts(source: str, depth: int, classes: list[str] | None, to: str = "", train: str = "true") -> list[str]:
    """Unrolled growth of a tree over `source` (keys, x: a list of features, y), as tables up to r<depth><to>: by Gini's impurity over the classes or, without them,
    by variance. Only rows that `train` says are grown on; all are led to their leaves.

    A feature with over 20 values in a node is tried at 15 percentiles, others at all midpoints; five rows to split, two to a leaf.
    """
    if classes:
        sums = {f"s{k}": f"count(*) FILTER (WHERE y = '{c}' {{}})::DOUBLE" for k, c in enumerate(classes)}
        loss = lambda end, n: "(1 - " + " - ".join(f"({s}{end} / {n}) ** 2" for s in sums) + ")"
    else:
        sums = {"s0": "coalesce(sum(y) FILTER (WHERE true {}), 0)", "s1": "coalesce(sum(y * y) FILTER (WHERE true {}), 0)"}
        loss = lambda end, n: f"(s1{end} / {n} - (s0{end} / {n}) ** 2)"
    parts = [f"r0{to} AS (SELECT *, 1::BIGINT AS node FROM ({source}))"]
    for d in range(depth):
        parts.append(f"""l{d}{to} AS (SELECT node, unnest(range(1, len(x) + 1)) AS f, unnest(x) AS v, y FROM r{d}{to} WHERE {train}),
m{d}{to} AS (SELECT node, f, count(DISTINCT v) AS many FROM l{d}{to} GROUP BY 1, 2),
p{d}{to} AS (SELECT DISTINCT node, f, t FROM (SELECT node, f, unnest(list_transform(range(0, 15), lambda k: o[(70 + 90 * k) * (n - 1) // 1400 + 1] + (o[least((70 + 90 * k) * (n - 1) // 1400 + 2, n)] - o[(70 + 90 * k) * (n - 1) // 1400 + 1]) * ((70 + 90 * k) * (n - 1) % 1400 / 1400))) AS t FROM (SELECT node, f, list(v ORDER BY v) AS o, count(v) AS n FROM l{d}{to} JOIN m{d}{to} USING (node, f) WHERE many > 20 AND v IS NOT NULL GROUP BY node, f)
  UNION ALL SELECT node, f, (v + w) / 2 AS t FROM (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS w FROM (SELECT DISTINCT node, f, v FROM l{d}{to}) JOIN m{d}{to} USING (node, f) WHERE many <= 20) WHERE w IS NOT NULL)),
s{d}{to} AS (SELECT node, f, t, count(*)::DOUBLE AS n, count(*) FILTER (WHERE v <= t)::DOUBLE AS nl, {', '.join(f"{e.format('')} AS {s}, {e.format('AND v <= t')} AS {s}l" for s, e in sums.items())} FROM l{d}{to} JOIN p{d}{to} USING (node, f) GROUP BY 1, 2, 3),
g{d}{to} AS (SELECT node, f, t, n, round({loss('', 'n')} - nl / n * {loss('l', 'nl')} - (n - nl) / n * {loss('r', '(n - nl)')}, 9) AS score FROM (SELECT *, {', '.join(f'{s} - {s}l AS {s}r' for s in sums)} FROM s{d}{to}) WHERE nl >= 2 AND n - nl >= 2 AND n >= 5),
b{d}{to} AS (SELECT node, f, t FROM g{d}{to} WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, f, t) = 1),
r{d + 1}{to} AS (SELECT r.* EXCLUDE (node), CASE WHEN f IS NULL THEN node WHEN coalesce(x[f] <= t, false) THEN 2 * node ELSE 2 * node + 1 END AS node FROM r{d}{to} r LEFT JOIN b{d}{to} USING (node))""")
    return parts


def tree_sql(source: str, keys: str, depth: int, classes: list[str] | None) -> str:
    """Each row's leaf with its prediction."""
    parts, out = tree_parts(source, depth, classes), f"r{depth}"
    if classes:
        tops = f"c AS (SELECT node, y, count(*)::DOUBLE AS n FROM {out} GROUP BY 1, 2), v AS (SELECT node, y AS prediction, round(n / sum(n) OVER (PARTITION BY node), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, y) = 1)"
        return f"WITH {', '.join(parts)}, {tops} SELECT {keys}, node AS leaf, prediction, share FROM {out} JOIN v USING (node)"
    return f"WITH {', '.join(parts)}, v AS (SELECT node, round(avg(y), 6) AS prediction FROM {out} GROUP BY 1) SELECT {keys}, node AS leaf, prediction FROM {out} JOIN v USING (node)"


LINES = "SELECT l_orderkey, l_linenumber, [l_quantity::DOUBLE, (l_extendedprice / 1000)::DOUBLE, l_discount::DOUBLE] AS x, l_returnflag AS y FROM lineitem"
XS = ["quantity", "price", "discount"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_discount").alias("discount"), "l_returnflag", (F.col("l_tax") * 100).alias("tax"))


@query(tree_sql(LINES, "l_orderkey, l_linenumber", 3, ["A", "N", "R"]))
def tree_three_classes(spark, sf_dir):
    """Three features, one of them with few values, and three classes."""
    df = _lines(spark, sf_dir)
    out = T.predict(T.leaf(df, tree := T.grow(df, XS, "l_returnflag", "gini", 3)), tree, "prediction", "shares")
    return out.select("l_orderkey", "l_linenumber", "leaf", "prediction", F.round(F.array_max("shares"), 6).alias("share"))


@query(tree_sql(LINES.replace("l_returnflag AS y", "(l_extendedprice / l_quantity / 1000)::DOUBLE AS y"), "l_orderkey, l_linenumber", 3, None))
def tree_regression(spark, sf_dir):
    """A unit's price from three features."""
    df = _lines(spark, sf_dir).withColumn("unit", F.col("price") / F.col("quantity"))
    out = T.predict(T.leaf(df, tree := T.grow(df, XS, "unit", "variance", 3)), tree)
    return out.select("l_orderkey", "l_linenumber", "leaf", F.round("prediction", 6).alias("prediction"))


@query(f"""WITH d AS (SELECT event_id, [CASE WHEN event_type <> 'error' THEN value END, (user_id % 50)::DOUBLE, (event_id % 7)::DOUBLE] AS x, (event_type IN ('purchase', 'signup'))::INT::VARCHAR AS y FROM events)
SELECT event_id, leaf, prediction::INT AS prediction, share FROM ({tree_sql("SELECT * FROM d", "event_id", 2, ["0", "1"])})""")
def tree_with_nulls(spark, sf_dir):
    """Rows without a value go to the right in growth and in prediction."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), (F.col("user_id") % 50).alias("group"), (F.col("event_id") % 7).alias("day"), F.col("event_type").isin("purchase", "signup").cast("int").alias("y"))
    out = T.predict(T.leaf(e, tree := T.grow(e, ["value", "group", "day"], "y", "gini", 2)), tree, "prediction", "shares")
    return out.select("event_id", "leaf", "prediction", F.round(F.array_max("shares"), 6).alias("share"))


PENALTIES = [0.0, 1.0, 100.0, 10000.0]


@query(f"""WITH d AS (SELECT (l_orderkey % 5)::INT AS fold, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem), p AS (SELECT unnest({PENALTIES}::DOUBLE[]) AS penalty),
s AS (SELECT f.fold, count(*)::BIGINT AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS "by" FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
w AS (SELECT *, n + penalty AS g, n * ab / (sa * sb) AS h, n * ay / sa AS u, n * "by" / sb AS v FROM s, p),
c AS (SELECT *, (g * u - h * v) / (g * g - h * h) AS wa, (g * v - h * u) / (g * g - h * h) AS wb FROM w)
SELECT c.fold, c.penalty, c.n AS n_train, count(*)::BIGINT AS n_test, round(avg((y - my - wa * (a - ma) / sa - wb * (b - mb) / sb) ** 2), 6) AS mse FROM c JOIN d USING (fold) GROUP BY c.fold, c.penalty, c.n""")
def cv_ridge(spark, sf_dir):
    """Five folds that keep orders together, four penalties, features scaled by each fold's training rows."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))
    return V.cross_validate(df, ["l_quantity", "l_discount"], "y", "fold", PENALTIES).withColumn("mse", F.round("mse", 6))


RATE, STEPS, LAM = 0.5, 5, 0.01


def _logistic_sql():
    classes, xs = ["A", "N", "R"], ["1.0", "a", "b"]
    sig = lambda k: f"1 / (1 + exp(-(w{k}0 + w{k}1 * a + w{k}2 * b)))"
    parts = ["d AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 50 AS a, l_discount::DOUBLE * 10 AS b, l_returnflag AS y FROM lineitem)", "s0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS w{k}{j}" for k in range(3) for j in range(3)) + ")"]
    for t in range(STEPS):
        moved = ", ".join(f"any_value(w{k}{j}) - {RATE} * (avg(({sig(k)} - (y = '{c}')::INT) * {x}) + {LAM if j else 0} * any_value(w{k}{j})) AS w{k}{j}" for k, c in enumerate(classes) for j, x in enumerate(xs))
        parts.append(f"s{t + 1} AS (SELECT {moved} FROM d, s{t})")
    parts.append("o AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{sig(k)} AS p{k}" for k in range(3)) + f" FROM d, s{STEPS})")
    return f"WITH {', '.join(parts)} SELECT l_orderkey, l_linenumber, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS prediction, " + ", ".join(f"round(p{k} / (p0 + p1 + p2), 6) AS p_{c}" for k, c in enumerate("anr")) + " FROM o"


@query(_logistic_sql())
def logistic_ovr(spark, sf_dir):
    """Three classes, a fixed number of steps."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), "l_returnflag")
    out = V.Logistic(df, ["a", "b"], "l_returnflag", RATE, STEPS, LAM).predict(df)
    return out.select("l_orderkey", "l_linenumber", "prediction", *[F.round(F.col("shares")[k], 6).alias(f"p_{c}") for k, c in enumerate("anr")])


@query()
def krr_ovr(spark, sf_dir):
    """A kernel ridge for each label from one factorisation; `fitted_on` is the number of sampled rows."""
    e = vectors(spark, sf_dir)
    model, classes, used = V.kernel_ridge_classes(e, "vec_id", "v", "label", M.rbf(1 / 128), rows=1000)
    return model.apply(e, "v", "scores").select("vec_id", V.class_of_scores("scores", classes).alias("prediction"), F.round(F.array_max("scores"), 6).alias("score"), F.lit(used).alias("fitted_on"))


NEWTON = 8


def _sigmoid_sql():
    """The Newton steps of three sigmoids, unrolled."""
    names = list(zip(range(3), "fop", ("F", "O", "P")))
    parts = [TRIPLE.removeprefix("WITH "), "d AS (SELECT * FROM t WHERE o_orderkey % 2 = 0)", "n AS (SELECT count(*)::DOUBLE AS n, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{c}')::DOUBLE AS n{k}" for k, _, c in names) + " FROM d)"]
    parts.append("z0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS a{k}, ln((n{k} + 1) / (n - n{k} + 1)) AS b{k}" for k, _, _ in names) + " FROM n)")
    for t in range(NEWTON):
        p = lambda k, s: f"(1 / (1 + exp(-(a{k} * {s} + b{k}))))"
        sums = ", ".join(
            f"any_value(a{k}) AS a{k}, any_value(b{k}) AS b{k}, sum({p(k, s)} - y{k}) AS e{k}, sum(({p(k, s)} - y{k}) * {s}) AS es{k}, sum({p(k, s)} * (1 - {p(k, s)})) + 1e-12 AS w{k}, sum({p(k, s)} * (1 - {p(k, s)}) * {s}) AS ws{k}, sum({p(k, s)} * (1 - {p(k, s)}) * {s} * {s}) + 1e-12 AS wss{k}"
            for k, s, _ in names
        )
        targets = ", ".join(f"CASE WHEN o_orderstatus = '{c}' THEN (n{k} + 1) / (n{k} + 2) ELSE 1 / (n - n{k} + 2) END AS y{k}" for k, _, c in names)
        parts.append(f"q{t} AS (SELECT {sums} FROM (SELECT d.*, {targets} FROM d, n), z{t})")
        parts.append(f"z{t + 1} AS (SELECT " + ", ".join(f"a{k} - (w{k} * es{k} - ws{k} * e{k}) / (w{k} * wss{k} - ws{k} * ws{k}) AS a{k}, b{k} - (wss{k} * e{k} - ws{k} * es{k}) / (w{k} * wss{k} - ws{k} * ws{k}) AS b{k}" for k, _, _ in names) + f" FROM q{t})")
    parts.append("c AS (SELECT o_orderkey, " + ", ".join(f"1 / (1 + exp(-(a{k} * {s} + b{k}))) AS c{k}" for k, s, _ in names) + f" FROM t, z{NEWTON})")
    parts.append("g AS (SELECT o_orderkey, " + ", ".join(f"greatest(0.005, c{k} / (c0 + c1 + c2)) AS g{k}" for k, _, _ in names) + " FROM c)")
    return f"WITH {', '.join(parts)} SELECT o_orderkey, " + ", ".join(f"round(g{k} / (g0 + g1 + g2), 6) AS {s}" for k, s, _ in names) + " FROM g"


@query(_sigmoid_sql())
def calibrate_sigmoid(spark, sf_dir):
    """Shares of three classes, each calibrated against the rest on half of the orders."""
    df = triple(spark, sf_dir).select("o_orderkey", "o_orderstatus", "f", "o", "p")
    fit = V.Sigmoids(df.where("o_orderkey % 2 = 0"), ["f", "o", "p"], "o_orderstatus", ["F", "O", "P"], NEWTON)
    return df.select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in zip("fop", V.floored(fit.apply()))])


DIMS = 4


@query(f"""WITH e AS (SELECT vec_id AS key, label, list_transform(range(1, {DIMS + 1}), lambda i: embedding[i]::DOUBLE * 10 ** i) AS v FROM embeddings), s AS (SELECT [{", ".join(f"stddev_pop(v[{i}])" for i in range(1, DIMS + 1))}] AS sd FROM e),
n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), t AS (SELECT *, (SELECT max(n) FROM n) - n AS need FROM n), own AS (SELECT key, label, v, list_transform(list_zip(v, sd), lambda z: z[1] / z[2]) AS z, row_number() OVER (PARTITION BY label ORDER BY key) AS k FROM e JOIN t USING (label), s WHERE need > 0),
d AS (SELECT a.key AS base, b.key AS other, row_number() OVER (PARTITION BY a.key ORDER BY round(list_sum(list_transform(list_zip(a.z, b.z), lambda z: (z[1] - z[2]) ** 2)), 9), b.key) AS rank FROM own a JOIN own b ON a.label = b.label AND a.key <> b.key),
new AS (SELECT label, n, unnest(range(1, need + 1)) AS new_id FROM t WHERE need > 0), p AS (SELECT *, floor({UNIT(42, "base", "label", "new_id")} * n) + 1 AS k, floor({UNIT(42, "near", "label", "new_id")} * least(5, n - 1)) + 1 AS rank, {UNIT(42, "step", "label", "new_id")} AS step FROM new)
SELECT p.label, new_id, a.key AS base, b.key AS other, round(a.v[1] + step * (coalesce(b.v[1], a.v[1]) - a.v[1]), 6) AS first, round(a.v[4] + step * (coalesce(b.v[4], a.v[4]) - a.v[4]), 4) AS last
FROM p JOIN own a ON a.label = p.label AND a.k = p.k LEFT JOIN d ON d.base = a.key AND d.rank = p.rank LEFT JOIN own b ON b.key = d.other""")
def smote_scaled(spark, sf_dir):
    """Every smaller label is filled up; neighbours are sought with dimensions of very different widths scaled."""
    v = F.array(*[F.col("embedding")[i].cast("double") * F.pow(F.lit(10.0), F.lit(i + 1)) for i in range(DIMS)])
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))
    return N.smote_scaled(e, "vec_id", "v", "label").select("label", "new_id", "base", "other", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[3], 4).alias("last"))


@query("""WITH d AS (SELECT event_id AS key, event_type AS label, round(value, 1) AS x, (user_id % 5)::DOUBLE AS y FROM events WHERE value IS NOT NULL),
n AS (SELECT a.key AS query, b.key, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 9) AS d FROM d a JOIN d b ON a.label = b.label AND a.key <> b.key)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, key)::INT AS rank FROM n QUALIFY rank <= 3""")
def nearest_rows(spark, sf_dir):
    """Each event's three nearest events of its type: all rows against all rows, many of them with equal values."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "event_type", F.array(F.round("value", 1), (F.col("user_id") % 5).cast("double")).alias("v"))
    return N.nearest(e, e, "event_id", "v", 3, "event_type")


def _tau_sql(a, b):
    return f"(WITH g AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2), s AS (SELECT sum(sign(a.x - b.x)::DOUBLE * sign(a.y - b.y) * a.n * b.n) AS s, sum(abs(sign(a.x - b.x)) * a.n * b.n) AS p, sum(abs(sign(a.y - b.y)) * a.n * b.n) AS q FROM g a, g b) SELECT s / sqrt(p * q) FROM s)"


@query(f"""WITH d AS (SELECT l_quantity AS a, floor(l_quantity / 10) + l_linenumber % 2 AS b, round(l_discount * 100) AS c, floor(l_extendedprice / 2000) AS y FROM lineitem),
t AS (SELECT {", ".join(f"{_tau_sql(x, z)} AS {x}{z}" for x, z in ("ab", "ac", "bc", "ay", "by", "cy"))}), f AS (SELECT *, abs(ab) > 0.5 AS p, abs(ac) > 0.5 AS q, abs(bc) > 0.5 AS r, abs(ay) AS la, abs("by") AS lb, abs(cy) AS lc FROM t),
g AS (SELECT *, p AND la < lb AS oa1, p AND la >= lb AS ob1 FROM f), h AS (SELECT *, oa1 OR (q AND la < lc) AS oa, NOT oa1 AND q AND la >= lc AS oc1 FROM g),
i AS (SELECT *, ob1 OR (NOT oc1 AND r AND lb < lc) AS ob, oc1 OR (NOT ob1 AND r AND lb >= lc) AS oc FROM h)
SELECT 'a' AS "column", round(ay, 6) AS tau_label, NOT oa AS kept FROM i UNION ALL SELECT 'b', round("by", 6), NOT ob FROM i UNION ALL SELECT 'c', round(cy, 6), NOT oc FROM i""")
def prune_kendall(spark, sf_dir):
    """Of columns that go together, the one closer to the label stays."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.floor(F.col("l_quantity") / 10) + F.col("l_linenumber") % 2).alias("b"), F.round(F.col("l_discount") * 100).alias("c"), F.floor(F.col("l_extendedprice") / 2000).alias("y"))
    return P.kendall_kept(df, ["a", "b", "c"], "y").withColumn("tau_label", F.round("tau_label", 6))


def _shrunk_sql(depth, folds):
    """Three trees, each of two folds, and every penalty's error on the third."""
    source = "SELECT (l_orderkey % 3)::INT AS fold, [l_quantity::DOUBLE, (l_extendedprice / 1000)::DOUBLE, l_discount::DOUBLE] AS x, (l_extendedprice / l_quantity / 1000)::DOUBLE AS y FROM lineitem"
    parts, out = [f"lams AS (SELECT unnest({list(H.PENALTIES)}::DOUBLE[]) AS lam)"], []
    for f in range(folds):
        r = f"r{depth}_{f}"
        parts += tree_parts(source, depth, None, f"_{f}", f"fold <> {f}")
        parts.append(f"n_{f} AS (SELECT node >> k AS a, avg(y) AS mu, count(*) AS n FROM {r}, (SELECT unnest(range(0, {depth + 1})) AS k) WHERE fold <> {f} AND node >> k >= 1 GROUP BY 1)")
        parts.append(f"s_{f} AS (SELECT leaf, lam, sum((c.mu - p.mu) / (1 + lam / p.n)) AS s FROM (SELECT DISTINCT node AS leaf FROM {r}), lams, (SELECT unnest(range(0, {depth})) AS k), n_{f} c, n_{f} p WHERE c.a = leaf >> k AND p.a = leaf >> (k + 1) GROUP BY 1, 2)")
        out.append(f"SELECT {f} AS fold, l.lam, count(*)::BIGINT AS n, round(avg((y - (SELECT mu FROM n_{f} WHERE a = 1) - coalesce(s, 0)) ** 2), 6) AS loss FROM {r} JOIN lams l ON true LEFT JOIN s_{f} s ON s.leaf = {r}.node AND s.lam = l.lam WHERE fold = {f} GROUP BY l.lam")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_shrunk_sql(2, 3))
def hs_losses(spark, sf_dir):
    """Every penalty of shrunk regression trees, by three folds."""
    df = _lines(spark, sf_dir).withColumns({"unit": F.col("price") / F.col("quantity"), "fold": (F.col("l_orderkey") % 3).cast("int")})
    return H.losses(df, "l_orderkey", XS, "unit", "variance", "fold", [0, 1, 2], depth=2).withColumn("loss", F.round("loss", 6))


def _study_sql(seeds=10, penalties=(0.0, 50.0)):
    """Weighted least squares of two features in closed form, for each seed, arm and penalty."""
    boot, under = UNIT(7, "boot", "seed", "key"), UNIT(7, "under", "seed", "key")
    times = " + ".join(f"(u >= {b})::INT" for b in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406))
    measures = ("accuracy", "recall", "specificity", "gmean")
    return f"""WITH d AS (SELECT event_id AS key, value AS a, (user_id % 10)::DOUBLE AS b, (event_type IN ('purchase', 'signup') AND value > 20)::INT::DOUBLE AS y, event_id % 3 > 0 AS train FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
k AS (SELECT y, count(*)::DOUBLE AS n FROM d WHERE train GROUP BY 1), h AS (SELECT y, n / (SELECT min(n) FROM k) AS share FROM k),
e AS (SELECT d.*, share, seed, {boot} AS u, {under} AS v FROM d JOIN h USING (y), (SELECT unnest(range(1, {seeds + 1}))::INT AS seed) WHERE train),
w AS (SELECT seed, a, b, y, unnest(['none', 'weighted', 'undersampled', 'bootstrapped']) AS arm, unnest([1, 1 / share, (v < 1 / share)::INT, {times}]::DOUBLE[]) AS w FROM e),
m AS (SELECT seed, arm, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my FROM w GROUP BY 1, 2),
s AS (SELECT m.seed, m.arm, any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sqrt(sum(w * (a - ma) ** 2) / any_value(n)) AS sa, sqrt(sum(w * (b - mb) ** 2) / any_value(n)) AS sb, sum(w * (a - ma) * (b - mb)) AS ab, sum(w * (a - ma) * (y - my)) AS ay, sum(w * (b - mb) * (y - my)) AS "by" FROM w JOIN m USING (seed, arm) GROUP BY 1, 2),
p AS (SELECT *, n + penalty AS g, ab / (sa * sb) AS h, ay / sa AS x, "by" / sb AS z FROM s, (SELECT unnest({list(penalties)}::DOUBLE[]) AS penalty)),
f AS (SELECT *, (g * x - h * z) / (g * g - h * h) / sa AS wa, (g * z - h * x) / (g * g - h * h) / sb AS wb FROM p),
t AS (SELECT seed, arm, penalty, y = 1 AS y, round(my + wa * (a - ma) + wb * (b - mb), 9) >= 0.5 AS q FROM f, (SELECT a, b, y FROM d WHERE NOT train)),
c AS (SELECT seed, arm, penalty, count(*) FILTER (WHERE y AND q)::DOUBLE AS tp, count(*) FILTER (WHERE NOT y AND q)::DOUBLE AS fp, count(*) FILTER (WHERE NOT y AND NOT q)::DOUBLE AS tn, count(*) FILTER (WHERE y AND NOT q)::DOUBLE AS fn FROM t GROUP BY 1, 2, 3),
r AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM c), o AS (SELECT *, sqrt(recall * specificity) AS gmean FROM r)
SELECT arm, penalty, count(*) AS seeds, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in measures)} FROM o GROUP BY 1, 2"""


@query(_study_sql())
def resampling_study(spark, sf_dir):
    """Four arms, ten seeds, two penalties: means and deviations over the seeds."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL AND user_id IS NOT NULL")
    df = e.select("event_id", F.col("value").alias("a"), (F.col("user_id") % 10).alias("b"), (F.col("event_type").isin("purchase", "signup") & (F.col("value") > 20)).cast("int").alias("y"))
    return rounded(V.over_seeds(V.study(df, "event_id", ["a", "b"], "y", F.col("event_id") % 3 > 0, list(range(1, 11)), [0.0, 50.0])))
