"""Queries that encode, impute, scale, select, split, resample and profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import preparation as P
from larkspur.operators import profiling as Q
from larkspur.plans.metrics import rounded
from larkspur.plans.registry import query, table

UNIT = lambda seed, purpose, *ids: f"""(CAST('0x' || substr(md5('{seed}:{purpose}:' || {" || ':' || ".join(ids)}), 1, 8) AS BIGINT) / 4294967296.0)"""
HOLED = "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS who, (event_type IN ('purchase', 'signup'))::INT AS y, event_id % 10 < 7 AS train FROM events"


def holed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("who"), F.col("event_type").isin("purchase", "signup").cast("int").alias("y"), (F.col("event_id") % 10 < 7).alias("train"))


@query("SELECT o_orderkey, (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def one_hot_drop_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return P.one_hot(o, "o_orderstatus", P.levels(o, "o_orderstatus"), drop_first=True).drop("o_orderstatus")


@query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INT) AS priority FROM orders")
def ordinal_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", P.ordinal_map("o_orderpriority", {p: int(p[0]) for p in P.levels(o, "o_orderpriority")}).alias("priority"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey = 0) THEN (SELECT count(DISTINCT b.c_mktsegment) FROM customer b WHERE b.c_nationkey = 0 AND b.c_mktsegment < customer.c_mktsegment) ELSE -1 END::INT AS code FROM customer")
def label_encode(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return P.label_encode(c, "c_mktsegment", P.levels(c.where("c_nationkey = 0"), "c_mktsegment"), "code").select("c_custkey", "code")


@query("SELECT p_type, n, (row_number() OVER (ORDER BY n DESC, p_type) - 1)::INT AS code FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10)")
def frequency_codes(spark, sf_dir):
    return P.frequency_codes(table(spark, sf_dir, "part"), "p_type", 10)


@query(f"WITH h AS ({HOLED}) SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM h WHERE train)), 6) AS value, coalesce(who, (SELECT who FROM h WHERE train AND who IS NOT NULL GROUP BY who ORDER BY count(*) DESC, who LIMIT 1)) AS who FROM h")
def impute_median_mode(spark, sf_dir):
    h = holed(spark, sf_dir)
    return P.impute_mode(P.impute_median(h, h.where("train"), ["value"]), h.where("train"), ["who"]).select("event_id", F.round("value", 6).alias("value"), "who")


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events WHERE event_id % 10 < 7)) / (SELECT stddev_pop(value) FROM events WHERE event_id % 10 < 7), 6) AS value FROM events")
def standard_scale_pop(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return P.scale(e, e.where("event_id % 10 < 7"), ["value"]).select("event_id", F.round("value", 6).alias("value"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def pearson_pairs(spark, sf_dir):
    return rounded(P.pearson(table(spark, sf_dir, "lineitem"), NUMBERS))


@query("WITH g AS (SELECT quality AS x, toxic AS y, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), s AS (SELECT sum(sign(a.x - b.x)::DOUBLE * sign(a.y - b.y) * a.n * b.n) AS s, sum(abs(sign(a.x - b.x)) * a.n * b.n) AS p, sum(abs(sign(a.y - b.y)) * a.n * b.n) AS q FROM g a, g b) SELECT round(s / sqrt(p * q), 6) AS tau FROM s")
def kendall_pairs(spark, sf_dir):
    return rounded(P.kendall(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("SELECT b AS \"column\", round(abs(r), 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS b, corr(l_extendedprice, {b}) AS r FROM lineitem" for b in ("l_quantity", "l_discount", "l_tax")) + ") ORDER BY abs(r) DESC LIMIT 2")
def corr_rank(spark, sf_dir):
    pairs = P.pearson(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]).where("a = 'l_extendedprice'")
    return pairs.select(F.col("b").alias("column"), F.round(F.abs("r"), 6).alias("r")).orderBy(F.desc("r"), "column").limit(2)


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:split:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, r <= greatest(1, floor(n * 0.3)) AS is_test FROM r")
def stratified_split(spark, sf_dir):
    return P.stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "is_test")


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY md5('42:fold:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels")
def kfold_assign(spark, sf_dir):
    return P.kfold(table(spark, sf_dir, "labels"), "doc_id", 5, "quality").select("doc_id", "fold")


@query(f"SELECT event_id, floor({UNIT(42, 'group', 'user_id')} * 3)::INT AS fold FROM events")
def group_kfold(spark, sf_dir):
    return P.group_kfold(table(spark, sf_dir, "events"), "user_id", 3).select("event_id", "fold")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:sample:' || o_orderkey), o_orderkey LIMIT 500")
def subsample_hash(spark, sf_dir):
    return P.subsample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:under:' || doc_id), doc_id) AS r FROM labels) SELECT doc_id, quality FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def undersample(spark, sf_dir):
    return P.undersample(table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query(f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT quality AS q, n FROM c ORDER BY n, quality LIMIT 1), k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:order:' || doc_id), doc_id) AS k FROM labels, m WHERE quality = q), reps AS (SELECT unnest(range(1, 4)) AS replicate),
a AS (SELECT replicate, k AS pick, floor({UNIT(42, 'boot', 'replicate', 'k')} * n) + 1 AS kk FROM k, reps, m),
b AS (SELECT replicate, doc_id, row_number() OVER (PARTITION BY replicate ORDER BY md5('42:major:' || replicate || ':' || doc_id), replicate || ':' || doc_id) AS pick FROM labels, reps, m WHERE quality <> q)
SELECT replicate::INT AS replicate, pick::INT AS pick, doc_id, true AS minority FROM a JOIN k ON k.k = a.kk UNION ALL SELECT replicate::INT, pick::INT, doc_id, false FROM b, m WHERE pick <= n""")
def bootstrap_balanced(spark, sf_dir):
    df = table(spark, sf_dir, "labels")
    least = df.groupBy("quality").count().orderBy("count", "quality").first()["quality"]
    return P.balanced_bootstrap(df, "quality", "doc_id", 3).select("replicate", "pick", "doc_id", (F.col("quality") == least).alias("minority"))


SMOTE = f"""WITH own AS (SELECT vec_id AS key, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings WHERE label = 3), k AS (SELECT *, row_number() OVER (ORDER BY key) AS k, count(*) OVER () AS n FROM own),
d AS (SELECT a.key, b.key AS other, row_number() OVER (PARTITION BY a.key ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)), 9), b.key) AS rank FROM own a JOIN own b ON a.key <> b.key),
near AS (SELECT * FROM d WHERE rank <= 5), many AS (SELECT key, max(rank) AS m FROM near GROUP BY key), new AS (SELECT i AS new_id, floor({UNIT(42, 'base', 'i')} * (SELECT count(*) FROM own)) + 1 AS k FROM (SELECT unnest(range(1, 51)) AS i)),
p AS (SELECT new_id, key AS base, v, floor({UNIT(42, 'near', 'new_id')} * m) + 1 AS rank FROM new JOIN k USING (k) JOIN many USING (key))
SELECT new_id, base, other, round(v[1] + {UNIT(42, 'step', 'new_id')} * (w.v1 - v[1]), 6) AS first, round(list_sum(list_transform(list_zip(v, w.v8), lambda z: z[1] + {UNIT(42, 'step', 'new_id')} * (z[2] - z[1]))), 5) AS total FROM p JOIN near ON near.key = p.base AND near.rank = p.rank JOIN (SELECT key, v[1] AS v1, v AS v8 FROM own) w ON w.key = other"""


@query(SMOTE)
def smote_binary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v"))
    df = P.smote(e, "vec_id", "v", "label", 3, 50)
    return df.select("new_id", "base", "other", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT quality, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality")
def class_weights(spark, sf_dir):
    return rounded(P.class_weights(table(spark, sf_dir, "labels"), "quality"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate < TIMESTAMP '1999-01-01' AS train FROM orders), s AS (SELECT quantile_cont(o_totalprice, 0.5) AS med, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM o WHERE train)
SELECT o_orderkey, train, round((o_totalprice - m) / sd, 6) AS o_totalprice, (o_orderstatus = 'F')::INT AS "o_orderstatus_F", (o_orderstatus = 'O')::INT AS "o_orderstatus_O", (o_orderstatus = 'P')::INT AS "o_orderstatus_P" FROM o, s""")
def prepare_matrix_train_only(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("train"))
    train = P.refuse_snapshots(o).where("train")
    df = P.scale(P.impute_median(o, train, ["o_totalprice"]), train, ["o_totalprice"])
    return P.one_hot(df, "o_orderstatus", P.levels(train, "o_orderstatus")).withColumn("o_totalprice", F.round("o_totalprice", 6)).drop("o_orderstatus")


@query("SELECT round(quantile_cont(s, 0.5) / 2, 6) AS weight FROM (" + " UNION ALL ".join(f"SELECT stddev_pop(embedding[{i + 1}]::DOUBLE) AS s FROM embeddings WHERE label = 3" for i in range(8)) + ")")
def mixed_encode_weight(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label = 3")
    row = e.agg(F.array(*[F.stddev_pop(F.col("embedding")[i].cast("double")) for i in range(8)]).alias("s"))
    return row.select(F.explode("s").alias("s")).agg(F.round(F.percentile("s", 0.5) / 2, 6).alias("weight"))


@query(f"""WITH h AS ({HOLED}), m AS (SELECT 'value' AS "column", count(*) - count(value) AS n, avg((value IS NULL)::INT) AS share, greatest(abs(coalesce(corr((value IS NULL)::INT, user_id), 0)), abs(corr((value IS NULL)::INT, y))) AS c FROM h UNION ALL SELECT 'who', count(*) - count(who), avg((who IS NULL)::INT), greatest(abs(corr((who IS NULL)::INT, user_id)), abs(corr((who IS NULL)::INT, y))) FROM h)
SELECT "column", n::DOUBLE AS n_missing, round(share, 6) AS share, round(c, 6) AS corr, CASE WHEN c > 0.3 THEN 'MAR' WHEN share > 0.6 THEN 'MNAR' ELSE 'MCAR' END AS kind FROM m""")
def missing_profile(spark, sf_dir):
    return rounded(Q.missing(holed(spark, sf_dir), ["value", "who"], ["user_id", "y"]))


def _outlier_sql(c):
    return f"SELECT '{c}' AS \"column\", count(CASE WHEN abs(({c} - m) / s) > 3 THEN 1 END)::DOUBLE AS n_z, count(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 END)::DOUBLE AS n_iqr FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem)"


@query(" UNION ALL ".join(map(_outlier_sql, NUMBERS)))
def outlier_z_iqr(spark, sf_dir):
    return Q.outliers(table(spark, sf_dir, "lineitem"), NUMBERS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_unique, round(max(n) / sum(n), 6) AS top_share, max(n) / sum(n) > 0.99 OR count(*) <= 1 AS near_constant FROM (SELECT {c}, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("l_returnflag", "l_linestatus", "l_tax")))
def near_constant(spark, sf_dir):
    return rounded(Q.near_constant(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_tax"]))


@query(" UNION ALL ".join(f"SELECT '{b}' AS \"column\", round(abs(corr(l_extendedprice, {b})), 6) AS r, abs(corr(l_extendedprice, {b})) > 0.9 AS leaks FROM lineitem" for b in ("l_quantity", "l_discount", "l_tax")))
def leakage_corr(spark, sf_dir):
    pairs = P.pearson(table(spark, sf_dir, "lineitem"), NUMBERS[1:2] + NUMBERS[:1] + NUMBERS[2:]).where("a = 'l_extendedprice'")
    return pairs.select(F.col("b").alias("column"), F.round(F.abs("r"), 6).alias("r"), (F.abs("r") > 0.9).alias("leaks"))


@query("SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(skewness(value), 5) AS skew, min(value) AS min, max(value) AS max, count(DISTINCT value) AS n_unique FROM events")
def label_quality(spark, sf_dir):
    d = Q.distribution(table(spark, sf_dir, "events"), "value")
    return d.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("skew", 5).alias("skew"), "min", "max", "n_unique")


@query("SELECT count(*) AS classes, sum(n)::BIGINT AS rows, round(max(n) / min(n), 6) AS ratio FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def class_imbalance(spark, sf_dir):
    return rounded(Q.imbalance(table(spark, sf_dir, "events"), "event_type"))


@query("SELECT least(20, greatest(1, floor(l_quantity / 2.5) + 1))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_corr_data(spark, sf_dir):
    return Q.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 20)


@query("SELECT 'events' AS scope, 'value' AS field, count(CASE WHEN value < 1 THEN 1 END) AS affected_rows, 'value under 1' AS reason FROM events UNION ALL SELECT 'orders', 'o_custkey', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), 'customers without orders'")
def quality_log(spark, sf_dir):
    a = table(spark, sf_dir, "events").agg(F.count_if(F.col("value") < 1).alias("n")).select(F.lit("events").alias("scope"), F.lit("value").alias("field"), F.col("n").alias("affected_rows"), F.lit("value under 1").alias("reason"))
    lone = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(lone.select(F.lit("orders").alias("scope"), F.lit("o_custkey").alias("field"), F.col("n").alias("affected_rows"), F.lit("customers without orders").alias("reason")))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS s, round(abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(value, 6) END AS clean FROM events")
def sigmoid_zscore_sanitise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stats = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    odd = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return e.crossJoin(F.broadcast(stats)).select("event_id", F.round(F.abs(F.col("value") - F.col("m")) / F.col("s"), 6).alias("z"), F.round(S.sigmoid(F.col("value") / 100), 6).alias("s"), F.round(S.sane(odd), 6).alias("clean"))


@query("SELECT user_id, toxic_n, round(m, 6) AS median_value, y_major FROM (SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS toxic_n, quantile_cont(value, 0.5) AS m, count(CASE WHEN event_type = 'click' THEN 1 END) * 2 >= count(*) AS y_major FROM events GROUP BY 1)")
def leaf_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("toxic_n"), F.round(F.percentile("value", 0.5), 6).alias("median_value"), (F.count_if(F.col("event_type") == "click") * 2 >= F.count(F.lit(1))).alias("y_major"))




CHOSEN = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "WITH r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(CHOSEN) for b in CHOSEN[i + 1 :]) + "), y AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, abs(corr({c}, l_discount)) AS r FROM lineitem" for c in CHOSEN) + "), gone AS (SELECT CASE WHEN p.r >= q.r THEN b ELSE a END AS c FROM r JOIN y p ON p.c = a JOIN y q ON q.c = b WHERE abs(r.r) > 0.85) SELECT c AS kept FROM y WHERE c NOT IN (SELECT c FROM gone)"
)
def prune_pearson(spark, sf_dir):
    """Of two columns that go together, the one closer to the label stays."""
    pairs = {(r["a"], r["b"]): r["r"] for r in P.pearson(table(spark, sf_dir, "lineitem"), [*CHOSEN, "l_discount"]).collect()}  # one number for each pair of columns
    kept = P.prune_pearson({k: v for k, v in pairs.items() if "l_discount" not in k}, {c: pairs[c, "l_discount"] for c in CHOSEN}, CHOSEN)
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(c) for c in kept])).alias("kept"))


RATIOS = ["l_extendedprice", "l_quantity", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS numerator, '{b}' AS denominator, round(share, 6) AS share, share > 0.99 AS leaks FROM (SELECT count(*) FILTER (WHERE abs({a} / nullif({b}, 0) - l_extendedprice / l_quantity) <= 0.005) / count(*) AS share FROM lineitem)" for a in RATIOS for b in RATIOS if a != b))
def leakage_guard(spark, sf_dir):
    """Which two features rebuild a unit's price as their ratio: the right ones do, others only for some rows."""
    df = table(spark, sf_dir, "lineitem").select(*RATIOS).withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(Q.rebuilt(Q.guarded(df, RATIOS), "unit", RATIOS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(bool_and({c} IN (0, 1)), false) AS is_binary FROM labels" for c in ("doc_id", "quality", "toxic")))
def binary_columns(spark, sf_dir):
    return Q.binary(table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])


@query(f"SELECT event_type, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (SELECT event_type, run, avg(value) AS m FROM events, (SELECT unnest(range(1, 11)) AS run) WHERE {UNIT(42, 'run', 'run', 'event_id')} < 0.7 GROUP BY 1, 2) GROUP BY 1")
def run_aggregates(spark, sf_dir):
    """Mean and population deviation of a figure over ten seeded runs, each on its own part of the rows."""
    runs = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("run")).where(S.unit(42, "run", F.col("run"), F.col("event_id")) < 0.7)
    return rounded(runs.groupBy("event_type", "run").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")))


@query("SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"customer\":' || o_custkey || '}' AS json, list_filter(l, lambda x, i: list_position(l, x) = i) AS digits FROM (SELECT *, [o_orderkey % 3, o_custkey % 3, o_orderkey % 2] AS l FROM orders)")
def json_and_list_dedupe(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))).alias("json"), F.array_distinct(F.array(F.col("o_orderkey") % 3, F.col("o_custkey") % 3, F.col("o_orderkey") % 2)).alias("digits"))
