"""Queries that join, group, audit and reshape."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import relational as R
from larkspur.operators.ordering import percentile_row
from larkspur.plans.registry import query, table

def many():
    return F.count(F.lit(1))


@query("""SELECT o_orderkey, side, who, score, CASE WHEN score > other THEN 3 WHEN score = other THEN 1 ELSE 0 END AS points FROM (
SELECT o_orderkey, 'home' AS side, o_custkey AS who, floor(o_totalprice / 100000)::BIGINT AS score, (o_custkey % 5)::BIGINT AS other FROM orders UNION ALL SELECT o_orderkey, 'away', o_custkey % 100, (o_custkey % 5)::BIGINT, floor(o_totalprice / 100000)::BIGINT FROM orders)""")
def long_format_union(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumns({"h": F.floor(F.col("o_totalprice") / 100000), "a": (F.col("o_custkey") % 5).cast("long"), "guest": F.col("o_custkey") % 100})
    long = R.long_format(df, ["o_orderkey"], {"home": {"who": "o_custkey", "score": "h", "other": "a"}, "away": {"who": "guest", "score": "a", "other": "h"}})
    return long.select("o_orderkey", "side", "who", "score", F.when(F.col("score") > F.col("other"), 3).when(F.col("score") == F.col("other"), 1).otherwise(0).alias("points"))


@query("SELECT o_orderkey, n_lines, round(revenue, 4) AS revenue FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def left_join_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(many().alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    return table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "n_lines", "revenue")


FAULT = "CASE WHEN event_type = 'error' THEN 'error event' WHEN value < 1 THEN 'value under 1' END"


@query(f"""SELECT 'events' AS source, user_id AS key, event_id::VARCHAR AS record_id, {FAULT} AS reason FROM events WHERE ({FAULT}) IS NOT NULL""")
def drop_with_log(spark, sf_dir):
    _, log = R.drop_with_log(table(spark, sf_dir, "events"), "events", F.col("user_id"), F.col("event_id"), {"error event": F.col("event_type") == "error", "value under 1": F.col("value") < 1})
    return log


@query("""WITH c AS (SELECT p_size, lower(trim(p_brand)) AS name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, name) AS k, count(*) OVER (PARTITION BY p_size) AS v FROM c)
SELECT p_size, name AS canonical_name, n AS observations, v AS variants FROM r WHERE k = 1""")
def canonical_names(spark, sf_dir):
    return R.canonical_names(table(spark, sf_dir, "part"), "p_size", "p_brand")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_tagged(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) + count(CASE WHEN event_type = 'signup' THEN 1 END) AS total FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id")
def full_outer_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = (e.where(F.col("event_type") == kind).groupBy("user_id").agg(many().alias(kind)) for kind in ("purchase", "signup"))
    return a.join(b, "user_id", "full").select("user_id", (F.coalesce("purchase", F.lit(0)) + F.coalesce("signup", F.lit(0))).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, round(1 / h / t, 6) AS p_home, round(1 / d / t, 6) AS p_draw, round(1 / a / t, 6) AS p_away, round(t, 6) AS overround FROM (SELECT *, 1 / h + 1 / d + 1 / a AS t FROM (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS h, CASE WHEN l_discount > 0 THEN 1 + 10 * l_discount END AS d, 1 + 10 * l_tax AS a FROM lineitem))""")
def devig(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 1).alias("h"), F.when(F.col("l_discount") > 0, 1 + 10 * F.col("l_discount")).alias("d"), (1 + 10 * F.col("l_tax")).alias("a"))
    df = R.de_vig(df, ["h", "d", "a"], ["p_home", "p_draw", "p_away"])
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away", "overround")])


@query("""SELECT coalesce(n_name, 'ALL') AS nation, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS tagged, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 6) AS coverage FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name)""")
def coverage_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    tagged = F.count_if(F.col("o_orderstatus") == "F")
    return joined.rollup("n_name").agg(many().alias("total"), tagged.alias("tagged"), F.round(tagged / many(), 6).alias("coverage")).select(F.coalesce("n_name", F.lit("ALL")).alias("nation"), "total", "tagged", "coverage")


@query("""SELECT DISTINCT p_name, trim(replace(lower(translate(p_name, 'aeo', 'aeo')), '-', ' ')) AS name FROM part""")
def name_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", S.normalised_name(F.translate(F.col("p_name"), "aeo", "äéó")).alias("name")).distinct()


@query("""SELECT a.p_partkey, b.p_partkey AS other, levenshtein(a.p_name, b.p_name)::INT AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def levenshtein_pairs(spark, sf_dir):
    return R.tiled_pairs(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", "p_name", F.levenshtein, "other", "distance")


#: A source spelling of a nation's name: capitals, the last letter gone from names of over six letters.
SPELT = "CASE WHEN length(n_name) > 6 THEN upper(left(n_name, length(n_name) - 1)) ELSE upper(n_name) END"


@query(f"""WITH s AS (SELECT {SPELT} AS source_name, lower({SPELT}) AS s, n_regionkey FROM nation), t AS (SELECT n_name AS target_name, lower(n_name) AS t, n_regionkey FROM nation),
p AS (SELECT *, levenshtein(s, t) AS f, list_transform(string_split(s, ' '), lambda x: list_min(list_transform(string_split(t, ' '), lambda y: CASE WHEN starts_with(y, x) OR starts_with(x, y) THEN 0 WHEN levenshtein(x, y) <= 1 THEN levenshtein(x, y) END))) AS c FROM s JOIN t USING (n_regionkey)),
q AS (SELECT *, row_number() OVER (PARTITION BY source_name, n_regionkey ORDER BY s <> t, -len(list_filter(c, lambda x: x IS NOT NULL)) / len(c), coalesce(list_sum(c), 0), f, target_name) AS r FROM p)
SELECT source_name, n_regionkey, target_name, CASE WHEN s = t THEN 'exact' ELSE 'fuzzy' END AS method FROM q WHERE r = 1""")
def fuzzy_resolve(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return R.resolve_names(n.select(F.expr(SPELT).alias("name"), "n_regionkey"), n.select(F.col("n_name").alias("name"), "n_regionkey"), "n_regionkey")


@query("""SELECT o_orderpriority, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 6) AS F, round(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) / count(*), 6) AS O, round(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) / count(*), 6) AS P FROM orders GROUP BY 1""")
def share_pivot(spark, sf_dir):
    df = R.shares(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return df.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("F", "O", "P")])


@query("""SELECT o_orderpriority, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS F, min(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O, min(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS P FROM orders GROUP BY 1""")
def pivot_min(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.min("o_totalprice"))


@query("""WITH t AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 8) SELECT CASE WHEN p_type IN (SELECT p_type FROM t) THEN p_type ELSE 'Other' END AS p_type, count(*) AS n FROM part GROUP BY 1""")
def top_n_other(spark, sf_dir):
    return R.top_or_other(table(spark, sf_dir, "part"), "p_type", 8).groupBy("p_type").agg(many().alias("n"))


@query("""WITH c AS (SELECT c_nationkey, o_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, o_custkey) AS k, sum(n) OVER (PARTITION BY c_nationkey) AS t FROM c)
SELECT c_nationkey, o_custkey AS top, round(n / t, 6) AS share FROM r WHERE k = 1""")
def top_team_share(spark, sf_dir):
    c = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "o_custkey").agg(many().alias("n"))
    best = c.groupBy("c_nationkey").agg(F.max_by(F.struct("o_custkey", "n"), F.struct("n", (-F.col("o_custkey")).alias("k"))).alias("b"), F.sum("n").alias("t"))
    return best.select("c_nationkey", F.col("b.o_custkey").alias("top"), F.round(F.col("b.n") / F.col("t"), 6).alias("share"))


LADDER = "CASE WHEN o_totalprice >= 400000 THEN 'huge' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(f"SELECT {LADDER} AS decision, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def decision_case(spark, sf_dir):
    ladder = F.when(F.col("o_totalprice") >= 400000, "huge").when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd")
    return table(spark, sf_dir, "orders").groupBy(ladder.alias("decision")).agg(many().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    tag = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return tag("union", a.union(b).distinct()).unionByName(tag("intersect", a.intersect(b))).unionByName(tag("except", a.exceptAll(b).distinct().join(b, "k", "left_anti")))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return R.dedupe_first(df, ["digest"], ["doc_id"]).select("doc_id", "digest")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN (SELECT quantile_cont(l_extendedprice, 0.01) FROM lineitem) AND (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)""")
def quantile_trim(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    bounds = percentile_row(df, {"a": ("l_extendedprice", 0.01), "b": ("l_extendedprice", 0.99)})
    return df.crossJoin(F.broadcast(bounds)).where(F.col("l_extendedprice").between(F.col("a"), F.col("b"))).drop("a", "b")


@query("SELECT p_partkey, round(p_retailprice, 2) AS price, round(p_size / 100, 4) AS rate FROM part")
def money_percent_parse(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("m"), F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("r"))
    return df.select("p_partkey", F.round(S.money(F.col("m")), 2).alias("price"), F.round(S.percent(F.col("r")), 4).alias("rate"))


@query("SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_number, TRY_CAST(p_type AS DOUBLE) AS nothing FROM part")
def lenient_cast(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).try_cast("double").alias("brand_number"), F.col("p_type").try_cast("double").alias("nothing"))


@query("SELECT event_id, (event_id % 90 // 60 * 3600 + event_id % 60 * 60 + event_id % 60)::DOUBLE + 0.5 AS seconds FROM events")
def clock_text_seconds(spark, sf_dir):
    e = F.col("event_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.concat_ws(":", two(F.floor(e % 90 / 60)), two(e % 60), F.concat(two(e % 60), F.lit(".500")))
    return table(spark, sf_dir, "events").select("event_id", S.clock_seconds(text).alias("seconds"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT conv_id, count(*) AS turns, min(CASE WHEN turn = 0 THEN role END) AS first_role, count(CASE WHEN role = 'user' AND turn = 0 THEN 1 END) > 0 AS opened_by_user, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def nested_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("lineup"))
    first = F.get("lineup", F.lit(0))
    head = nested.select("conv_id", "lineup", first["role"].alias("first_role"), F.coalesce((first["role"] == "user") & (first["turn"] == 0), F.lit(False)).alias("opened_by_user"))
    return R.flatten(head, "lineup", ["conv_id", "first_role", "opened_by_user"]).groupBy("conv_id", "first_role", "opened_by_user").agg(many().alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT starts_with(o_orderpriority, '2') AND contains(o_orderpriority, 'URG')""")
def filters_pack(spark, sf_dir):
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").dropna(subset=["o_custkey"]).where((F.col("o_orderstatus") == "F") & p.isin("1-URGENT", "2-HIGH") & ~p.startswith("2") & p.contains("URG")).select("o_orderkey", "o_custkey", p)


@query("""SELECT o_orderkey, greatest(-5, least(5, floor(o_totalprice / 100000 - 2)))::BIGINT AS margin, CASE WHEN o_custkey % 91 < 15 THEN '0-15' WHEN o_custkey % 91 < 30 THEN '15-30' WHEN o_custkey % 91 < 45 THEN '30-45' WHEN o_custkey % 91 < 60 THEN '45-60' WHEN o_custkey % 91 < 75 THEN '60-75' ELSE '75-90' END AS phase, o_orderstatus || ' ' || o_orderpriority AS label, 'orders' AS source FROM orders""")
def case_clip_phase(spark, sf_dir):
    minute = F.col("o_custkey") % 91
    phase = F.when(minute < 15, "0-15").when(minute < 30, "15-30").when(minute < 45, "30-45").when(minute < 60, "45-60").when(minute < 75, "60-75").otherwise("75-90")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.lit(-5), F.least(F.lit(5), F.floor(F.col("o_totalprice") / 100000 - 2))).cast("long").alias("margin"), phase.alias("phase"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("label"), F.lit("orders").alias("source"))


@query("""SELECT o_orderkey, n, returned, round(xg, 3) AS xg, abs(total - o_totalprice) < 1 AS score_ok FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned, sum(l_discount) AS xg, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def team_summary_check(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(many().alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_discount").alias("xg"), F.sum("l_extendedprice").alias("total"))
    return table(spark, sf_dir, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "n", "returned", F.round("xg", 3).alias("xg"), (F.abs(F.col("total") - F.col("o_totalprice")) < 1).alias("score_ok"))


@query("""SELECT seg AS c_mktsegment, ord::INT AS ord, count(c_custkey) AS n, round(avg(c_acctbal), 4) AS mean_balance, count(DISTINCT floor(c_acctbal / 1000)) AS bins FROM (VALUES ('BUILDING', 0), ('AUTOMOBILE', 1), ('MACHINERY', 2), ('FURNITURE', 3), ('NONE', 4)) v(seg, ord) LEFT JOIN customer ON c_mktsegment = seg GROUP BY 1, 2""")
def ordered_groups(spark, sf_dir):
    order = spark.createDataFrame([(s, i) for i, s in enumerate(["BUILDING", "AUTOMOBILE", "MACHINERY", "FURNITURE", "NONE"])], "c_mktsegment string, ord int")
    means = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(many().alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.count_distinct(F.floor(F.col("c_acctbal") / 1000)).alias("bins"))
    return F.broadcast(order).join(means, "c_mktsegment", "left").fillna(0, ["n", "bins"]).orderBy("ord", F.desc("n"))


@query("SELECT floor(c_acctbal / 1000)::BIGINT AS bin, count(*) AS n FROM customer GROUP BY 1")
def value_histogram(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_acctbal") / 1000).alias("bin")).agg(many().alias("n")).orderBy("bin")


@query("""SELECT o_orderkey, c_mktsegment, n_name, CASE WHEN c_acctbal > 9000 THEN NULL ELSE 1 END AS tagged FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def validated_joins(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = R.validated_join(table(spark, sf_dir, "customer"), nation, ["c_nationkey"]).withColumnRenamed("c_custkey", "o_custkey")
    rich = customer.where("c_acctbal <= 9000").select("o_custkey", F.lit(1).alias("tagged"))
    return R.validated_join(R.validated_join(table(spark, sf_dir, "orders"), customer, ["o_custkey"]), rich, ["o_custkey"], "left").select("o_orderkey", "c_mktsegment", "n_name", "tagged")


@query("SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS name FROM customer")
def string_fold(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.folded(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).alias("name"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def date_by_source_format(spark, sf_dir):
    short = F.col("o_orderkey") % 2 == 0
    text = F.when(short, F.date_format("o_orderdate", "dd/MM/yy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(short, S.short_date(text)).otherwise(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date")).alias("day"))


@query("""WITH e AS (SELECT depth::INT AS depth, trees::INT AS trees, rate::DOUBLE AS rate FROM (VALUES (2), (4), (8)) a(depth), (VALUES (50), (100)) b(trees), (VALUES (0.1), (0.3)) c(rate)) SELECT depth, trees, rate, o.n FROM e, (SELECT count(*) AS n FROM orders) o""")
def param_grid(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))).alias("depth")).withColumn("trees", F.explode(F.array(F.lit(50), F.lit(100)))).withColumn("rate", F.explode(F.array(F.lit(0.1), F.lit(0.3))))
    return grid.crossJoin(F.broadcast(table(spark, sf_dir, "orders").agg(many().alias("n"))))
