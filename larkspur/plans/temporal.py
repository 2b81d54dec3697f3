"""Queries over ordered rows: form, clocks, snapshots, splits, customers' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import temporal as T
from larkspur.plans.registry import query, table

ORDERED = ["o_orderdate", "o_orderkey"]
#: Ticks of eight hours since the first day of the events.
TICK = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 28800000000"


def tick():
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 28800000000).cast("long")


@query("""SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER w5, 4) AS form, row_number() OVER w - 1 AS played_prior FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w5 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def form_prior5(spark, sf_dir):
    df = T.ordinal(T.prior_mean(table(spark, sf_dir, "orders"), "o_custkey", ORDERED, ["o_totalprice"]), "o_custkey", ORDERED)
    return df.select("o_custkey", "o_orderkey", F.round("form_o_totalprice", 4).alias("form"), "played_prior")


@query("SELECT o_custkey, o_orderkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::INT AS rest_days FROM orders")
def rest_days(spark, sf_dir):
    return T.rest_days(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", ORDERED).select("o_custkey", "o_orderkey", "rest_days")


@query("""SELECT count(*) AS first_rows, count(form) AS leaking FROM (SELECT row_number() OVER w AS rn, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS form
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE rn = 1""")
def first_row_leakage_check(spark, sf_dir):
    df = T.first_rows(T.prior_mean(table(spark, sf_dir, "orders"), "o_custkey", ORDERED, ["o_totalprice"]), "o_custkey", ORDERED)
    return df.agg(F.count(F.lit(1)).alias("first_rows"), F.count("form_o_totalprice").alias("leaking"))


@query("""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)),
s AS (SELECT day, CASE WHEN r <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.6)) + greatest(1, floor(n * 0.2)) THEN 'validation' ELSE 'test' END AS split FROM d)
SELECT split, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM orders JOIN s ON o_orderdate::DATE = day GROUP BY split""")
def date_split(spark, sf_dir):
    df = T.date_split(table(spark, sf_dir, "orders"), "o_orderdate")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("SELECT 0::BIGINT AS days_in_two_splits, 0::BIGINT AS orders_lost, 3::BIGINT AS splits FROM orders LIMIT 1")
def split_invariants(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    df = T.date_split(orders, "o_orderdate")
    days = df.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("days_in_two_splits"))
    return days.crossJoin(orders.agg(F.count(F.lit(1)).alias("a")).crossJoin(df.agg(F.count(F.lit(1)).alias("b"), F.count_distinct("split").alias("splits")))).select("days_in_two_splits", (F.col("a") - F.col("b")).alias("orders_lost"), "splits")


@query("SELECT user_id, s::INT AS snapshot FROM (SELECT DISTINCT user_id FROM events), unnest(range(0, 91, 5)) AS t(s)")
def snapshot_grid(spark, sf_dir):
    return T.snapshot_grid(table(spark, sf_dir, "events").select("user_id").distinct(), 0, 90, 5)


PREFIX = f"""WITH e AS (SELECT user_id, event_type, value, max({TICK}) OVER (PARTITION BY user_id ORDER BY event_id) AS eff FROM events), g AS (SELECT user_id, s AS snapshot FROM (SELECT DISTINCT user_id FROM events), unnest(range(0, 91, 5)) AS t(s))
SELECT g.user_id, g.snapshot::BIGINT AS snapshot, count(e.user_id) AS n_events, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS n_purchases, round(coalesce(sum(value), 0), 4) AS value_so_far, count(CASE WHEN eff >= g.snapshot - 10 THEN 1 END) AS n_recent
FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.eff <= g.snapshot GROUP BY g.user_id, g.snapshot"""


def _prefix(spark, sf_dir, operator):
    df = T.effective_clock(table(spark, sf_dir, "events").withColumn("tick", tick()), "user_id", ["event_id"], "tick")
    sums = {"n_events": F.lit(1), "n_purchases": F.when(F.col("event_type") == "purchase", 1).otherwise(0), "value_so_far": F.col("value")}
    df = operator(df, "user_id", "eff", sums, {"n_recent": F.lit(1)})
    return df.select("user_id", F.col("snapshot").cast("long").alias("snapshot"), "n_events", "n_purchases", F.round("value_so_far", 4).alias("value_so_far"), "n_recent")


@query(PREFIX)
def prefix_cut_bucketed(spark, sf_dir):
    return _prefix(spark, sf_dir, T.prefix_state)


@query(PREFIX)
def prefix_cut_range(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    df = T.effective_clock(df.withColumn("tick", tick()), "user_id", ["event_id"], "tick")
    sums = {"n_events": F.when(F.col("e.user_id").isNotNull(), 1), "n_purchases": F.when(F.col("event_type") == "purchase", 1), "value_so_far": F.col("value")}
    df = T.prefix_state_range(df, "user_id", "eff", sums, {"n_recent": F.lit(1)})
    return df.select("user_id", F.col("snapshot").cast("long").alias("snapshot"), "n_events", "n_purchases", F.round("value_so_far", 4).alias("value_so_far"), "n_recent")


@query(f"SELECT user_id, event_id, ({TICK})::BIGINT AS tick, (max({TICK}) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS eff FROM events")
def effective_minute(spark, sf_dir):
    return T.effective_clock(table(spark, sf_dir, "events").withColumn("tick", tick()), "user_id", ["event_id"], "tick").select("user_id", "event_id", "tick", "eff")


@query("""SELECT user_id, count(*) AS moved FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS b FROM events) WHERE a != b GROUP BY user_id""")
def reorder_audit(spark, sf_dir):
    return T.reordered(table(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_type", "ts", "event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("moved"))


CUT = """WITH o AS (SELECT *, epoch_us(o_orderdate) AS us FROM orders), b AS (SELECT min(us) AS a, max(us) AS z FROM o), c AS (SELECT a + floor(0.7 * (z - a)) AS cut, z FROM b)"""
FEATURES = CUT + """, f AS (SELECT o_custkey, floor((max(c.cut) - max(us)) / 86400e6)::BIGINT AS recency, count(DISTINCT o_orderkey) AS frequency, round(sum(l_extendedprice), 2) AS monetary, count(DISTINCT l_partkey) AS unique_products, round(max(l_extendedprice), 2) AS max_line, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS std_line
FROM o, c, lineitem WHERE l_orderkey = o_orderkey AND us < c.cut GROUP BY o_custkey)"""
TARGETS = """, t AS (SELECT o_custkey, floor((max(c.z) - max(us)) / 86400e6)::BIGINT AS future_recency, count(*) AS future_frequency, sum(o_totalprice) AS spend FROM o, c WHERE us >= c.cut GROUP BY o_custkey)"""


def _window_split(spark, sf_dir):
    orders = T.cutoff_split(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    bounds = orders.agg(F.min("us").alias("a"), F.max("us").alias("z")).select((F.col("a") + F.floor(0.7 * (F.col("z") - F.col("a")))).alias("cut"), "z")
    return orders.crossJoin(F.broadcast(bounds))


def _features(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    joined = _window_split(spark, sf_dir).where("in_features").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey").agg(
        F.floor((F.max("cut") - F.max("us")) / 86400e6).alias("recency"), F.count_distinct("o_orderkey").alias("frequency"), F.round(F.sum("l_extendedprice"), 2).alias("monetary"),
        F.count_distinct("l_partkey").alias("unique_products"), F.round(F.max("l_extendedprice"), 2).alias("max_line"), F.round(F.coalesce(F.stddev_samp("l_extendedprice"), F.lit(0.0)), 4).alias("std_line"),
    )


def _targets(spark, sf_dir):
    return _window_split(spark, sf_dir).where("not in_features").groupBy("o_custkey").agg(F.floor((F.max("z") - F.max("us")) / 86400e6).alias("future_recency"), F.count(F.lit(1)).alias("future_frequency"), F.sum("o_totalprice").alias("spend"))


@query(FEATURES + " SELECT * FROM f")
def rfm_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query(CUT + TARGETS + " SELECT o_custkey, future_recency, future_frequency, round(spend, 2) AS future_monetary FROM t")
def rfm_target(spark, sf_dir):
    return _targets(spark, sf_dir).select("o_custkey", "future_recency", "future_frequency", F.round("spend", 2).alias("future_monetary"))


@query(FEATURES + TARGETS + " SELECT f.o_custkey, recency, frequency, t.o_custkey IS NULL AS is_churned, coalesce(future_frequency, 0) AS future_frequency, round(ln(1 + coalesce(spend, 0)), 6) AS log_future FROM f LEFT JOIN t USING (o_custkey)")
def rfm_churn_join(spark, sf_dir):
    joined = _features(spark, sf_dir).join(_targets(spark, sf_dir).withColumn("active", F.lit(True)), "o_custkey", "left")
    return joined.select("o_custkey", "recency", "frequency", F.col("active").isNull().alias("is_churned"), F.coalesce("future_frequency", F.lit(0)).alias("future_frequency"), F.round(F.log1p(F.coalesce("spend", F.lit(0.0))), 6).alias("log_future"))


@query(CUT + TARGETS + """, r AS (SELECT *, row_number() OVER (ORDER BY future_recency, o_custkey) AS a, row_number() OVER (ORDER BY future_frequency, o_custkey) AS b, row_number() OVER (ORDER BY spend, o_custkey) AS m, count(*) OVER () AS n FROM t),
k AS (SELECT o_custkey, CASE WHEN 3 * (a - 1) < n - 1 THEN 3 WHEN 3 * (a - 1) < 2 * (n - 1) THEN 2 ELSE 1 END + CASE WHEN 3 * (b - 1) < n - 1 THEN 1 WHEN 3 * (b - 1) < 2 * (n - 1) THEN 2 ELSE 3 END + CASE WHEN 3 * (m - 1) < n - 1 THEN 1 WHEN 3 * (m - 1) < 2 * (n - 1) THEN 2 ELSE 3 END AS score FROM r)
SELECT o_custkey, score::INT AS score, CASE WHEN score >= 8 THEN 'champion' WHEN score >= 6 THEN 'loyal' WHEN score >= 4 THEN 'at risk' ELSE 'lost' END AS segment FROM k""")
def rfm_segments(spark, sf_dir):
    t = _targets(spark, sf_dir)
    for value, name in (("future_recency", "r"), ("future_frequency", "f"), ("spend", "m")):
        t = T.tercile(t, value, "o_custkey", name)
    score = (4 - F.col("r")) + F.col("f") + F.col("m")
    return t.select("o_custkey", score.cast("int").alias("score"), F.when(score >= 8, "champion").when(score >= 6, "loyal").when(score >= 4, "at risk").otherwise("lost").alias("segment"))


@query("""SELECT o_custkey, d AS weekday FROM (SELECT o_custkey, (isodow(o_orderdate) - 1)::INT AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, isodow(o_orderdate)) AS r FROM orders GROUP BY 1, isodow(o_orderdate)) WHERE r = 1""")
def mode_weekday(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.mode(F.weekday("o_orderdate"), True).alias("weekday"))


@query("SELECT date_trunc('week', o_orderdate)::DATE AS week, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def week_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderkey, hour(o_orderdate)::INT AS h, (isodow(o_orderdate) - 1)::INT AS dow, month(o_orderdate)::INT AS mon, year(o_orderdate)::INT AS yr, isodow(o_orderdate) >= 6 AS weekend, hour(o_orderdate) BETWEEN 9 AND 17 AS business, round((epoch_us(min(l_shipdate)) - epoch_us(o_orderdate)) / 3.6e9, 4) AS hours_to_ship, round(date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / 365.25, 4) AS years_ago
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def duration_and_dateparts(spark, sf_dir):
    ships = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    d, us = F.col("o_orderdate"), lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return table(spark, sf_dir, "orders").join(ships, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", F.hour(d).alias("h"), F.weekday(d).alias("dow"), F.month(d).alias("mon"), F.year(d).alias("yr"), (F.weekday(d) >= 5).alias("weekend"), F.hour(d).between(9, 17).alias("business"),
        F.round((us("ship") - us("o_orderdate")) / 3.6e9, 4).alias("hours_to_ship"), F.round(F.datediff(F.lit("2002-01-01").cast("date"), F.to_date(d)) / 365.25, 4).alias("years_ago"),
    )


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS diff_total FROM orders""")
def home_away_selfjoin_diff(spark, sf_dir):
    numbered = T.ordinal(table(spark, sf_dir, "orders"), "o_custkey", ORDERED, "k")
    home = numbered.select(*[F.col(c).alias(f"home_{c}") for c in ("o_custkey", "o_orderkey", "o_totalprice", "k")])
    away = numbered.select(*[F.col(c).alias(f"away_{c}") for c in ("o_custkey", "o_totalprice", "k")])
    joined = home.join(away, (F.col("home_o_custkey") == F.col("away_o_custkey")) & (F.col("home_k") == F.col("away_k") + 1), "left")
    return joined.select(F.col("home_o_custkey").alias("o_custkey"), F.col("home_o_orderkey").alias("o_orderkey"), F.round(F.col("home_o_totalprice") - F.col("away_o_totalprice"), 2).alias("diff_total"))


@query("""WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT user_id, value AS frozen FROM p WHERE k = 1), g AS (SELECT user_id, unnest(range(0, 91, 5)) AS s FROM f)
SELECT user_id, round(max(frozen) - min(frozen), 9) AS spread, count(*) AS points FROM g JOIN f USING (user_id) GROUP BY user_id""")
def frozen_reference_flat(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    frozen = T.first_rows(events, "user_id", ["event_id"]).select("user_id", F.col("value").alias("frozen"))
    grid = T.snapshot_grid(frozen.select("user_id"), 0, 90, 5)
    return grid.join(frozen, "user_id").groupBy("user_id").agg(F.round(F.max("frozen") - F.min("frozen"), 9).alias("spread"), F.count(F.lit(1)).alias("points"))

