"""Queries that replay events through Structured Streaming; the finished stream gives what the batch SQL gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.plans.registry import query, table
from larkspur.streaming import replay


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def _shown(df, times=("start",)):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s WHERE user_id IS NOT NULL GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Sessions of a user, six hours apart at least."""
    out = replay.finished(lambda e: replay.sessions(e, "ts", ["user_id"], "value", "6 hours"), _events(spark, sf_dir), "ts")
    return _shown(out.where("user_id IS NOT NULL"), ("start", "end"))


@query("""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(k) FOR k IN [0, 8, 16]]) AS start FROM events WHERE event_type IS NOT NULL) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Days that begin every eight hours, by type."""
    out = replay.finished(lambda e: replay.sliding(e, "ts", ["event_type"], "value", "24 hours", "8 hours"), _events(spark, sf_dir), "ts")
    return _shown(out.where("event_type IS NOT NULL"))


@query("""SELECT date_trunc('day', ts) AS start, coalesce(c_mktsegment, 'none') AS segment, count(*) AS n, round(sum(value), 4) AS total FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1, 2""")
def stream_enriched(spark, sf_dir):
    """Daily sums by the segment of the event's user, looked up in a table at rest."""
    customers = table(spark, sf_dir, "customer")

    def build(e):
        joined = replay.enriched(e, customers, "user_id", "c_custkey", ["c_mktsegment"])
        # (the closing row has no type, so it gets a segment of its own)
        segment = F.when(F.col("event_type").isNull(), "closing").otherwise(F.coalesce("c_mktsegment", F.lit("none")))
        return replay.windowed(joined.withColumn("segment", segment), "ts", ["segment"], "value", "1 day")

    return _shown(replay.finished(build, _events(spark, sf_dir), "ts").where("segment <> 'closing'"))
