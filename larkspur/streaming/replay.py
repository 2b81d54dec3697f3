"""Batch state as streams: sums over tumbling, sliding and session windows with late rows, joins with tables at rest, and each entity's running state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import shared_folder


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum for each tumbling window and key; rows later than `late` are left out, which bounds the state."""
    w = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def running(events: DataFrame, entity: str, clock: str, value: str) -> DataFrame:
    """After each batch, each entity's count, sum and effective clock (its highest so far)."""

    def update(key: tuple, parts: Iterator, state) -> Iterator:
        import pandas as pd

        n, total, high = state.get if state.exists else (0, 0.0, -(1 << 62))
        for rows in parts:
            n, total, high = n + len(rows), total + float(rows[value].sum()), max(high, int(rows[clock].max()))
        state.update((n, total, high))
        yield pd.DataFrame({entity: [key[0]], "n": [n], "total": [total], "eff": [high]})

    kind = dict(events.dtypes)[entity]
    return events.groupBy(entity).applyInPandasWithState(update, f"{entity} {kind}, n long, total double, eff long", "n long, total double, eff long", "update", "NoTimeout")


def sliding(events: DataFrame, time: str, keys: list[str], value: str, width: str = "6 hours", slide: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Count and sum for each window of the given width that begins every `slide`, and key: a row counts in every window that covers it."""
    w = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width, slide), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], value: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and sum for each session of a key: rows that follow one another by less than `gap`. The state holds open sessions only."""
    w = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total")


def enriched(events: DataFrame, table: DataFrame, key: str, table_key: str, columns: list[str]) -> DataFrame:
    """events with columns of a table at rest (null where it has no such key). The table is read anew with each batch; its key must be unique there."""
    side = table.select(F.col(table_key).alias("_key"), *columns)
    return events.join(side, F.col(key) == F.col("_key"), "left").drop("_key")


def finished(build: Callable[[DataFrame], DataFrame], events: DataFrame, time: str, parts: int = 2, after: str = "1000 days") -> DataFrame:
    """What a stream that appends has written once all events went through it, in the order of time and in so many steps, and time went on.

    Events are put into the shared folder a part at a time; after each, the stream is started, takes what is new, and stops: its state goes
    on from its checkpoint. A last row, null but for a time far behind, moves the watermark past every window; what is null in all
    of its keys is left out of the result by the caller.
    """
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    place = F.col(time).cast("timestamp").cast("double")
    bounds = events.agg(F.percentile_approx(place, [k / parts for k in range(1, parts)] or [0.5], 1000).alias("b"), F.max(time).alias("last")).first()
    edges = [None, *(bounds["b"] or [])[: parts - 1], None]

    def run() -> None:
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/source")
        q = build(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/sink").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for low, high in zip(edges, edges[1:]):
        part = events.where(F.lit(True) if low is None else place > low).where(F.lit(True) if high is None else place <= high)
        part.write.mode("append").parquet(f"{folder}/source")
        run()
    if bounds["last"] is not None:
        end = [F.expr(f"CAST(NULL AS {kind})").alias(c) if c != time else F.lit(bounds["last"]).cast(kind).alias(c) for c, kind in events.dtypes]
        spark.range(1).select(*end).withColumn(time, F.expr(f"CAST({time} + INTERVAL {after} AS {dict(events.dtypes)[time]})")).write.mode("append").parquet(f"{folder}/source")
        run()
    return spark.read.schema(build(spark.readStream.schema(events.schema).parquet(f"{folder}/source")).schema).parquet(f"{folder}/sink")
