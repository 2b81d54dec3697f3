"""Operators over ordered rows. Every order ends in a unique key, and every window is partitioned by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.ordering import global_rank


def prior_mean(df: DataFrame, entity: str, order: list[str], measures: list[str], rows: int = 5) -> DataFrame:
    """Mean of each measure over the rows before, at most so many; null where there is none."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumns({f"form_{m}": F.avg(m).over(w) for m in measures})


def rest_days(df: DataFrame, entity: str, date: str, order: list[str]) -> DataFrame:
    return df.withColumn("rest_days", F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(entity).orderBy(*order))))


def ordinal(df: DataFrame, entity: str, order: list[str], name: str = "played_prior") -> DataFrame:
    """How many rows of the entity come before."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(entity).orderBy(*order)) - 1).cast("long"))


def effective_clock(df: DataFrame, entity: str, order: list[str], clock: str, name: str = "eff") -> DataFrame:
    """The running maximum of a clock, so that a late small reading can't move a row back in time."""
    return df.withColumn(name, F.max(clock).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def snapshot_grid(entities: DataFrame, start: int, stop: int, step: int, name: str = "snapshot") -> DataFrame:
    """Every entity at every grid point."""
    return entities.withColumn(name, F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))))


def prefix_state(events: DataFrame, entity: str, eff: str, sums: dict[str, Column], recent: dict[str, Column], grid: tuple[int, int, int] = (0, 90, 5), trailing: int = 10) -> DataFrame:
    """State of each entity at each grid point: sums over events up to it, and over the closed window of the last `trailing` ticks.

    No range join: events are summed per tick, ticks are made dense with the grid, and windows add them up, so the cost
    is one shuffle on the entity whatever the grid.
    """
    per_tick = events.groupBy(entity, eff).agg(*[F.sum(c).alias(k) for k, c in {**sums, **recent}.items()]).withColumn("at_grid", F.lit(False))
    points = snapshot_grid(events.select(entity).distinct(), *grid, name=eff).withColumn("at_grid", F.lit(True))
    dense = per_tick.unionByName(points, allowMissingColumns=True).groupBy(entity, eff).agg(F.max("at_grid").alias("at_grid"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in {**sums, **recent}])
    upto = Window.partitionBy(entity).orderBy(eff).rangeBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(entity).orderBy(eff).rangeBetween(-trailing, 0)
    dense = dense.withColumns({**{k: F.sum(k).over(upto) for k in sums}, **{k: F.sum(k).over(last) for k in recent}})
    return dense.where("at_grid").select(entity, F.col(eff).alias("snapshot"), *sums, *recent)


def prefix_state_range(events: DataFrame, entity: str, eff: str, sums: dict[str, Column], recent: dict[str, Column], grid: tuple[int, int, int] = (0, 90, 5), trailing: int = 10) -> DataFrame:
    """The same by a range join on the entity, for irregular grids."""
    points = snapshot_grid(events.select(entity).distinct(), *grid)
    joined = points.alias("g").join(events.alias("e"), (F.col(f"g.{entity}") == F.col(f"e.{entity}")) & (F.col(f"e.{eff}") <= F.col("g.snapshot")), "left")
    late = F.col(f"e.{eff}") >= F.col("g.snapshot") - trailing
    return joined.groupBy(F.col(f"g.{entity}").alias(entity), "snapshot").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()], *[F.coalesce(F.sum(F.when(late, c)), F.lit(0)).alias(k) for k, c in recent.items()])


def date_split(df: DataFrame, date: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Rows tagged train, validation or test by whole dates, in order; three dates are needed.

    The distinct dates are numbered within calendar years and the years' counts added up, so that no task holds more than a year of dates.
    """
    day = F.to_date(date)
    days = df.select(day.alias("day")).distinct()
    year = days.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("many"))
    before = year.alias("a").join(F.broadcast(year.alias("b")), F.col("b.year") <= F.col("a.year")).groupBy(F.col("a.year").alias("year")).agg(F.sum(F.when(F.col("b.year") < F.col("a.year"), F.col("b.many")).otherwise(0)).alias("before"))
    total = year.agg(F.sum("many").alias("n"))
    ranked = days.withColumn("year", F.year("day")).withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy("day"))).join(F.broadcast(before), "year").withColumn("rank", F.col("rank") + F.col("before")).crossJoin(F.broadcast(total))
    a, b = F.greatest(F.lit(1), F.floor(F.col("n") * train)), F.greatest(F.lit(1), F.floor(F.col("n") * validation))
    short = a + b >= F.col("n")
    a, b = F.when(short, F.col("n") - 2).otherwise(a), F.when(short, F.lit(1)).otherwise(b)
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "validation").otherwise("test")
    return df.join(ranked.select("day", split.alias("split")), day == F.col("day")).drop("day")


def reordered(df: DataFrame, entity: str, given: list, canonical: list) -> DataFrame:
    """Rows whose place changes from one order to the other."""
    w = Window.partitionBy(entity)
    places = df.withColumns({"place_given": F.row_number().over(w.orderBy(*given)), "place_canonical": F.row_number().over(w.orderBy(*canonical))})
    return places.where("place_given != place_canonical")


def tercile(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """1, 2 or 3 by rank of value (ties by key), with bounds at thirds of n - 1; 2 for all if fewer than three rows or distinct values."""
    stats = df.agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ranked = global_rank(df, [value, key], "_r").crossJoin(F.broadcast(stats))
    r, n = F.col("_r"), F.col("_n")
    return ranked.withColumn(name, F.when((n < 3) | (F.col("_lo") == F.col("_hi")), 2).when(3 * (r - 1) < n - 1, 1).when(3 * (r - 1) < 2 * (n - 1), 2).otherwise(3)).drop("_r", "_n", "_lo", "_hi")


def first_rows(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where("_rn = 1").drop("_rn")


def cutoff_split(df: DataFrame, time: str, share: float = 0.7) -> DataFrame:
    """Rows before and from min + share * (max - min), as column in_features. The bounds are one row."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    bounds = df.agg(F.min(micros).alias("_a"), F.max(micros).alias("_b"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("in_features", micros < F.col("_a") + F.floor(share * (F.col("_b") - F.col("_a")))).drop("_a", "_b")
