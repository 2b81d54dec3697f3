"""Joins, audits, groupings and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scalars as S


class ContractError(ValueError):
    """Data or columns that an operator needs are not as it needs them."""


def require_columns(df: DataFrame, columns: set[str]) -> DataFrame:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def expect_empty(violations: DataFrame, message: str) -> None:
    """Raise if there is a row; it is the only thing that is read."""
    if violations.take(1):
        raise ContractError(message)


def expect_rows(df: DataFrame, message: str) -> DataFrame:
    """df; raise if it has no row (a window without data would make features of nothing)."""
    if not df.take(1):
        raise ContractError(message)
    return df


def violations_of_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("many")).where("many > 1")


def validated_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides are first held to the promised uniqueness of the key."""
    if validate in ("one_to_one", "many_to_one"):
        expect_empty(violations_of_key(right, key), f"the right side repeats {key}")
    if validate in ("one_to_one", "one_to_many"):
        expect_empty(violations_of_key(left, key), f"the left side repeats {key}")
    return left.join(right, key, how)


def long_format(df: DataFrame, ids: list[str], sides: dict[str, dict[str, str]]) -> DataFrame:
    """One row per side: sides maps a side's name to {new column: its column}. One pass, no union."""
    structs = [F.struct(F.lit(side).alias("side"), *[F.col(c).alias(new) for new, c in columns.items()]) for side, columns in sides.items()]
    return df.select(*ids, F.explode(F.array(*structs)).alias("_s")).select(*ids, "_s.*")


def drop_with_log(df: DataFrame, source: str, key: Column, record: Column, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and the log of the others: source, key, record_id, reason (the first that holds)."""
    reason = F.coalesce(*[F.when(fault, F.lit(name)) for name, fault in reasons.items()])
    tagged = df.withColumn("_reason", reason)
    return tagged.where("_reason IS NULL").drop("_reason"), tagged.where("_reason IS NOT NULL").select(F.lit(source).alias("source"), key.alias("key"), record.cast("string").alias("record_id"), F.col("_reason").alias("reason"))


def canonical_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """Per key the most frequent folded name (ties: the first by name), how often it was seen, and how many variants there are."""
    counted = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).groupBy(key, S.folded(F.col(name)).alias("name")).agg(F.count(F.lit(1)).alias("observations"))
    w = Window.partitionBy(key)
    ranked = counted.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("observations"), "name")), "variants": F.count(F.lit(1)).over(w)})
    return ranked.where("_r = 1").select(key, F.col("name").alias("canonical_name"), "observations", "variants")


def top_or_other(df: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """column with all but the n most frequent values replaced."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(F.col(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(column, F.when(F.col(column).isNull() | F.col("_top").isNotNull(), F.col(column)).otherwise(other)).drop("_top")


def shares(df: DataFrame, group: str, value: str, values: list[str]) -> DataFrame:
    """Per group the share of each value, as columns."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(value) == v).alias(v) for v in values])
    return counts.select(group, *[(F.col(v) / F.col("_n")).alias(v) for v in values])


def de_vig(df: DataFrame, odds: list[str], names: list[str]) -> DataFrame:
    """Odds as probabilities without the bookmaker's margin; null if one of them is."""
    inverse = [1 / F.col(o) for o in odds]
    total = sum(inverse[1:], inverse[0])
    return df.withColumns({**{n: i / total for n, i in zip(names, inverse)}, "overround": total})


def resolve_names(source: DataFrame, target: DataFrame, group: str | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """For each source name: its target and the method (override, exact, fuzzy). Names are compared within a group, or else within
    their first letter, so that it is an equi join; names that no target shares a letter with have no match."""
    overrides = overrides or {}
    a = source.select(F.col("name").alias("source_name"), S.normalised_name(F.col("name")).alias("s"), *([group] if group else []))
    b = target.select(F.col("name").alias("target_name"), S.normalised_name(F.col("name")).alias("t"), *([group] if group else []))
    on = [group] if group else ["_letter"]
    if not group:
        a, b = a.withColumn("_letter", F.substring("s", 1, 1)), b.withColumn("_letter", F.substring("t", 1, 1))
    pairs = a.join(b, on).withColumn("sim", S.token_similarity(F.col("s"), F.col("t"))).withColumn("full", F.levenshtein("s", "t"))
    fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])[F.col("source_name")] if overrides else F.lit(None).cast("string")
    best = F.min_by(F.struct("target_name", (F.col("s") == F.col("t")).alias("exact")), F.struct((F.col("s") != F.col("t")).alias("x"), (-F.col("sim.share")).alias("y"), F.col("sim.distance").alias("d"), F.col("full").alias("f"), "target_name"))
    out = pairs.groupBy("source_name", *([group] if group else [])).agg(best.alias("_b"))
    return out.select("source_name", *([group] if group else []), F.coalesce(fixed, F.col("_b.target_name")).alias("target_name"), F.when(fixed.isNotNull(), "override").when(F.col("_b.exact"), "exact").otherwise("fuzzy").alias("method"))


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in this order (nulls first). An aggregate, so that a key with very many rows is folded before the shuffle."""
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def flatten(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    """One row for each struct of an array; rows with an empty or null array stay, with nulls."""
    return df.select(*keep, F.explode_outer(array).alias("_x")).select(*keep, "_x.*")


def ordered_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of this order that df has."""
    return df.select([c for c in order if c in df.columns])


def rename_any(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns])


#: Rows of a group on either side of a tile of pairs, about; keys of a value that meet the other side at once, at most; pairs that a task makes, about; tasks, at most.
TILE_ROWS, TILE_KEYS, TASK_PAIRS, MOST_TASKS = 1024, 32, 4_000_000, 10_000


def tiled_pairs(df: DataFrame, group: list[str], key: str, value: str, measure: Callable[[Column, Column], Column], other: str, name: str) -> DataFrame:
    """key, other, name: every two rows of a group, the lower key first, with a measure of their values that is the same both ways.

    A group's rows are dealt into chunks by a hash of their keys, and every two chunks meet in a tile, so a group of any size is
    spread over tasks that each hold a few thousand rows. In a tile the measure is taken once for a value's TILE_KEYS keys and each
    other value, and keys are paired last; the left side comes by values, as Spark holds all rows that one row of a join becomes.
    """
    df = df.select(*group, key, value).dropna(subset=[*group, key])
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
    tasks = int(min(MOST_TASKS, pairs // TASK_PAIRS + 1))
    dealt = df.join(sizes.select(*group, F.ceil(F.col("_n") / TILE_ROWS).cast("int").alias("_chunks")), group)
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64(key), F.col("_chunks")).cast("int"))
    values = dealt.groupBy(*group, "_chunks", "_chunk", value).agg(F.collect_list(key).alias("keys"))
    parts = F.transform(F.sequence(F.lit(1), F.size("keys"), F.lit(TILE_KEYS)), lambda at: F.slice("keys", at, TILE_KEYS))
    chunks = values.groupBy(*group, "_chunks", "_chunk").agg(F.collect_list(F.struct(F.col(value).alias("value"), "keys")).alias("_rows"))
    tile = [*group, "_low", "_high"]
    left = values.select(*group, "_chunks", F.col("_chunk").alias("_low"), F.col(value).alias("_value"), F.explode(parts).alias("_xs"))
    left = left.select(*group, "_low", "_value", "_xs", F.explode(F.sequence("_low", F.col("_chunks") - 1)).alias("_high"))
    right = chunks.select(*group, F.col("_chunk").alias("_high"), "_rows", F.explode(F.sequence(F.lit(0), "_chunk")).alias("_low"))
    tiles = left.repartition(tasks, *tile).join(right.repartition(tasks, *tile).hint("merge"), tile)
    met = tiles.select((F.col("_low") == F.col("_high")).alias("_same"), "_value", "_xs", F.explode("_rows").alias("_y"))
    met = met.select("_same", "_xs", F.col("_y.keys").alias("_ys"), measure(F.col("_value"), F.col("_y.value")).alias(name))
    met = met.select("_same", "_ys", name, F.explode("_xs").alias("_x")).select("_same", "_x", name, F.explode("_ys").alias("_y"))
    met = met.where(~F.col("_same") | (F.col("_x") < F.col("_y")))  # two chunks meet once, a chunk meets itself both ways
    return met.select(F.least("_x", "_y").alias(key), F.greatest("_x", "_y").alias(other), name)
