"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source size times. The whole part is certain; the rest
is a copy probability. Pairs of fractional documents pass words from one to the other, up or down by
chance so that each probability keeps its mean, until one of the two is integral. What a source takes in
words stays the same at each such step. Large documents go first, so that the last fractional document of a
source tends to be a small one; it is rounded to the nearer whole number, so that the source misses its
target by half of that document at most.

Documents are dealt by source and a hash of their id into groups of about GROUP rows (so a source of any
size is spread over many tasks); each group leaves one fractional document at most, and these residuals
meet FAN at a time in the next level of a reduction tree, until each source has one.

Randomness comes from the seed, the source, the level and the group, over rows in a fixed order: reruns
agree. Results for odd rows: a null source is a source (the last); documents without a word have size 0
and take nothing; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import fresh, saved, slim

WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST_COPIES = 3
GROUP, FAN = 4096, 64
#: The driver holds one row for each source: their weights are a setting, so there are not many.
MOST_SOURCES = 1_000_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words to take from each source. Weights go round over the sources by code point, null last; what a stopped source leaves is shared again."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def pivot(sizes: list[int], parts: list[float], draw) -> tuple[list[float], int | None]:
    """Copy probabilities after pairing each fractional document with the one still open; and which is left open, if any."""
    parts, held = list(parts), None
    for j, p in enumerate(parts):
        if not 0 < p < 1 or not sizes[j]:
            continue
        if held is None:
            held = j
            continue
        i, si, sj = held, sizes[held], sizes[j]
        up, down = min((1 - parts[i]) * si, p * sj), min(parts[i] * si, (1 - p) * sj)
        if draw() * (up + down) < down:
            full = (1 - parts[i]) * si <= p * sj
            parts[i], parts[j] = (1.0 if full else parts[i] + up / si), (p - up / sj if full else 0.0)
        else:
            full = parts[i] * si <= (1 - p) * sj
            parts[i], parts[j] = (0.0 if full else parts[i] - down / si), (p + down / sj if full else 1.0)
        for k in (i, j):
            if parts[k] < 1e-12 or parts[k] > 1 - 1e-12:
                parts[k] = float(round(parts[k]))
        held = next((k for k in (i, j) if 0 < parts[k] < 1), None)
    return parts, held


def level(df: DataFrame, number: int, seed: int, last: bool) -> DataFrame:
    """One level of the reduction tree: each (source, group) keeps one open row at most; at the last, none."""
    schema = df.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(["_size", "_hash", "_key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source = rows["_source"].iloc[0]
        rng = np.random.default_rng([seed, number, zlib.crc32(repr(None if pd.isna(source) else source).encode()), int(rows["_group"].iloc[0])])
        parts, held = pivot(rows["_size"].tolist(), rows["_part"].tolist(), rng.random)
        if last and held is not None:
            parts[held], held = float(round(parts[held])), None
        rows["_part"] = parts
        rows["_open"] = [k == held for k in range(len(rows))]
        return rows

    return df.groupBy("_source", "_group").applyInPandas(run, schema)


def copies(docs: DataFrame, key: Column, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """One row per document: _id, _key, _size, _source, _source_size, _target, _copies."""
    sized = docs.select(F.col("`doc_id`").alias("_id"), F.col("`source`").alias("_source"), key.alias("_key"), size_of(F.col("`text`")).alias("_size"))
    sized = saved(sized)  # a few numbers for each document; the texts are read once
    stats = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count(F.lit(1)).alias("_rows"))
    got = stats.limit(MOST_SOURCES + 1).collect()
    if len(got) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: group them before mixing")
    goal = targets({r["_source"]: r["_source_size"] for r in got}, weights)
    groups = {r["_source"]: max(1, math.ceil(r["_rows"] / GROUP)) for r in got}
    plan = docs.sparkSession.createDataFrame(
        [(r["_source"], r["_source_size"], goal[r["_source"]], goal[r["_source"]] / r["_source_size"] if r["_source_size"] else 0.0, groups[r["_source"]]) for r in got],
        "_s string, _source_size long, _target double, _each double, _groups int",
    )
    if len(got) <= 10_000:
        plan = F.broadcast(plan)
    rest = F.col("_each") - F.floor("_each")
    df = sized.join(plan, sized["_source"].eqNullSafe(plan["_s"])).select(
        "_id", "_key", "_size", "_source", "_source_size", "_target", F.floor("_each").cast("long").alias("_whole"),
        F.when(F.col("_size") > 0, rest).otherwise(0.0).alias("_part"), F.lit(False).alias("_open"),
        F.xxhash64("_key", F.lit(seed)).alias("_hash"),
        F.pmod(F.xxhash64(F.lit(seed), "_key", F.lit(1)), F.col("_groups")).cast("long").alias("_group"),
    )
    most, number, done = max(groups.values(), default=1), 0, None
    while True:
        last = most == 1
        df = level(df, number, seed, last)
        if last:
            done = df if done is None else done.unionByName(df)
            return done.select("_id", "_key", "_size", "_source", "_source_size", "_target", (F.col("_whole") + F.col("_part").cast("long")).alias("_copies"))
        df = saved(df)
        closed = df.where(~F.col("_open"))
        done = closed if done is None else done.unionByName(closed)
        df = df.where(F.col("_open")).withColumn("_group", F.floor(F.col("_group") / FAN).cast("long"))
        most, number = math.ceil(most / FAN), number + 1


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    slimmed = slim(docs, "doc_id", "text", "source")
    got = copies(slimmed, F.xxhash64("doc_id", "source"), weights, seed)
    return got.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def sample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts move once: rows and copies meet by a hash of all columns, so that only
    rows which are equal throughout can stand for each other."""
    key, nth, taken, one = fresh(docs, "mix_key", "mix_nth", "mix_copies", "mix_one")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    got = copies(docs, hashed, weights, seed)
    per_key = got.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_list(F.col("_copies").cast("int"))).alias(taken))
    from pyspark.sql import Window

    numbered = docs.withColumn(key, hashed).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return numbered.join(per_key, key).withColumn(one, F.explode(F.array_repeat(F.lit(1), F.get(F.col(taken), F.col(nth) - 1)))).select(*[F.col(f"`{c}`") for c in docs.columns])
