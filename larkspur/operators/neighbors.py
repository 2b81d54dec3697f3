"""The k nearest rows of each row, exactly, as an equi-join by cells around pivots.

Rows with equal vectors are one point from here on, with its k + 1 smallest keys, so copies of any number cost one point. Points go to
the cell of their nearest pivot; each cell's radius, and its points' least distances to the pivot, are a small table. For a query,
these bound the distance of its k-th neighbour from above (by the triangle inequality), and only cells that can hold a point
within that bound are asked. Cells are cut in chunks of CHUNK points, queries of one chunk in parts, and a chunk's answer is k + 1 keys, so
neither a cell nor a query is bounded by one task. Where vectors have many dimensions, bounds help little and most cells are asked:
the work is then that of all pairs, still spread over chunks.

Vectors must have equal lengths and no nulls; distances are squared, rounded to nine places, and equal ones go by key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators.ordering import saved

#: Pivots, points of a chunk, queries of a part, and groups (classes), at most: pivots and cells' bounds are collected and broadcast.
PIVOTS, CHUNK, PART, MOST_GROUPS = 64, 4096, 20_000, 200


def vectors_of(column) -> np.ndarray:
    return np.array(column.tolist(), float)


def firsts(rows: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """Of each `by`, the smallest values, at most `most`: first in each batch, then over what is left."""

    def run(parts):
        for pdf in parts:
            names = [pdf[b].map(tuple) if len(pdf) and isinstance(pdf[b].iloc[0], (list, np.ndarray)) else pdf[b] for b in by]
            at = pdf.sort_values(value).groupby([n.loc[pdf.index] for n in names], sort=False, dropna=False).head(most) if len(pdf) else pdf
            yield at

    some = rows.select(*by, value).mapInPandas(run, rows.select(*by, value).schema)
    order = Window.partitionBy(*by).orderBy(value)
    return some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1] if len(a) else 0):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, group: str | None = None, pivots: int = PIVOTS) -> DataFrame:
    """query, key, d, rank: for each row of queries the k nearest rows of base (of the same group, if there is one; nulls are a group), but not the row with its own key."""
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    own = base.select(g.alias("g"), F.col(vector).alias("v"), F.col(key).alias("key"))
    asked = queries.select(g.alias("g"), F.col(vector).alias("v"), F.col(key).alias("query"))
    points = saved(firsts(own, ["g", "v"], "key", k + 1).groupBy("g", "v").agg(F.sort_array(F.collect_list("key")).alias("keys")))  # k + 1 keys at most
    some = points.select("v").orderBy(S.draw(5, "pivot", F.col("v")), "v").limit(pivots).collect()
    kind = dict(own.dtypes)["key"]
    if not some:
        return base.sparkSession.createDataFrame([], f"query {kind}, key {kind}, d double, rank int")
    centre = np.unique(vectors_of(np.array([r["v"] for r in some] + [None], object)[:-1]), axis=0)

    def placed(parts):
        for pdf in parts:
            if len(pdf):
                d = distances(vectors_of(pdf["v"]), centre)
                pdf["cell"] = d.argmin(1).astype("int32")
                pdf["r"] = np.sqrt(d.min(1))
                yield pdf

    cells = saved(points.mapInPandas(placed, f"g string, v array<double>, keys array<{kind}>, cell int, r double"))
    near = firsts(cells.select("g", "cell", "r"), ["g", "cell"], "r", k + 1).groupBy("g", "cell").agg(F.sort_array(F.collect_list("r")).alias("near"))
    stats = cells.groupBy("g", "cell").agg(F.max("r").alias("radius"), F.count(F.lit(1)).alias("n")).join(near, ["g", "cell"]).limit(pivots * MOST_GROUPS + 1).collect()
    if len(stats) > pivots * MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups")
    table: dict[str, list] = {}
    for r in stats:
        table.setdefault(r["g"], []).append((r["cell"], r["radius"], r["near"], -(-r["n"] // CHUNK)))

    def sent(parts):
        """Each query to the chunks of every cell that may hold one of its k nearest (k + 1, as it may find itself)."""
        import pandas as pd

        for pdf in parts:
            out = []
            for name, rows in pdf.groupby("g"):
                known = table.get(name)
                if known is None:
                    continue
                d = np.sqrt(distances(vectors_of(rows["v"]), centre[[c[0] for c in known]]))
                upper = np.concatenate([d[:, [j]] + np.array(c[2])[None] for j, c in enumerate(known)], 1)
                bound = np.sort(upper, 1)[:, min(k, upper.shape[1] - 1)] if upper.shape[1] > k else np.full(len(rows), np.inf)
                reach = d - np.array([c[1] for c in known])[None] <= bound[:, None] * (1 + 1e-9) + 1e-4
                for j, c in enumerate(known):
                    hit = rows[reach[:, j]]
                    for chunk in range(c[3]):
                        out.append(pd.DataFrame({"qid": hit["qid"], "g": name, "v": hit["v"], "cell": c[0], "chunk": chunk}))
            if out:
                yield pd.concat(out)

    # one query for each different vector; the id is fixed by the checkpoint
    different = saved(asked.select("g", "v").distinct().withColumn("qid", F.monotonically_increasing_id()))
    questions = saved(different.mapInPandas(sent, "qid long, g string, v array<double>, cell int, chunk int"))
    sizes = questions.groupBy("g", "cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    chunks = F.create_map(*[x for c in {(r["g"], r["cell"], -(-r["n"] // CHUNK)) for r in stats} for x in (F.concat_ws(":", F.lit(c[0]), F.lit(c[1])), F.lit(int(c[2])))]) if any(r["n"] > CHUNK for r in stats) else None
    many = chunks[F.concat_ws(":", "g", "cell")] if chunks is not None else F.lit(1)
    held = cells.withColumn("chunk", F.pmod(F.xxhash64("v"), many).cast("int")).join(sizes, ["g", "cell", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    posed = questions.join(sizes, ["g", "cell", "chunk"]).withColumn("part", F.pmod(F.xxhash64("qid"), "parts").cast("int"))
    columns = ["g", "cell", "chunk", "part", "role", "qid", "v", "keys"]
    rows = held.select("g", "cell", "chunk", "part", F.lit(0).alias("role"), F.lit(None).cast("long").alias("qid"), "v", "keys").unionByName(posed.select("g", "cell", "chunk", "part", F.lit(1).alias("role"), "qid", "v", F.lit(None).cast(f"array<{kind}>").alias("keys")))
    rows = rows.select(*columns).repartition("g", "cell", "chunk", "part").sortWithinPartitions("g", "cell", "chunk", "part", "role")

    def answered(parts):
        import pandas as pd

        at, held_v, held_keys, x = None, [], [], None
        for pdf in parts:
            for (name, role), rows in pdf.groupby([pdf["g"] + ":" + pdf["cell"].astype(str) + ":" + pdf["chunk"].astype(str) + ":" + pdf["part"].astype(str), "role"], sort=False):
                if name != at:
                    at, held_v, held_keys, x = name, [], [], None
                if role == 0:
                    held_v += rows["v"].tolist()
                    held_keys += [list(y) for y in rows["keys"]]
                    continue
                if not held_v:
                    continue
                if x is None:
                    x, least = np.array(held_v, float), np.array([y[0] for y in held_keys])
                found = []
                for a in range(0, len(rows), 256):
                    some = rows.iloc[a : a + 256]
                    d = np.round(distances(vectors_of(some["v"]), x), 9)
                    for q, line in zip(some["qid"], d):
                        close = np.flatnonzero(line <= np.partition(line, min(k, len(line) - 1))[min(k, len(line) - 1)])
                        best = close[np.lexsort((least[close], line[close]))][: k + 1]
                        pairs = sorted((line[j], y) for j in best for y in held_keys[j])[: k + 1]
                        found += [(q, y, z) for z, y in pairs]
                yield pd.DataFrame(found, columns=["qid", "key", "d"])

    got = rows.mapInPandas(answered, f"qid long, key {kind}, d double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("d", "key"))
    best = got.withColumn("_r", place).where(F.col("_r") <= k + 1).drop("_r")
    named = asked.join(different, (asked["v"] == different["v"]) & (asked["g"] == different["g"])).select("query", "qid")
    out = named.join(best, "qid").where("key <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "key"))
    return out.select("query", "key", "d").withColumn("rank", rank).where(F.col("rank") <= k)


def smote_scaled(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """label, new_id (from 1 in each class), base, other, vector: as many synthetic rows of each class as it has fewer than the largest.

    Neighbours are sought among the class, with each dimension divided by its deviation over all rows (0 counts as 1); a new row lies between a
    drawn row and one of its k nearest, in the vectors' own units. A class of one row is repeated (other is null).
    """
    from larkspur.operators.ordering import running_within

    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v")).where("label IS NOT NULL")
    first = rows.first()
    width = len(first["v"]) if first else 0
    spread = rows.agg(F.array(*[F.when(F.stddev_pop(F.col("v")[i]) > 0, F.stddev_pop(F.col("v")[i])).otherwise(1.0) for i in range(width)]).alias("sd") if width else F.array().cast("array<double>").alias("sd"))
    scaled = rows.crossJoin(F.broadcast(spread)).select("key", "label", "v", F.zip_with("v", "sd", lambda x, s: x / s).alias("z"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    short = saved(sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).where("n < most").withColumn("need", F.col("most") - F.col("n")))
    own = saved(scaled.join(F.broadcast(short.select("label")), "label"))  # classes: MOST_GROUPS at most, see nearest
    near = nearest(own, own, "key", "z", k, "label").select(F.col("query").alias("base"), F.col("key").alias("other"), "rank")
    near = saved(near)
    numbered = running_within(own.select("key", "label", "v"), ["label"], ["key"], {"_k": F.lit(1)})
    block = 10_000
    new = short.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - 1) / block)))).withColumn("new_id", F.explode(F.sequence(F.col("b") * block + 1, F.least(F.col("need"), (F.col("b") + 1) * block))))
    draw = lambda purpose: S.unit(seed, purpose, F.col("label"), F.col("new_id"))
    new = new.select("label", "new_id", "n", (F.floor(draw("base") * F.col("n")) + 1).alias("_k"), (F.floor(draw("near") * F.least(F.lit(k), F.col("n") - 1)) + 1).cast("int").alias("rank"))
    out = new.join(numbered.select("label", "_k", F.col("key").alias("base"), "v"), ["label", "_k"]).join(near, ["base", "rank"], "left")
    out = out.join(own.select(F.col("key").alias("other"), F.col("v").alias("w")), "other", "left")
    step = draw("step")
    moved = F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda x, y: x + step * (y - x)))
    return out.select("label", "new_id", "base", "other", moved.alias("vector"))
