"""Decision trees that grow by level: one scan of the rows for all nodes of a level.

A row's node is found by following the splits so far. For the open nodes of a level, rows are folded to (node, feature,
value) with their sums: rows and one sum for each class, or rows, y and y squared. The folded values are summed up in order within
node and feature by ranges of the order (`ordering.running_within`), so neither a node nor a feature has to fit one task. Each
value then gives the thresholds that lie between it and the next one: the midpoint, or, in a node with over FEW different values
of the feature, those of its percentiles that fall there. What comes back to the driver is the best split of each node with
the sums of its left side; those of the right one are what is left of the node's.

A null has no value to compare, so it goes to the right, in growth and in `leaf` alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import running_within, saved

#: Values of a feature in a node up to which all midpoints are tried; beyond that, percentiles are, these many from the FIRST to the LAST.
FEW, TRIED, FIRST, LAST = 20, 15, 5, 95
#: Classes and nodes of a tree, at most: a tree is broadcast as one small table.
MOST_CLASSES, MOST_NODES = 200, 1 << 16


@dataclass
class Tree:
    """Nodes by number: node k has the children 2k and 2k + 1. splits: feature (its place) and threshold; leaves: the sums of rows and of each class (or of y and y squared); empty for a tree of no rows."""

    features: list[str]
    classes: list | None
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, list[float]] = field(default_factory=dict)

    def value(self, node: int):
        """The mean of y, or the label that most rows of the leaf have (the first among equals)."""
        n, *sums = self.leaves[node]
        if self.classes is None:
            return sums[0] / n
        return self.classes[max(range(len(sums)), key=lambda k: (sums[k], -k))]

    def shares(self, node: int) -> list[float]:
        n, *sums = self.leaves[node]
        return [s / n for s in sums]


def labels(df: DataFrame, y: str) -> list:
    got = [r[0] for r in df.where(F.col(y).isNotNull()).select(y).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(got) > MOST_CLASSES:
        raise ValueError(f"{y} has over {MOST_CLASSES} classes")
    return sorted(got)


def at_node(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows (with _x, the features, and _node) one level further down: rows of a split node go to its children."""
    if not tree.splits:
        return rows
    table = [(node, f, t) for node, (f, t) in tree.splits.items()]
    steps = rows.sparkSession.createDataFrame(table, "_at long, _feature int, _threshold double")  # MOST_NODES rows at most
    out = rows.join(F.broadcast(steps), F.col("_node") == F.col("_at"), "left")
    left = F.coalesce(F.get("_x", F.col("_feature")) <= F.col("_threshold"), F.lit(False))
    return out.withColumn("_node", F.when(F.col("_at").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + F.when(left, 0).otherwise(1))).drop("_at", "_feature", "_threshold")


def impurity(kind: str, sums: list[str], n: str) -> str:
    """Of a side with n rows: Gini's (sums: rows of each class) or the variance (sums: y, y squared), as SQL."""
    part = lambda s: f"coalesce(try_divide({s}, {n}), 0D)"
    if kind == "variance":
        return f"({part(sums[1])} - {part(sums[0])} * {part(sums[0])})"
    return "(1D - " + " - ".join(f"{part(s)} * {part(s)}" for s in sums) + ")"


def hellinger(left: list[str], total: list[str]) -> str:
    """How far a split moves two classes apart, as SQL."""
    root = lambda a, b: f"sqrt(coalesce(try_divide({a}, {b}), 0D))"
    one = f"power({root(left[1], total[1])} - {root(left[0], total[0])}, 2)"
    other = f"power({root(f'({total[1]} - {left[1]})', total[1])} - {root(f'({total[0]} - {left[0]})', total[0])}, 2)"
    return f"({one} + {other})"


def best_splits(rows: DataFrame, sums: list[str], kind: str, least_leaf: int, tried: int) -> DataFrame:
    """_node, feature, threshold, score, left (the left side's sums): the best split of each node. rows: _node, _x, _n (1) and the sums of one row."""
    totals = ["_n", *sums]
    per = rows.select("_node", *totals, F.posexplode("_x").alias("feature", "v"))
    folded = saved(per.groupBy("_node", "feature", "v").agg(*[F.sum(c).alias(c) for c in totals]))
    # the totals of a node count rows without a value, too: they are on the right
    whole = folded.where("feature = 0").groupBy("_node").agg(*[F.sum(c).alias(f"{c}_t") for c in totals])
    values = folded.where("v IS NOT NULL AND NOT isnan(v)")
    upto = running_within(values, ["_node", "feature"], ["v"], {f"{c}_l": F.col(c) for c in totals} | {"_place": F.lit(1)})
    upto = saved(upto.select("_node", "feature", "v", "_n", *[f"{c}_l" for c in totals], "_place"))
    after = upto.select("_node", "feature", (F.col("_place") - 1).alias("_place"), F.col("v").alias("after"))
    ends = upto.groupBy("_node", "feature").agg(F.max("_place").alias("many"), F.max("_n_l").alias("known"))
    steps = upto.join(after, ["_node", "feature", "_place"]).join(ends, ["_node", "feature"]).join(whole, "_node")
    # a wanted place lies between two neighbours: both are v, or the second one is the value after v
    # (in whole numbers: a place is a fraction of `whole`)
    whole = 100 * max(1, tried - 1)
    place = f"({FIRST * max(1, tried - 1)} + {LAST - FIRST} * k) * bigint(known - 1)"
    second = f"CASE WHEN {place} div {whole} + 1 < _n_l THEN v ELSE after END"
    percentile = f"CASE WHEN {place} div {whole} >= _n_l - _n AND {place} div {whole} < _n_l THEN v + ({second} - v) * (({place}) % {whole} / {whole}D) END"
    middle = "array(v + (after - v) / 2)"
    thresholds = f"CASE WHEN many > {FEW} THEN array_compact(transform(sequence(0, {tried - 1}), k -> {percentile})) ELSE {middle} END" if tried else middle
    found = steps.withColumn("threshold", F.explode(F.expr(thresholds))).where(f"_n_l >= {least_leaf} AND _n_t - _n_l >= {least_leaf}")
    left, total, right = [f"{c}_l" for c in sums], [f"{c}_t" for c in sums], [f"({c}_t - {c}_l)" for c in sums]
    if kind == "hellinger":
        score = hellinger(left, total)
    else:
        score = f"{impurity(kind, total, '_n_t')} - _n_l / _n_t * {impurity(kind, left, '_n_l')} - (_n_t - _n_l) / _n_t * {impurity(kind, right, '(_n_t - _n_l)')}"
    found = found.withColumn("score", F.expr(f"round({score}, 9)"))
    sides = F.array(*[F.col(f"{c}_l") for c in totals]).alias("left")
    best = F.min_by(F.struct("feature", "threshold", "score", sides), F.struct(-F.col("score"), "feature", "threshold"))
    return found.groupBy("_node").agg(best.alias("b")).select("_node", "b.*")


def grow(df: DataFrame, features: list[str], y: str, kind: str = "gini", depth: int = 10, least_split: int = 5, least_leaf: int = 2, tried: int | None = None) -> Tree:
    """A tree by Gini's impurity (any labels), variance (a number) or hellinger (two labels). Rows without a y are left out.

    Ties go to the first feature and the lowest threshold. A node with fewer than least_split rows, with one label, at the given depth, or (but
    for hellinger) without gain is a leaf. tried: percentiles that are tried beyond FEW values; 0 tries all midpoints always, as hellinger does.
    """
    tried = (0 if kind == "hellinger" else TRIED) if tried is None else tried
    classes = None if kind == "variance" else labels(df, y)
    if kind == "hellinger" and len(classes) > 2:
        raise ValueError("hellinger parts two classes")
    if classes is None:
        own = {"_s0": F.col(y).cast("double"), "_s1": F.col(y).cast("double") * F.col(y).cast("double")}
    else:
        own = {f"_s{k}": (F.col(y) == F.lit(c)).cast("double") for k, c in enumerate(classes)}
    tree = Tree(features, classes)
    base = df.where(F.col(y).isNotNull()).select(F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), F.lit(1.0).alias("_n"), *[c.alias(n) for n, c in own.items()], F.lit(1).cast("long").alias("_node"))
    root = base.agg(*[F.sum(c) for c in ("_n", *own)]).first()
    tree.leaves[1] = list(root) if root[0] else []
    pure = lambda s: max(s[1:]) == s[0] if classes is not None else s[2] / s[0] - (s[1] / s[0]) ** 2 < 1e-20
    level, new = base, [1] if root[0] else []
    for at in range(depth):
        open_ = [k for k in new if tree.leaves[k][0] >= least_split and not pure(tree.leaves[k])]
        if not open_:
            break
        some = level.where(F.col("_node").isin(open_)) if len(open_) < len(new) else level
        found = [r for r in best_splits(some, list(own), kind, least_leaf, tried).collect() if kind == "hellinger" or r["score"] > 0]  # a row for each open node
        new = []
        for r in found:
            k, sums = r["_node"], tree.leaves.pop(r["_node"])
            tree.splits[k] = (r["feature"], r["threshold"])
            tree.leaves[2 * k], tree.leaves[2 * k + 1] = r["left"], [t - x for t, x in zip(sums, r["left"])]
            new += [2 * k, 2 * k + 1]
        if len(tree.leaves) > MOST_NODES:
            raise ValueError(f"a tree of over {MOST_NODES} leaves; lower the depth")
        if not new:
            break
        level = at_node(some, Tree(features, classes, {r["_node"]: tree.splits[r["_node"]] for r in found})).where(F.col("_node") >= 1 << (at + 1))
    return tree


def leaf(df: DataFrame, tree: Tree, name: str = "leaf") -> DataFrame:
    """df with the number of the leaf that each row falls into; the tree is a broadcast table, and a level is a join with it."""
    rows = df.withColumns({"_x": F.array(*[F.col(f).cast("double") for f in tree.features]), "_node": F.lit(1).cast("long")})
    for level in range(max((k.bit_length() for k in tree.splits), default=0)):
        some = {k: s for k, s in tree.splits.items() if k.bit_length() == level + 1}
        rows = at_node(rows, Tree(tree.features, tree.classes, some))
    return rows.drop("_x").withColumnRenamed("_node", name)


def predict(df: DataFrame, tree: Tree, name: str = "prediction", shares: str | None = None) -> DataFrame:
    """df with the value of its leaf (see `Tree.value`) and, if asked for, the shares of the classes there."""
    kind = "double" if not tree.classes else df.sparkSession.createDataFrame([(tree.classes[0],)]).dtypes[0][1]
    table = [(k, float(tree.value(k)) if tree.classes is None else tree.value(k), tree.shares(k)) if sums else (k, None, None) for k, sums in tree.leaves.items()]
    values = df.sparkSession.createDataFrame(table, f"_leaf long, _value {kind}, _shares array<double>")
    out = leaf(df, tree, "_leaf").join(F.broadcast(values), "_leaf").drop("_leaf")
    return out.select(*df.columns, F.col("_value").alias(name), *([F.col("_shares").alias(shares)] if shares else []))
