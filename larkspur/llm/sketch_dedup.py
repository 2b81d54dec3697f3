"""Near-duplicate documents by bottom-k sketches from one hash function, with exact verification.

A document's set is its distinct 5-word shingles (the whole sequence if it has fewer words, nothing if it has
none); two documents link when 100 * intersection >= percent * union. Sets are hashed by the one function of
`jaccard_join`, and a sketch is the KEPT least hashes of a set: all of it for a set of up to KEPT.

1. Documents with equal sets are one node from here on: groups of copies of any size cost a row per task.
2. Two linked sets keep many values in common: at least (2 - 1 / share) of the smaller sketch if that is a whole set,
   and `least_shared` of KEPT otherwise, but for odds of ODDS. So the first size - least + 1 values of a sketch, in an order in
   which common shingles come last, must meet one of the other's: only those go to the inverted lists of retained values.
3. A list has one leader, the member that has its value earliest, and gives pairs of leader and member; a node is
   compared with the leader that it overlaps with most. Links are merged into components. Lists whose members still lie
   in several components are taken up again: those outside the list's main component meet one member of it, for ROUNDS
   rounds, and then, in the list of the first value that both have and in bounds that BITS bits of each sketch give, each member of other components. So a group of
   copies of one document costs a pair for each of them, not all pairs, and no link between components is left out.
4. Pairs are dealt by one of the two nodes, in blocks. The sketch of their union (the KEPT least of both) estimates
   the Jaccard likeness, and pairs under `least_shared` go. Where both sketches are whole sets, the count is exact and
   decides. The others are read as texts, and their full sets decide.

The joins by value and by node are sort-merge joins, whose large partitions Spark splits at run time.

Odds: a link between sets of more than KEPT shingles is lost with odds under ODDS at the least likeness (far less above
it); sets are compared by 64-bit hashes, see `jaccard_join`. Reruns give the same rows.

Results for odd rows: a document without a word is linked with nothing and kept; repeated rows and equal texts are one
component, and rows that repeat the least id of theirs are all kept; a null doc_id names a component only if that
has only nulls, and is kept only then; other columns don't matter; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import in_parts, saved, shuffles_cleared, slim
from larkspur.llm.jaccard_join import common_shingles, components, drawn_secret, first_pass, node_of, sets, wanted_texts, with_hubs

#: Values of a sketch, and the odds that a link of the least likeness is not seen in sketches.
KEPT, ODDS = 256, 1e-12
PERCENT = 85
#: Bits that tell which values a sketch may have.
BITS = 1024
#: Candidates of a node that are compared in one block.
BLOCK = 2000
#: Rounds in which members of a list meet one member of its main component before they meet each other.
ROUNDS = 1


def least_shared(p: float, kept: int, odds: float = ODDS) -> int:
    """The most c for which fewer than c of kept values, each with the chance p, have the given odds at most."""
    below = 0.0
    for c in range(kept + 1):
        below += math.comb(kept, c) * p**c * (1 - p) ** (kept - c)
        if below > odds:
            return c
    return kept


def least_of(n: int, percent: int, of_cut: int) -> int:
    """How many values a sketch of a set of n must have in common with that of any linked set."""
    return of_cut if n > KEPT else max(1, (n * (200 * percent - 10_000)) // (100 * percent))


def in_order(sketch: np.ndarray, values: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A sketch with its common values last, the most common at the very end."""
    if not len(values):
        return sketch
    at = np.minimum(np.searchsorted(values, sketch), len(values) - 1)
    late = np.flatnonzero(values[at] == sketch)
    return np.concatenate([np.delete(sketch, late), sketch[late[np.argsort(rank[at[late]])]]])


def bits_of(sketch: np.ndarray) -> np.ndarray:
    """Which of BITS values the sketch's hashes take in their lowest bits."""
    some = np.zeros(BITS, bool)
    some[(sketch & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(some).view(np.int64)


def sketches(docs: DataFrame, common, secret: int, percent: int) -> DataFrame:
    """node, n, least (see `least_of`), bits, sketch (in the lists' order) of each set; a node comes once from each task that has it."""
    import pyarrow as pa

    of_cut = least_shared(percent / 100, KEPT)

    def run(batches):
        values, rank, _ = common.value
        seen: set[int] = set()
        for batch in in_parts(batches):
            nodes, n, least, bits, kept = [], [], [], [], []
            for own in sets(batch.column(0), secret):
                if len(own) and (node := node_of(own)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    n.append(len(own))
                    least.append(least_of(len(own), percent, of_cut))
                    bits.append(bits_of(own[:KEPT]))
                    kept.append(in_order(own[:KEPT], values, rank))
            if nodes:
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int64)))
                eight = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(bits)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int32()), pa.array(least, pa.int32()), eight, sketch], names=["node", "n", "least", "bits", "sketch"])

    return docs.select("text").mapInArrow(run, "node long, n int, least int, bits array<long>, sketch array<long>")


def entries(rows: DataFrame) -> DataFrame:
    """The inverted lists of retained values: value, node, n, least, left (how many values of the sketch come from this one on)."""
    size = F.size("sketch")
    part = F.slice("sketch", F.lit(1), size - F.col("least") + 1)
    return rows.select("node", "n", "least", size.alias("size"), F.posexplode(part).alias("pos", "value")).select("value", "node", "n", "least", (F.col("size") - F.col("pos")).alias("left"))


def needed(a: str, b: str, percent: int) -> Column:
    """How many values the sketches of two linked sets (with these endings of column names) must share: what the overlap says if both are whole
    sets. Else a value of the larger set's sketch is in both with the share of the overlap in that set, which grows as sizes come together."""
    n, m = F.col(f"n{a}").cast("long"), F.col(f"n{b}").cast("long")
    least = F.array(*[F.lit(least_shared(percent * (100 + ratio) / 100 / (100 + percent), KEPT)) for ratio in range(percent, 101)])
    ratio = F.greatest(F.lit(0), F.floor(100 * F.least(n, m) / F.greatest(n, m)) - percent).cast("int")
    return F.when(F.greatest(n, m) <= KEPT, F.ceil(percent * (n + m) / (100 + percent))).otherwise(F.get(least, ratio))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two entries of one list can be the first common value of two linked sets."""
    n, m = F.col(f"n{a}").cast("long"), F.col(f"n{b}").cast("long")
    alike = (100 * n >= percent * m) & (100 * m >= percent * n)
    return alike & (F.least(F.col(f"left{a}"), F.col(f"left{b}")) >= needed(a, b, percent))


def bit_columns() -> list[Column]:
    """The bits of a sketch as columns, with spare: how many of its values (at most KEPT) the bits do not show."""
    bits = [F.coalesce(F.col("bits")[k], F.lit(0)).alias(f"bits{k}_") for k in range(BITS // 64)]
    shown = reduce(lambda a, b: a + b, [F.bit_count(F.col("bits")[k]) for k in range(BITS // 64)])
    return [*bits, (F.least(F.col("n"), F.lit(KEPT)) - shown).alias("spare")]


def bits_allow(a: str, b: str, percent: int) -> Column:
    """Whether the bits of two sketches leave room for the values that they must share: a bit that only one has is a value that the other lacks.

    Values that the bits of both show, and those that they do not show, can be shared: size - (shown - both) = spare + both.
    """
    both = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"bits{k}_{a}").bitwiseAND(F.col(f"bits{k}_{b}"))) for k in range(BITS // 64)])
    return F.least(F.col(f"spare{a}"), F.col(f"spare{b}")) + both >= needed(a, b, percent)


def front_of(rows: DataFrame, several: bool = False) -> DataFrame:
    """The foremost member of each list (of those with several members, if that is asked for): value, node1, n1, least1, left1."""
    first = F.min_by(F.struct("node", "n", "least", "left"), F.struct((-F.col("left") / F.least("n", F.lit(KEPT))).alias("late"), "node"))
    front = rows.groupBy("value").agg(first.alias("x"), F.min("node").alias("low"), F.max("node").alias("high"))
    return (front.where("low <> high") if several else front).select("value", *[F.col(f"x.{c}").alias(f"{c}1") for c in ("node", "n", "least", "left")])


def best_pairs(met: DataFrame, percent: int, tried: DataFrame | None = None) -> DataFrame:
    """Of entries with the foremost member of their list, each node with the one of those that it meets in most lists: query, node."""
    met = met.where((F.col("node") != F.col("node1")) & may_link("", "1", percent)).groupBy("node", "node1").agg(F.count(F.lit(1)).alias("many"))
    if tried is not None:
        met = met.withColumns({"a": F.least("node", "node1"), "b": F.greatest("node", "node1")}).join(tried, ["a", "b"], "left_anti")
    return met.groupBy("node").agg(F.max_by("node1", F.struct("many", "node1")).alias("query"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("query", "node").alias("a"), F.greatest("query", "node").alias("b"))


def dealt(pairs: DataFrame) -> DataFrame:
    """query, block, role (0: the query itself, 1: a candidate), node: the candidates of a query in blocks, with the query in each."""
    blocks = pairs.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = blocks.select("query", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("query").alias("node"))
    offered = pairs.join(blocks, "query").select("query", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "node")
    return asked.unionByName(offered)


def shared_in_union(a: np.ndarray, b: np.ndarray, kept: int) -> int:
    """How many of the kept least values of two sorted sketches' union are in both."""
    merged = np.sort(np.concatenate([a, b]))
    again = merged[1:] == merged[:-1]
    distinct = np.append(0, np.cumsum(~again))  # how many different values stand before each one
    return int((again & (distinct[1:] < kept)).sum())


def linked(shared: int, n: int, m: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def estimated(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (query, node) that the sketches of their unions leave: query, node, sure (whether both are whole sets, so that the link is certain)."""
    import pyarrow as pa

    of_cut = least_shared(percent / 100, KEPT)
    sent = dealt(pairs).join(rows.select("node", "n", "sketch"), "node").select("query", "block", "role", "node", "n", "sketch")
    sent = sent.repartition("query", "block").sortWithinPartitions("query", "block", "role", "node")

    def run(batches):
        key, own, size, last = None, None, 0, None
        for batch in in_parts(batches):
            out = []
            flat, at = batch.column(5).flatten().to_numpy().astype(np.uint64), batch.column(5).offsets.to_numpy()
            at = at - at[0]
            for k, (q, block, role, node, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(5)])):
                if (q, block) != key:
                    key, own, last = (q, block), None, None
                if (role, node) == last:  # from another task
                    continue
                last = (role, node)
                sketch = np.sort(flat[at[k] : at[k + 1]])
                if role == 0:
                    own, size = sketch, n
                elif own is not None:
                    sure = n <= KEPT and size <= KEPT
                    if linked(shared_in_union(own, sketch, 2 * KEPT), n, size, percent) if sure else shared_in_union(own, sketch, KEPT) >= of_cut:
                        out.append((q, node, sure))
            if out:
                a, b, sure = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure)], names=["query", "node", "sure"])

    return sent.mapInArrow(run, "query long, node long, sure boolean")


def verified(docs: DataFrame, pairs: DataFrame, keys: DataFrame, secret: int, percent: int) -> DataFrame:
    """The pairs (query, node) that link, by the full sets of their texts. keys: node, text_key."""
    import pyarrow as pa

    send = saved(dealt(pairs).join(keys, "node"))
    texts = wanted_texts(docs, send).groupBy("text_key").agg(F.first("text").alias("text"))
    rows = texts.join(send, "text_key").select("query", "block", "role", "node", "text")
    rows = rows.repartition("query", "block").sortWithinPartitions("query", "block", "role", "node")

    def run(batches):
        key, own = None, None
        for batch in in_parts(batches):
            out = []
            for q, block, role, node, x in zip(*[batch.column(k).to_pylist() for k in range(4)], sets(batch.column(4), secret)):
                if (q, block) != key:
                    key, own = (q, block), None
                if node_of(x) != node:  # another text with the same hash
                    continue
                if role == 0:
                    own = x
                elif own is not None and linked(shared_in_union(own, x, len(own) + len(x)), len(own), len(x), percent):
                    out.append((q, node))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["query", "node"])

    return rows.mapInArrow(run, "query long, node long")


def links_of(docs: DataFrame, pairs: DataFrame, rows: DataFrame, keys: DataFrame, secret: int, percent: int) -> DataFrame:
    """Of pairs (query, node), those that link: a, b."""
    left = saved(estimated(pairs, rows, percent))
    sure = left.where("sure").select(F.col("query").alias("a"), F.col("node").alias("b"))
    open_ = left.where("NOT sure").select("query", "node")
    if not open_.take(1):
        return sure
    return saved(sure.unionByName(verified(docs, open_, keys, secret, percent).select(F.col("query").alias("a"), F.col("node").alias("b"))))


def mixed_lists(lists: DataFrame, of: DataFrame) -> DataFrame:
    """Of the lists' entries, those of lists whose members lie in several components, with component and main (the list's most frequent one)."""
    rows = saved(lists.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")))
    found = rows.groupBy("value", "component").agg(F.count(F.lit(1)).alias("many")).groupBy("value")
    found = found.agg(F.max_by("component", F.struct("many", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1").select("value", "main")
    return saved(rows.join(found, "value"))


def rest_of(rows: DataFrame, tried: DataFrame, sketch_rows: DataFrame, percent: int) -> DataFrame:
    """Of mixed lists, the pairs of different components that were not compared and that the bits of their sketches allow: query, node."""
    known = sketch_rows.select("node", "sketch", *bit_columns()).join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    rows = rows.join(known, "node").withColumn("before", F.slice("sketch", F.lit(1), F.size("sketch") - F.col("left"))).drop("sketch")
    rows = saved(rows)
    bits = [f"bits{k}_" for k in range(BITS // 64)]
    apart = rows.where("component != main").select("value", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "left", "component", "spare", *bits, "before")])
    # Two sketches have one order, so a pair leaves one list only. The condition must stay short: Java does not compile a method of over
    # 8,000 bytes, and interprets it for every pair (see the test).
    rest = apart.join(rows.drop("main"), "value").where((F.col("component") != F.col("component2")) & may_link("", "2", percent) & bits_allow("", "2", percent) & ~F.arrays_overlap("before", "before2"))
    rest = rest.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = saved(rest)
    # of two nodes the one with more pairs is the query, so that few sketches are sent often
    ends = rest.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("pairs"))
    for end in ("a", "b"):
        rest = rest.join(ends.withColumnsRenamed({"end": end, "pairs": f"{end}_pairs"}), end)
    turn = F.col("a_pairs") >= F.col("b_pairs")
    return rest.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("query"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("node"))


def classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node, text_key) of all documents, and (node, component) of all nodes with a shingle."""
    docs, secret = slim(docs, "doc_id", "text"), drawn_secret()
    first = saved(first_pass(docs, secret))
    documents = first.where("kind = 0").drop("kind")
    keys = documents.where("n > 0").groupBy("node").agg(F.min("text_key").alias("text_key"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(first.where("kind = 1")))  # 16 MB at most
    rows = saved(sketches(docs, common, secret, percent))
    found = entries(rows)
    met = saved(found.join(front_of(found, several=True), "value"))
    lists = met.select("value", "node", "n", "least", "left")
    pairs = saved(best_pairs(met, percent))
    tried = both_ways(pairs)
    links = links_of(docs, pairs, rows, keys, secret, percent)
    of = saved(components(links))
    mixed = mixed_lists(lists, of)
    for _ in range(ROUNDS):
        pairs = saved(best_pairs(mixed.where("component != main").join(front_of(mixed.where("component = main")), "value"), percent, tried))
        tried = tried.unionByName(both_ways(pairs))
        more = links_of(docs, pairs, rows, keys, secret, percent)
        if not more.take(1):
            break
        links = links.unionByName(more)
        of = saved(components(links))
        mixed = mixed_lists(lists, of)
    more = links_of(docs, rest_of(mixed, tried, rows, percent), rows, keys, secret, percent)
    of = components(links.unionByName(more))
    nodes = documents.where("n > 0").select("node").distinct()
    return documents, saved(nodes.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), kept (whether it is that one)."""
    with shuffles_cleared(docs.sparkSession):
        rows, nodes = classes(docs, percent)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = with_hubs(nodes, nodes.join(least, "node").groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    out = with_hubs(rows.where("n > 0"), saved(named), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
