"""Document fingerprints from closed syncmers, with built-in functions only.

Words are hashed; a run of INNER words is an inner hash, a run of K words is an anchor if the least of its
inner hashes stands at its first or last place. Whether a run is an anchor depends on that run alone, so
equal passages have equal anchors wherever they stand. A fingerprint is every anchor of the whole text, in the
order of the text (so that places can be matched, see `anchors`), as 31-bit hashes with points between; the
likeness of two fingerprints is the Jaccard likeness of their sets of anchors, computed in full.

Results for odd rows: a text without an anchor (short ones) has the hash of all its words as its only one;
null counts as empty, and a text without a word has an empty fingerprint; two empty ones are alike (1), an
empty and a full one are not (0); ids may be of any type that has an order; null ids come last in the order of
documents; equal ids are ordered by a hash of their texts; a single document is its own next one; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import partitions, saved, slim, words_of

K, INNER = 8, 2
#: Documents that stand in order within one bucket, about.
BUCKET = 1024
#: Bounds of buckets, which are broadcast, at most; beyond that, buckets grow with the documents.
MOST_BUCKETS = 1 << 18


def later(column: str, by: int) -> Column:
    """An array without its first elements."""
    return F.slice(F.col(column), F.lit(by + 1), F.greatest(F.size(column) - by, F.lit(0)))


def with_hashes(df: DataFrame, text: str, words: str, inner: str) -> DataFrame:
    """df with the hashes of the words of a text column, and of each run of INNER (two) words, in two array columns."""
    df = df.withColumn(words, F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x)))
    return df.withColumn(inner, F.zip_with(F.col(words), later(words, INNER - 1), lambda a, b: F.xxhash64(a, b)))


def runs(words: str, inner: str, found) -> Column:
    """found(hash, place) for each anchor, in order. Every run of K words is looked at through its K - 1 inner hashes, side by side."""
    wide = K - INNER + 1
    names = [f"i{k}" for k in range(wide)]
    zipped = F.arrays_zip(*[later(inner, k).alias(n) for k, n in enumerate(names)])

    def look(x: Column, i: Column) -> Column:
        at_edge = F.least(x[names[0]], x[names[-1]]) <= F.least(*[x[n] for n in names[1:-1]])
        return F.when(at_edge, found(short(F.xxhash64(*[x[n] for n in names[::INNER]])), i))

    return F.array_compact(F.slice(F.transform(zipped, look), F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(0))))


def short(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the anchors of a text column, in order: an array of integers."""
    words, inner = f"{out}__w", f"{out}__i"
    df = with_hashes(df, text, words, inner).withColumn(out, runs(words, inner, lambda h, i: h))
    whole = F.when(F.size(words) > 0, F.array(short(F.xxhash64(words)))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(words, inner)


def anchors(docs: DataFrame) -> DataFrame:
    """Every anchor with its place, for positional matching: doc_id, position (in words, from 0), anchor. Texts of under K words have none."""
    df = with_hashes(slim(docs, "doc_id", "text"), "text", "w", "i")
    found = runs("w", "i", lambda h, i: F.struct(i.alias("position"), h.alias("anchor")))
    return df.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def shown(found: Column) -> Column:
    return F.array_join(found.cast("array<string>"), ".")


def likeness(a: str, b: str) -> Column:
    """Of two columns of anchors, 0 to 1: the share of their distinct anchors that both have."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.greatest(both, F.lit(1)))


def bucketed(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """df (with a column place) with bucket: how many of the sorted bounds (one row, broadcast) are not above place, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_BUCKETS.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col("bounds"), at + step - 1) <= F.col("place"), at + step).otherwise(at))
    return df.crossJoin(F.broadcast(bounds)).withColumn("bucket", found).drop("bounds")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n/2) characters replaced by the first as many of
    the next document in descending order of doc_id. Texts are dealt once, by ranges of that order with about
    BUCKET documents each; in each range the topmost document of the range below stands as a guest after the
    last, so that the next document is the row that follows. Bounds of ranges and their topmost places are found
    in a small table of ids and hashes of texts.
    """
    df = slim(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    # ascending places are descending in the order of documents: null ids first, hashes of texts turned round
    df = df.withColumn("place", F.struct("doc_id", F.bitwise_not(F.xxhash64("text")).alias("tie")))
    places = saved(df.select("place"))
    n = min(MOST_BUCKETS, max(1, places.count() // BUCKET))
    lowest = places.repartitionByRange(n, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("place"))
    bounds = saved(lowest.agg(F.sort_array(F.collect_list("place")).alias("bounds")))  # one row of n places at most
    tops = bucketed(places, bounds).groupBy("bucket").agg(F.max("place").alias("top"))
    tops = tops.agg(F.sort_array(F.collect_list(F.struct("bucket", "top"))).alias("all"))  # n rows at most
    below = F.transform("all", lambda x, i: F.struct(x["bucket"].alias("host"), F.coalesce(F.get("all", i - 1), F.element_at("all", -1))["top"].alias("then")))
    handed = saved(tops.select(F.explode(below).alias("x")).select("x.*"))
    met = (F.col("place.tie") == F.col("then.tie")) & F.col("place.doc_id").eqNullSafe(F.col("then.doc_id"))
    guests = df.join(F.broadcast(handed), met).dropDuplicates(["host"]).select("doc_id", "text", "place", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    rows = bucketed(df, bounds).select("doc_id", "text", "place", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    rows = rows.repartitionByRange(max(partitions(docs.sparkSession), n // 4), "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("place"))
    df = with_anchors(rows, "text", "own").withColumns({"next_text": F.lead("text").over(order), "next_own": F.lead("own").over(order)}).where("NOT guest")
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    df = df.withColumns({"n_chars": chars.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))}).drop("text", "next_text")
    df = with_anchors(df, "edited", "edited_own")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("edited_own")).alias("edited_fingerprint"),
        likeness("own", "edited_own").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )
