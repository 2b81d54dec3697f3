"""Spelling variants: words one edit apart, the common form of each, and the root that forms lead to.

Two words are near if one inserted, deleted or replaced code point makes one of the other. With c the length of
the shorter one, that is so exactly when their common prefix and common suffix (each at most c long) add up to
the longer one's length minus one, or more. Words are compared by dense tiling: the words of a tile are
matrices of code points, aligned at the left and at the right, all rows against all rows, and column by column
the common lengths grow.

Which words meet in a tile: a word of length c stands in class c as a short one, and in class c - 1 as a long
one; short ones are compared with all others of the class. A pair of class c whose common prefix is under c/2
has a common suffix of at least c/2, so a class is dealt twice, by first and by last halves. Groups with more words than a
tile holds are dealt again in the same way by half of what is still open, with the bounds that keep every pair in
exactly one group, until a group fits a tile or at most two code points are open; what is still larger then (the
alphabet bounds it) is cut in blocks and every two blocks meet. So groups shrink with the words' own letters, however
many words share a beginning, and no group of the corpus is compared in one place.

A tile gives, for each of its words, how many are near and the best of them: no pair leaves it.

Results for odd rows: null and letterless texts have no words; a null id counts as an empty one where letters are
dropped; ids may be of any type; repeated rows count again; texts are read whole, and a word may be of any length;
ties between near words go to the smallest in code-point order; other columns don't matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import in_parts, saved, slim

LETTERS = "A-Za-zÀ-ÿ"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words of one task that are counted before counts leave it, and characters of them.
COUNTED, CHARACTERS = 300_000, 1 << 24
#: Rows of one tile at most, its characters, and rows up to which small groups of one kind share a tile.
TILE, TILE_CHARACTERS, SHARED = 1024, 1 << 21, 160
#: A group is not dealt again once so few code points of it are open.
OPEN = 2
#: A form is so many times as frequent as the word.
TIMES = 5


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_one_in: int = 0) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, how often each stands in the texts, of those long and frequent enough.

    With drop_one_in, runs whose crc32 of id, colon and run is divisible by it lose a code point: planted misspellings.
    """
    import pyarrow as pa

    find = re.compile(f"[{LETTERS}]+").findall

    def packed(counts: Counter):
        words, n = list(counts), list(counts.values())
        for a in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.string()), pa.array(n[a : a + 50_000], pa.int64())], names=["word", "n"])

    def run(batches):
        counts, size = Counter(), 0
        for batch in in_parts(batches):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{id_ or ''}:".encode())
                for word, k in Counter(find(text.encode().translate(_LOWER).decode())).items():
                    if len(word) < least_length:
                        continue
                    if drop_one_in and not (h := zlib.crc32(word.encode(), start)) % drop_one_in:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += k
                    size += len(word)
                if len(counts) >= COUNTED or size >= CHARACTERS * 8:
                    yield from packed(counts)
                    counts, size = Counter(), 0
        yield from packed(counts)

    rows = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), "text")
    counts = rows.mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def room() -> Column:
    """How many words of a class one tile holds."""
    return F.greatest(F.lit(2), F.least(F.lit(TILE), F.floor(F.lit(TILE_CHARACTERS) / (F.col("c") + 1)))).cast("int")


def dealt(rows: DataFrame) -> DataFrame:
    """rows (word, n, c, x, y, below) once by the next half from the left and once by the next from the right, with key: what a group has in common.

    A group has its first x and its last y code points in common, and looks for the pairs with a common prefix of x or more, under below.
    """
    half = F.floor((F.col("c") - F.col("x") - F.col("y")) / 2).cast("int")
    cut = F.col("x") + half
    left = F.struct(cut.alias("x"), F.col("y").alias("y"), F.col("below").alias("below"))
    right = F.struct(F.col("x").alias("x"), (F.col("c") - cut).alias("y"), F.least("below", cut).alias("below"))
    out = rows.select("word", "n", "c", F.explode(F.array(left, right)).alias("s")).select("word", "n", "c", "s.*").where("x < below")
    return out.withColumn("key", F.xxhash64("c", "x", "y", "below", F.expr("left(word, x)"), F.expr("right(word, y)")))


def tiles(words: DataFrame) -> DataFrame:
    """The words of each tile: word, n, c, x, y, below, key, i, j (the two blocks of the group that meet in it), own (the word's block)."""
    size = F.length("word")
    classes = F.array(F.struct(size.alias("c")), F.struct((size - 1).alias("c")))
    rows = dealt(words.select("word", "n", F.explode(classes).alias("s")).select("word", "n", "s.c", F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("s.c") + 1).alias("below")).where("c > 0"))
    out = None
    while True:
        # a group without a short word, or with one word, has no pair
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum((F.length("word") == F.col("c")).cast("int")).alias("short")).where("many > 1 AND short > 0").drop("short")
        sized = saved(rows.join(groups, "key"))
        large = (F.col("many") > room()) & (F.col("c") - F.col("x") - F.col("y") > OPEN)
        fit = sized.where(~large)
        out = fit if out is None else out.unionByName(fit)
        if not sized.where(large).take(1):
            break
        rows = dealt(sized.where(large).drop("key", "many"))
    blocks = F.ceil(F.col("many") / room()).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    out = out.withColumns({"blocks": blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select("word", "n", "c", "x", "y", "below", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def matrices(words: list[str], c: int) -> tuple[np.ndarray, np.ndarray]:
    """The first c and the last c code points of words of c or c + 1 of them: a column of each matrix is one place of all words."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(flat) and flat.max() < 256:
        flat = flat.astype(np.uint8)
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size) - size
    places = np.arange(c)
    return flat[begin[:, None] + places].T.copy(), flat[(begin + size - c)[:, None] + places].T.copy()


def common(columns: np.ndarray) -> np.ndarray:
    """How many first columns agree, of each row with each row."""
    rows = columns.shape[1]
    alive, out = np.ones((rows, rows), bool), np.zeros((rows, rows), np.uint8 if len(columns) < 256 else np.int32)
    for k, column in enumerate(columns):
        alive &= column[:, None] == column
        out += alive
        if k % 4 == 3 and not alive.any():  # with short words each has itself, so this is for blocks of long ones
            break
    return out


def near_in_tile(words: list[str], n: list[int], own: np.ndarray, apart: bool, c: int, x: int, y: int, below: int) -> list[tuple]:
    """(word, how many are near, the best one's n, the best one) of the words of a tile that have a near one; apart: only words of different blocks are compared."""
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    words = [words[k] for k in order]
    first, last = matrices(words, c)
    prefix, suffix = common(first), common(last[::-1])
    long = np.array([len(w) > c for w in words])
    near = prefix.astype(np.int32) + suffix >= c - 1 + (long[:, None] | long)
    near &= (prefix >= x) & (prefix < below) & (suffix >= y) & ~(long[:, None] & long)
    np.fill_diagonal(near, False)
    if apart:
        own = own[order]
        near &= own[:, None] != own
    many, best = near.sum(1), near.argmax(1)
    return [(words[k], int(many[k]), n[order[best[k]]], words[best[k]]) for k in np.flatnonzero(many).tolist()]


def neighbours(words: DataFrame) -> DataFrame:
    """Of words (word, n), those with a near one: word, n_near, best (the near word of largest n, ties to the smallest), best_n."""
    import pyarrow as pa

    kind = ["c", "x", "y", "below"]

    def run(batches):
        words, n, own, at, groups = [], [], [], None, 0

        def found():
            if groups and len(words) > 1:
                got = near_in_tile(words, n, np.array(own), at[-2] != at[-1], *at[:4])
                if got:
                    columns = list(zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

        def cut(columns):
            """Whole tiles of one batch: (place of each tile's kind, key and blocks, its rows)."""
            table = np.stack([c.to_numpy().astype(np.int64) for c in columns])
            edge = np.flatnonzero((table[:, 1:] != table[:, :-1]).any(0)) + 1
            bounds = [0, *edge.tolist(), table.shape[1]]
            return [(tuple(table[:, a].tolist()), a, b) for a, b in zip(bounds, bounds[1:])]

        for batch in batches:
            if not batch.num_rows:
                continue
            w, many, block = (batch.column(k).to_pylist() for k in range(3))
            for key, a, b in cut([batch.column(k) for k in range(3, 10)]):  # c, x, y, below, key, i, j
                same = at is not None and key == at
                # tiles of one kind share a matrix while it is small: pairs of different groups differ in what a group has in common
                if not same and (at is None or key[:4] != at[:4] or key[5] != key[6] or at[5] != at[6] or len(words) + b - a > SHARED):
                    yield from found()
                    words, n, own, groups = [], [], [], 0
                groups += not same
                at = key
                words += w[a:b]
                n += many[a:b]
                own += block[a:b]
        yield from found()

    rows = tiles(words).select("word", "n", "own", *kind, "key", "i", "j")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions(*kind, "key", "i", "j")
    got = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    got = got.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("x"))
    return got.select("word", "n_near", F.col("x.best").alias("best"), (-F.col("x.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead. Each form is TIMES as frequent as its word, so paths are short, and each round doubles the step."""
    step = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("then"))
        step = saved(step.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        if not step.where("moved").take(1):
            return step.select("word", "root")


def group(words: DataFrame) -> DataFrame:
    """words (word, n; each word once) with form (the near word of largest n, if it is TIMES as frequent), root (the last of the forms), n_near and form_n."""
    words = saved(slim(words, "word", "n"))
    found = words.join(neighbours(words), "word", "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    found = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    led = roots(found.where("form IS NOT NULL"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corrected(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Misspelt words with the documents that they stand in: doc_id, word, root, times. groups as `group` gives them."""
    rows = slim(docs, "doc_id", "text")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = rows.select("doc_id", F.explode(F.split(lower, f"[^{LETTERS}]+")).alias("word")).where("word <> ''")
    return runs.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("times")).join(groups.where("form IS NOT NULL").select("word", "root"), "word").select("doc_id", "word", "root", "times")
