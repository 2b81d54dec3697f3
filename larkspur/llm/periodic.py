"""Periodic runs of words: the maximal repetitions of each text, found in enhanced suffix arrays.

The words of a task's batch of texts, each text closed by a mark of its own, are one array of numbers. Ranks of
runs of 1, 2, 4, ... words (only those that are not yet alone are ranked again) give the suffix array, its inverse
and, read from the longest runs down, the lengths of common prefixes of neighbours. Ranks begin with the text, so an
interval of common prefixes never spans two texts.

A square (two equal runs of q words, one behind the other) is branching if the word behind it differs from the
word q before. Both of its halves then stand in the interval of common prefixes of exactly q words, in different
children. So for each such interval the suffixes of all children but the largest are looked at: the inverse array
tells whether the suffix q words ahead, or q words back, is in the interval. A run ends in exactly one branching
square of each of its periods; rotating that square to the left, word by word as long as it stays a square (by the
ranks, a power of two at a time), leads to the run's start. What has the same start and end is one run, of its
smallest period. No tree is built, and intervals are found by jumps over arrays.

Time and memory of a batch go with n log n of its words; a batch has about a megabyte of text, or one longer text.

Results for odd rows: null, empty and wordless texts have no runs; repeated rows and ids count each by itself, and
ids are carried along, not used; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import in_parts, slim, words_of

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """The words of the texts as numbers, with a mark behind each text; where each text begins (and the end of all); the words."""
    codes: dict[bytes, int] = {}
    parts, begin, all_words = [], [0], []
    for k, text in enumerate(texts):
        words = text.encode().split() if text else []  # bytes are split at just the six kinds of white space
        all_words.append(words)
        own = np.empty(len(words) + 1, np.int64)
        own[:-1] = [codes.setdefault(w, len(codes)) for w in words]
        own[-1] = -1
        parts.append(own)
        begin.append(begin[-1] + len(own))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(begin), all_words


def ranks(words: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words: the rank of the run of so many words from each place on, equal for equal runs of one text only; at last all differ.

    A rank is the first place that the run takes in the order of suffixes. Runs that reach a text's mark are alone.
    """
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    key = text * (int(words.max()) + 2) + words + 1
    order = np.argsort(key, kind="stable")
    rank = np.zeros(len(key), np.int64)
    rank = placed(key[order], order, rank, rank)
    out, size = [rank], 1
    while True:
        open_ = shared(rank)
        if not len(open_):
            return out
        # open runs hold no mark, so what follows them is in the same text
        key = rank[open_] * (len(rank) + 1) + rank[open_ + size]
        order = np.argsort(key, kind="stable")
        rank, size = placed(key[order], open_[order], rank[open_][order], rank), 2 * size
        out.append(rank)


def placed(sorted_key: np.ndarray, places: np.ndarray, low: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """rank, with new ranks for places (sorted by key, low their old ranks): each old group parts into groups of equal keys, ranked by their first place."""
    at = np.arange(len(sorted_key))

    def begun(values: np.ndarray) -> np.ndarray:
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        return np.maximum.accumulate(np.where(first, at, 0))

    out = rank.copy()
    out[places] = low + begun(sorted_key) - begun(low)
    return out


def shared(rank: np.ndarray) -> np.ndarray:
    """Places whose rank stands elsewhere, too."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words are equal from places a and b on (different places)."""
    out = np.zeros(len(a), np.int64)
    last = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + out, last), np.minimum(b + out, last)
        out += (levels[k][x] == levels[k][y]) << k
    return out


def common_suffixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words are equal before places a and b, read backwards (a < b)."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = a - out - (1 << k)
        inside = x >= 0
        x = np.maximum(x, 0)
        y = np.maximum(b - out - (1 << k), 0)
        out += (inside & (levels[k][x] == levels[k][y])) << k
    return out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a value over 0 the last one before it with a smaller value, or -1. Each place jumps to where the one that it looks at points, until that one is smaller."""
    at = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero((at >= 0) & (values > 0))
    while True:
        open_ = open_[values[at[open_]] >= values[open_]]
        if not len(open_):
            return at
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]


def branching_squares(words: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of each branching square."""
    inverse = levels[-1]
    n = len(inverse)
    order = np.empty(n, np.int64)
    order[inverse] = np.arange(n)
    depth = np.zeros(n, np.int64)  # of a suffix with the one before it in the order
    depth[1:] = common_prefixes(levels, order[:-1], order[1:])
    low = smaller_before(depth)
    high = n - 1 - smaller_before(depth[::-1])[::-1]  # the first place behind with a smaller depth
    split = np.flatnonzero(depth > 0)
    if not len(split):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # places of one interval (from low to high - 1, as the suffix before the first split is in it) part its children
    by = np.lexsort((split, high[split], low[split]))
    split = split[by]
    left, right, q = low[split], high[split], depth[split]
    first = np.ones(len(split), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    interval = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    # children: from each split on, and the one that begins the interval
    child_begin = np.concatenate([left[heads], split])
    child_end = np.concatenate([split[heads], np.where(np.append(first[1:], True), right, np.append(split[1:], 0))])
    child_of = np.concatenate([np.arange(len(heads)), interval])
    by = np.argsort(child_of, kind="stable")
    child_begin, child_end, child_of = child_begin[by], child_end[by], child_of[by]
    width = child_end - child_begin
    of_interval = np.flatnonzero(np.append(True, child_of[1:] != child_of[:-1]))
    widest = np.repeat(np.maximum.reduceat(width, of_interval), np.diff(np.append(of_interval, len(width))))
    at = np.arange(len(width))
    largest = np.minimum.reduceat(np.where(width == widest, at, len(width)), of_interval)
    keep = np.ones(len(width), bool)
    keep[largest] = False
    width, child_begin, child_of = width[keep], child_begin[keep], child_of[keep]
    which = np.repeat(np.arange(len(width)), width)
    suffix = order[child_begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)]
    interval = child_of[which]
    lo, hi, period = left[heads][interval], right[heads][interval], q[heads][interval]
    starts, periods = [], []
    for start in (suffix, suffix - period):
        other = np.where(start == suffix, suffix + period, start)
        other = np.clip(other, 0, n - 1)
        met = (start >= 0) & (inverse[other] >= lo) & (inverse[other] < hi)
        s, p = start[met], period[met]
        ends = s + 2 * p
        differs = words[ends] != words[ends - p]
        starts.append(s[differs])
        periods.append(p[differs])
    return np.concatenate(starts), np.concatenate(periods)


def runs_in(words: np.ndarray, begin: np.ndarray, least_words: int, least_times: int) -> np.ndarray:
    """The runs of a batch, sorted by text, start and period: rows of text, start (in the text), length, period."""
    if not len(words):
        return np.zeros((0, 4), np.int64)
    levels = ranks(words, begin)
    start, period = branching_squares(words, levels)
    end = start + 2 * period
    start = start - common_suffixes(levels, start, start + period)
    length = end - start
    keep = (length >= least_words) & (length >= least_times * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    text = np.searchsorted(begin, start, side="right") - 1
    by = np.lexsort((period, start))
    return np.stack([text, start - begin[text], length, period], 1)[by]


def find(docs: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start in words from 0, length, period; by start, then period), and collapsed: the words that are
    in no run behind its first period, joined by one space."""
    import pyarrow as pa

    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type, False)), T.StructField("collapsed", T.StringType())])
    arrow_run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches):
        for batch in in_parts(batches, rows=2048):
            words, begin, all_words = numbered(batch.column(1).to_pylist())
            found = runs_in(words, begin, least_words, least_times)
            gone = np.zeros(len(words) + 1, np.int64)
            at = begin[found[:, 0]] + found[:, 1]
            np.add.at(gone, at + found[:, 3], 1)
            np.add.at(gone, at + found[:, 2], -1)
            gone = np.cumsum(gone) > 0
            bounds = np.searchsorted(found[:, 0], np.arange(len(all_words) + 1))
            with_run = set(found[:, 0].tolist())
            kept = [b" ".join(w).decode() if k not in with_run else b" ".join([x for x, out in zip(w, gone[begin[k] :].tolist()) if not out]).decode() for k, w in enumerate(all_words)]
            runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(arrow_run))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in all_words], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(kept, pa.string())], names=schema.names
            )

    return slim(docs, "doc_id", "text").mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (ties: smallest start, then period), compared in whole numbers; null if there is none."""
    more = lambda a, b: a["length"].cast("decimal(19,0)") * b["period"] > b["length"].cast("decimal(19,0)") * a["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, 0), lambda best, x: F.when(more(x, best), x).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text with a run written over the end of about a tenth of the texts, from hashes of ids: with h = crc32(doc_id as text) and g = floor(h / 10),
    if 10 divides h, each word i from a = g % n on is word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_of(F.col("text"))
    n = F.size("words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = slim(docs, "doc_id", "text").withColumn("words", F.when(chosen, words)).withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    written = F.array_join(F.transform("words", lambda x, i: F.get("words", at(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(n > 0, written).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of what `find` gives: doc_id, n_runs, start, length, period and exponent_milli of the strongest run, runs_sha256, collapsed_sha256."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
