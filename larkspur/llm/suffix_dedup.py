"""Removal of repeated passages: a distributed sparse suffix array.

A byte goes if a string of LENGTH bytes (a window) that covers it also starts earlier (in a document that
comes before, or earlier in the same one). A suffix for every byte would be a hundred times the corpus, so
suffixes start at anchors only: of the GRAM-byte runs inside a window, the one with the least hash. Equal
windows have their anchor at the same offset, so they meet at the suffixes of their anchors.

1. One pass counts the anchors' runs; those that occur once can't be in a repeated window. Anchors whose
   windows all repeat those of the anchor before them in the same text (a text of one byte, say, has an anchor
   at every byte) are settled there and then, by comparing bytes, and leave the list.
2. A second pass cuts, for each anchor whose run occurs again, the suffix from the anchor on and the prefix
   before it, as far as its windows reach. A bitmap of fixed size says which runs occur again; what it lets
   through wrongly is found unrepeated later.
3. Suffixes are range-partitioned by sampled splitters (repartitionByRange over the suffix, then the document,
   so that a passage which stands in a third of all documents is spread as well). Each partition orders its
   suffixes, and its prefixes read backwards, by a multikey quicksort, and takes the lengths that neighbours
   have in common. Two windows with offset d are equal if nothing between them in the order of suffixes falls
   below LENGTH - d common bytes, and nothing in the order of prefixes below d. The earliest one stays.
4. What stays in a partition and may be equal to a window of another one (it shares LENGTH - d bytes with the
   partition's first or last suffix) is compared across boundaries, by a 128-bit digest of its bytes.
5. The ranges that go are joined with the texts.

Results for odd rows: null text counts as empty; texts shorter than LENGTH lose nothing; ids may be of any type
that has an order, and a null doc_id comes after all others; rows that repeat both id and text are one document,
and each gets its result; rows that repeat an id with other text are ordered by a hash of the text; an empty
table gives an empty result. A text of any length is looked at PART bytes at a time.
"""

from __future__ import annotations

import math
from hashlib import blake2b, sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import eights, in_parts, mixed, partitions, saved, slim

LENGTH, GRAM = 100, 32
#: Suffixes that one task sorts, about.
SORTED = 250_000
#: Parts of this size and less are sorted directly.
SMALL = 48
#: The bitmap of runs that occur again has at most so many bits (8 MB).
MOST_BITS = 1 << 26
#: Bytes of a text that are looked at at once, and bits that hold a place in them.
PART, PLACE_BITS = 1 << 20, 21
_ODD = np.random.default_rng(77).integers(1, 1 << 63, GRAM // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEADING = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)


def repeats_before(flat: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, a: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which anchors have only windows that are equal to those as far before them as the anchor before."""
    step = np.diff(a, prepend=a[:1])
    maybe = np.zeros(len(a), bool)
    maybe[1:] = (run[1:] == run[:-1]) & (step[1:] <= LENGTH - GRAM)
    maybe &= first - step >= at[np.searchsorted(at, first, side="right") - 1]
    for q in np.unique(step[maybe]).tolist():
        k = np.flatnonzero(maybe & (step == q))
        low = int(first[k[0]]) - q
        same = np.cumsum(np.concatenate([[0], flat[low + q : last[k[-1]] + LENGTH] == flat[low : last[k[-1]] + LENGTH - q]]), dtype=np.int32)
        maybe[k] = same[last[k] + LENGTH - q - low] - same[first[k] - q - low] == last[k] + LENGTH - first[k]
    return maybe


def anchors(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts that stand in flat at these bounds: (first window, last window, anchor, hash of its run) of each anchor, in order,
    and the ranges of bytes (start, end) that go because windows repeat the ones just before them."""
    none = np.zeros(0, np.int64)
    if len(flat) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64), none, none
    n, eight = len(flat) - GRAM + 1, eights(flat)
    run = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM // 8):
            run += eight[8 * k : 8 * k + n].astype(np.uint64) * _ODD[k]
    run = mixed(run)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (run & ~low) | np.arange(n, dtype=np.uint64)
    width = LENGTH - GRAM + 1
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    windows = len(flat) - LENGTH + 1
    least = np.minimum(least[:windows], least[width - size : width - size + windows])
    inside = np.ones(windows, bool)  # windows that do not cross from one text into the next
    for b in at[1:-1].tolist():
        inside[max(0, b - LENGTH + 1) : b] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64), none, none
    a = (least[starts] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(starts) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    first, last, a = starts[first], starts[last], a[first]
    gone = repeats_before(flat, at, first, last, a, run[a])
    begin, end = first[gone], last[gone] + LENGTH
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | (np.searchsorted(at, begin[1:], side="right") != np.searchsorted(at, begin[:-1], side="right"))
    k = np.flatnonzero(new)
    return first[~gone], last[~gone], a[~gone], run[a[~gone]], begin[k], end[np.concatenate([k[1:], [len(begin)]]) - 1] if len(k) else none


def spread(texts):
    """Of an Arrow string column: parts of about PART bytes as (flat bytes, bounds, row of each text, where in its text each begins).
    Parts of one text overlap so that each window stands in one of them."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return
    flat, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    i = 0
    while i < len(at) - 1:
        j = i + 1
        while j < len(at) - 1 and at[j + 1] - at[i] <= PART:
            j += 1
        if at[j] - at[i] <= PART:
            yield flat[at[i] : at[j]], at[i : j + 1] - at[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for k in range(0, int(at[j] - at[i]) - LENGTH + 1, PART - LENGTH + 1):
                part = flat[at[i] + k : min(at[j], at[i] + k + PART)]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([k])
        i = j


def repeated_runs(texts: DataFrame) -> DataFrame:
    """run, n for each anchor's run that occurs more than once."""
    import pyarrow as pa

    def count(batches):
        for batch in in_parts(batches, 2048):
            for flat, at, _, _ in spread(batch.column(0)):
                values, n = np.unique(anchors(flat, at)[3], return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["run", "n"])

    return texts.mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where("n > 1")


def bitmap(runs: DataFrame, many: int) -> np.ndarray:
    """Bits for the runs, 32 for each of them and MOST_BITS at most: a table of bounded size, gathered in blocks of 8 KB."""
    import pyarrow as pa

    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, math.ceil(math.log2(32 * many + 1))))

    def fold(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.uint64) & np.uint64(bits - 1)
            for block in np.unique(at >> np.uint64(16)).tolist():
                own = (at[at >> np.uint64(16) == np.uint64(block)] & np.uint64(0xFFFF)).astype(np.int64)
                blocks.setdefault(block, np.zeros(1 << 16, bool))[own] = True
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in blocks.values()], pa.binary())], names=["block", "bits"])

    dealt = runs.select("run", F.shiftrightunsigned(F.col("run").bitwiseAND(F.lit(bits - 1)), 16).alias("block")).repartition("block").select("run")
    table = np.zeros(bits >> 6, np.uint64)
    for r in dealt.mapInArrow(fold, "block long, bits binary").toLocalIterator():  # at most MOST_BITS / 8 bytes, a part at a time
        table[r["block"] << 10 : r["block"] + 1 << 10] |= np.frombuffer(r["bits"], np.uint64)
    return table


def suffixes(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Of rows (ord, tie, text): suffix, prefix, ord, tie, start (of the first window) for each anchor whose run may occur again;
    and, with end above 0 and a few bytes to be dealt by as suffix, ranges that go because a text repeats itself."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = ["suffix", "prefix", "ord", "tie", "start", "end"]

    def cut(batches):
        bits = shared.value
        wrap = np.uint64(len(bits) * 64 - 1)
        for batch in in_parts(batches):
            ties = batch.column(1).to_numpy(zero_copy_only=False)
            for flat, at, row, begins in spread(batch.column(2)):
                first, last, a, run, begin, end = anchors(flat, at)
                bit = run & wrap
                keep = np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                first, last, a = first[keep], last[keep], a[keep]
                text = np.searchsorted(at, np.concatenate([a, begin]), side="right") - 1
                data, at_row = flat.tobytes(), row[text]
                move = begins[text] - at[text]
                suffix = [data[x : y + LENGTH] for x, y in zip(a.tolist(), last.tolist())] + [blake2b(x.to_bytes(8, "little") + data[x : x + GRAM], digest_size=8).digest() for x in begin.tolist()]
                if suffix:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(suffix, pa.binary()),
                        pa.array([data[x:y] for x, y in zip(first.tolist(), a.tolist())] + [b""] * len(begin), pa.binary()),
                        batch.column(0).take(pa.array(at_row)), pa.array(ties[at_row], pa.int64()), pa.array(np.concatenate([first, begin]) + move, pa.int64()),
                        pa.array(np.concatenate([np.zeros(len(a), np.int64), end + move[len(a) :]]), pa.int64()),
                    ], names=names)

    schema = T.StructType([T.StructField("suffix", T.BinaryType()), T.StructField("prefix", T.BinaryType()), rows.schema["ord"], *[T.StructField(c, T.LongType()) for c in ("tie", "start", "end")]])
    return rows.mapInArrow(cut, schema)


def multikey_quicksort(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of the strings that begin at these places and have these sizes. A character is a word of eight bytes: a part of the
    strings is split by one word into those below, equal and above; the equal ones that go on are split by their next word."""
    eight, data = eights(flat), flat.tobytes()
    begins, ends = begin.tolist(), (begin + size).tolist()
    order = np.arange(len(begin))
    todo = [(0, len(begin), 0)]
    while todo:
        low, high, depth = todo.pop()
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = sorted(part.tolist(), key=lambda i: data[begins[i] + depth : ends[i]])  # noqa: B023
            continue
        left = size[part] - depth
        word = eight[begin[part] + depth].astype(np.uint64)
        short = left < 8
        if short.any():
            word[short] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(left[short], 1).astype(np.uint64))
            word[left <= 0] = 0
        pivot = sorted((int(word[0]), int(word[len(word) // 2]), int(word[-1])))[1]
        below, same = word < np.uint64(pivot), word == np.uint64(pivot)
        above = ~(below | same)
        ended = same & (left <= 8)
        goes_on = same & ~ended
        done = part[ended][np.argsort(left[ended], kind="stable")]
        order[low:high] = np.concatenate([part[below], done, part[goes_on], part[above]])
        a = low + int(below.sum())
        b = a + len(done)
        c = b + int(goes_on.sum())
        todo += [(x, y, d) for x, y, d in ((low, a, depth), (b, c, depth + 8), (c, high, depth)) if y - x > 1]
    return order


def common_lengths(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order but the first: how many bytes its string has in common with the one before."""
    eight, a, b = eights(flat), order[:-1], order[1:]
    out = np.minimum(size[a], size[b])
    open_, depth = np.flatnonzero(out > 0), 0
    while len(open_):
        x = eight[begin[a[open_]] + depth].astype(np.uint64) ^ eight[begin[b[open_]] + depth].astype(np.uint64)
        differ = x != 0
        k = open_[differ]
        out[k] = np.minimum(out[k], depth + (x[differ][:, None] < _LEADING).sum(1))
        open_, depth = open_[~differ], depth + 8
        open_ = open_[out[open_] > depth]
    return out


class Neighbours:
    """The strings of a column in order, and for each length which of them have that many first bytes in common."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.order = multikey_quicksort(flat, begin, size)
        self.common = common_lengths(flat, begin, size, self.order)

    def classes(self, length: int) -> np.ndarray:
        """A number for each string, equal for those that are at least so long and have so many bytes in common."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.common < length)
        return out


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column one after another, and their bounds."""
    import pyarrow as pa

    x = column.cast(pa.large_binary())
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = x.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def ages(ids, ties: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (id, tie, place), null ids last, and for each row the number of its triple in that order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    order = pc.sort_indices(pa.table({"id": ids, "tie": ties, "place": places}), sort_keys=[("id", "ascending"), ("tie", "ascending"), ("place", "ascending")], null_placement="at_end").to_numpy().astype(np.int64)
    code = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new = np.zeros(len(order), np.int64)
    for x in (code, ties, places):
        new[1:] |= x[order[1:]] != x[order[:-1]]
    age = np.empty(len(order), np.int64)
    age[order] = np.cumsum(new)
    return order, age


def resolve(rows: DataFrame, parts: int) -> DataFrame:
    """Of suffixes: what is repeated within a partition (kind 0: ord, tie, start and end of bytes that go) and
    the first ones of windows that may go on in another (kind 1: ord, tie, start, and a digest)."""
    import pyarrow as pa

    names = ["kind", "ord", "tie", "start", "end", "window"]

    def batch_of(kind, ids, ties, start, end, windows=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), ids, pa.array(ties, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.nulls(len(ids), pa.binary()) if windows is None else pa.array(windows, pa.binary())], names=names)

    def sort_and_compare(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got).combine_chunks()
        columns = [c.chunk(0) for c in got.columns]
        known = columns[5].to_numpy() > 0
        if known.any():
            k = pa.array(np.flatnonzero(known))
            yield batch_of(0, columns[2].take(k), *[columns[i].take(k).to_numpy() for i in (3, 4, 5)])
            k = pa.array(np.flatnonzero(~known))
            columns = [c.take(k) for c in columns]
        if not (n := len(columns[0])):
            return
        (suffix, s_at), (prefix, p_at) = bytes_of(columns[0]), bytes_of(columns[1])
        s_size, p_size = np.diff(s_at), np.diff(p_at)
        ids, ties, anchor = columns[2], columns[3].to_numpy(), columns[4].to_numpy() + p_size
        forward = Neighbours(suffix, s_at[:-1], s_size)
        backward = Neighbours(prefix[::-1], len(prefix) - p_at[1:], p_size)
        order, age = ages(ids, ties, anchor)
        ends = forward.order[[0, -1]]
        data, before = suffix.tobytes(), prefix.tobytes()
        widest = LENGTH - GRAM
        gone = np.zeros((n, widest + 2), bool)  # of each anchor, the offsets of its windows that go
        edge_row, edge_offset = [], []
        for d in range(widest + 1):
            has = order[(LENGTH - s_size[order] <= d) & (d <= p_size[order])]
            if not len(has):
                continue
            ahead = forward.classes(LENGTH - d)
            key = ahead[has] * (n + 1) + backward.classes(d)[has]
            by_key = np.argsort(key, kind="stable")
            key, has = key[by_key], has[by_key]
            new = np.ones(len(has), bool)
            new[1:] = key[1:] != key[:-1]
            lead = has[np.flatnonzero(new)][np.cumsum(new) - 1]
            gone[has, d] = age[has] != age[lead]
            stays = has[new]
            stays = stays[(ahead[stays] == ahead[ends[0]]) | (ahead[stays] == ahead[ends[1]])]
            edge_row.append(stays)
            edge_offset.append(np.full(len(stays), d))
        flips = np.diff(gone.ravel().astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)  # runs of offsets; the last column is never set
        if len(begin):
            row = begin // (widest + 2)
            a = anchor[row]
            yield batch_of(0, ids.take(pa.array(row)), ties[row], a - (end - 1) % (widest + 2), a - begin % (widest + 2) + LENGTH)
        if edge_row:
            row, offset = np.concatenate(edge_row), np.concatenate(edge_offset)
            if len(row):
                windows = [blake2b(before[p - d : p] + data[s : s + LENGTH - d], digest_size=16).digest() for p, s, d in zip(p_at[1:][row].tolist(), s_at[row].tolist(), offset.tolist())]
                yield batch_of(1, ids.take(pa.array(row)), ties[row], anchor[row] - offset, np.zeros(len(row), np.int64), windows)

    dealt = rows.repartitionByRange(parts, "suffix", "ord", "tie", "start")
    schema = T.StructType([T.StructField("kind", T.IntegerType()), rows.schema["ord"], *[T.StructField(c, T.LongType()) for c in ("tie", "start", "end")], T.StructField("window", T.BinaryType())])
    return dealt.mapInArrow(sort_and_compare, schema)


def removed(rows: DataFrame) -> DataFrame:
    """Of rows (ord, tie, text): ord, tie and ranges (start, end of bytes that go) for each document that loses some."""
    runs = saved(repeated_runs(rows.select("text")))
    stats = runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    parts = max(partitions(rows.sparkSession), math.ceil(stats["n"] / SORTED), 1)
    found = saved(resolve(suffixes(rows, bitmap(runs, stats["runs"])), parts))
    edges = found.where("kind = 1").withColumn("place", F.struct(F.col("ord").isNull().alias("no_id"), "ord", "tie", "start"))
    least = edges.groupBy("window").agg(F.count(F.lit(1)).alias("many"), F.min("place").alias("least")).where("many > 1").drop("many")
    across = edges.join(least, "window").where("not (place <=> least)").select("ord", "tie", "start", (F.col("start") + LENGTH).alias("end"))
    return found.where("kind = 0").select("ord", "tie", "start", "end").unionByName(across).groupBy("ord", "tie").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in ranges or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def dedupe(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay) and, unless with_kept is false, kept (those bytes)."""
    import pyarrow as pa

    docs = slim(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").alias("ord"), F.xxhash64("text").alias("tie"), "text")
    ranges = removed(rows).withColumnsRenamed({"ord": "ord2", "tie": "tie2"})
    joined = rows.join(ranges, rows["ord"].eqNullSafe(ranges["ord2"]) & (rows["tie"] == ranges["tie2"]), "left").select("ord", "text", "ranges")
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.BinaryType())] * with_kept])

    def cut(batches):
        for batch in in_parts(batches):
            out = []
            for text, found in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                text, spans, at, kept = text or b"", merged(found), 0, []
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(spans), sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], names=schema.names)

    return joined.mapInArrow(cut, schema)
