"""Near-duplicate documents: an exact Jaccard join on word shingles by T-occurrence search.

A document's set is its distinct 5-word shingles (the whole sequence if it has fewer words, nothing if it
has none), held as 64-bit hashes; two documents link when 100 * intersection >= 80 * union.

1. One pass over the texts hashes each set as a whole. Documents with equal sets are one node from here
   on, so groups of copies of any size cost one row per task.
2. A second pass gives each node the part of its set that any partner must share with it (the first n/5 + 1
   shingles in one global order, common ones last) to inverted lists, dealt by shingle; the lists of common
   shingles are dealt in salted parts of about HOT entries. In each part the node that has the shingle earliest
   is the leader, and of the leaders of a list's parts the first; what leaves the lists are pairs (leader, member),
   never all pairs of a list.
3. Each node is searched for by its best leader, then links are merged into components. In lists whose members
   still lie apart, those outside the most frequent component are searched for by a member of it, for STAR_ROUNDS
   rounds, and only pairs of one list that then still lie in different components are searched for by each other.
4. A search is a T-occurrence search (DivideSkip) over the inverted lists of a block of candidates' whole sets:
   for the block's query the longest of its lists are set aside, the short ones are merged by a heap that skips, and the
   candidates that can still reach the overlap are probed in the long ones by bisection. Candidates of one query
   are dealt in blocks by size, so that a query with very many is spread over tasks.

The order of shingles, their salts and their leaders bear on cost only, not on results. Texts that are searched
are read again, found by a hash of the text in a bitmap of fixed size and a join behind it, and travel as texts,
which are smaller than their sets. Components come from rounds of joins with checkpoints; keys that stand in very
many rows are joined by a broadcast of at most MOST_HUBS of them.

Hashes: words are hashed by chains of bijections over eight bytes at a time, begun at a secret that is drawn for
each job (words of one length of up to eight bytes can't collide, and nobody can make longer ones that do),
shingles and sets from those. A false link or a lost one needs a collision of two 64-bit hashes: odds of
about one in 10**13 for two sets of a thousand shingles, and of one in 37 that any two of 10**9 different sets or
texts share a hash. Results don't depend on the secret.

Results for odd rows: a document without a word is linked with nothing; repeated rows and equal texts are one
component; a null doc_id never names a component unless it has only nulls; other columns and their names don't
matter; an empty table gives an empty result. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import eights, fresh, in_parts, mixed, saved, shuffles_cleared, slim

SHINGLE = 5
#: 9 * intersection >= 4 * (size + size) says the same as 100 * intersection >= 80 * union.
SHARE, OF = 4, 9
#: Shingles for which the order by frequency is kept; all others come before them.
MOST_COMMON = 1 << 20
#: Shingles that are counted together before counts leave a task, and the count from which they do.
COUNTED, LEAST_COUNT = 1_000_000, 2
#: Entries of one part of a list, about.
HOT = 20_000
#: Shingles of the candidates in one block of a query, about.
BLOCK = 500_000
#: Rounds of searches by one member of each list before members are searched for by each other.
STAR_ROUNDS = 2
#: Bits of the table that tells which texts are wanted at all; a join behind it is exact.
WANTED_BITS = 1 << 23
#: Rows of one key from which it is looked at whether it is a hub, and hubs at most.
HUB, MOST_HUBS = 100_000, 10_000

_RNG = np.random.default_rng(20_240_607)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIZE, _NEXT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
#: Words of more bytes are hashed by blake2b.
LONG_WORD = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def drawn_secret() -> int:
    """The secret of a job, drawn on the driver; every pass of the job hashes with it."""
    return int.from_bytes(os.urandom(8), "big")


def word_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, secret: int) -> np.ndarray:
    """A 64-bit hash of each of the words that stand in flat at these places."""
    size, eight = end - begin, eights(flat)
    with np.errstate(over="ignore"):
        out = mixed(size.astype(np.uint64) * _SIZE ^ np.uint64(secret))
        open_, depth = np.flatnonzero(size <= LONG_WORD), 0
        while len(open_):
            left = size[open_] - depth
            word = eight[begin[open_] + depth].astype(np.uint64)
            word &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
            out[open_] = mixed(out[open_] * _NEXT ^ word)
            open_, depth = open_[left > 8], depth + 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(blake2b(flat[begin[k] : end[k]].tobytes(), digest_size=8, key=secret.to_bytes(8, "big")).digest(), "big")
    return out


def sets(texts, secret: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow string column (null: none)."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(flat):
        return [np.zeros(0, np.uint64)] * len(texts)
    flat = _LOWER[flat]
    word = ~_SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[at] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word
    end[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    words = word_hashes(flat, s, e, secret)
    first, out = np.searchsorted(s, at), []
    with np.errstate(over="ignore"):
        many = max(0, len(words) - SHINGLE + 1)
        shingles = np.zeros(many, np.uint64)
        for k in range(SHINGLE):
            shingles += words[k : k + many] * _PLACE[k]
        shingles = mixed(shingles)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(shingles[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node_of(own: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = mixed(own ^ np.uint64(0xA0761D6478BD642F)).sum(keepdims=True) + mixed(own).sum() * np.uint64(0xE7037ED1A0B428DB) + np.uint64(len(own))
        return int(mixed(total).astype(np.int64)[0])


def first_pass(docs: DataFrame, secret: int) -> DataFrame:
    """doc_id, n, node, text_key for each document (kind 0), and counts of shingles that are common within a task (kind 1: node is the shingle, n the count)."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("kind", T.IntegerType()), docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n", "node", "text_key")]])

    def counted(some: list[np.ndarray], kind):
        values, n = np.unique(np.concatenate(some), return_counts=True)
        keep = n >= LEAST_COUNT
        values, n = values[keep].astype(np.int64), n[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.nulls(len(n), kind), pa.array(n.astype(np.int64)), pa.array(values), pa.nulls(len(n), pa.int64())], names=schema.names)

    def run(batches):
        some, size, seen, kind = [], 0, set(), None
        for batch in in_parts(batches):
            kind = batch.column(0).type
            own = sets(batch.column(1), secret)
            nodes = [node_of(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(own), pa.int32()), batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(nodes, pa.int64()), batch.column(2)], names=schema.names)
            for x, node in zip(own, nodes):
                if len(x) and node not in seen:
                    seen.add(node)
                    some.append(x)
                    size += len(x)
            if size >= COUNTED:
                yield counted(some, kind)
                some, size = [], 0
        if some:
            yield counted(some, kind)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, schema)


def common_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most common shingles (at most MOST_COMMON, from a count that all of them reach), sorted, each one's place in the order, and into how many parts its list is dealt."""
    import pyarrow as pa

    total = saved(counts.groupBy("node").agg(F.sum("n").alias("n")))
    # large counts are put in classes of a power of two, so this is about a hundred rows
    size = F.when(F.col("n") < 64, F.col("n")).otherwise(64 + F.floor(F.log2("n")))
    classes = total.groupBy(size.alias("class")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("class")).collect()
    least, many = None, 0
    for r in classes:
        many += r["many"]
        if many > MOST_COMMON:
            break
        least = r["class"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy().astype(np.int64).tobytes()], pa.binary()) for k in (0, 1)], names=["node", "n"])

    # at most MOST_COMMON numbers of each kind, 16 MB in all
    got = [(r["node"], r["n"]) for r in total.where(size >= least).select("node", "n").mapInArrow(pack, "node binary, n binary").collect()]
    values, n = (np.frombuffer(b"".join(x[k] for x in got), np.int64) for k in (0, 1))
    values = values.astype(np.uint64)
    rank = np.empty(len(n), np.int32)
    rank[np.lexsort((values, n))] = np.arange(len(n), dtype=np.int32)
    order = np.argsort(values)
    return values[order], rank[order], (-(-n // HOT)).astype(np.int32)[order]


def shared_part(own: np.ndarray, values: np.ndarray, rank: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n/5 + 1 shingles of a set in the global order (those that are not common by hash, then common ones, the most common last),
    and into how many parts their lists are dealt."""
    n = len(own)
    many = np.ones(n, np.int32)
    if len(values):
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        late = np.flatnonzero(values[at] == own)
        if len(late):
            late = late[np.argsort(rank[at[late]])]
            many[n - len(late) :] = salts[at[late]]
            own = np.concatenate([np.delete(own, late), own[late]])
    keep = n - (4 * n + 4) // 5 + 1
    return own[:keep], many[:keep]


def index(docs: DataFrame, common, secret: int) -> DataFrame:
    """Entries of the inverted lists: shingle, salt, salts (the part of the list and how many there are), node, n, pos (the shingle's place in the node's set, in the global order)."""
    import pyarrow as pa

    names = ["shingle", "salt", "salts", "node", "n", "pos"]

    def run(batches):
        values, rank, salts = common.value
        seen: set[int] = set()
        for batch in in_parts(batches):
            out: list[list[np.ndarray]] = [[] for _ in names]
            for own in sets(batch.column(0), secret):
                if not len(own) or (node := node_of(own)) in seen:
                    continue
                seen.add(node)
                part, many = shared_part(own, values, rank, salts)
                for x, y in zip(out, (part.astype(np.int64), (np.int64(node) % many).astype(np.int32), many, np.full(len(part), node, np.int64), np.full(len(part), len(own), np.int32), np.arange(len(part), dtype=np.int32))):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return docs.select("text").mapInArrow(run, "shingle long, salt int, salts int, node long, n int, pos int")


def members_of(shingle, salt, salts, node, n, pos) -> list[np.ndarray] | None:
    """Of whole parts of lists, the entries that may have a partner, each with the leader of its part: shingle, salt, salts, node, n, pos, close, fits, lead, lead_n, lead_pos.

    A list is looked through by size: an entry stays if the next larger set is not too large for it, or it is not
    too large for the next smaller one. close says the same of the bound that the places give (`may_link`), which holds
    for the first shingle that two sets share. Entries of lists that are dealt in several parts all stay; fits says whether
    one has a partner in its own part, and those that do come first as leaders.
    """
    order = np.lexsort((node, n, salt, shingle))
    columns = [x[order] for x in (shingle, salt, salts, node, n.astype(np.int64), pos.astype(np.int64))]
    again = np.zeros(len(order), bool)
    again[1:] = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1]) & (columns[3][1:] == columns[3][:-1])
    columns = [x[~again] for x in columns]
    shingle, salt, salts, node, n, pos = columns
    new = np.ones(len(node), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])
    part = np.cumsum(new) - 1
    with_next = ~np.append(new[1:], True)
    near = np.zeros(len(node), bool)
    near[:-1] = with_next[:-1] & (SHARE * n[1:] <= (OF - SHARE) * n[:-1])
    stays = near.copy()
    stays[1:] |= near[:-1]
    reach = OF * (n - pos) - SHARE * n
    close = np.zeros(len(node), bool)
    close[:-1] = with_next[:-1] & (SHARE * n[1:] <= reach[:-1])
    if len(node):
        step = int(n.max()) * OF * 2 + 1
        most = np.maximum.accumulate(reach + part * step) - part * step  # the largest reach so far in the part: reaches lie within (-step / 2, step / 2)
        close[1:] |= ~new[1:] & (most[:-1] >= SHARE * n[1:])
    several = salts > 1
    keep = np.flatnonzero(stays | several)
    if not len(keep):
        return None
    shingle, salt, salts, node, n, pos, close, fits, part = (x[keep] for x in (shingle, salt, salts, node, n, pos, close | several, stays & close, part))
    by_place = np.lexsort((node, pos / n, ~fits & (salts > 1), part))
    first = np.ones(len(keep), bool)
    first[1:] = part[by_place][1:] != part[by_place][:-1]
    lead = np.empty(len(keep), np.int64)
    lead[by_place] = by_place[np.flatnonzero(first)][np.cumsum(first) - 1]
    return [shingle, salt, salts, node, n.astype(np.int32), pos.astype(np.int32), close, fits, node[lead], n[lead].astype(np.int32), pos[lead].astype(np.int32)]


def listed(entries: DataFrame) -> DataFrame:
    """The members of the lists (see `members_of`): one shuffle by shingle and part, in which the lists are sorted."""
    import pyarrow as pa

    names = ["shingle", "salt", "salts", "node", "n", "pos", "close", "fits", "lead", "lead_n", "lead_pos"]

    def run(batches):
        def out(columns):
            if len(columns[0]) and (got := members_of(*columns)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=names)

        held = None
        for batch in batches:
            if batch.num_rows:
                own = [c.to_numpy() for c in batch.columns]
                held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                cut = len(last) - int(last.sum())  # the last list may go on
                yield from out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from out(held)

    dealt = entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt")
    return dealt.mapInArrow(run, "shingle long, salt int, salts int, node long, n int, pos int, close boolean, fits boolean, lead long, lead_n int, lead_pos int")


def led(members: DataFrame) -> DataFrame:
    """members, with the leaders of the parts of a list giving way to the first of them, so that a list has one leader."""
    leaders = members.where("salts > 1 AND node = lead").groupBy("shingle").agg(F.min_by(F.struct("lead", "lead_n", "lead_pos"), F.struct((~F.col("fits")).alias("alone"), F.col("lead_pos") / F.col("lead_n"), "lead")).alias("top"), F.max("salts").alias("salts"))
    leaders = leaders.select("shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "top.*")
    several = members.where("salts > 1").drop("lead", "lead_n", "lead_pos").join(leaders, ["shingle", "salt"])
    return members.where("salts = 1").unionByName(several)


def wanted_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """text_key, text of the documents whose hash of the text is one of keys (text_key), and of a few others; each at least once.

    Whether a hash is wanted is looked up in WANTED_BITS bits (a table of fixed size); a join must follow.
    """
    import pyarrow as pa

    bit = F.pmod("text_key", F.lit(WANTED_BITS))
    words = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits"))
    table = np.zeros(WANTED_BITS >> 6, np.int64)
    got = words.toPandas()  # at most WANTED_BITS / 64 rows, whatever the input
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    bits = docs.sparkSession.createDataFrame(pa.table({"wanted_bits": pa.array([table], pa.list_(pa.int64()))}))
    hashed = docs.select(F.xxhash64("text").alias("text_key"), "text").crossJoin(F.broadcast(bits))
    word = F.get("wanted_bits", F.shiftright(bit, 6).cast("int"))
    rows = hashed.where(F.call_function("shiftright", word, bit.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1)) == 1).select("text_key", "text")

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            new = [k for x, k in zip(keys.tolist(), first.tolist()) if x not in seen]
            seen.update(keys.tolist())
            if new:
                yield batch.take(pa.array(sorted(new)))

    return rows.mapInArrow(once, "text_key long, text string")


def part_bits(docs: DataFrame, wanted: DataFrame, common, secret: int) -> DataFrame:
    """Of wanted (node, text_key): node, bits0 to bits7: which of 512 values the hashes of the node's shared part take. A bit that only one of two nodes has is a shingle that they do not share."""
    import pyarrow as pa

    def run(batches):
        values, rank, salts = common.value
        for batch in in_parts(batches):
            found, bits = [], []
            for own in sets(batch.column(1), secret):
                found.append(node_of(own))
                some = np.zeros(512, bool)
                some[(mixed(shared_part(own, values, rank, salts)[0]) >> np.uint64(55)).astype(np.int64)] = True
                bits.append(np.packbits(some).view(np.int64))
            if found:
                table = np.stack(bits)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *[pa.array(table[:, k].copy()) for k in range(8)]], names=["node", *[f"bits{k}" for k in range(8)]])

    return wanted_texts(docs, wanted).mapInArrow(run, "node long, " + ", ".join(f"bits{k} long" for k in range(8))).dropDuplicates(["node"])


def may_share(n: str, n2: str, suffix: str) -> Column:
    """Whether the bits of two nodes leave room for as many shared shingles in their shared parts as the overlap needs there."""
    only = lambda a, b: sum((F.bit_count(F.col(f"bits{k}{a}").bitwiseAND(F.bitwise_not(F.col(f"bits{k}{b}")))) for k in range(1, 8)), F.bit_count(F.col(f"bits0{a}").bitwiseAND(F.bitwise_not(F.col(f"bits0{b}")))))
    rest = lambda c: F.floor((4 * F.col(c) + 4) / 5) - 1
    common = F.least(F.col(n) - rest(n) - only("", suffix), F.col(n2) - rest(n2) - only(suffix, ""))
    return OF * (common + F.greatest(rest(n), rest(n2))) >= SHARE * (F.col(n) + F.col(n2))


def may_link(n: str, pos: str, n2: str, pos2: str) -> Column:
    """Whether two sets that have their first common shingle at these places can have the overlap."""
    return OF * F.least(F.col(n) - F.col(pos), F.col(n2) - F.col(pos2)) >= SHARE * (F.col(n) + F.col(n2))


def divide_skip(lists: list[list[int]], need: list[int], least: int, mu: float = 0.01) -> list[int]:
    """Which ids occur in as many of the lists as each one needs (need[id], never below least); lists are sorted."""
    if len(lists) < least:
        return []
    lists = sorted(lists, key=len)
    many = max(0, min(least - 1, int(least / (mu * np.log2(max(2, len(lists[-1]))) + 1))))
    short, long = lists[: len(lists) - many], lists[len(lists) - many :][::-1]
    enough = least - many
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while heap:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap))
        count = len(taken)
        if count >= enough:
            left = len(long)
            for x in long:
                if count >= need[top] or count + left < need[top]:
                    break
                left -= 1
                k = bisect_left(x, top)
                count += k < len(x) and x[k] == top
            if count >= need[top]:
                found.append(top)
            to = top + 1
        else:  # no id before the one that then is on top can occur often enough
            while heap and len(taken) < enough - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            to = max(top + 1, heap[0][0])
        for _, i, k in taken:
            k = bisect_left(short[i], to, k)
            if k < len(short[i]):
                heapq.heappush(heap, (short[i][k], i, k))
    return found


class Lists:
    """Inverted lists over the whole sets of a block of candidates."""

    def __init__(self, candidates: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in candidates])
        flat = np.concatenate(candidates)
        order = np.argsort(flat, kind="stable")
        self.values, self.ids = flat[order], np.repeat(np.arange(len(candidates)), self.sizes)[order]

    def search(self, own: np.ndarray, mu: float = 0.01) -> list[int]:
        """The candidates that have the overlap with this set, by T-occurrence search."""
        a, b = np.searchsorted(self.values, own), np.searchsorted(self.values, own, side="right")
        lists = [self.ids[x:y].tolist() for x, y in zip(a.tolist(), b.tolist()) if y > x]
        # a set of under 4/5 of the size has not enough shingles, so at least 4/5 must be shared
        return divide_skip(lists, (-(-SHARE * (len(own) + self.sizes) // OF)).tolist(), -(-SHARE * len(own) // (OF - SHARE)), mu)


def search(docs: DataFrame, pairs: DataFrame, keys: DataFrame, secret: int) -> DataFrame:
    """Of pairs (query, node, n of the node), those that link: a, b. keys: node, text_key.

    The candidates of a query are dealt in blocks of about BLOCK shingles; query and candidates meet as texts.
    """
    import pyarrow as pa

    blocks = pairs.groupBy("query").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    asked = blocks.select(F.col("query").alias("node"), "query", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(1000))).alias("block"), "blocks", F.lit(0).alias("role"))
    asked = asked.select("node", "query", "block", F.least(F.col("block") + 1000, "blocks").alias("upto"), "role")
    offered = pairs.join(blocks, "query").select("node", "query", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(0).alias("upto"), F.lit(1).alias("role"))
    send = saved(asked.unionByName(offered).join(keys, "node"))
    texts = wanted_texts(docs, send).groupBy("text_key").agg(F.first("text").alias("text"))
    rows = texts.join(send, "text_key").select("query", "block", "upto", "role", "node", "text")
    if send.where("upto - block > 1").take(1):  # a query of very many blocks goes out a thousand blocks at a time
        far = rows.where("upto - block > 1").repartition("query", "block").select("query", F.explode(F.sequence("block", F.col("upto") - 1)).alias("block"), "upto", "role", "node", "text")
        rows = rows.where("upto - block <= 1").unionByName(far)
    rows = rows.select("query", "block", "role", "node", "text")
    rows = rows.repartition("query", "block").sortWithinPartitions("query", "block", "role", "node")

    def run(batches):
        key, own, nodes, candidates = None, None, [], []

        def found():
            if own is not None and candidates and (out := [nodes[k] for k in Lists(candidates).search(own)]):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.int64()), pa.array(out, pa.int64())], names=["a", "b"])

        for batch in in_parts(batches):
            for q, block, role, node, x in zip(*[batch.column(k).to_pylist() for k in range(4)], sets(batch.column(4), secret)):
                if (q, block) != key:
                    yield from found()
                    key, own, nodes, candidates = (q, block), None, [], []
                if node_of(x) != node:  # another text with the same hash
                    continue
                if role == 0:
                    own = x
                else:
                    nodes.append(node)
                    candidates.append(x)
        yield from found()

    return rows.mapInArrow(run, "a long, b long")


def with_hubs(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table that has each key once. Keys that stand in very many rows are joined by a broadcast of their rows of the
    table: there are at most MOST_HUBS of them, as each has over a MOST_HUBS-th of all rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("hub_rows"))
    seen = counts.agg(F.max("hub_rows").alias("most"), F.sum("hub_rows").alias("rows")).first()
    if (seen["most"] or 0) < HUB:
        return rows.join(table, key, how)
    hubs = saved(counts.where(F.col("hub_rows") >= max(HUB, seen["rows"] // MOST_HUBS + 1)).select(key))
    rest = rows.join(F.broadcast(hubs), key, "left_anti").join(table, key, how)
    return rest.unionByName(rows.join(F.broadcast(hubs), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hubs), key, "left_semi")), key, how))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node that has a link: rounds of large star and small star until nothing changes.

    A round makes one edge of each. With HUB rows or more, what is least at a node is found before rows of one node meet
    (see `with_hubs`); with fewer, a window over them takes one shuffle a step.
    """
    edges = saved(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("changed")).distinct())
    many = 2 * edges.count() >= HUB

    def with_least(rows: DataFrame) -> DataFrame:
        """a, b, changed (whether it is for any row of a and b), least and most (of all b of an a)."""
        if many:
            rows = rows.groupBy("a", "b").agg(F.max("changed").alias("changed"))
            return with_hubs(rows, rows.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")), "a")
        at = Window.partitionBy("a")
        return rows.withColumns({"least": F.min("b").over(at), "most": F.max("b").over(at)})

    while True:
        rows = edges.select("a", "b", F.lit(False).alias("changed"))
        both = with_least(rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "changed")))
        low = F.least("a", "least")
        large = both.where("b > a").select(F.col("b").alias("a"), low.alias("b"), (low != F.col("a")).alias("changed"))
        small = with_least(large).withColumn("changed", F.col("changed") | (F.col("least") != F.col("most")))
        end = F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b"))
        edges = saved(small.select(end.alias("a"), F.col("least").alias("b"), "changed"))
        if not edges.where("changed").take(1):
            return edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()


def mixed_lists(entries: DataFrame, of: DataFrame) -> DataFrame:
    """Of entries, those of lists whose members lie in several components, with component and main (the list's most frequent one)."""
    rows = saved(entries.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")))
    lists = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("many"), F.max("salts").alias("salts"))
    lists = lists.groupBy("shingle").agg(F.max_by("component", F.struct("many", "component")).alias("main"), F.count(F.lit(1)).alias("components"), F.max("salts").alias("salts")).where("components > 1")
    return saved(rows.drop("salts").join(lists.select("shingle", "main", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), ["shingle", "salt"]))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node, text_key) of all documents, and (node, component) of the nodes that link with another."""
    docs = slim(docs, "doc_id", "text")
    secret = drawn_secret()
    first = saved(first_pass(docs, secret))
    documents = first.where("kind = 0").drop("kind")
    keys = documents.where("n > 0").groupBy("node").agg(F.min("text_key").alias("text_key"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(first.where("kind = 1")))
    members = saved(led(saved(listed(index(docs, common, secret)))))
    # what the rest of two sets can have in common behind the shared part of the index bounds the overlap
    larger = F.greatest("n", "lead_n")
    stars = members.where("node != lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("many"), F.max(may_link("n", "pos", "lead_n", "lead_pos")).alias("may"), F.first("n").alias("n"), F.first("lead_n").alias("lead_n"))
    reach = F.col("many") + larger - (larger - F.floor((4 * larger + 4) / 5) + 1)
    stars = stars.where(F.col("may") & (OF * reach >= SHARE * (F.col("n") + F.col("lead_n"))))
    best = saved(stars.groupBy("node").agg(F.max_by("lead", F.struct("many", "lead")).alias("query"), F.first("n").alias("n")))
    links = saved(search(docs, best, keys, secret))
    of = saved(components(links))
    # lists whose members still lie apart: first those that are not in the list's most frequent component are searched for by
    # its foremost member, as long as that merges much, and then by each other
    # (an entry that is not close has no partner for which this list holds the first shingle in common)
    entries = members.where("close").select("shingle", "salt", "salts", "node", "n", "pos")
    tried = best.select(F.least("query", "node").alias("query"), F.greatest("query", "node").alias("node"))
    rows = mixed_lists(entries, of)
    for _ in range(STAR_ROUNDS):
        front = rows.where("component = main").groupBy("shingle").agg(F.min_by(F.struct(F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos")), F.struct(F.col("pos") / F.col("n"), "node")).alias("front"), F.max("salts").alias("salts"))
        front = front.select("shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "front.*")
        stars = rows.where("component != main").drop("salts").join(front, ["shingle", "salt"]).where(may_link("n", "pos", "lead_n", "lead_pos"))
        stars = stars.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("many"), F.first("n").alias("n")).withColumns({"a": F.least("node", "lead"), "b": F.greatest("node", "lead")})
        stars = stars.join(tried.withColumnsRenamed({"query": "a", "node": "b"}), ["a", "b"], "left_anti")
        best = saved(stars.groupBy("node").agg(F.max_by("lead", F.struct("many", "lead")).alias("query"), F.first("n").alias("n")))
        tried = tried.unionByName(best.select(F.least("query", "node").alias("query"), F.greatest("query", "node").alias("node")))
        found = saved(search(docs, best, keys, secret))
        if not found.take(1):
            break
        links = links.unionByName(found)
        of = saved(components(links))
        rows = mixed_lists(entries, of)
    bits = part_bits(docs, rows.select("node").distinct().join(keys, "node"), common, secret)
    rows = saved(rows.join(bits, "node"))
    twos = ("n", "pos", "component", *[f"bits{k}" for k in range(8)])
    apart = rows.where("component != main").select("shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("query"), *[F.col(c).alias(f"{c}2") for c in twos])
    rest = apart.join(rows.drop("main", "salts"), ["shingle", "salt"]).where((F.col("component") != F.col("component2")) & may_link("n", "pos", "n2", "pos2") & may_share("n", "n2", "2"))
    turn = F.col("query") < F.col("node")
    pick = lambda a, b: F.when(turn, F.col(a)).otherwise(F.col(b))
    rest = rest.select(pick("query", "node").alias("query"), pick("node", "query").alias("node"), pick("n2", "n").alias("query_n"), pick("n", "n2").alias("n")).distinct()
    rest = saved(rest.join(tried, ["query", "node"], "left_anti"))
    # of two nodes, the one with more pairs is the query, so that few texts are sent often
    ends = rest.select(F.explode(F.array("query", "node")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("pairs"))
    for end in ("query", "node"):
        rest = rest.join(ends.withColumnsRenamed({"end": end, "pairs": f"{end}_pairs"}), end)
    turn = F.col("query_pairs") >= F.col("node_pairs")
    rest = rest.select(F.when(turn, F.col("query")).otherwise(F.col("node")).alias("query"), F.when(turn, F.col("node")).otherwise(F.col("query")).alias("node"), F.when(turn, F.col("n")).otherwise(F.col("query_n")).alias("n"))
    more = search(docs, rest, keys, secret)
    return documents, components(links.unionByName(more))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node, text_key) of all documents, and (node, component) of all nodes with a shingle."""
    with shuffles_cleared(docs.sparkSession):
        rows, of = classes(docs)
        nodes = rows.where("n > 0").select("node").distinct().join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return rows, saved(nodes)


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    rows, nodes = grouped(docs)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = with_hubs(nodes, nodes.join(least, "node").groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    out = with_hubs(rows.where("n > 0"), saved(named), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def dedupe(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; documents without a word all stay.

    Rows and the small table of those that stay meet by a hash of the text and the id.
    """
    rows, nodes = grouped(docs)
    copies = rows.where("n > 0").groupBy("node", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    first = copies.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "text_key", "copies")).alias("x"))
    keep = saved(nodes.join(first, "node").groupBy("component").agg(F.min("x").alias("x")).select("x.*"))
    key, one, id_, copies = fresh(docs, "dedupe_key", "dedupe_text_key", "dedupe_id", "dedupe_copies")
    keep = keep.select(F.col("text_key").alias(one), F.col("doc_id").alias(id_), F.col("copies").alias(copies))
    worded = F.coalesce(F.col("`text`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    full = docs.where(worded).withColumn(key, F.xxhash64(F.col("`text`")))
    full = full.join(keep, (F.col(key) == F.col(one)) & F.col("`doc_id`").eqNullSafe(F.col(id_)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = full.where(F.col(copies) == 1).select(*own)
    if keep.where(F.col(copies) > 1).take(1):  # rows that repeat id and text: one of them stays
        out = out.unionByName(full.where(F.col(copies) > 1).dropDuplicates([key, id_]).select(*own))
    return out.unionByName(docs.where(~worded))
