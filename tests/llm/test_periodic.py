"""Periodic runs against a plain version: every start and period, and every word, looked at."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from larkspur.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least_words=6, least_times=4):
    n, found = len(words), {}
    for q in range(1, n // least_times + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(least_words, least_times * q):
                found.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(i, words):
    n = len(words)
    if i is None or not n:
        return words
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def plain_row(i, text):
    words = planted(i, WORD.findall(text or ""))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + length for s, length, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(kept)))


def drawn(rnd):
    """Words of a small alphabet, with repetitions written into one another."""
    out = []
    while len(out) < rnd.choice([0, 3, 12, 60, 200]):
        piece = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))] * rnd.randint(1, 9)
        out += piece[: rnd.randint(1, len(piece))] if rnd.random() < 0.6 else (out[-rnd.randint(1, 30) :] or ["a"]) * rnd.randint(1, 6)
    return out[:400]


def test_runs_of_a_batch_are_those_of_all_starts_and_periods():
    rnd = random.Random(21)
    for round_ in range(60):
        texts = [drawn(rnd) for _ in range(rnd.randint(1, 12))] + [["a"] * 300, [], ["a", "b"] * 90 + ["c"], list("aab" * 40 + "b"), [str(k) for k in range(50)]]
        rnd.shuffle(texts)
        least, times = rnd.choice([(6, 4), (2, 2), (5, 3)])
        words, begin, found = periodic.numbered([" ".join(t) for t in texts])
        assert [[w.decode() for w in x] for x in found] == texts
        got = periodic.runs_in(words, begin, least, times)
        for k, t in enumerate(texts):
            assert list(map(tuple, got[got[:, 0] == k][:, 1:].tolist())) == plain_runs(t, least, times)


def test_suffix_arrays_are_sorted_and_common_lengths_right():
    rnd = random.Random(22)
    texts = [drawn(rnd) for _ in range(9)]
    words, begin, _ = periodic.numbered([" ".join(t) for t in texts])
    levels = periodic.ranks(words, begin)
    order = np.argsort(levels[-1])
    of = np.searchsorted(begin, np.arange(len(words)), side="right") - 1
    suffix = lambda i: (of[i], *words[i : begin[of[i] + 1]].tolist())
    assert all(suffix(a) < suffix(b) for a, b in zip(order, order[1:]))
    for _ in range(300):
        a, b = sorted(rnd.sample(range(len(words)), 2))
        same = of[a] == of[b]
        x = 0
        while same and words[a + x] == words[b + x] >= 0:
            x += 1
        y = 0
        while same and a - y - 1 >= begin[of[a]] and words[a - y - 1] == words[b - y - 1] >= 0:
            y += 1
        assert periodic.common_prefixes(levels, np.array([a]), np.array([b]))[0] == x
        assert periodic.common_suffixes(levels, np.array([a]), np.array([b]))[0] == y
    values = np.array([rnd.randint(0, 5) for _ in range(500)])
    got = periodic.smaller_before(values)
    assert all(got[j] == next((i for i in range(j - 1, -1, -1) if values[i] < values[j]), -1) for j in range(500) if values[j])


def test_documents_with_planted_runs(spark):
    rnd = random.Random(23)
    rows = [(i, " ".join(drawn(rnd)) if i % 3 else " ".join(rnd.choice(["x", "été", "😀", "z"]) + rnd.choice(["", "\t", "\n"]) for _ in range(rnd.randint(0, 90)))) for i in range(150)]
    rows += [(None, "a " * 30), (None, None), (151, ""), (152, " \n"), (153, None), (10, rows[10][1]), (10, rows[10][1]), (154, "no break " * 8), (155, "ha " * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, `h` int").repartition(5)
    got = periodic.digests(periodic.find(periodic.with_planted_runs(df)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(h % 10 == 0 for h in (zlib.crc32(str(i).encode()) for i in range(150))) > 5
    want = sorted(((i, *plain_row(i, t if i != 155 else "ha " * 60)) for i, t in rows if i != 155), key=str)
    assert sorted((tuple(r) for r in got.where("doc_id IS NULL OR doc_id <> 155").collect()), key=str) == want
    assert tuple(got.where("doc_id = 155").first())[1:6] == (1, 0, 5000, 1, 5_000_000)


def test_runs_and_collapsed_texts_are_returned(spark):
    df = spark.createDataFrame([("k", "go a b a b a b a b a stop"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in periodic.find(df).collect()}
    assert [tuple(x) for x in got["k"]["runs"]] == [(1, 9, 2)] and got["k"]["collapsed"] == "go a b stop" and got["k"]["n_words"] == 11
    assert got[None]["runs"] == [] and got[None]["collapsed"] == "" and got[None]["n_words"] == 0
    assert [tuple(x) for x in periodic.find(df, 5, 5).where("n_words > 0").first()["runs"]] == []


def test_ties_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a a a a a a b c d c d c d c d c d c d b b b b b b")], "doc_id long, text string")
    assert tuple(periodic.digests(periodic.find(df)).first())[1:6] == (3, 0, 6, 1, 6000)
    assert periodic.digests(periodic.find(periodic.with_planted_runs(df.limit(0)))).count() == 0


@pytest.mark.parametrize("times", [1, 40])
def test_long_texts_are_read_whole(spark, times):
    rnd = random.Random(24)
    words = [rnd.choice("abcdefgh") for _ in range(500 * times)] + ["x", "y", "z"] * 50
    got = periodic.find(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in got["runs"]] == [r for r in plain_runs(words, 6, 4)] if times == 1 else (500 * times, 150, 3) in [tuple(x) for x in got["runs"]]
