"""Near duplicates by sketches against all pairs of full sets."""

import math
import os
import random
import re

import numpy as np
import pytest

from larkspur.llm import queries, sketch_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows, percent=85):
    own = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(own)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                top[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(own):
        ids = [own[j][0] for j in range(len(own)) if root(j) == root(k) and own[j][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(s), least, i == least))
    return sorted(out, key=str)


def words(rnd, n, many=5000):
    return [f"w{rnd.randint(0, many)}" for _ in range(n)]


def edited(rnd, w, times):
    w = list(w)
    for _ in range(times):
        k = rnd.randrange(len(w))
        w[k : k + rnd.randint(0, 1)] = [f"e{rnd.randint(0, 9999)}"]
    return w


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(31)
    texts = [None, "", " \n", "one", "One", "one two three", "ONE two three four", "one two three four five"]
    passage = words(rnd, 60)
    for size, times in ((30, (0, 1, 1)), (200, (0, 1, 3, 4, 5, 6)), (300, (0, 4, 6, 8, 9, 10)), (1200, (5, 20, 30, 35, 40, 45)), (5000, (100, 150, 160, 170, 190))):
        base = words(rnd, size)
        texts += [" ".join(base), " ".join(base).upper(), *[" ".join(edited(rnd, base, k)) for k in times]]
        texts += [" ".join(words(rnd, 100) + passage) for _ in range(4)]
    chain = words(rnd, 400)
    for k in range(0, 300, 12):  # each is near the next only
        texts.append(" ".join(chain[k:] + words(rnd, k)))
        chain = texts[-1].split(" ")[:400]
    base = words(rnd, 260)
    texts += [" ".join(edited(rnd, base, 1 + k % 6)) for k in range(60)]  # a family around one text
    texts += [f"ha{'' if k % 2 else ' '}ha " * 200 for k in range(4)]
    out = list(enumerate(texts))
    rnd.shuffle(out)
    return out


def got(df, percent=85):
    return sorted((tuple(r) for r in sketch_dedup.near_duplicates(df, percent).collect()), key=str)


def test_components_are_those_of_all_pairs(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", True) for i, t in rows], "doc_id long, text string, n int, node string, kept boolean").repartition(5)
    assert got(df) == plain(rows)


def test_other_shares_small_blocks_and_no_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(sketch_dedup, "BLOCK", 3)
    monkeypatch.setattr(sketch_dedup, "ROUNDS", 0)
    some = rows[::2]
    assert got(spark.createDataFrame(some, "doc_id long, text string"), 60) == plain(some, 60)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
@pytest.mark.parametrize("name", ["op5_jaccard_join", "op12_sketch_dedup"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = c.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_null_repeated_and_text_ids(spark, rows):
    t = [x for _, x in rows if x and len(x) > 100][:3]
    odd = [("b", t[0]), ("a", t[0]), ("a", t[0]), (None, t[0]), (None, t[1]), (None, t[1]), ("c", None), (None, ""), ("d", t[2])]
    assert got(spark.createDataFrame(odd, "doc_id string, text string")) == plain(odd)
    assert sketch_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_bounds():
    assert sketch_dedup.least_shared(0.85, 256) == next(c for c in range(257) if sum(math.comb(256, k) * 0.85**k * 0.15 ** (256 - k) for k in range(c + 1)) > 1e-12)
    rnd = np.random.default_rng(1)
    for _ in range(300):
        base = rnd.integers(0, 1 << 62, 700, dtype=np.uint64)
        n = int(rnd.integers(20, 600))
        cut = int(n * rnd.uniform(0, 0.15))
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[: n - cut], base[n : n + int(rnd.integers(0, 3))]]))
        both = len(np.intersect1d(a, b))
        assert sketch_dedup.shared_in_union(a, b, 2000) == both
        x, y = a[:256], b[:256]
        union = np.union1d(a, b)[:256]
        assert sketch_dedup.shared_in_union(x, y, 256) == (np.isin(union, x) & np.isin(union, y)).sum()
        if 100 * both >= 85 * (len(a) + len(b) - both):
            least = max(sketch_dedup.least_of(len(s), 85, sketch_dedup.least_shared(0.85, 256)) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= least
            order = lambda s: set(s[: len(s) - least + 1].tolist())  # noqa: E731  both in one order
            assert order(x) & order(y)
